"""Training-corpus pipeline over documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; ``run`` writes it as Parquet and rereads it as the next
stage's docs. All stages but the last return the columns of documents.

1. language ID: documents that the operator rejects go: no letter, or no
   likeness to any language. The others get the predicted language.
2. n-gram Jaccard join: of each group of near duplicates the smallest id stays.
3. suffix-array dedup: passages that also start earlier are cut out of the texts.
4. decontamination: documents that hold a benchmark item go.
5. SentencePiece: token ids, decoded again; the decoded text is what stays of
   the text, and n_tokens and ids are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm import decontamination, jaccard, language, sentencepieces, suffixes
from speechframes.llm.common import fold, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taught = docs.where(fold(F.col("doc_id"), 4).isin(0, 1, 3))
    judged = language.identify(docs, language.train(taught), prefix="__sf_")
    kept = judged.where((F.col("__sf_lang_pred") != language.UNDETERMINED) & (F.col("__sf_score") > 0))
    return kept.withColumn("lang", F.col("__sf_lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.deduplicate(docs, prefix="__sf_")
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, sentencepieces.default_model(), decoded_col="text")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece", tokenize),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
