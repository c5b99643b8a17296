import corpus_pipeline as C
from pyspark.sql import functions as F
from test_decontamination import ITEM
from test_duplicates import brute_join, removed_bytes

from speechframes.llm import decontamination as D
from speechframes.llm.common import written
from speechframes.llm.sentencepieces import default_model


def test_stages_match_brute_force(spark, corpus, tmp_path):
    import sentencepiece

    docs = [*corpus, (500, f"begin {ITEM} end"), (501, "123 456"), (502, None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in C.run(spark, folder).collect()}
    want = {i: t for i, t in docs if t and any(c.isalpha() for c in t)}
    want = {i: t for i, t in want.items() if brute_join(list(want.items()))[i][0] == i}
    cut = removed_bytes(sorted(want.items()))
    joined = {}
    for i, (data, flags) in cut.items():
        parts, run = [], bytearray()
        for c, f in zip(data, flags, strict=True):
            if f:
                parts.append(run)
                run = bytearray()
            else:
                run.append(c)
        joined[i] = "".join(p.decode("utf-8", "ignore") for p in [*parts, run])
    want = {i: t for i, t in joined.items() if D.normal(ITEM) not in D.normal(t)}
    assert 500 not in want and got.keys() == want.keys()
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for i, t in want.items():
        assert got[i]["text"] == t and got[i]["ids"] == sp.encode(t) and got[i]["n_chars"] == len(t)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs.withColumn("score", F.lit("extra")).withColumn("ids", F.lit(1)), no_docs):
        for k, (_, stage) in enumerate(C.STAGES):
            made = written(stage(spark, docs, str(tmp_path)), "test-stage")
            assert k == len(C.STAGES) - 1 or made.columns == docs.columns
            docs = made
