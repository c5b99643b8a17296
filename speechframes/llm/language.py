"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies)
its letters' vectors, each permuted (rolled) by its place; a document's vector
bundles (adds) those of its n-grams, and a language's prototype bundles all its
training documents. A document gets the language of the prototype with the
highest cosine; the score is that cosine, 0 at least.

Training adds up bundles inside tasks, then by language and dimension over all
tasks; the driver sees the prototypes only (languages x ``DIMENSIONS`` numbers; more
than ``MOST_LANGUAGES`` are refused). Tasks hold blocks of n-gram vectors of
bounded size, however many different n-grams a text has.
All labelled rows of the training folds are used.

Defined cases: documents without text or without a letter are ``und`` with
score 0 and teach nothing; rows without language or id teach nothing; ties go to
the language first in the alphabet; runs of other characters than letters count
as one gap; texts are read whole in pieces of bounded size; without any training
row every document is ``und``; an empty table gives an empty result; extra
columns are kept by ``identify`` and never read, and columns named like its
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import fold, pieces, table

DIMENSIONS = 1024
GRAM = 3
SEED = 20_011
CHUNK_CHARS = 400_000
CHUNK_ROWS = 4_000
BLOCK_CELLS = 1 << 23  # of a block of n-gram vectors, and of its counts by document
SPARSE = 32
MOST_LANGUAGES = 2_000
DENSE_CODES = 1 << 22
UNDETERMINED = "und"


class Profiler:
    """Bundles texts; numbers letters as they appear."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.number = np.full(0x110000, -1, np.int32)  # by code point; 0: no letter
        self.letters = [np.ones(dimensions, np.int8)]  # the gap's vector comes from code point 32
        self.letters[0] = self._random(32)

    def _random(self, point: int) -> np.ndarray:
        return np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, np.int8) * 2 - 1

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every n-gram its document and its code, and of every document the number of letters."""
        # a gap before and after every text
        lower = [f" {t.lower()} " for t in texts]
        text = "".join(lower)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[points]
        if len(new := np.unique(points[number < 0])):
            for p in new.tolist():
                if chr(p).isalpha():
                    self.number[p] = len(self.letters)
                    self.letters.append(self._random(p))
                else:
                    self.number[p] = 0
            number = self.number[points]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lower])
        letters = np.bincount(doc[number > 0], minlength=len(texts))
        keep = number > 0
        keep[1:] |= (number[:-1] > 0) | (doc[1:] != doc[:-1])  # of a run of gaps the first stays
        keep[:1] = True
        number, doc = number[keep].astype(np.int64), doc[keep]
        n = len(self.letters)
        code = np.zeros(max(0, len(number) - self.gram + 1), np.int64)
        for i in range(self.gram):
            code = code * n + number[i : len(number) - self.gram + 1 + i]
        same = doc[: len(code)] == doc[self.gram - 1 :][: len(code)]
        return doc[: len(code)][same], code[same], letters

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        n, base = len(self.letters), np.array(self.letters)
        out = np.ones((len(codes), self.dimensions), np.int8)
        for i in range(self.gram):
            out *= np.roll(base, i, axis=1)[codes // n**i % n]
        return out.astype(np.float32)

    def bundle(self, texts: list[str], group: np.ndarray | None = None, groups: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts, or of groups of them, and the texts' numbers of letters."""
        doc, code, letters = self.grams(texts)
        row, rows = (doc, len(texts)) if group is None else (group[doc], groups)
        n = len(self.letters) ** self.gram
        if n <= DENSE_CODES:
            often = np.bincount(code, minlength=n)
            present = np.flatnonzero(often)
            often, local = often[present], np.zeros(n, np.int64)
        else:
            present, code, often = np.unique(code, return_inverse=True, return_counts=True)
            local = np.zeros(len(present), np.int64)
        order = np.argsort(-often, kind="stable")  # frequent n-grams first: their blocks are dense
        if n <= DENSE_CODES:
            local[present[order]] = np.arange(len(order))
        else:
            local[order] = np.arange(len(order))
        code, present = local[code], present[order]
        ranked = np.argsort(code, kind="stable")
        code, row = code[ranked], row[ranked].astype(np.int64)
        out = np.zeros((rows, self.dimensions), np.float32)
        width = max(1, BLOCK_CELLS // max(rows, self.dimensions))
        for start in range(0, len(present), width):
            stop = min(start + width, len(present))
            a, b = np.searchsorted(code, (start, stop))
            vectors = self.vectors(present[start:stop])
            if (stop - start) * rows <= SPARSE * (b - a):
                counts = np.bincount(row[a:b] * (stop - start) + code[a:b] - start, minlength=rows * (stop - start))
                out += counts.reshape(rows, stop - start).astype(np.float32) @ vectors
            else:  # a product with almost only zeros: add the vectors row by row
                by_row = np.argsort(row[a:b], kind="stable") + a
                for i in range(0, b - a, width):
                    part = by_row[i : i + width]
                    begins = np.flatnonzero(np.diff(row[part], prepend=-1))
                    out[row[part[begins]]] += np.add.reduceat(vectors[code[part] - start], begins)
        return out, letters


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS or i + 1 - start >= CHUNK_ROWS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, of all rows with text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, total = Profiler(), {}
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in _chunks(texts):
                names = sorted(set(langs[a:b]))
                index = {x: i for i, x in enumerate(names)}
                made, _ = profiler.bundle(texts[a:b], np.array([index[x] for x in langs[a:b]]), len(names))
                for x, row in zip(names, made, strict=True):
                    total[x] = total.get(x, 0) + row.astype(np.int64)
        for x, row in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(row), pa.string()), pa.array(range(len(row)), pa.int32()), pa.array(row, pa.int64())], ["lang", "dim", "value"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    for r in rows:
        vector = np.array([x["value"] for x in r["v"]], np.float64)
        if norm := np.linalg.norm(vector):
            found[r["lang"]] = (vector / norm).astype(np.float32)
    return dict(sorted(found.items()))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score added; ``prefix`` goes before both names."""
    names, matrix = list(prototypes), np.array(list(prototypes.values()), np.float32).reshape(len(prototypes), DIMENSIONS)
    made_names = [f"{prefix}lang_pred", f"{prefix}score"]
    kept_names = [c for c in docs.columns if c not in made_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler()
        for batch in (part for whole in batches for part in pieces(whole, text_col)):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            langs, scores = [], []
            for a, b in _chunks(texts):
                made, letters = profiler.bundle(texts[a:b])
                cosine = made @ matrix.T / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9) if names else np.zeros((b - a, 1))
                best = cosine.argmax(1)
                known = (letters > 0) & bool(names)
                langs += [names[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
                scores += np.where(known, np.clip(cosine.max(1), 0, 1), 0).tolist()
            kept = batch.select(kept_names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept_names, *made_names])

    schema = docs.select(*kept_names).withColumns(dict(zip(made_names, (F.lit(""), F.lit(0.0)), strict=True))).schema
    return docs.select(*kept_names).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = train(docs.where((fold(F.col("doc_id"), 4) != 2) & (fold(F.col("doc_id"), 4) >= 0)))
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return identify(docs.select("doc_id", "text"), prototypes).select("doc_id", held, "lang_pred", "score")
