"""Document fingerprints by Order MinHash.

The k-mers (k code points) of a text are numbered by occurrence, so repeated
k-mers differ. Each of ``SKETCHES`` hash functions selects the ``MINIMA`` k-mers
of least hash, keeps them in text order, and hashes that tuple. Two fingerprints
are alike in the share of equal tuples: it falls with the edit distance, since
edits change k-mers, their numbers and their order.

``with_next`` pairs every document with the next one in descending id. Ids are
dealt to ranges with bounds from quantiles; each range also gets the first
document of the range below, so the pairs form while the sorted range streams
through its task, and no task holds more than two documents besides its batch.
The driver sees one id for each range.

Defined cases: null texts are empty; an empty text has no k-mer and the
fingerprint of zeros, alike 1 to another empty text and 0 to any other; a text
shorter than k is one k-mer; if there are fewer k-mers than minima, the tuple is
filled up with zeros; ids are integers, null ids come last in an order by the
hash of their text (over several ranges); equal ids are ordered by the hash of
their text, in one range; a single document is its own next; an empty table gives an empty
result; columns beside id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import pieces, table

K = 8
SKETCHES = 64
MINIMA = 2
SEED = 7_919
COLUMNS = 8_192
LOWEST = -(1 << 63)

_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 31, SKETCHES, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _RANDOM.integers(0, 1 << 32, SKETCHES, np.int64).astype(np.uint32)
_LETTERS = _RANDOM.integers(1, 1 << 62, K, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed values: the constants of the public-domain SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(text: str) -> np.ndarray:
    """A 32-bit hash of every (k-mer, occurrence), in text order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(points) == 0:
        return np.zeros(0, np.uint32)
    width = min(K, len(points))
    kmer = np.zeros(len(points) - width + 1, np.uint64)
    for i in range(width):
        kmer += points[i : i + len(kmer)] * _LETTERS[i]
    kmer = _mixed(kmer)
    order = np.argsort(kmer, kind="stable")
    ranked = kmer[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    place = np.arange(len(kmer))
    number = np.empty(len(kmer), np.uint64)
    number[order] = (place - np.maximum.accumulate(np.where(begins, place, 0))).astype(np.uint64)
    return (_mixed(kmer + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> np.ndarray:
    """The fingerprint as 16-bit numbers, one for each hash function."""
    kmers = numbered_kmers(text)
    if not len(kmers):
        return np.zeros(SKETCHES, np.uint16)
    rows = np.arange(SKETCHES)
    found_at, found = [], []
    for start in range(0, len(kmers), COLUMNS):
        hashes = (kmers[None, start : start + COLUMNS] ^ _FLIPS[:, None]) * _TIMES[:, None]
        for _ in range(min(MINIMA, hashes.shape[1])):
            at = hashes.argmin(1)
            found_at.append(at + start)
            found.append(hashes[rows, at].astype(np.uint64))
            hashes[rows, at] = np.uint32(0xFFFFFFFF)
    at, least = np.array(found_at), np.array(found)
    if len(at) > MINIMA:
        best = np.argsort(least, axis=0, kind="stable")[:MINIMA]
        at = np.take_along_axis(at, best, 0)
    at = np.sort(at, axis=0)
    out = np.zeros(SKETCHES, np.uint64)
    for i in range(MINIMA):
        value = kmers[at[i]].astype(np.uint64) + np.uint64(1) if i < len(at) else np.zeros(SKETCHES, np.uint64)
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + value)
    return (out >> np.uint64(48)).astype(np.uint16)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples; an empty text is like empty texts only."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float((a == b).mean())


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint added (or replaced), four hexadecimal digits for each hash function."""
    kept_names = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                made = [as_text(sketch(t or "")) for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.select(kept_names).columns, pa.array(made, pa.string())], [*kept_names, out_col])

    return docs.select(*kept_names).mapInArrow(run, docs.select(*kept_names).withColumn(out_col, F.lit("")).schema)


def in_next_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (_range, _ghost, id, text), each range in one partition, in order; its last rows (_ghost) begin the range below.

    The bounds and the first keys of the ranges, one number each, go to the tasks
    as sorted arrays, where a key's range is a binary search.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows without id share the lowest quarter of the keys, dealt by the hash of their text
    unnamed = F.lit(LOWEST) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = rows.withColumn("_key", F.when(F.col("id").isNull(), unnamed).otherwise(F.greatest("id", F.lit(LOWEST >> 1))))
    bounds = np.array(sorted({int(b) for b in rows.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts)}), np.int64)
    place = F.pandas_udf(lambda key: pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right")), "long")
    tops = dict(sorted((r["_range"], r["top"]) for r in rows.groupBy(place("_key").alias("_range")).agg(F.max("_key").alias("top")).collect()))
    ranges = list(tops)
    firsts = np.array([tops[r] for r in ranges], np.int64)
    above = np.array([*ranges[1:], *ranges[:1]], np.int64)

    def places(key: pd.Series) -> pd.Series:
        """A row's range, and for the first rows of a range also the one above."""
        keys = key.to_numpy()
        own = np.searchsorted(bounds, keys, side="right")
        at = np.minimum(np.searchsorted(firsts, keys), len(firsts) - 1)
        return pd.Series([[o, a] if f else [o] for o, a, f in zip(own.tolist(), above[at].tolist(), (firsts[at] == keys).tolist(), strict=True)])

    both = rows.select("id", "text", "_key", F.posexplode(F.pandas_udf(places, "array<long>")("_key")).alias("_ghost", "_range"))
    return both.repartitionByRange(parts, "_range").sortWithinPartitions("_range", "_ghost", F.desc("_key"), F.desc("id"), F.xxhash64("text")).select("_range", "_ghost", "id", "text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text: the last third replaced by the beginning of the next document."""

    def pairs(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            for part in pieces(batch, "text"):
                for place, ghost, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("_range", "_ghost", "id", "text")), strict=True):
                    if ghost and (last is None or last[0] != place):
                        continue  # a further row of the same id: the first one is the next document
                    made = sketch(text)
                    if last is not None and last[0] == place:
                        yield last[1:], (text, made)
                    last = None if ghost else (place, doc_id, text, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for (doc_id, text, made), (next_text, next_made) in pairs(batches):
            n = len(text) // 3
            edited = text[: len(text) - n] + next_text[:n]
            edited_made = made if edited == text else sketch(edited)
            out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(made), as_text(edited_made), likeness(made, edited_made), likeness(made, next_made)))
            if len(out) >= 1000:
                yield flush()
                out.clear()
        if out:
            yield flush()

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_next_order(docs, id_col, text_col).select("_range", "_ghost", "id", "text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
