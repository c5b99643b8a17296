"""Hard negatives of anchors by threshold joins in the manner of L2AP.

Anchors are a stated set of rows; they and all rows are dealt to blocks of bounded
bytes, and each pair of blocks is one group. In a group the rows are an
inverted index: dimensions in the order of their weight, in parts; a part of a row
is listed only while the norm of the row from there on reaches threshold / norm
of the anchor, since what comes after cannot make up a threshold by itself. An
anchor walks the parts, adds up partial scores, and drops rows whose partial
score and norms of what remains (Cauchy-Schwarz) stay below its threshold. The
rows that are left get their exact score. Thresholds start high and are lowered
for the anchors whose windows have not filled: first until they have their
positives among the rows of their label, then until every window below a positive
has its negatives, or the window's lower end is reached. Each group gives its
best few, which Spark merges into the best of all.

A score is an integer inner product. It is exact below 2^63; vectors whose scores
may pass 2^53 are multiplied as integers.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors count as followed by zeros, empty ones
as zero vectors; null ids are last among ties; repeated rows are rows of their own
(a copy of an anchor is one of its other rows); positives with negative scores
have empty windows; empty tables and tables without anchors give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechframes.llm.common import table, written

BLOCK_BYTES = 8 << 20  # of eight-byte components in a block of rows; a block of anchors has a quarter
BATCH = 128  # anchors that walk the index together
FALL = 0.85  # thresholds are lowered by this factor
LAST = np.iinfo(np.int64).max
HITS = "anchor long, positive int, negative_id long, score long"
HIT = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("negative_id", pa.int64()), ("score", pa.int64())])


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, short ones filled with zeros."""
    found = np.zeros((len(vectors), width), dtype=np.int64)
    done = 0
    for chunk in vectors.chunks:
        lengths = chunk.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(chunk)), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found[done + row, column] = chunk.flatten().to_numpy(zero_copy_only=False)
        done += len(chunk)
    return found


class Index:
    """An inverted index of the rows of a block for thresholds of any height."""

    def __init__(self, vectors: np.ndarray):
        energy = (vectors.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-energy, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[:, self.order])
        width = len(self.order)
        # parts end where a half, a quarter, ... of all weight remains
        left = energy.sum() - np.cumsum(energy[self.order])
        ends = [int(np.searchsorted(-left, -energy.sum() / 2**k) + 1) for k in range(1, 6)]
        self.cuts = sorted({0, width, *(e for e in ends if e < width)})
        self.floats = self.vectors.astype(np.float64)
        self.tails = self._tails(self.vectors)
        self.lists = [np.argsort(-t, kind="stable") for t in self.tails]

    def _tails(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The norms from each cut on, with room for rounding."""
        squares = vectors.astype(np.float64) ** 2
        return [np.sqrt(squares[:, c:].sum(axis=1)) * (1 + 1e-9) for c in self.cuts]

    def above(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score reaches the anchor's threshold (0 or more)."""
        x = np.ascontiguousarray(anchors[:, self.order])
        norms = self._tails(x)
        exact = (norms[0].max(initial=0) + 1) * (self.tails[0].max(initial=0) + 1) < 2**53
        y = self.floats if exact else self.vectors
        x = x.astype(y.dtype, copy=False)
        least = thresholds - 0.5  # scores are integers
        floor = np.min(least / np.maximum(norms[0], 1e-300), initial=np.inf)
        partial = np.zeros((len(x), len(y)), dtype=y.dtype)
        alive = np.zeros(partial.shape, dtype=bool)
        for k, (start, end) in enumerate(zip(self.cuts, self.cuts[1:])):
            tails = self.tails[k]
            listed = self.lists[k][: int(np.searchsorted(-tails[self.lists[k]], -floor, side="right"))]
            if not len(listed):
                break
            # rows that list no more parts stay as their last part has left them
            if len(listed) == len(y):
                partial += x[:, start:end] @ y[:, start:end].T
                reach = partial + np.outer(norms[k + 1], self.tails[k + 1]) >= least[:, None]
                alive = reach if k == 0 else alive & reach
            else:
                partial[:, listed] += x[:, start:end] @ y[listed, start:end].T
                reach = partial[:, listed] + np.outer(norms[k + 1], self.tails[k + 1][listed]) >= least[:, None]
                alive[:, listed] = reach if k == 0 else alive[:, listed] & reach
            if np.count_nonzero(alive) < alive.size >> 4:
                break
        i, j = np.nonzero(alive)
        score = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            score[cut] = np.einsum("nd,nd->n", x[i[cut]], y[j[cut]])
        found = score >= thresholds[i]
        return i[found], j[found], score[found]


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group by score and id."""
    order = np.lexsort((ids, -score, group))
    group = group[order]
    first = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1] if len(group) else np.zeros(0, np.int64)
    nth = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return order[nth < most]


class Block:
    def __init__(self, rows: pa.Table, width: int):
        self.uid = rows.column("uid").to_numpy()
        self.null = rows.column("id").is_null().to_numpy(zero_copy_only=False)
        self.id = rows.column("id").fill_null(LAST).to_numpy()
        self.label = rows.column("label").to_numpy()
        self.vectors = matrix(rows.column("vector"), width)


def _hits(parts: list[tuple], rows: Block) -> pa.Table:
    anchor, positive, place, score = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
    ids = pa.array(rows.id[place], mask=rows.null[place])
    return pa.table([pa.array(anchor, pa.int64()), pa.array(positive, pa.int32()), ids, pa.array(score, pa.int64())], schema=HIT)


def _width(*tables: pa.Table) -> int:
    return max([1, *(int(c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in tables for c in t.column("vector").chunks)])


def find_positives(most: int):
    """The best rows of each anchor's own label in a block (scores from 0 on: others have no negatives)."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return HIT.empty_table()
        width = _width(rows, anchors)
        block, asked = Block(rows, width), Block(anchors, width)
        parts = []
        for label in np.unique(asked.label):
            own, mine = np.flatnonzero(block.label == label), np.flatnonzero(asked.label == label)
            if not len(own):
                continue
            index = Index(block.vectors[own])
            for at in range(0, len(mine), BATCH):
                todo = mine[at : at + BATCH]
                t = np.floor(np.sqrt((asked.vectors[todo].astype(np.float64) ** 2).sum(axis=1)) * index.tails[0].max() * FALL).astype(np.int64)
                while len(todo):
                    i, j, score = index.above(asked.vectors[todo], t)
                    other = block.uid[own[j]] != asked.uid[todo[i]]
                    i, j, score = i[other], j[other], score[other]
                    done = (np.bincount(i, minlength=len(todo)) >= most) | (t <= 0)
                    took = np.flatnonzero(done[i])
                    took = took[best(i[took], score[took], block.id[own[j[took]]], most)]
                    parts.append((asked.uid[todo[i[took]]], np.zeros(len(took), np.int64), own[j[took]], score[took]))
                    todo, t = todo[~done], np.floor(t[~done] * FALL).astype(np.int64)
        return _hits(parts, block)

    return find


def find_negatives(most: int, low: int, high: int):
    """The best rows of other labels in each window of an anchor in a block."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return HIT.empty_table()
        width = _width(rows, anchors)
        block, asked = Block(rows, width), Block(anchors, width)
        index = Index(block.vectors)
        scores = anchors.column("scores").to_pylist()
        most_windows = max(map(len, scores))
        bottom, top = np.full((len(scores), most_windows), LAST), np.full((len(scores), most_windows), -1)
        for i, windows in enumerate(scores):
            for w, s in enumerate(windows):
                bottom[i, w], top[i, w] = -(-low * s // 100), high * s // 100
        parts = []
        for at in range(0, len(scores), BATCH):
            todo = np.arange(at, min(len(scores), at + BATCH))
            t = np.maximum(bottom[todo].min(axis=1), np.floor(top[todo].max(axis=1) * FALL).astype(np.int64))
            while len(todo):
                i, j, score = index.above(asked.vectors[todo], t)
                other = block.label[j] != asked.label[todo[i]]
                i, j, score = i[other], j[other], score[other]
                inside = (score[:, None] >= bottom[todo][i]) & (score[:, None] <= top[todo][i])
                held = np.zeros((len(todo), most_windows), dtype=np.int64)
                np.add.at(held, i, inside)
                filled = (held >= most) | (bottom[todo] >= t[:, None])
                done = filled.all(axis=1)
                hit, window = np.nonzero(inside & done[i][:, None])
                took = best(i[hit] * most_windows + window, score[hit], block.id[j[hit]], most)
                hit, window = hit[took], window[took]
                parts.append((asked.uid[todo[i[hit]]], window, j[hit], score[hit]))
                floor = np.where(filled, LAST, bottom[todo]).min(axis=1)
                t = np.maximum(floor, np.floor(t * FALL).astype(np.int64))[~done]
                todo = todo[~done]
        return _hits(parts, block)

    return find


def first_of(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits of each anchor and positive, with their rank."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("negative_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds; the vectors are of integers.

    For each anchor and each of its first ``positives`` other rows of its label:
    the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    if not 0 < low <= high:
        raise ValueError("0 < low <= high is needed")
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    plain = plain.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    plain = written(plain.withColumn("uid", F.monotonically_increasing_id()), "negative-rows")
    size = plain.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    per_block = max(1, BLOCK_BYTES // (8 * max(1, size[2])))
    n_rows, n_anchors = max(1, -(-size[0] // per_block)), max(1, -(-size[1] // max(1, per_block // 4)))
    block = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of_rows = plain.withColumn("r", block(n_rows)).withColumn("a", every(n_anchors)).drop("asks")
    of_anchors = plain.where("asks").withColumn("a", block(n_anchors)).drop("asks")

    def met(anchors: DataFrame, find) -> DataFrame:
        # columns of their own: both sides come from one table
        asked = anchors.select(*[F.col(c).alias(c) for c in anchors.columns if c != "a"], every(n_rows).alias("asked_r"), F.col("a").alias("asked_a"))
        return of_rows.groupBy("r", "a").cogroup(asked.groupBy("asked_r", "asked_a")).applyInArrow(find, HITS)

    near = first_of(met(of_anchors, find_positives(positives)), positives)
    near = written(near.select("anchor", (F.col("rank") - 1).alias("positive"), F.col("negative_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    windows = near.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    asking = of_anchors.join(windows.withColumnRenamed("anchor", "uid"), "uid")
    far = first_of(met(asking, find_negatives(negatives, low, high)), negatives)
    ids = of_anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(near, ["anchor", "positive"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(F.col("embedding").isNotNull() & finite).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("embedding"),
    )
    return mine(rows, F.col("vec_id") % 100 == 0)
