"""Sample-counted windows: slices, epochs, commit windows with context, overlapping windows, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """chunks with first and last: the samples of the session that they hold, [first, last)."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("n_samples").over(line)
    return chunks.withColumn("last", last).withColumn("first", F.col("last") - F.col("n_samples"))


def slices(chunks: DataFrame, keys: list[str], size: int, order: list[str] = ("seq",)) -> DataFrame:
    """Tumbling windows of ``size`` samples; chunks are split at the boundaries, the tail is flushed as idle.

    One row per slice: slice_index, base_sample, n_samples, n_parts, flush_reason.
    """
    placed = positions(chunks, keys, list(order)).where("n_samples > 0")
    parts = placed.withColumn("slice_index", F.explode(F.expr(f"sequence(first div {size}, (last - 1) div {size})")))
    begin, stop = F.col("slice_index") * size, (F.col("slice_index") + 1) * size
    parts = parts.withColumn("_n", F.least("last", stop) - F.greatest("first", begin))
    found = parts.groupBy(*keys, "slice_index").agg(F.sum("_n").alias("n_samples"), F.count("*").alias("n_parts"))
    return found.withColumn("base_sample", F.col("slice_index") * size).withColumn("flush_reason", F.when(F.col("n_samples") == size, "slice").otherwise("idle"))


def slice_parts(chunks: DataFrame, keys: list[str], size: int, order: list[str] = ("seq",)) -> DataFrame:
    """The byte ranges of each chunk's payload that each slice takes (two bytes a sample)."""
    placed = positions(chunks, keys, list(order)).where("n_samples > 0")
    parts = placed.withColumn("slice_index", F.explode(F.expr(f"sequence(first div {size}, (last - 1) div {size})")))
    begin = F.greatest(F.col("first"), F.col("slice_index") * size)
    stop = F.least(F.col("last"), (F.col("slice_index") + 1) * size)
    return parts.select(*keys, "seq", "slice_index", ((begin - F.col("first")) * 2).alias("byte_from"), ((stop - F.col("first")) * 2).alias("byte_to"))


def commit_windows(totals: DataFrame, size: int, context: int, least_tail: int) -> DataFrame:
    """Commits [k*size, (k+1)*size) with analysis intervals widened by the context and clipped to what there is.

    totals has n_samples (of the whole session). The tail is committed at the
    end unless it is under ``least_tail``.
    """
    rows = totals.where("n_samples > 0").withColumn("commit", F.explode(F.expr(f"sequence(0L, (n_samples - 1) div {size})")))
    start = F.col("commit") * size
    end = F.least(start + size, F.col("n_samples"))
    rows = rows.withColumn("c_start", start).withColumn("c_end", end).where((F.col("c_end") - F.col("c_start") == size) | (F.col("c_end") - F.col("c_start") >= least_tail))
    ready = F.when(F.col("n_samples") >= F.col("c_start") + size + context, "streaming").otherwise("end")
    return rows.withColumn("a_start", F.greatest(F.lit(0).cast("long"), F.col("c_start") - context)).withColumn("a_end", F.least(F.col("c_end") + context, F.col("n_samples"))).withColumn("ready", ready)


def overlap_windows(totals: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` every size - overlap samples; an incomplete tail is not emitted."""
    hop = size - overlap
    rows = totals.where(F.col("n_samples") >= size)
    rows = rows.withColumn("window_index", F.explode(F.expr(f"sequence(0L, (n_samples - {size}) div {hop})")))
    return rows.withColumn("w_start", F.col("window_index") * hop).withColumn("w_end", F.col("window_index") * hop + size)


def centre_owner(words: DataFrame, hop: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """words with the overlapping window that owns their centre: floor(centre / hop)."""
    return words.withColumn("owner", F.expr(f"({start} + {end}) div {2 * hop}"))


def frames(chunks: DataFrame, size: int) -> DataFrame:
    """Every chunk cut into frames of ``size`` samples, the last one short; frame numbers run within the chunk."""
    cut = chunks.where("n_samples > 0").withColumn("_at", F.explode(F.expr(f"sequence(0L, n_samples - 1, {size}L)")))
    return cut.withColumn("frame", (F.col("_at") / size).cast("long")).withColumn("frame_samples", F.least(F.lit(size), F.col("n_samples") - F.col("_at"))).drop("_at")
