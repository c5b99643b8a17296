"""Stream statistics, cadence, histograms and concurrency."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechframes.operators import intervals
from speechframes.operators.ordered import fold_sessions


def stream_stats(events: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("n_events"),
        F.sum("n_samples").alias("n_samples"),
        F.count_if(F.col("kind") == "PARTIAL").alias("n_partial"),
        F.count_if(F.col("kind") == "FINAL").alias("n_final"),
        F.min_by("kind", order).alias("first_kind"),
        (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )


def cadence(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: delay of the first FINAL after the first event, median and largest gap between events."""
    gaps = events.withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*keys).orderBy(*order)))
    made = gaps.groupBy(*keys).agg(F.min("ts_us").alias("_first"), F.min(F.when(F.col("kind") == "FINAL", F.col("ts_us"))).alias("_final"), F.expr("percentile(_gap, 0.5)").alias("median_gap_us"), F.max("_gap").alias("max_gap_us"))
    return made.withColumn("first_final_us", F.col("_final") - F.col("_first")).drop("_first", "_final")


def histogram(rows: DataFrame, labels: list[str], value: str, low: float, high: float, buckets: int) -> DataFrame:
    """Counts by label and equal bucket (0 below, buckets + 1 at or above the end)."""
    return rows.groupBy(*labels, F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"))


def concurrency(spans: DataFrame, start: str, stop: str, bucket: int) -> DataFrame:
    """Open spans after every change: (at, open), spans closing before others open at the same time.

    A sweep over all spans without a single sorted partition: net changes by
    time bucket are added up first (one row per bucket), then each bucket is
    swept on its own.
    """
    steps = spans.select(F.col(start).alias("at"), F.lit(1).alias("d")).union(spans.select(F.col(stop).alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy("at").agg(F.sum("d").alias("d")).withColumn("_bucket", F.floor(F.col("at") / bucket))
    nets = steps.groupBy("_bucket").agg(F.sum("d").alias("_net"))
    before = F.coalesce(F.sum("_net").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = nets.select("_bucket", before.alias("_before"))
    within = F.sum("d").over(Window.partitionBy("_bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("_in", within).join(offsets, "_bucket").select("at", (F.col("_before") + F.col("_in")).alias("open"))


def admissions(opens: DataFrame, keys: list[str], key_schema: str, order: str, most: int, start: str = "at_us", stop: str = "until_us") -> DataFrame:
    """Whether each open finds one of its key's ``most`` slots free, and how many are taken after it: keys, order, admitted, open.

    A refused open takes no slot, so what comes later depends on it: each key is
    replayed in order of start (then ``order``, unique in the key, a long), with a
    heap of the releases to come; slots that fall free at an open's time are free for it.
    The timeline of a key is cut wherever all earlier spans have ended, whether
    admitted or not: no slot is taken there, so the pieces are replayed apart.
    Spans that end no later than they start hold a slot only until the next open.
    """
    if most < 1:
        raise ValueError("the number of slots must be positive")
    spans = opens.select(*keys, order, start, F.greatest(start, stop).alias(stop))
    # start - end so far > -1: everything before has ended
    pieces = intervals.gap_islands(spans, keys, [], -1, [start, order], start, stop, bin_width=3_600_000_000)

    def step(state: dict, row: dict) -> Iterator[dict]:
        releases = state["releases"]
        while releases and releases[0] <= row[start]:
            heapq.heappop(releases)
        admitted = len(releases) < most
        if admitted:
            heapq.heappush(releases, row[stop])
        yield {order: row[order], "admitted": admitted, "open": len(releases)}

    made = fold_sessions(pieces, [*keys, "island"], [start, order], lambda: {"releases": []}, step, f"{key_schema}, island long, {order} long, admitted boolean, open long")
    return made.drop("island")


def speech_gate(spans: DataFrame, keys: list[str], least: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Total speech per key and whether it reaches the gate."""
    made = spans.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col(end) - F.col(start))).alias("speech_ms"))
    return made.withColumn("passes", F.col("speech_ms") >= least)


def speaker_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct and assigned speakers; two or more allow splitting by turn."""
    named = F.nullif(F.col("speaker"), F.lit(""))
    made = segments.groupBy(*keys).agg(F.count("*").alias("n_segments"), F.count_distinct(named).alias("n_speakers"), F.count(named).alias("n_assigned"))
    return made.withColumn("split_mode", F.col("n_speakers") >= 2)


def audio_check(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Events, finals, distinct speakers, and enrolled ones (named otherwise than SPEAKER_nn)."""
    speaker = F.nullif(F.col("speaker"), F.lit(""))
    enrolled = F.when(~F.startswith(F.col("speaker"), F.lit("SPEAKER_")), speaker)
    return segments.groupBy(*keys).agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "FINAL").alias("n_finals"), F.count_distinct(speaker).alias("n_speakers"), F.count_distinct(enrolled).alias("n_enrolled"))
