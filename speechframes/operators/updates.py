"""Partial and final updates: live lines, repeated texts, replacement intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechframes.functions.text import strip
from speechframes.operators import scan


def live_line(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the number of finals and the latest partial after the last of them (null if there is none)."""
    at = F.struct(*order)
    made = updates.groupBy(*keys).agg(F.count_if(F.col("kind") == "FINAL").alias("n_finals"), F.max(F.when(F.col("kind") == "FINAL", at)).alias("_final"), F.max(F.when(F.col("kind") == "PARTIAL", at)).alias("_partial"), F.max_by("text", F.when(F.col("kind") == "PARTIAL", at)).alias("_text"))
    return made.withColumn("live_text", F.when(F.col("_final").isNull() | (F.col("_partial") > F.col("_final")), F.col("_text"))).drop("_final", "_partial", "_text")


def dedup_updates(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Blank updates go, so do partials that repeat the update before them in the same replacement interval; finals stay."""
    line = Window.partitionBy(*keys).orderBy(*order)
    rows = updates.withColumn("text", strip("text")).where("text <> ''")
    same = F.coalesce((F.lag("text").over(line) == F.col("text")) & (F.lag("kind").over(line) != "FINAL"), F.lit(False))
    return rows.withColumn("_same", same).where((F.col("kind") == "FINAL") | ~F.col("_same")).drop("_same")


def replacement_start(updates: DataFrame, keys: list[str], order: list[str], end: str) -> DataFrame:
    """updates with start_at: where the last FINAL before them ended, 0 at first."""
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return updates.withColumn("start_at", F.coalesce(F.last(F.when(F.col("kind") == "FINAL", F.col(end)), ignorenulls=True).over(line), F.lit(0).cast("long")))


def monotonic_errors(rows: DataFrame, keys: list[str], order: list[str], start: str, end: str, duration: str, tolerance: int = 0) -> DataFrame:
    """Rows that break previous start <= start <= end <= duration."""
    rows = scan.with_previous(rows, keys, order, 4096, "_last")
    before = F.coalesce(F.col("_last")[start], F.lit(0).cast("long"))
    fine = (F.col("_before") - tolerance <= F.col(start)) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.col(duration))
    return rows.withColumn("_before", before).where(~fine).drop("_before", "_last")
