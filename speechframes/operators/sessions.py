"""Recordings from audio chunks: summaries, idle closes, end markers, ordered assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recording_summary(chunks: DataFrame, keys: list[str], rate: int, order: Column, latest: list[str] = ()) -> DataFrame:
    """One row per recording: samples, duration, the first chunk's columns, the latest chunk's ``latest``."""
    firsts = [F.min_by(c, order).alias(c) for c in ("tenant_id", "lang", "sample_rate") if c in chunks.columns and c not in keys]
    lasts = [F.max_by(c, order).alias(c) for c in latest]
    found = chunks.groupBy(*keys).agg(F.sum("n_samples").alias("total_samples"), F.count("*").alias("n_chunks"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *firsts, *lasts)
    return found.withColumn("duration_ms", F.expr(f"total_samples * 1000 div {rate}") if rate > 0 else F.lit(0))


def idle_sessions(chunks: DataFrame, keys: list[str], idle_us: int, order: list[str] = ("ts_us", "seq")) -> DataFrame:
    """chunks with recording: a new one after more than ``idle_us`` without a chunk."""
    line = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.col("ts_us") - F.lag("ts_us").over(line) > idle_us).cast("int"), F.lit(0))
    return chunks.withColumn("_new", new).withColumn("recording", F.sum("_new").over(line)).drop("_new")


def end_marker_sessions(chunks: DataFrame, keys: list[str], order: list[str] = ("seq",)) -> DataFrame:
    """Chunks with recording: an end marker closes the open recording, and audio after it begins another.

    The markers themselves carry no audio and go; one without an open recording is ignored.
    """
    line = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = chunks.withColumn("_segment", F.coalesce(F.sum(F.col("end_marker").cast("int")).over(line), F.lit(0))).where("NOT end_marker")
    return marked.withColumn("recording", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_segment")) - 1).drop("_segment")


def assemble_pcm(chunks: DataFrame, keys: list[str], most_bytes: int = 512 << 20) -> DataFrame:
    """One row per recording with its payload in order; recordings over ``most_bytes`` keep a null payload and a reason.

    The payloads are joined once, as hexadecimal text; chunks without one add nothing.
    """
    sized = chunks.groupBy(*keys).agg(F.sum(F.octet_length("pcm")).alias("n_bytes"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "pcm"))), lambda p: F.hex(p["pcm"]))
    fits = chunks.join(sized.where(F.col("n_bytes") <= most_bytes), keys, "left_semi")
    joined = fits.groupBy(*keys).agg(F.unhex(F.array_join(parts, "")).alias("pcm"))
    return sized.join(joined, keys, "left").withColumn("reason", F.when(F.col("n_bytes") > most_bytes, "too-large"))


def two_source_mix(left: DataFrame, right: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Equal blocks of two sources added and clipped to [-1, 1]; a missing side is silent."""
    a, b = left.select(*keys, F.col(samples).alias("_a")), right.select(*keys, F.col(samples).alias("_b"))
    zero = F.lit(0.0)
    mixed = F.zip_with(F.coalesce("_a", F.array().cast("array<double>")), F.coalesce("_b", F.array().cast("array<double>")), lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, zero) + F.coalesce(y, zero))))
    return a.join(b, keys, "full").select(*keys, mixed.alias(samples))


def replay_dedup(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of the rows that at-least-once publication repeats; repeats combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def published_or_pending(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Inputs whose output is acknowledged, and those that wait."""
    return inputs.join(outputs, keys, "left_semi"), inputs.join(outputs, keys, "left_anti")


def deletable_recordings(recordings: DataFrame, outputs: DataFrame, keys: list[str], controls: str = "controls") -> DataFrame:
    """Recordings that may go: one final track, not to be stored, output acknowledged."""
    single = (F.size(f"{controls}.final_tracks") == 1) & ~F.col(f"{controls}.store_recording")
    return recordings.where(single).join(outputs, keys, "left_semi")
