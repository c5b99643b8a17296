"""Audio of turns, cut out of chunks without putting the recording together.

Running sums of the chunk sizes give every chunk its samples in the session;
turns and chunks meet by bins of samples; each chunk gives the bytes that a turn
covers, and only those are shuffled to their turn and joined in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechframes.operators import gallery, intervals, scan

WIDTH = 2  # bytes of a sample
BIN_SAMPLES = 960_000


def concatenated(parts: Column) -> Column:
    """The bytes of an array, one after the other."""

    def joined(rows: pd.Series) -> pd.Series:
        return rows.map(b"".join)

    return F.pandas_udf(joined, "binary")(parts)


def placed_chunks(chunks: DataFrame, keys: list[str], order: str = "seq", pcm: str = "pcm", bin_width: int = 1024) -> DataFrame:
    """chunks with first_sample and end_sample, their place in the session; a chunk without payload or with half a sample keeps whole samples."""
    size = F.coalesce(F.expr(f"octet_length({pcm}) div {WIDTH}"), F.lit(0)).cast("long")
    line = scan.numbered(scan.packed(chunks.withColumn("_n", size), keys, order, bin_width), [order])
    line = line.withColumn("_sofar", F.sum("_row._n").over(scan.within([order]).rowsBetween(Window.unboundedPreceding, 0)))
    bins = scan.summaries(line, _sum=F.max("_sofar")).where("_head IS NOT NULL").withColumn("_before", F.coalesce(F.sum("_sum").over(scan.earlier()), F.lit(0)))
    line = scan.carried(line, bins, "_before")
    line = line.withColumn("_end", F.col("_before") + F.col("_sofar"))
    kept = [c for c in chunks.columns if c not in ("first_sample", "end_sample")]
    return scan.unpacked(line, F.col("_end")).select(*kept, (F.col("_end") - F.col("_n")).alias("first_sample"), F.col("_end").alias("end_sample"))


def clipped_turns(turns: DataFrame, chunks: DataFrame, keys: list[str], start: str = "s", end: str = "e", pcm: str = "pcm") -> DataFrame:
    """Turns (in samples) inside the audio of their session; empty ones and those of sessions without audio go."""
    totals = chunks.groupBy(*keys).agg(F.sum(F.coalesce(F.expr(f"octet_length({pcm}) div {WIDTH}"), F.lit(0))).cast("long").alias("_total"))
    held = turns.join(totals, keys).withColumn(start, F.greatest(F.lit(0).cast("long"), F.col(start))).withColumn(end, F.least(end, "_total"))
    return held.where(F.col(end) > F.col(start)).drop("_total")


def _cut(chunks: DataFrame, ranges: DataFrame, keys: list[str], owner: list[str], place: list[str], order: str, start: str, end: str, pcm: str, bin_samples: int) -> DataFrame:
    """The samples of the ranges (keys, owner, place, start, end), one row for each owner, in the order of place."""
    placed = placed_chunks(chunks.select(*keys, order, pcm), keys, order, pcm).where("end_sample > first_sample")
    placed = placed.select(*keys, pcm, F.col("first_sample").alias(start), F.col("end_sample").alias(end))
    pairs = intervals.overlapping_pairs(ranges, placed, keys, start, end, bin_samples)
    begin = F.greatest(F.col(start), F.col(f"r_{start}")) - F.col(f"r_{start}")
    part = F.substr(F.col(f"r_{pcm}"), (begin * WIDTH + 1).cast("int"), (F.col("overlap") * WIDTH).cast("int"))
    pieces = pairs.select(*keys, *owner, F.struct(*place, F.col(f"r_{start}").alias("_at"), part.alias("_bytes"), F.col("overlap").alias("_n")).alias("_piece"))
    made = pieces.groupBy(*keys, *owner).agg(F.sum("_piece._n").alias("n_samples"), F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    return made.withColumn("pcm", concatenated(F.transform("_pieces", lambda p: p["_bytes"]))).drop("_pieces")


def turn_audio(chunks: DataFrame, turns: DataFrame, keys: list[str], order: str = "seq", start: str = "s", end: str = "e", pcm: str = "pcm", bin_samples: int = BIN_SAMPLES) -> DataFrame:
    """turns with n_samples and pcm, their part of the session's audio. turns: keys, turn_ord (once in a session), start and end in samples.

    Chunks follow one another in the order of their number; samples that two
    turns share go to both. Turns that cover no audio have no row.
    """
    held = clipped_turns(turns.select(*keys, "turn_ord", start, end), chunks, keys, start, end, pcm)
    made = _cut(chunks, held, keys, ["turn_ord"], [], order, start, end, pcm, bin_samples)
    return turns.join(made, [*keys, "turn_ord"])


def speaker_audio(chunks: DataFrame, turns: DataFrame, keys: list[str], least: int, most: int, order: str = "seq", start: str = "s", end: str = "e", pcm: str = "pcm", bin_samples: int = BIN_SAMPLES) -> DataFrame:
    """Per speaker the first ``most`` samples of its turns, one after the other; speakers with less than ``least`` in all have no row.

    The cap is worked out on numbers, so audio beyond it does not move.
    """
    held = clipped_turns(turns, chunks, keys, start, end, pcm).where(F.col("speaker") != "")
    taken = gallery.speaker_budget(held, keys, least, most, start, end).withColumn(end, F.col(start) + F.col("take"))
    ranges = taken.select(*keys, "speaker", F.struct(F.col(start).alias("s"), F.col(end).alias("e"), "turn_ord").alias("_turn"), start, end)
    return _cut(chunks, ranges, keys, ["speaker"], ["_turn"], order, start, end, pcm, bin_samples)
