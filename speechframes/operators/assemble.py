"""Words to segments to nested transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechframes.functions.text import strip
from speechframes.operators import scan
from speechframes.operators.intervals import BIN_MS, number_islands, speakers_in_bins


def spaced(word: Column, separator: str = "smart") -> Column:
    """A word with the blank before it; words are put together as they are, and the text is stripped at the end.

    smart: a blank before words that begin with a letter or digit; space: a
    blank before every word; raw: nothing, the words carry their spacing.
    """
    if separator == "space":
        return F.concat(F.lit(" "), word)
    plain = F.substring(word, 1, 1).between("a", "z")  # most words, without a regular expression
    return word if separator == "raw" else F.when(plain | word.rlike(r"^[\p{L}\p{N}]"), F.concat(F.lit(" "), word)).otherwise(word)


def join_words(words: Column, separator: str = "smart") -> Column:
    """Text of an ordered array of words."""
    return strip(F.array_join(F.transform(words, lambda w: spaced(w, separator)), ""))


def word_segments(
    words: DataFrame, keys: list[str], order: list[str], gap: int | None = None, separator: str = "smart", with_words: bool = False,
    start: str = "s_ms", end: str = "e_ms", bin_width: int = BIN_MS,
) -> DataFrame:
    """Runs of words of one speaker (and, with ``gap``, without longer pauses) as segments; blank ones go.

    Words are sorted once, in bins of ``bin_width`` of the first order column,
    and leave their bin as pieces of segments. What comes before a bin can only
    join pieces, never part them, so the segments are the islands of the pieces.
    Shuffles keep the number of partitions that the session sets; they are not
    coalesced, because a task then would hold and sort several times as many words.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = [c for c in dict.fromkeys([*order, "speaker", start, end, "word"]) if c not in keys]
    rows = words.select(*named, F.struct(*keys).alias("_key"), scan.bin_number(words, order[0], bin_width).alias("_bin")).repartition(parts, *scan.AT)
    by = list(dict.fromkeys([*order, "speaker", start, end]))
    return segments_of_bins(rows, keys, order, by, gap, separator, with_words, start, end)


def speaker_segments(
    words: DataFrame, turns: DataFrame, keys: list[str], word_id: list[str], gap: int | None = None, separator: str = "smart", with_words: bool = False,
    coverage: tuple[int, int] | None = (1, 10), start: str = "s_ms", end: str = "e_ms", bin_width: int = BIN_MS,
) -> DataFrame:
    """Words with their speakers (intervals.assign_speakers) as segments (word_segments), ordered by start and word_id: one exchange and one sort of words serve both."""
    order = list(dict.fromkeys([start, *word_id]))
    rows = speakers_in_bins(words.select(*dict.fromkeys([*keys, *order, end, "word"])), turns, keys, word_id, coverage, start, end, bin_width)
    return segments_of_bins(rows, keys, order, [*order, end], gap, separator, with_words, start, end)


def segments_of_bins(rows: DataFrame, keys: list[str], order: list[str], by: list[str], gap: int | None, separator: str, with_words: bool, start: str, end: str) -> DataFrame:
    """The segments of words that are partitioned by _key (their keys) and _bin and sorted ``by`` columns that leave no ties; see word_segments."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = number_islands(rows, Window.partitionBy(*scan.AT).orderBy(*by), ["speaker"], gap, start, end, "_piece")
    # all of a word is made before it is collected, so the arrays are only sorted and taken apart
    said = [(F.col(start) / 1000).alias("start_s"), (F.col(end) / 1000).alias("end_s")] if with_words else []
    row = F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, "word", start, end]), spaced(F.col("word"), separator).alias("_spaced"), *said)))
    whole = [F.min(start).alias(start), F.max(end).alias(end)]
    pieces = rows.groupBy(*scan.AT, "_piece", "speaker").agg(*whole, F.min(F.struct(*by))[start].alias("_from"), F.count("*").alias("n_words"), row.alias("_words"))
    pieces = pieces.withColumn("_text", F.array_join("_words._spaced", ""))
    kept = ["_bin", "_piece", "_text"]
    if with_words:
        pieces = pieces.withColumn("_said", F.arrays_zip(F.col("_words.start_s").alias("start_s"), F.col("_words.end_s").alias("end_s"), F.col("_words.word").alias("text")))
        kept.append("_said")
    line = Window.partitionBy(*keys).orderBy("_bin", "_piece")
    pieces = pieces.select("_key.*", *[c for c in pieces.columns if c not in ("_key", "_words")])
    islands = number_islands(pieces.repartition(parts, *keys), line, ["speaker"], gap, "_from", end, "island")
    made = islands.groupBy(*keys, "island", "speaker").agg(*whole, F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list(F.struct(*kept))).alias("_pieces"))
    made = made.withColumn("text", strip(F.array_join("_pieces._text", ""))).where("text <> ''")
    if with_words:
        made = made.withColumn("words", F.flatten("_pieces._said"))
    return made.drop("_pieces")


def transcripts(segments: DataFrame, keys: list[str], start: str = "s_ms", end: str = "e_ms", raw_text: str | None = None) -> DataFrame:
    """One nested row per key: segments in order, and their texts joined by blanks."""
    fields = [F.col(start).alias("s"), F.col("island").alias("i"), (F.col(start) / 1000).alias("start_s"), (F.col(end) / 1000).alias("end_s"), F.col("text").alias("text"), F.coalesce("speaker", F.lit("")).alias("speaker")]
    if "words" in segments.columns:
        fields.append(F.col("words").alias("words"))
    listed = F.sort_array(F.collect_list(F.struct(*fields)))
    extra = [F.first(raw_text, ignorenulls=True).alias("_raw")] if raw_text else []
    made = segments.groupBy(*keys).agg(listed.alias("segments"), *extra)
    made = made.withColumn("segments", F.transform("segments", lambda s: s.dropFields("s", "i")))
    texts = F.filter(F.transform("segments", lambda s: strip(s["text"])), lambda t: t != "")
    full = F.array_join(texts, " ")
    if raw_text:
        full = F.coalesce(F.nullif(full, F.lit("")), "_raw")
    last = F.aggregate("segments", F.lit(0.0), lambda a, s: F.greatest(a, s["end_s"]))
    return made.withColumn("full_text", full).withColumn("duration_s", last).drop("_raw")


def shift_segments(segments: Column, base_s: Column) -> Column:
    """Nested segments moved to the absolute clock, words included."""
    word = lambda w: F.struct((w["start_s"] + base_s).alias("start_s"), (w["end_s"] + base_s).alias("end_s"), w["text"].alias("text"))
    return F.transform(segments, lambda s: F.struct((s["start_s"] + base_s).alias("start_s"), (s["end_s"] + base_s).alias("end_s"), s["text"].alias("text"), s["speaker"].alias("speaker"), F.transform(s["words"], word).alias("words")))


def clean_segments(segments: DataFrame, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Trimmed text; blank and empty segments go."""
    return segments.withColumn("text", strip("text")).where((F.col("text") != "") & (F.col(end) > F.col(start)))


def word_timings(words: Column) -> Column:
    """Words with both times and a text, which may stand under word or text."""
    named = F.transform(words, lambda w: F.struct(w["start"].alias("start_s"), w["end"].alias("end_s"), strip(F.coalesce(w["word"], w["text"])).alias("text")))
    return F.filter(named, lambda w: w["start_s"].isNotNull() & w["end_s"].isNotNull() & (F.coalesce(w["text"], F.lit("")) != ""))


def aligned_or_raw(asr: DataFrame, aligned: DataFrame, keys: list[str], least: tuple[int, int] = (7, 10), start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Per key the durations of both segmentations and which one to use: alignment must cover 0.7 of the speech."""
    length = lambda: F.sum(F.greatest(F.lit(0).cast("long"), F.col(end) - F.col(start)))
    a = asr.groupBy(*keys).agg(length().alias("asr_ms"))
    b = aligned.groupBy(*keys).agg(length().alias("aligned_ms"))
    both = a.join(b, keys, "left").withColumn("aligned_ms", F.coalesce("aligned_ms", F.lit(0).cast("long")))
    covered = (F.col("asr_ms") == 0) | (F.col("aligned_ms") * least[1] >= F.col("asr_ms") * least[0])
    return both.withColumn("use", F.when(covered, "aligned").otherwise("asr"))


def union_tracks(**tracks: DataFrame) -> DataFrame:
    """Rows of independent tracks, labelled; columns that a track lacks are null."""
    out = None
    for name, df in tracks.items():
        df = df.withColumn("track", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
