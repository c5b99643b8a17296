"""Interval joins and gap islands over timed rows.

Times are integers (milliseconds or samples). Keys name the session. Interval
joins cut time into bins, so a session of any length spreads over many tasks;
a pair that meets in several bins counts in the first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from speechframes.functions.text import strip
from speechframes.operators import scan

BIN_MS = 60_000


def _bins(start: Column, end: Column, width: int, explode=F.explode) -> Column:
    first = F.floor(start / width).cast("long")
    return explode(F.sequence(first, F.greatest(first, F.floor(F.greatest(start, end - 1) / width).cast("long"))))


def overlapping_pairs(left: DataFrame, right: DataFrame, keys: list[str], start: str = "s_ms", end: str = "e_ms", bin_width: int = BIN_MS) -> DataFrame:
    """Pairs that overlap by more than nothing; right's columns carry the prefix r_, and overlap is added."""
    a = left.withColumn("_bin", _bins(F.col(start), F.col(end), bin_width))
    b = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns]).withColumn("_bin", _bins(F.col(f"r_{start}"), F.col(f"r_{end}"), bin_width))
    late = F.greatest(F.col(start), F.col(f"r_{start}"))
    return (
        a.join(b, [*keys, "_bin"])
        .where((F.col(f"r_{start}") < F.col(end)) & (F.col(start) < F.col(f"r_{end}")) & (F.col("_bin") == F.floor(late / bin_width)))
        .withColumn("overlap", F.least(end, f"r_{end}") - late)
        .drop("_bin")
    )


def assign_by_overlap(
    segments: DataFrame, turns: DataFrame, keys: list[str], segment_id: list[str], default: str = "", coverage: tuple[int, int] | None = (1, 10),
    start: str = "s_ms", end: str = "e_ms", out: str = "speaker", bin_width: int = BIN_MS,
) -> DataFrame:
    """segments (one row for each segment_id in its key) with the speaker of the single turn that overlaps each most.

    Of equal overlaps the turn that comes first (turn_ord) wins. An overlap below
    the part ``coverage`` (numerator, denominator) of the segment leaves the default.
    """
    if "_kept" in segments.columns:
        raise ValueError("_kept is a name of this operator's own")
    kept = [c for c in segments.columns if c not in (*keys, *segment_id, start, end, out)]
    rest = F.struct(*kept) if kept else F.lit(None)
    a = segments.select(*keys, *segment_id, start, end, rest.alias("_kept"))
    a = a.withColumn("_bin", _bins(F.col(start), F.col(end), bin_width, F.explode_outer))
    b = turns.select(*keys, F.col("turn_ord").alias("_ord"), F.col("speaker").alias("_said"), F.col(start).alias("_from"), F.col(end).alias("_to"))
    b = b.withColumn("_bin", _bins(F.col("_from"), F.col("_to"), bin_width))
    # no pair is needed once only: a pair that meets in several bins has one overlap
    meets = [a[c] == b[c] for c in (*keys, "_bin")] + [F.col("_from") < F.col(end), F.col(start) < F.col("_to")]
    overlap = F.when(F.col("_from").isNotNull(), F.least(end, "_to") - F.greatest(start, "_from"))
    pairs = a.join(b, meets, "left").select(*[a[k] for k in keys], *segment_id, start, end, "_kept", "_ord", "_said", overlap.alias("overlap"))
    # the segment's own columns ride along, so the result is not joined back
    rank = F.when(F.col("overlap").isNotNull(), F.struct("overlap", F.negative("_ord")))
    winner = F.max_by(F.struct(F.col("_said").alias("speaker"), "overlap"), rank)
    best = pairs.groupBy(*keys, *segment_id, start, end).agg(F.first("_kept").alias("_kept"), winner.alias("_best"))
    enough = F.col("_best.overlap").isNotNull() & (F.col(end) > F.col(start))
    if coverage:
        enough &= F.col("_best.overlap") * coverage[1] >= (F.col(end) - F.col(start)) * coverage[0]
    label = F.when(enough, F.col("_best.speaker")).otherwise(F.lit(default))
    return best.select(*[label.alias(c) if c == out else F.col(f"_kept.{c}").alias(c) if c in kept else F.col(c) for c in dict.fromkeys([*segments.columns, out])])


def nearest_turn(points: DataFrame, turns: DataFrame, keys: list[str], start: str = "s_ms", end: str = "e_ms", out: str = "speaker", bin_width: int = BIN_MS) -> DataFrame:
    """points with the speaker of the turn whose start or end lies nearest to their middle; ties go to the first turn.

    Boundaries and middles are sorted together, bin by bin; the last boundary
    before and the first after a middle are the only candidates, and a bin is
    carried those of the bins around it. Sessions without turns give null.
    Positions are doubled to keep half milliseconds whole.
    """
    ends = turns.select(*keys, F.explode(F.array(F.col(start) * 2, F.col(end) * 2)).alias("_at"), "turn_ord", "speaker")
    ends = ends.groupBy(*keys, "_at").agg(F.min(F.struct("turn_ord", "speaker")).alias("_turn")).withColumn("_turn", F.struct("_at", "_turn.turn_ord", "_turn.speaker"))
    rows = points.withColumn("_at", F.col(start) + F.col(end)).unionByName(ends, allowMissingColumns=True)
    line = scan.numbered(scan.packed(rows, keys, "_at", 2 * bin_width).withColumn("_turn", F.col("_row._turn")), ["_at"])
    bins = scan.summaries(line, every=True, _opening=F.min("_turn"), _closing=F.max("_turn")).where("_head IS NOT NULL")
    bins = bins.withColumn("_past", F.max("_closing").over(scan.earlier())).withColumn("_next", F.min("_opening").over(scan.later()))
    found = scan.carried(line, bins, "_past", "_next")
    # a boundary at a middle counts on both sides; either way the frame only grows
    before = F.max("_turn").over(scan.within(["_at"]).rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("_turn").over(scan.within([F.desc("_row._at")]).rangeBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_a", F.coalesce(before, "_past")).withColumn("_b", F.coalesce(after, "_next")).where("_turn IS NULL")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_row._at") - F.col(f"{c}._at")).alias("d"), F.col(f"{c}.turn_ord").alias("o"), F.col(f"{c}.speaker").alias("s")))
    near = F.least(rank("_a"), rank("_b"))["s"]
    return scan.unpacked(found.withColumn("_near", near), F.col("_near")).select(*[c for c in points.columns if c != out], F.col("_near").alias(out))


def assign_speakers(segments: DataFrame, turns: DataFrame, keys: list[str], segment_id: list[str], coverage: tuple[int, int] | None = (1, 10), start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Best overlap, else the nearest turn, else blank; see speakers_in_bins."""
    made = speakers_in_bins(segments, turns, keys, segment_id, coverage, start, end)
    return made.select(*[F.col(f"_key.{c}") if c in keys else F.col(c) for c in segments.columns if c != "speaker"], "speaker")


def speakers_in_bins(
    segments: DataFrame, turns: DataFrame, keys: list[str], segment_id: list[str], coverage: tuple[int, int] | None = (1, 10),
    start: str = "s_ms", end: str = "e_ms", bin_width: int = BIN_MS,
) -> DataFrame:
    """segments (one row for each segment_id in its key) with speaker (best overlap, else the nearest turn, else blank) in place of keys _key and _bin.

    They are partitioned by _key and the _bin of their start, and sorted in these
    by start, segment_id and end. Turns come to the bins: all that touch a bin
    which one of a bin's segments touches, for the nearest also the last boundary
    before those and the first after them. So segments cross the network once
    and are sorted once; turns are few and are hashed.
    """
    session = segments.sparkSession
    number = lambda c: F.floor(c / bin_width).cast("long")
    kept = [c for c in segments.columns if c not in (*keys, "speaker")]
    rows = segments.select(F.struct(*keys).alias("_key"), scan.bin_number(segments, start, bin_width).alias("_bin"), F.struct(*kept).alias("_row"))
    rows = rows.repartition(int(session.conf.get("spark.sql.shuffle.partitions")), *scan.AT)
    cores = session.sparkContext.defaultParallelism
    # a row is left of each bin: written by no more tasks than cores
    timed = F.col(start).isNotNull() & F.col(end).isNotNull()
    least, most = F.min(F.when(timed, F.least(start, end))), F.max(F.when(timed, F.greatest(start, end)))
    frames = scan.unpacked(rows.coalesce(cores), *scan.AT).groupBy(*scan.AT)
    frames = frames.agg(*[F.coalesce(number(c), F.lit(scan.FIRST_BIN)).alias(n) for c, n in ((least, "_first"), (most, "_last"))])

    said = turns.select(F.struct(*keys).alias("_key"), F.col("turn_ord").alias("_ord"), F.col("speaker").alias("_said"), F.col(start).alias("_from"), F.col(end).alias("_to"))
    spread = said.withColumn("_opens", number(F.least("_from", "_to"))).withColumn("_at", F.explode(F.sequence("_opens", number(F.greatest("_from", "_to")))))
    touched = frames.withColumn("_at", F.explode(F.sequence("_first", "_last"))).join(spread, ["_key", "_at"]).where(F.col("_at") == F.greatest("_first", "_opens"))

    ends = said.select("_key", F.explode(F.array("_from", "_to")).alias("_t"), "_ord", "_said").where("_t IS NOT NULL")
    ends = ends.groupBy("_key", number(F.col("_t")).alias("_at")).agg(F.min(F.struct(F.negative("_t").alias("_t"), "_ord", "_said")).alias("_closing"), F.min(F.struct("_t", "_ord", "_said")).alias("_opening"))
    asked = frames.select(*scan.AT, F.inline(F.array(*[F.struct(F.col(c).alias("_at"), F.lit(c).alias("_side")) for c in ("_first", "_last")])))
    line = ends.unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("_key").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_key").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_past", F.min("_closing").over(before)).withColumn("_next", F.min("_opening").over(after)).where("_side IS NOT NULL")
    near = F.when(F.col("_side") == "_first", F.struct(F.negative("_past._t").alias("_t"), "_past._ord", "_past._said")).otherwise(F.col("_next"))
    beyond = line.select(*scan.AT, near.alias("_near")).where("_near._t IS NOT NULL").select(*scan.AT, "_near._ord", "_near._said", F.col("_near._t").alias("_from"), F.col("_near._t").alias("_to"))

    turn = ["_from", "_to", "_ord", "_said"]
    touched = touched.select(*scan.AT, *turn).coalesce(cores)
    known = touched.unionByName(beyond).coalesce(cores).groupBy(*scan.AT).agg(F.collect_list(F.struct(*turn)).alias("_turns"))

    first, last = F.col(f"_row.{start}"), F.col(f"_row.{end}")
    named = F.concat(*[F.col(f"_key.{k}").cast("string") for k in keys]).isNotNull()
    there = lambda right: right.withColumnsRenamed({"_key": "_k", "_bin": "_b"}).hint("shuffle_hash")
    same = [F.col("_key") == F.col("_k"), F.col("_bin") == F.col("_b")]
    # coalesced, because else its columns would be asked to be not null here only, and turns would be read twice
    meets = [*same, F.coalesce((F.col("_from") < last) & (first < F.col("_to")) & named, F.lit(False))]
    pairs = rows.join(there(touched), meets, "left").select(*scan.AT, "_row.*", "_ord", "_said", (F.least(last, "_to") - F.greatest(first, "_from")).alias("_overlap"))
    # the first of a segment's pairs is the best, and is a row of its own if there is none
    line = Window.partitionBy(*scan.AT, start, *segment_id, end).orderBy(F.desc("_overlap"), "_ord")
    best = pairs.withColumn("_first", F.lag(F.lit(1)).over(line).isNull()).where("_first")
    first, last = F.col(start), F.col(end)
    enough = F.col("_overlap").isNotNull() & (last > first)
    if coverage:
        enough &= F.col("_overlap") * coverage[1] >= (last - first) * coverage[0]
    best = best.withColumn("speaker", F.when(enough & (F.col("_said") != ""), F.col("_said")))
    met = best.join(there(known), [*same, F.col("speaker").isNull()], "left")
    # distances are doubled to keep half milliseconds whole
    away = lambda t: F.least(F.abs(first + last - t["_from"] * 2), F.abs(first + last - t["_to"] * 2))
    nearest = F.array_min(F.transform("_turns", lambda t: F.struct(away(t).alias("d"), t["_ord"].alias("o"), t["_said"].alias("speaker"))))
    return met.select(*scan.AT, *kept, F.coalesce("speaker", nearest["speaker"], F.lit("")).alias("speaker"))


def number_islands(rows: DataFrame, line: WindowSpec, same: list[str], gap: int | None, start: str, end: str, out: str) -> DataFrame:
    """rows with the number of their island in a window's partition, from 1, by the rule of gap_islands; one sort for all of it."""
    differs = F.lag(F.lit(1)).over(line).isNull()
    for c in same:
        differs |= ~F.col(c).eqNullSafe(F.lag(c).over(line))
    running = F.sum(F.col("_new").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_new", differs)
    if gap is not None:
        # runs are numbered upwards: the greatest pair is the last run's greatest end
        latest = F.max(F.struct("_run", F.col(end).alias("_reach"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_run", running).withColumn("_latest", latest)
        upto = F.when(F.col("_latest._run") == F.col("_run"), F.col("_latest._reach"))
        rows = rows.withColumn("_new", F.col("_new") | F.coalesce(F.col(start) - upto > gap, F.lit(True)))
    return rows.withColumn(out, running).drop("_new", "_run", "_latest")


def gap_islands(rows: DataFrame, keys: list[str], same: list[str], gap: int | None, order: list[str], start: str = "s_ms", end: str = "e_ms", bin_width: int = BIN_MS) -> DataFrame:
    """rows with island, numbered from 1 in each key.

    A row joins the row before it if the columns of ``same`` are equal and, where
    ``gap`` is given, it starts no more than ``gap`` after the island's end so
    far. Within a run of equal rows the running maximum of the ends is the
    island's, because a new island starts beyond all earlier ends.

    Keys are cut into bins of ``bin_width`` of the first order column. A bin is
    carried the row before it, the greatest end since the last change of
    ``same``, and the number of islands before it.
    """
    # rows that tie in all of these are alike for what follows
    order = list(dict.fromkeys([*order, *same, *([start, end] if gap is not None else [])]))
    rows = rows.drop("island")
    line = scan.numbered(scan.packed(rows, keys, order[0], bin_width), order)
    differs = F.lit(False)
    for c in same:
        differs |= ~F.col(f"_row.{c}").eqNullSafe(F.lag(f"_row.{c}").over(scan.within(order)))
    line = line.withColumn("_new", (F.col("_nth") > 1) & differs)
    running = F.sum(F.col("_new").cast("long")).over(scan.within(order).rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumn("_run", running)
    more = {"_breaks": F.max("_run")}
    if gap is not None:
        run = scan.within(order, "_run")
        line = line.withColumns({"_reach": F.max(f"_row.{end}").over(run.rowsBetween(Window.unboundedPreceding, -1)), "_tail": F.max(f"_row.{end}").over(run.rowsBetween(Window.unboundedPreceding, 0))})
        more["_tail"] = F.max_by("_tail", "_nth")
    opens = F.lag("_bin").over(scan.bins()).isNull()
    for c in same:
        opens |= ~F.col(f"_head.{c}").eqNullSafe(F.lag("_last").over(scan.bins())[c])
    bins = scan.summaries(line, **more).withColumn("_opens", opens)
    if gap is None:
        bins = bins.withColumn("_islands", F.coalesce(F.sum(F.col("_breaks") + F.col("_opens").cast("long")).over(scan.earlier()), F.lit(0)))
        line = scan.carried(line, bins, "_opens", "_islands").withColumn("_run", F.col("_run") + F.col("_opens").cast("long"))
    else:
        bins = bins.withColumn("_since", F.sum((F.col("_opens") | (F.col("_breaks") > 0)).cast("long")).over(scan.bins()))
        bins = bins.withColumn("_reached", F.max("_tail").over(Window.partitionBy("_key", "_since").orderBy("_bin"))).withColumn("_carry", F.lag("_reached").over(scan.bins()))
        line = scan.carried(line, bins, "_opens", "_carry")
        upto = F.when((F.col("_run") == 0) & ~F.col("_opens"), F.greatest("_reach", "_carry")).otherwise(F.col("_reach"))
        changed = F.col("_new") | ((F.col("_nth") == 1) & F.col("_opens"))
        line = line.withColumn("_new", changed | F.coalesce(F.col(f"_row.{start}") - upto > gap, F.lit(True))).withColumn("_run", running)
        counts = scan.summaries(line, _breaks=F.max("_run")).where("_head IS NOT NULL")
        line = scan.carried(line, counts.withColumn("_islands", F.coalesce(F.sum("_breaks").over(scan.earlier()), F.lit(0))), "_islands")
    return scan.unpacked(line.withColumn("_island", F.col("_islands") + F.col("_run")), F.col("_island").alias("island"))


def merge_turns(turns: DataFrame, keys: list[str], gap: int, window_end: str | None = None, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Turns of one speaker at most ``gap`` apart become one. Turns are clipped to [0, window_end] first; blank or empty ones go."""
    kept = turns.where(strip("speaker") != "").withColumn(start, F.greatest(F.lit(0).cast("long"), F.col(start)))
    if window_end:
        kept = kept.withColumn(end, F.least(F.col(end), F.col(window_end)))
    islands = gap_islands(kept.where(F.col(end) > F.col(start)), keys, ["speaker"], gap, [start, end, "speaker"], start, end)
    return islands.groupBy(*keys, "island", "speaker").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_turns"))


def merge_turns_capped(turns: DataFrame, keys: list[str], least: int, gap: int, most: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Short and blank turns go first, then merging; stops once ``most`` turns stand, the last of them unextended (never before the second)."""
    kept = turns.where((strip("speaker") != "") & (F.col(end) > F.col(start)) & (F.col(end) - F.col(start) >= least))
    islands = gap_islands(kept, keys, ["speaker"], gap, [start, end], start, end)
    last = max(most, 2)
    first = F.row_number().over(Window.partitionBy(*keys, "island").orderBy(start, end)) == 1
    islands = islands.withColumn("_first", first).where((F.col("island") < last) | ((F.col("island") == last) & F.col("_first")))
    return islands.groupBy(*keys, "island", "speaker").agg(F.min(start).alias(start), F.max(end).alias(end))


def merge_speech(spans: DataFrame, keys: list[str], gap: int, least: int, pad: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Speech spans at most ``gap`` apart merge; merged ones under ``least`` go; the rest is padded on both sides from 0."""
    islands = gap_islands(spans, keys, [], gap, [start, end], start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))
    islands = islands.where(F.col(end) - F.col(start) >= least)
    return islands.select(*keys, "island", F.greatest(F.lit(0).cast("long"), F.col(start) - pad).alias(start), (F.col(end) + pad).alias(end))


def owned_words(words: DataFrame, commits: DataFrame, keys: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Words with the commit that owns their middle, clipped to the commit's analysis interval.

    commits: keys, commit, c_start, c_end, a_start, a_end. A word belongs to the
    commit with 2*c_start <= start + end < 2*c_end, after clipping.
    """
    clipped_s, clipped_e = F.greatest(start, "a_start"), F.least(end, "a_end")
    spread = words.withColumn("_bin", _bins(F.col(start), F.col(end) + 1, BIN_MS))
    commits = commits.withColumn("_bin", _bins(F.col("a_start"), F.col("a_end"), BIN_MS))
    pairs = spread.join(commits, [*keys, "_bin"]).withColumn("w_start", clipped_s).withColumn("w_end", clipped_e)
    first = F.greatest(F.floor(F.col(start) / BIN_MS), F.floor(F.col("a_start") / BIN_MS)) == F.col("_bin")
    middle = F.col("w_start") + F.col("w_end")
    return pairs.where(first & (F.col("w_end") > F.col("w_start")) & (middle >= F.col("c_start") * 2) & (middle < F.col("c_end") * 2)).drop("_bin")


def exclusive_crops(turns: DataFrame, keys: list[str], longest: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Overlapping speech goes to the earlier turn; what is left of each turn is cut into crops of at most ``longest``."""
    line = Window.partitionBy(*keys).orderBy(start, end, "turn_ord").rowsBetween(Window.unboundedPreceding, -1)
    own = turns.withColumn("_from", F.greatest(F.col(start), F.coalesce(F.max(end).over(line), F.lit(0).cast("long")))).where(F.col("_from") < F.col(end))
    cut = own.withColumn("_at", F.explode(F.expr(f"sequence(_from, {end} - 1, CAST({longest} AS BIGINT))")))
    return cut.select(*keys, "turn_ord", "speaker", F.col("_at").alias("crop_s"), F.least(F.col("_at") + longest, F.col(end)).alias("crop_e"))


def coarse_dedup(rows: DataFrame, keys: list[str], resolution: int, order: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """The first row of each (start, end, speaker) after rounding half to even to the resolution."""
    near = lambda c: (F.rint(F.col(c) / resolution) * resolution).cast("long")
    rows = rows.withColumn("k_start", near(start)).withColumn("k_end", near(end))
    # a grouped minimum rather than a window: equal keys combine before the shuffle
    rest = [c for c in rows.columns if c not in (*keys, "k_start", "k_end", "speaker")]
    first = rows.groupBy(*keys, "k_start", "k_end", "speaker").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "k_start", "k_end", "speaker", "_row.*")
