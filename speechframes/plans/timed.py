"""Queries on timed rows: speaker joins, merging, segments, windows. Each has its DuckDB equivalent beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechframes.operators import assemble, gallery, intervals, reports, sessions, updates, windows
from speechframes.plans import views
from speechframes.plans.views import CHUNKS, TURNS, WORDS

KEY = ["session_id"]
WORD_ID = ["turn", "idx"]
GAP_MS, SHORT_MS, WORD_GAP_MS = 750, 700, 1000
SLICE, CONTEXT, TAIL = 40_000, 4_000, 4_000
TURN_BIN = 16  # turns that are sorted together

BEST = """best AS (
  SELECT session_id, turn, idx, r_speaker, overlap FROM (
    SELECT w.session_id, w.turn, w.idx, t.speaker AS r_speaker, least(w.e_ms, t.e_ms) - greatest(w.s_ms, t.s_ms) AS overlap,
           row_number() OVER (PARTITION BY w.session_id, w.turn, w.idx ORDER BY least(w.e_ms, t.e_ms) - greatest(w.s_ms, t.s_ms) DESC, t.turn_ord) AS r
    FROM words w JOIN turns t ON w.session_id = t.session_id AND t.s_ms < w.e_ms AND w.s_ms < t.e_ms)
  WHERE r = 1
)"""


def islands_sql(source: str, same: str | None, gap: int | None, order: str, keep: str = "TRUE") -> str:
    """CTEs ending in ``islands``: the rows of source with their island number."""
    changed = f"lag(1) OVER k IS NULL{f' OR {same} IS DISTINCT FROM lag({same}) OVER k' if same else ''}"
    new = "r" if gap is None else f"CASE WHEN mx IS NULL OR s_ms - mx > {gap} THEN 1 ELSE 0 END"
    return f"""runs AS (
  SELECT *, CASE WHEN {changed} THEN 1 ELSE 0 END AS r FROM {source} WHERE {keep} WINDOW k AS (PARTITION BY session_id ORDER BY {order})
), runs2 AS (
  SELECT *, sum(r) OVER (PARTITION BY session_id ORDER BY {order}) AS run FROM runs
), runs3 AS (
  SELECT *, max(e_ms) OVER (PARTITION BY session_id, run ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM runs2
), islands AS (
  SELECT *, sum({new}) OVER (PARTITION BY session_id ORDER BY {order}) AS island FROM runs3
)"""


def assigned(spark, sf, default="", coverage=(1, 10)):
    return intervals.assign_by_overlap(views.words(spark, sf), views.turns(spark, sf), KEY, WORD_ID, default, coverage)


def speaker_overlap_join(spark, sf):
    return assigned(spark, sf, coverage=None).select("session_id", "turn", "idx", "speaker")


def speaker_overlap_threshold(spark, sf):
    return assigned(spark, sf, "?").groupBy("session_id", "speaker").agg(F.count("*").alias("n_words"))


def overlap_default_label(spark, sf):
    return assigned(spark, sf, "SPEAKER_00", None).groupBy("speaker").agg(F.count("*").alias("n_words"))


def nearest_turn_fallback(spark, sf):
    missing = assigned(spark, sf).where("speaker = ''").drop("speaker")
    return intervals.nearest_turn(missing, views.turns(spark, sf), KEY).select("session_id", "turn", "idx", "speaker")


NEAREST = """SELECT session_id, turn, idx, speaker FROM (
  SELECT w.session_id, w.turn, w.idx, t.speaker, row_number() OVER (PARTITION BY w.session_id, w.turn, w.idx
         ORDER BY least(abs(w.s_ms + w.e_ms - 2*t.s_ms), abs(w.s_ms + w.e_ms - 2*t.e_ms)), t.turn_ord) AS r
  FROM missing w JOIN turns t ON w.session_id = t.session_id) WHERE r = 1"""
MISSING = """missing AS (
  SELECT w.* FROM words w LEFT JOIN best b USING (session_id, turn, idx)
  WHERE b.overlap IS NULL OR b.overlap * 10 < w.e_ms - w.s_ms
)"""


def turn_merge_gap(spark, sf):
    return intervals.merge_turns(views.turns(spark, sf), KEY, GAP_MS).drop("island")


def turn_merge_dropfirst_cap(spark, sf):
    return intervals.merge_turns_capped(views.turns(spark, sf), KEY, 2000, 150, 4).drop("island")


def word_group_gap(spark, sf):
    spoken = views.words(spark, sf).withColumn("speaker", F.col("role"))
    made = assemble.word_segments(spoken, KEY, ["turn", "idx"], WORD_GAP_MS, "space", bin_width=TURN_BIN)
    return made.select("session_id", "island", "speaker", "s_ms", "e_ms", "n_words", F.md5("text").alias("text_md5"))


def vad_merge_pad(spark, sf):
    return intervals.merge_speech(views.turns(spark, sf), KEY, 400, 600, 300)


def full_segments(spark, sf, with_words=False):
    """Segments of words, each with a speaker: best overlap, else the nearest turn."""
    return assemble.speaker_segments(views.words(spark, sf), views.turns(spark, sf), KEY, WORD_ID, with_words=with_words)


FULL = f"""{TURNS}, {BEST}, {MISSING}, near AS ({NEAREST}), full_words AS (
  SELECT w.session_id, w.turn, w.idx, w.word, w.s_ms, w.e_ms, CASE WHEN b.overlap * 10 >= w.e_ms - w.s_ms THEN b.r_speaker ELSE n.speaker END AS speaker
  FROM words w LEFT JOIN best b USING (session_id, turn, idx) LEFT JOIN near n USING (session_id, turn, idx)
)"""


def speaker_segments(spark, sf):
    """Speaker-labelled segments of every session."""
    return full_segments(spark, sf).select("session_id", "island", "speaker", "s_ms", "e_ms", "n_words", "text")


SMART_TEXT = "trim(string_agg(CASE WHEN pos > 1 AND regexp_matches(word, '^[\\p{L}\\p{N}]') THEN ' ' || word ELSE word END, '' ORDER BY pos))"
SEGMENTS = f"""{FULL}, {islands_sql("full_words", "speaker", None, "s_ms, turn, idx")}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY s_ms, turn, idx) AS pos FROM islands
), segments AS (
  SELECT session_id, CAST(island AS BIGINT) AS island, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS n_words, {SMART_TEXT} AS text
  FROM placed GROUP BY session_id, island, speaker
)"""


def raw_concat_segments(spark, sf):
    spoken = views.words(spark, sf).withColumn("speaker", F.col("role"))
    made = assemble.word_segments(spoken, KEY, ["turn", "idx"], None, "raw", bin_width=TURN_BIN)
    return made.select("session_id", "island", "speaker", "s_ms", "e_ms", "n_words", F.md5("text").alias("text_md5"))


def transcript_assembly(spark, sf):
    made = assemble.transcripts(full_segments(spark, sf, with_words=True), KEY)
    n_words = F.aggregate("segments", F.lit(0), lambda a, s: a + F.size(s["words"]))
    return made.select("session_id", F.size("segments").cast("long").alias("n_segments"), n_words.cast("long").alias("n_words"), "full_text", F.round(F.col("duration_s") * 1000).cast("long").alias("end_ms"))


def shifted_segments(spark, sf):
    made = assemble.transcripts(full_segments(spark, sf, with_words=True), KEY)
    moved = made.withColumn("segments", assemble.shift_segments(F.col("segments"), F.lit(10.0)))
    return moved.select("session_id", F.posexplode("segments").alias("pos", "s")).select("session_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("s.start_s") * 1000).cast("long").alias("start_ms"), F.round(F.element_at("s.words", -1)["end_s"] * 1000).cast("long").alias("last_word_ms"))


def clean_segments(spark, sf):
    rows = views.words(spark, sf).select("session_id", "turn", "idx", F.regexp_replace("word", "^[A-Z].*$", " ").alias("text"), "s_ms", (F.col("e_ms") - 120).alias("e_ms"))
    return assemble.clean_segments(rows).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def slices(spark, sf):
    return windows.slices(views.chunks(spark, sf), KEY, SLICE).select("session_id", "slice_index", "n_samples", "n_parts", "base_sample", "flush_reason")


def slice_parts(spark, sf):
    return windows.slice_parts(views.chunks(spark, sf), KEY, SLICE)


def slices_sql(size: int) -> str:
    return f"""{CHUNKS}, placed AS (
  SELECT *, sum(n_samples) OVER (PARTITION BY session_id ORDER BY seq) AS last_s FROM chunks
), parts AS (
  SELECT session_id, seq, last_s - n_samples AS first_s, last_s, unnest(generate_series(CAST((last_s - n_samples) // {size} AS BIGINT), CAST((last_s - 1) // {size} AS BIGINT))) AS slice_index
  FROM placed WHERE n_samples > 0
)"""


SLICES_SQL = """, summed AS (
  SELECT session_id, slice_index, CAST(sum(least(last_s, (slice_index + 1) * {0}) - greatest(first_s, slice_index * {0})) AS BIGINT) AS n_samples, count(*) AS n_parts
  FROM parts GROUP BY session_id, slice_index)"""


def epochs(spark, sf):
    made = windows.slices(views.chunks(spark, sf), KEY, 160_000)
    return made.select("session_id", F.col("slice_index").alias("epoch"), "n_samples", (F.col("base_sample") + F.col("n_samples")).alias("end_sample"))


def totals(spark, sf):
    return views.chunks(spark, sf).groupBy("session_id").agg(F.sum("n_samples").alias("n_samples"))


def commit_windows(spark, sf):
    return windows.commit_windows(totals(spark, sf), SLICE, CONTEXT, TAIL).drop("n_samples")


COMMITS_SQL = f"""{CHUNKS}, totals AS (SELECT session_id, CAST(sum(n_samples) AS BIGINT) AS n_samples FROM chunks GROUP BY session_id), k AS (
  SELECT session_id, n_samples, unnest(generate_series(0, (n_samples - 1) // {SLICE})) AS "commit" FROM totals WHERE n_samples > 0
), c AS (SELECT *, "commit" * {SLICE} AS c_start, least("commit" * {SLICE} + {SLICE}, n_samples) AS c_end FROM k)
SELECT session_id, "commit", c_start, c_end, greatest(0, c_start - {CONTEXT}) AS a_start, least(c_end + {CONTEXT}, n_samples) AS a_end,
       CASE WHEN n_samples >= c_start + {SLICE} + {CONTEXT} THEN 'streaming' ELSE 'end' END AS ready
FROM c WHERE c_end - c_start = {SLICE} OR c_end - c_start >= {TAIL}"""


def overlap_windows(spark, sf):
    return windows.overlap_windows(totals(spark, sf), 80_000, 16_000).drop("n_samples")


def frames(spark, sf):
    made = windows.frames(views.chunks(spark, sf), 2_560)
    return made.groupBy("session_id", "seq").agg(F.count("*").alias("n_frames"), F.sum("frame_samples").alias("n_samples"), F.min("frame_samples").alias("least"))


def word_commits(spark, sf):
    """Commits of 10 s with 1 s of context over the words' clock."""
    ends = views.words(spark, sf).groupBy("session_id").agg(F.max("e_ms").cast("long").alias("n_samples"))
    return windows.commit_windows(ends, 10_000, 1_000, 250)


def midpoint_owner(spark, sf):
    own = intervals.owned_words(views.words(spark, sf), word_commits(spark, sf), KEY)
    return own.select("session_id", "turn", "idx", "commit", "w_start", "w_end")


def centre_owner(spark, sf):
    return windows.centre_owner(views.words(spark, sf), 8_000).groupBy("session_id", "owner").agg(F.count("*").alias("n_words"))


def exclusive_crops(spark, sf):
    return intervals.exclusive_crops(views.turns(spark, sf), KEY, 30_000)


def coarse_key_dedup(spark, sf):
    spoken = views.words(spark, sf).withColumn("speaker", F.col("role"))
    made = intervals.coarse_dedup(spoken, KEY, 1_500, ["s_ms", "turn", "idx"])
    return made.select("session_id", "k_start", "k_end", "speaker", "turn", "idx")


def coverage_fallback(spark, sf):
    turned = views.turns(spark, sf)
    return assemble.aligned_or_raw(turned, views.words(spark, sf), KEY)


def distinct_speakers(spark, sf):
    return reports.speaker_counts(assigned(spark, sf), KEY)


def speech_gate(spark, sf):
    return reports.speech_gate(views.turns(spark, sf), KEY, 100_000)


def speaker_budget(spark, sf):
    return gallery.speaker_budget(views.turns(spark, sf), KEY, 700, 10_000).select("session_id", "speaker", "turn_ord", "take")


def cluster_map(spark, sf):
    names = views.turns(spark, sf).groupBy("session_id", "speaker").agg(F.count("*").alias("n")).where("n > 1")
    names = names.select("session_id", "speaker", F.when(F.col("n") % 2 == 0, F.concat(F.lit("person_"), F.col("session_id"))).otherwise("").alias("name"))
    return gallery.apply_names(assigned(spark, sf), names, KEY).groupBy("session_id", "speaker").agg(F.count("*").alias("n_words"))


def srt_export(spark, sf):
    """Numbered subtitle cues of every session."""
    from speechframes.sources import sinks

    spoken = views.words(spark, sf).withColumn("speaker", F.col("role"))
    return sinks.srt_cues(assemble.word_segments(spoken, KEY, ["turn", "idx"], WORD_GAP_MS, bin_width=TURN_BIN), KEY).select("session_id", "cue", "cue_text")


WORD_SEGMENTS = f"""{WORDS}, spoken AS (SELECT *, role AS speaker FROM words), {islands_sql("spoken", "speaker", WORD_GAP_MS, "turn, idx")}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY turn, idx) AS pos FROM islands
)"""
STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"

QUERIES = {f.__name__: f for f in (
    speaker_overlap_join, speaker_overlap_threshold, overlap_default_label, nearest_turn_fallback, turn_merge_gap, turn_merge_dropfirst_cap, word_group_gap, vad_merge_pad,
    speaker_segments, raw_concat_segments, transcript_assembly, shifted_segments, clean_segments, slices, slice_parts, epochs, commit_windows, overlap_windows, frames, midpoint_owner,
    centre_owner, exclusive_crops, coarse_key_dedup, coverage_fallback, distinct_speakers, speech_gate, speaker_budget, cluster_map, srt_export,
)}

ASSIGNED = f"""{TURNS}, {BEST}, assigned AS (
  SELECT w.*, CASE WHEN b.overlap * 10 >= w.e_ms - w.s_ms THEN b.r_speaker ELSE '' END AS speaker FROM words w LEFT JOIN best b USING (session_id, turn, idx)
)"""

ORACLES = {
    "speaker_overlap_join": f"WITH {TURNS}, {BEST} SELECT w.session_id, w.turn, w.idx, coalesce(b.r_speaker, '') AS speaker FROM words w LEFT JOIN best b USING (session_id, turn, idx)",
    "speaker_overlap_threshold": f"WITH {ASSIGNED} SELECT session_id, CASE WHEN speaker = '' THEN '?' ELSE speaker END AS speaker, count(*) AS n_words FROM assigned GROUP BY ALL",
    "overlap_default_label": f"WITH {TURNS}, {BEST} SELECT coalesce(b.r_speaker, 'SPEAKER_00') AS speaker, count(*) AS n_words FROM words w LEFT JOIN best b USING (session_id, turn, idx) GROUP BY ALL",
    "nearest_turn_fallback": f"WITH {TURNS}, {BEST}, {MISSING} {NEAREST}",
    "turn_merge_gap": f"WITH {TURNS}, clipped AS (SELECT session_id, turn_ord, speaker, greatest(0, s_ms) AS s_ms, e_ms FROM turns), {islands_sql('clipped', 'speaker', GAP_MS, 's_ms, e_ms, speaker', 'e_ms > s_ms')} SELECT session_id, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS n_turns FROM islands GROUP BY session_id, island, speaker",
    "turn_merge_dropfirst_cap": f"WITH {TURNS}, {islands_sql('turns', 'speaker', 150, 's_ms, e_ms', 'e_ms > s_ms AND e_ms - s_ms >= 2000')}, f AS (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY s_ms, e_ms) AS nth FROM islands) SELECT session_id, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM f WHERE island < 4 OR (island = 4 AND nth = 1) GROUP BY session_id, island, speaker",
    "word_group_gap": f"WITH {WORD_SEGMENTS} SELECT session_id, CAST(island AS BIGINT) AS island, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS n_words, md5(trim(string_agg(word, ' ' ORDER BY pos))) AS text_md5 FROM placed GROUP BY session_id, island, speaker",
    "vad_merge_pad": f"WITH {TURNS}, {islands_sql('turns', None, 400, 's_ms, e_ms')} SELECT session_id, CAST(island AS BIGINT) AS island, greatest(0, min(s_ms) - 300) AS s_ms, max(e_ms) + 300 AS e_ms FROM islands GROUP BY session_id, island HAVING max(e_ms) - min(s_ms) >= 600",
    "speaker_segments": f"WITH {SEGMENTS} SELECT * FROM segments WHERE text <> ''",
    "raw_concat_segments": f"WITH {WORDS}, spoken AS (SELECT *, role AS speaker FROM words), {islands_sql('spoken', 'speaker', None, 'turn, idx')} SELECT session_id, CAST(island AS BIGINT) AS island, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms, count(*) AS n_words, md5(trim(string_agg(word, '' ORDER BY turn, idx))) AS text_md5 FROM islands GROUP BY session_id, island, speaker",
    "transcript_assembly": f"WITH {SEGMENTS} SELECT session_id, count(*) AS n_segments, CAST(sum(n_words) AS BIGINT) AS n_words, string_agg(text, ' ' ORDER BY s_ms, island) AS full_text, max(e_ms) AS end_ms FROM segments WHERE text <> '' GROUP BY session_id",
    "shifted_segments": f"WITH {SEGMENTS}, lastw AS (SELECT session_id, island, arg_max(e_ms, pos) AS le FROM placed GROUP BY ALL) SELECT s.session_id, row_number() OVER (PARTITION BY s.session_id ORDER BY s_ms, s.island) - 1 AS pos, s_ms + 10000 AS start_ms, le + 10000 AS last_word_ms FROM segments s JOIN lastw USING (session_id, island) WHERE text <> ''",
    "clean_segments": f"WITH {WORDS}, t AS (SELECT session_id, trim(regexp_replace(word, '^[A-Z].*$', ' ')) AS text, s_ms, e_ms - 120 AS e_ms FROM words) SELECT session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t WHERE text <> '' AND e_ms > s_ms GROUP BY session_id",
    "slices": f"WITH {slices_sql(SLICE)}{SLICES_SQL.format(SLICE)} SELECT session_id, slice_index, n_samples, n_parts, slice_index * {SLICE} AS base_sample, CASE WHEN n_samples = {SLICE} THEN 'slice' ELSE 'idle' END AS flush_reason FROM summed",
    "slice_parts": f"WITH {slices_sql(SLICE)} SELECT session_id, seq, slice_index, CAST((greatest(first_s, slice_index * {SLICE}) - first_s) * 2 AS BIGINT) AS byte_from, CAST((least(last_s, (slice_index + 1) * {SLICE}) - first_s) * 2 AS BIGINT) AS byte_to FROM parts",
    "epochs": f"WITH {slices_sql(160_000)}{SLICES_SQL.format(160_000)} SELECT session_id, slice_index AS epoch, n_samples, slice_index * 160000 + n_samples AS end_sample FROM summed",
    "commit_windows": f"WITH {COMMITS_SQL}",
    "overlap_windows": f"WITH {CHUNKS}, totals AS (SELECT session_id, CAST(sum(n_samples) AS BIGINT) AS n FROM chunks GROUP BY session_id), w AS (SELECT session_id, unnest(generate_series(0, (n - 80000) // 64000)) AS window_index FROM totals WHERE n >= 80000) SELECT session_id, window_index, window_index * 64000 AS w_start, window_index * 64000 + 80000 AS w_end FROM w",
    "frames": f"WITH {CHUNKS}, f AS (SELECT session_id, seq, n_samples, unnest(generate_series(0, n_samples - 1, 2560)) AS p FROM chunks WHERE n_samples > 0) SELECT session_id, seq, count(*) AS n_frames, CAST(sum(least(2560, n_samples - p)) AS BIGINT) AS n_samples, min(least(2560, n_samples - p)) AS least FROM f GROUP BY session_id, seq",
    "midpoint_owner": f"""WITH {WORDS}, ends AS (SELECT session_id, max(e_ms) AS n FROM words GROUP BY session_id), k AS (SELECT session_id, n, unnest(generate_series(0, (n - 1) // 10000)) AS "commit" FROM ends),
c AS (SELECT *, "commit" * 10000 AS c_start, least("commit" * 10000 + 10000, n) AS c_end FROM k), cw AS (SELECT *, greatest(0, c_start - 1000) AS a_start, least(c_end + 1000, n) AS a_end FROM c WHERE c_end - c_start = 10000 OR c_end - c_start >= 250),
j AS (SELECT w.session_id, w.turn, w.idx, "commit", c_start, c_end, greatest(s_ms, a_start) AS w_start, least(e_ms, a_end) AS w_end FROM words w JOIN cw ON w.session_id = cw.session_id AND w.s_ms < a_end AND a_start < w.e_ms)
SELECT session_id, turn, idx, "commit", w_start, w_end FROM j WHERE w_end > w_start AND w_start + w_end >= 2 * c_start AND w_start + w_end < 2 * c_end""",
    "centre_owner": f"WITH {WORDS} SELECT session_id, (s_ms + e_ms) // 16000 AS owner, count(*) AS n_words FROM words GROUP BY ALL",
    "exclusive_crops": f"WITH {TURNS}, o AS (SELECT *, greatest(s_ms, coalesce(max(e_ms) OVER (PARTITION BY session_id ORDER BY s_ms, e_ms, turn_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS f FROM turns), c AS (SELECT session_id, turn_ord, speaker, e_ms, unnest(generate_series(f, e_ms - 1, 30000)) AS crop_s FROM o WHERE f < e_ms) SELECT session_id, turn_ord, speaker, crop_s, least(crop_s + 30000, e_ms) AS crop_e FROM c",
    "coarse_key_dedup": f"WITH {WORDS}, r AS (SELECT *, CAST(round_even(s_ms / 1500, 0) * 1500 AS BIGINT) AS k_start, CAST(round_even(e_ms / 1500, 0) * 1500 AS BIGINT) AS k_end FROM words) SELECT session_id, k_start, k_end, role AS speaker, turn, idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k_start, k_end, role ORDER BY s_ms, turn, idx) AS n FROM r) WHERE n = 1",
    "coverage_fallback": f"WITH {TURNS}, a AS (SELECT session_id, CAST(sum(greatest(0, e_ms - s_ms)) AS BIGINT) AS asr_ms FROM turns GROUP BY ALL), b AS (SELECT session_id, CAST(sum(greatest(0, e_ms - s_ms)) AS BIGINT) AS aligned_ms FROM words GROUP BY ALL) SELECT session_id, asr_ms, coalesce(aligned_ms, 0) AS aligned_ms, CASE WHEN asr_ms = 0 OR coalesce(aligned_ms, 0) * 10 >= asr_ms * 7 THEN 'aligned' ELSE 'asr' END AS use FROM a LEFT JOIN b USING (session_id)",
    "distinct_speakers": f"WITH {ASSIGNED} SELECT session_id, count(*) AS n_segments, count(DISTINCT nullif(speaker, '')) AS n_speakers, count(nullif(speaker, '')) AS n_assigned, count(DISTINCT nullif(speaker, '')) >= 2 AS split_mode FROM assigned GROUP BY session_id",
    "speech_gate": f"WITH {TURNS} SELECT session_id, CAST(sum(greatest(0, e_ms - s_ms)) AS BIGINT) AS speech_ms, sum(greatest(0, e_ms - s_ms)) >= 100000 AS passes FROM turns GROUP BY session_id",
    "speaker_budget": f"WITH {TURNS}, l AS (SELECT *, greatest(0, e_ms - s_ms) AS len FROM turns), u AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY session_id, speaker ORDER BY s_ms, e_ms, turn_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(len) OVER (PARTITION BY session_id, speaker) AS total FROM l) SELECT session_id, speaker, turn_ord, CAST(greatest(0, least(len, 10000 - used)) AS BIGINT) AS take FROM u WHERE total >= 700 AND greatest(0, least(len, 10000 - used)) > 0",
    "cluster_map": f"WITH {ASSIGNED}, names AS (SELECT session_id, speaker, CASE WHEN count(*) % 2 = 0 THEN 'person_' || session_id ELSE '' END AS name FROM turns GROUP BY session_id, speaker HAVING count(*) > 1) SELECT a.session_id, coalesce(nullif(n.name, ''), a.speaker) AS speaker, count(*) AS n_words FROM assigned a LEFT JOIN names n ON a.session_id = n.session_id AND a.speaker = n.speaker GROUP BY ALL",
    "srt_export": f"WITH {WORD_SEGMENTS}, seg AS (SELECT session_id, island, any_value(speaker) AS speaker, min(s_ms) AS s, max(e_ms) AS e, {SMART_TEXT} AS text FROM placed GROUP BY session_id, island), cues AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, island) AS cue FROM seg WHERE trim(text) <> '') SELECT session_id, cue, CAST(cue AS VARCHAR) || chr(10) || {STAMP.format('s')} || ' --> ' || {STAMP.format('e')} || chr(10) || speaker || ': ' || text || chr(10) AS cue_text FROM cues",
}
