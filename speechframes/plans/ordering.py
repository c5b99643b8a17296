"""Queries on ordered jobs and audio. Where SQL can say it, the DuckDB equivalent stands beside."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from speechframes.operators import ordered
from speechframes.plans import views
from speechframes.plans.streams import KINDS, kinds
from speechframes.plans.views import WORDS
from speechframes.sources import wav

KEY = ["session_id"]


def text_merge(spark, sf):
    """Every turn as an epoch that repeats the last forty characters of the turn before it."""
    line = Window.partitionBy("conv_id").orderBy("turn")
    rows = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.concat_ws(" ", F.trim(F.right(F.lag(F.trim("text")).over(line), F.lit(40))), F.trim("text")).alias("text"))
    return ordered.merge_epochs(rows, KEY, ["turn"], "session_id long")


def text_restore(spark, sf):
    """Words without punctuation, and what the turn's text restores of them."""
    plain = views.words(spark, sf).withColumn("plain", F.regexp_replace("word", r"[^\p{L}\p{N}]+", ""))
    at = lambda c: (F.col(c) - F.col("turn") * 20000) / 1000
    listed = plain.groupBy("session_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", at("s_ms").alias("start_s"), at("e_ms").alias("end_s"), F.col("plain").alias("text")))), lambda w: w.dropFields("idx")).alias("words"))
    said = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("transcript"))
    crops = said.join(listed, ["session_id", "turn"]).withColumn("duration_s", F.lit(1e6))
    made = ordered.restore_text(crops, ["session_id", "turn"])
    return made.groupBy("session_id", "turn").agg(F.count("text").alias("n_words"), F.max("reason").alias("reason"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), "")).alias("text_md5"))


def native_turns(spark, sf):
    """Turns of each final: the native speaker tag changes every seven words."""
    rows = views.words(spark, sf).withColumn("speaker", ((F.expr("idx div 7") + F.col("turn")) % 3).cast("int"))
    word = F.struct("idx", F.col("word").alias("text"), (F.col("s_ms") / 1000).alias("start_s"), (F.col("e_ms") / 1000).alias("end_s"), "speaker")
    listed = rows.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(word)).alias("words"), F.min(F.col("s_ms") / 1000).alias("start_s"), F.max(F.col("e_ms") / 1000).alias("end_s"))
    said = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    made = ordered.native_turns(said.join(listed, ["session_id", "turn"]), ["session_id", "turn"])
    return made.select("session_id", "turn", "pos", "speaker", F.rint(F.col("start_s") * 1000).cast("long").alias("start_ms"), F.rint(F.col("end_s") * 1000).cast("long").alias("end_ms"))


def new_words(spark, sf):
    rows = views.words(spark, sf).withColumn("window", F.expr("s_ms div 4000")).withColumn("idx", F.col("turn") * 100_000 + F.col("idx"))
    return ordered.new_words(rows, KEY, "session_id long", "window", ["s_ms", "idx"])


def forced_endpoint(spark, sf):
    return ordered.forced_endpoints(kinds(spark, sf).select("session_id", "seq", "n_samples", "kind"), KEY, "session_id long", ["seq"], 30_000)


def partial_gate(spark, sf):
    rows = kinds(spark, sf).withColumn("speech", F.col("event_type") != "error").select("session_id", "seq", "n_samples", F.expr("seq * 400000").alias("ts_us"), "text", "speech")
    return ordered.partial_updates(rows, KEY, "session_id long", ["seq"])


RATES = (8_000, 16_000, 22_050, 44_100)


def riff_files(spark, sf):
    """A WAV file for each event, in turns of four rates, four widths, mono and stereo; every fifth one is cut short.

    8 and 16 bit files hold a constant tone, wider ones a ramp of one step of
    2**-23 a sample.
    """
    import numpy as np

    from speechframes.functions import audio

    def content(event: int, n: int) -> bytes:
        width, channels = event // 4 % 4 + 1, event // 16 % 2 + 1
        if width < 3:
            pcm = (b"\xa0" if width == 1 else b"\x10\x20") * (n * channels)
        else:
            ramp = np.repeat(np.arange(n, dtype=np.int64) << 8, channels).astype("<i4")
            pcm = ramp.view(np.uint8).reshape(-1, 4)[:, 4 - width :].tobytes()
        return audio.riff(pcm, RATES[event % 4], width, channels)[: None if event % 5 else -3]

    def made(batches):
        for batch in batches:
            for event, n in zip(batch.column("event_id").to_pylist(), batch.column("n_samples").to_pylist(), strict=True):
                yield {"path": str(event), "content": content(event, n)}

    schema = "path string, content binary"
    kind = to_arrow_schema(StructType.fromDDL(schema))
    return views.chunks(spark, sf).select("event_id", "n_samples").mapInArrow(lambda batches: wav.in_pieces(made(batches), kind, "content"), schema)


def wav_scan(spark, sf):
    made = wav.scan_wavs(riff_files(spark, sf))
    return made.select(F.col("path").cast("long").alias("event_id"), F.when(F.col("reason").isNull(), F.col("n_frames")).alias("n_frames"), "reason", F.octet_length("pcm").cast("long").alias("n_bytes"))


def resample(spark, sf):
    made = wav.normalise_audio(riff_files(spark, sf))
    return made.select(F.col("path").cast("long").alias("event_id"), "n_samples", F.round("level", 4).alias("level"), "reason")


QUERIES = {f.__name__: f for f in (text_merge, text_restore, native_turns, new_words, forced_endpoint, partial_gate, wav_scan, resample)}

WAVS = """f AS (SELECT event_id, CAST(floor(value*100) AS BIGINT) AS n, event_id % 5 = 0 AS cut, [8000, 16000, 22050, 44100][event_id % 4 + 1] AS rate, event_id // 4 % 4 + 1 AS width, event_id // 16 % 2 + 1 AS channels FROM events),
w AS (SELECT *, CASE WHEN cut THEN 'wrong-length' WHEN n = 0 THEN 'frames' WHEN n > 60 * rate THEN 'too-long' END AS reason FROM f)"""
# the ramp read every n / m samples; past its last sample the last one holds
LEVELS = """r AS (SELECT *, CAST(round_even(n * 16000 / rate, 0) AS BIGINT) AS m FROM w),
j AS (SELECT *, n * 1.0 / m AS pace, CAST(floor((n - 1) * m / n) AS BIGINT) AS k FROM r WHERE m > 1 AND reason IS NULL),
l AS (SELECT event_id, CASE width WHEN 1 THEN 0.25 WHEN 2 THEN 8208 / 32768 ELSE sqrt((pace * pace * k * (k + 1) * (2 * k + 1) / 6 + (m - 1 - k) * (n - 1.0) * (n - 1.0)) / m) / 8388608 END AS level FROM j)"""
# a window's words count against the ends of the words that earlier windows gave
NOVEL = f"""{WORDS}, w AS (SELECT session_id, s_ms // 4000 AS win, s_ms, e_ms, turn * 100000 + idx AS idx, word FROM words),
steps AS (SELECT session_id, win, row_number() OVER (PARTITION BY session_id ORDER BY win) AS k FROM (SELECT DISTINCT session_id, win FROM w)),
listed AS (SELECT session_id, k, s_ms, e_ms FROM w JOIN steps USING (session_id, win)),
said(session_id, k, printed) AS (SELECT session_id, k, CAST(0 AS BIGINT) FROM steps WHERE k = 1
  UNION ALL SELECT p.session_id, p.k + 1, greatest(p.printed, CAST(coalesce(max(l.e_ms) FILTER (WHERE l.s_ms > p.printed + 1), 0) AS BIGINT)) FROM said p JOIN listed l ON l.session_id = p.session_id AND l.k = p.k GROUP BY p.session_id, p.k, p.printed)"""
# each step reads the session's next chunk; seq is gapless
FORCED = f"""{KINDS}, f(session_id, seq, forced, since_final) AS (SELECT DISTINCT session_id, CAST(-1 AS BIGINT), FALSE, CAST(0 AS BIGINT) FROM kinds
  UNION ALL SELECT c.session_id, c.seq, c.kind <> 'FINAL' AND f.since_final + c.n_samples >= 30000, CASE WHEN c.kind = 'FINAL' OR f.since_final + c.n_samples >= 30000 THEN 0 ELSE f.since_final + c.n_samples END
  FROM f JOIN kinds c ON c.session_id = f.session_id AND c.seq = f.seq + 1)"""
# chunks come 0.4 s apart, so the clock is never reset; begun is what was committed before the chunk, commits how many windows it completes
GATED = f"""{KINDS}, c AS (SELECT session_id, seq, n_samples, CASE WHEN event_type = 'error' THEN '' ELSE text END AS said, sum(n_samples) OVER (PARTITION BY session_id ORDER BY seq) AS ingested FROM kinds),
e AS (SELECT session_id, seq, said, CAST(ingested AS BIGINT) AS ingested, seq * 400000 - CAST(ingested AS BIGINT) * 1000000 // 16000 > 2000000 AS lagging FROM c),
g(session_id, seq, begun, ingested, commits, emitted_at, shown, last_text) AS (SELECT DISTINCT session_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), '' FROM e
  UNION ALL SELECT session_id, seq, begun, ingested, commits, CASE WHEN due THEN ingested ELSE emitted_at END, CASE WHEN due AND said NOT IN ('', last_text) THEN said END,
    CASE WHEN commits > 0 THEN '' WHEN due AND said <> '' THEN said ELSE last_text END
  FROM (SELECT e.session_id, e.seq, e.said, e.ingested, g.emitted_at, g.last_text, g.begun + g.commits * 160000 AS begun, greatest(0, (e.ingested - g.begun - g.commits * 160000 - 16000) // 160000) AS commits,
    NOT e.lagging AND e.ingested - g.emitted_at >= 11200 AND e.ingested - g.begun - g.commits * 160000 BETWEEN 24000 AND 159999 AS due
    FROM g JOIN e ON e.session_id = g.session_id AND e.seq = g.seq + 1))"""
# echo: characters that the text repeats of what was said (eight at least); again: words, where no echo is found
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BARE = r"list_transform({}, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g'))"
MERGED = f"""t AS (SELECT conv_id AS session_id, turn, row_number() OVER line AS k, {STRIP.format("concat_ws(' ', trim(right(lag(trim(text)) OVER line, 40)), trim(text))")} AS new FROM conversations WINDOW line AS (PARTITION BY conv_id ORDER BY turn)),
m(session_id, k, turn, novel, said) AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '' FROM t
  UNION ALL SELECT session_id, k, CAST(turn AS BIGINT), {STRIP.format("CASE WHEN starts_with(whole, old) THEN substr(whole, length(old) + 1) ELSE whole END")}, whole
  FROM (SELECT *, CASE WHEN old = '' OR new = '' THEN old || new WHEN echo >= 8 THEN {STRIP.format("old || substr(new, echo + 1)")} WHEN again > 0 THEN array_to_string(list_concat(olds, news[again + 1:]), ' ') ELSE old || ' ' || new END AS whole
  FROM (SELECT *, coalesce(list_max(list_filter(range(1, least(len(olds), len(news)) + 1), lambda j: bare_olds[-j:] = bare_news[:j] AND NOT list_contains(bare_news[:j], ''))), 0) AS again
  FROM (SELECT *, {BARE.format("olds")} AS bare_olds, {BARE.format("news")} AS bare_news
  FROM (SELECT t.session_id, t.k, t.turn, m.said AS old, t.new, string_split_regex(m.said, '\\s+') AS olds, string_split_regex(t.new, '\\s+') AS news,
    coalesce(list_max(list_filter(range(8, least(length(m.said), length(t.new)) + 1), lambda n: lower(right(m.said, n)) = lower(left(t.new, n)))), 0) AS echo
    FROM m JOIN t ON t.session_id = m.session_id AND t.k = m.k + 1)))))"""
ORACLES = {
    "text_merge": f"WITH RECURSIVE {MERGED} SELECT session_id, turn, novel, length(said) AS committed_chars, right(said, 200) AS context FROM m WHERE k > 0",
    "new_words": f"WITH RECURSIVE {NOVEL} SELECT w.session_id, w.win AS \"window\", w.s_ms, w.idx, w.word FROM w JOIN steps USING (session_id, win) JOIN said USING (session_id, k) WHERE w.s_ms > said.printed + 1",
    "forced_endpoint": f"WITH RECURSIVE {FORCED} SELECT * FROM f WHERE seq >= 0",
    "partial_gate": f"""WITH RECURSIVE {GATED} SELECT session_id, seq, 'PARTIAL' AS kind, begun AS start_sample, ingested AS end_sample, shown AS text FROM g WHERE shown IS NOT NULL
UNION ALL SELECT session_id, seq, 'FINAL', begun + i * 160000, begun + (i + 1) * 160000, '' FROM g, LATERAL (SELECT unnest(range(commits)) AS i)""",
    "text_restore": f"WITH {WORDS}, n AS (SELECT session_id, turn, count(*) AS n_words FROM words WHERE regexp_replace(word, '[^\\p{{L}}\\p{{N}}]+', '', 'g') <> '' GROUP BY ALL) SELECT session_id, n.turn, n_words, CAST(NULL AS VARCHAR) AS reason, md5(text) AS text_md5 FROM n JOIN conversations c ON c.conv_id = n.session_id AND c.turn = n.turn",
    "native_turns": f"""WITH {WORDS}, t AS (SELECT *, (idx // 7 + turn) % 3 AS tag FROM words), g AS (SELECT session_id, turn, idx // 7 AS pos, tag, min(s_ms) AS s, max(e_ms) AS e FROM t GROUP BY ALL),
n AS (SELECT *, lead(s) OVER (PARTITION BY session_id, turn ORDER BY pos) AS nx FROM g) SELECT session_id, turn, CAST(pos AS BIGINT) AS pos, CASE WHEN tag = 0 THEN '' ELSE printf('SPEAKER_%02d', tag - 1) END AS speaker, s AS start_ms, least(e, coalesce(nx, e)) AS end_ms FROM n""",
    "wav_scan": f"WITH {WAVS} SELECT event_id, CASE WHEN reason IS NULL THEN n END AS n_frames, reason, CASE WHEN reason IS NULL THEN n * width * channels END AS n_bytes FROM w",
    "resample": f"WITH {WAVS}, {LEVELS} SELECT event_id, CASE WHEN reason IS NULL THEN CASE WHEN m > 1 THEN m ELSE 0 END END AS n_samples, CASE WHEN reason IS NULL THEN round(coalesce(level, 0.0), 4) END AS level, reason FROM r LEFT JOIN l USING (event_id)",
}
