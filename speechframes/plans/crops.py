"""Queries on audio of turns and on admission. Each has its DuckDB equivalent beside it; audio is hexadecimal text there."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechframes.operators import crops, ordered, reports
from speechframes.plans import jobs, views
from speechframes.plans.timed import KEY, islands_sql
from speechframes.plans.views import CHUNKS

LEAST, GAP, MOST, LONGEST = 60, 20, 4, 1500
BUDGET_LEAST, BUDGET = 150, 400


def audio(spark, sf):
    """Every turn's text as the bytes of one chunk; odd ones end in half a sample, which is left out."""
    return views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text").cast("binary").alias("pcm"))


def spans(spark, sf):
    """Turns in samples; some begin before the audio, overlap, or reach beyond its end."""
    start = F.col("turn") * 90 + (F.col("conv_id") % 7) * 3 - 5
    end = start + 40 + (F.col("conv_id") * 7 + F.col("turn") * 13) % 300
    return views.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("turn_ord"), F.col("role").alias("speaker"), start.cast("long").alias("s_ms"), end.cast("long").alias("e_ms"))


def samples(spark, sf):
    return spans(spark, sf).withColumnsRenamed({"s_ms": "s", "e_ms": "e"})


def turn_audio(spark, sf):
    made = crops.turn_audio(audio(spark, sf), samples(spark, sf), KEY, bin_samples=512)
    return made.select("session_id", "turn_ord", "speaker", "n_samples", F.sha2("pcm", 256).alias("sha256"))


def speaker_audio(spark, sf):
    made = crops.speaker_audio(audio(spark, sf), samples(spark, sf), KEY, BUDGET_LEAST, BUDGET, bin_samples=512)
    return made.select("session_id", "speaker", "n_samples", F.sha2("pcm", 256).alias("sha256"))


def hear(pcm: bytes) -> list[tuple[int, int, str]]:
    """Stands for a speech model: the first and last bytes of a crop in either half of it, or nothing where the first byte is odd."""
    n = len(pcm) // 2
    if pcm[0] % 2:
        return []
    return [(0, n // 2, pcm[:4].hex()), (n // 2, n, pcm[-4:].hex())]


def turn_transcripts(spark, sf):
    """Sessions split by turn, each crop heard by itself; the others, and those whose crops were all empty, by overlap."""
    asr = views.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), (F.col("turn") * 90).cast("long").alias("s_ms"), (F.col("turn") * 90 + 80).cast("long").alias("e_ms"), F.concat(F.lit("said "), F.col("turn")).alias("text")
    )
    names = spans(spark, sf).where("session_id % 2 = 0").select("session_id", "speaker", F.concat(F.lit("person_"), F.col("session_id"), F.lit("_"), F.col("speaker")).alias("name")).distinct()
    return jobs.transcribe_by_turn(asr, spans(spark, sf), KEY, "session_id long", audio(spark, sf), hear, names, LONGEST, LEAST, GAP, MOST, rate=1000)


def admission_replay(spark, sf):
    """Which events of a tenant find one of three slots free."""
    opens = views.chunks(spark, sf).select("tenant_id", "event_id", F.col("ts_us").alias("at_us"), (F.col("ts_us") + F.col("n_samples") * 100_000).alias("until_us"))
    return reports.admissions(opens, ["tenant_id"], "tenant_id long", "event_id", 3)


TTL_US = 6 * 3_600_000_000


def gallery_freshness(spark, sf):
    """A tenant's gallery is enrolled anew at each signup, invalidated at each error, and used by all other events."""
    kind = F.when(F.col("event_type") == "signup", "gallery").when(F.col("event_type") == "error", "invalidate").otherwise("use")
    rows = views.chunks(spark, sf).select("tenant_id", "ts_us", "event_id", kind.alias("kind"), F.col("event_id").alias("version"))
    return ordered.gallery_in_use(rows, "tenant_id long", ["ts_us", "event_id"], TTL_US)


QUERIES = {f.__name__: f for f in (turn_audio, speaker_audio, turn_transcripts, admission_replay, gallery_freshness)}

AUDIO = """audio AS (
  SELECT session_id, string_agg(substr(x, 1, length(x) // 4 * 4), '' ORDER BY turn) AS x, CAST(sum(length(x) // 4) AS BIGINT) AS total
  FROM (SELECT conv_id AS session_id, turn, hex(encode(coalesce(text, ''))) AS x FROM conversations) GROUP BY session_id
), spans AS (
  SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS turn_ord, role AS speaker, CAST(turn * 90 + (conv_id % 7) * 3 - 5 AS BIGINT) AS s_ms,
         CAST(turn * 90 + (conv_id % 7) * 3 + 35 + (conv_id * 7 + turn * 13) % 300 AS BIGINT) AS e_ms
  FROM conversations
), held AS (
  SELECT session_id, turn_ord, speaker, greatest(0, s_ms) AS s, least(e_ms, total) AS e, x FROM spans JOIN audio USING (session_id) WHERE least(e_ms, total) > greatest(0, s_ms)
)"""
HEARD = f"""{AUDIO}, voices AS (
  SELECT session_id FROM spans JOIN audio USING (session_id) WHERE speaker <> '' GROUP BY session_id, total HAVING count(DISTINCT speaker) >= 2 AND total <= {LONGEST}
), open AS (SELECT spans.* FROM spans JOIN voices USING (session_id)), {islands_sql("open", "speaker", GAP, "s_ms, e_ms", f"e_ms > s_ms AND e_ms - s_ms >= {LEAST} AND speaker <> ''")}, nth AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY s_ms, e_ms) AS nth FROM islands
), merged AS (
  SELECT session_id, island AS turn_ord, speaker, greatest(0, min(s_ms)) AS s, least(max(e_ms), any_value(total)) AS e, any_value(x) AS x
  FROM nth JOIN audio USING (session_id) WHERE island < {MOST} OR (island = {MOST} AND nth = 1) GROUP BY session_id, island, speaker
), crop AS (
  SELECT session_id, turn_ord, speaker, s, e - s AS n, substr(x, s * 4 + 1, (e - s) * 4) AS c FROM merged WHERE e > s
), heard AS (
  SELECT *, unnest([0, 1]) AS pos FROM crop WHERE CAST('0x' || substr(c, 1, 2) AS INTEGER) % 2 = 0
), said AS (
  SELECT session_id, turn_ord, pos, s + pos * (n // 2) AS s_ms, CASE WHEN pos = 0 THEN s + n // 2 ELSE s + n END AS e_ms, lower(CASE WHEN pos = 0 THEN left(c, 8) ELSE right(c, 8) END) AS text, speaker, 'turn' AS mode FROM heard
), asr AS (
  SELECT conv_id AS session_id, turn, turn * 90 AS s_ms, turn * 90 + 80 AS e_ms, 'said ' || turn AS text FROM conversations WHERE conv_id NOT IN (SELECT session_id FROM said)
), best AS (
  SELECT * FROM (SELECT a.session_id, a.turn, t.speaker, least(a.e_ms, t.e_ms) - greatest(a.s_ms, t.s_ms) AS overlap,
         row_number() OVER (PARTITION BY a.session_id, a.turn ORDER BY least(a.e_ms, t.e_ms) - greatest(a.s_ms, t.s_ms) DESC, t.turn_ord) AS r
  FROM asr a JOIN spans t ON a.session_id = t.session_id AND t.s_ms < a.e_ms AND a.s_ms < t.e_ms) WHERE r = 1
), both_ways AS (
  SELECT session_id, turn_ord, pos, s_ms, e_ms, text, speaker, mode FROM said
  UNION ALL SELECT a.session_id, NULL, a.turn, a.s_ms, a.e_ms, a.text, CASE WHEN b.overlap * 10 >= 80 THEN b.speaker ELSE '' END, 'overlap' FROM asr a LEFT JOIN best b ON a.session_id = b.session_id AND a.turn = b.turn
)"""

ORACLES = {
    "turn_audio": f"WITH {AUDIO} SELECT session_id, turn_ord, speaker, e - s AS n_samples, sha256(unhex(substr(x, s * 4 + 1, (e - s) * 4))) AS sha256 FROM held",
    "speaker_audio": f"""WITH {AUDIO}, u AS (
  SELECT *, coalesce(sum(e - s) OVER (PARTITION BY session_id, speaker ORDER BY s, e, turn_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(e - s) OVER (PARTITION BY session_id, speaker) AS total FROM held
), t AS (SELECT *, CAST(least(e - s, {BUDGET} - used) AS BIGINT) AS take FROM u WHERE total >= {BUDGET_LEAST} AND used < {BUDGET} AND speaker <> '')
SELECT session_id, speaker, CAST(sum(take) AS BIGINT) AS n_samples, sha256(unhex(string_agg(substr(x, s * 4 + 1, take * 4), '' ORDER BY s, e, turn_ord))) AS sha256 FROM t GROUP BY session_id, speaker""",
    "turn_transcripts": f"""WITH {HEARD} SELECT session_id, CAST(turn_ord AS BIGINT) AS turn_ord, CAST(pos AS BIGINT) AS pos, CAST(s_ms AS BIGINT) AS s_ms, CAST(e_ms AS BIGINT) AS e_ms, text,
  CASE WHEN session_id % 2 = 0 AND speaker <> '' THEN 'person_' || session_id || '_' || speaker ELSE speaker END AS speaker, mode FROM both_ways""",
    # ends: the releases to come of the slots that are taken
    "admission_replay": f"""WITH RECURSIVE {CHUNKS}, o AS (
  SELECT tenant_id, event_id, ts_us AS at_us, greatest(ts_us, ts_us + n_samples * 100000) AS until_us, row_number() OVER (PARTITION BY tenant_id ORDER BY ts_us, event_id) AS k FROM chunks
), r(tenant_id, k, event_id, admitted, ends) AS (
  SELECT DISTINCT tenant_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), FALSE, CAST([] AS BIGINT[]) FROM o
  UNION ALL SELECT tenant_id, k, event_id, len(rest) < 3, CASE WHEN len(rest) < 3 THEN list_append(rest, until_us) ELSE rest END
  FROM (SELECT o.*, list_filter(r.ends, lambda e: e > o.at_us) AS rest FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.k = r.k + 1)
) SELECT tenant_id, event_id, admitted, CAST(len(ends) AS BIGINT) AS open FROM r WHERE k > 0""",
    "gallery_freshness": f"""WITH RECURSIVE {CHUNKS}, o AS (
  SELECT tenant_id, ts_us, event_id, event_type, row_number() OVER (PARTITION BY tenant_id ORDER BY ts_us, event_id) AS k FROM chunks
), r(tenant_id, k, ts_us, event_id, used, enrolled, loaded_us, version) AS (
  SELECT DISTINCT tenant_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), FALSE, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM o
  UNION ALL SELECT o.tenant_id, o.k, o.ts_us, o.event_id, o.event_type NOT IN ('signup', 'error'), CASE WHEN o.event_type = 'signup' THEN o.event_id ELSE r.enrolled END,
    CASE WHEN o.event_type = 'error' THEN NULL WHEN o.event_type = 'signup' OR o.ts_us - r.loaded_us <= {TTL_US} THEN r.loaded_us ELSE o.ts_us END,
    CASE WHEN o.event_type IN ('signup', 'error') OR o.ts_us - r.loaded_us <= {TTL_US} THEN r.version ELSE r.enrolled END
  FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.k = r.k + 1
) SELECT tenant_id, ts_us, event_id, loaded_us, version FROM r WHERE used""",
}
