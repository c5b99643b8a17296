"""Queries on controls, validation, sessions, galleries and reports, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from speechframes.functions import controls, formats
from speechframes.operators import assemble, gallery, intervals, languages, reports, sessions, updates, validate
from speechframes.plans import views
from speechframes.plans.views import CHUNKS, HEADERS, PROBES, TURNS, UPLOADS

KEY = ["session_id"]
IDLE_US = 6 * 3600 * 1_000_000


def parsed(spark, sf):
    """Headers as messages carry them, parsed to controls."""
    rows = views.header_rows(views.headers(spark, sf))
    value = lambda name: controls.header_value(F.col("headers"), name)
    return rows.withColumn("controls", controls.stream_controls(value("x-outputs"), value("x-store-recording"), value("x-final-tracks")))


def stream_controls(spark, sf):
    c = F.col("controls")
    return parsed(spark, sf).select("event_id", *[c[f"want_{o}"].alias(f"want_{o}") for o in controls.OUTPUTS], c["store_recording"].alias("store_recording"), F.array_join(c["final_tracks"], "|").alias("final_tracks"))


CONTROLS = f"""{HEADERS}, controls AS (
  SELECT event_id, session_id,
    outputs_raw IS NULL OR list_contains(o, 'realtime') AS want_realtime, outputs_raw IS NULL OR list_contains(o, 'refined') AS want_refined, outputs_raw IS NULL OR list_contains(o, 'final') AS want_final,
    CASE WHEN lower(trim(store_raw)) IN ('1','true','yes','y','on') THEN TRUE WHEN lower(trim(store_raw)) IN ('0','false','no','n','off') THEN FALSE ELSE TRUE END AS store_recording,
    CASE WHEN tracks_raw IS NULL THEN ['whisperx'] ELSE list_filter(list_transform(string_split(tracks_raw, ','), lambda x: trim(x)), lambda x: x <> '') END AS tracks
  FROM (SELECT *, list_transform(string_split(coalesce(outputs_raw, ''), ','), lambda x: lower(trim(x))) AS o FROM headers)
)"""


def window_clamp(spark, sf):
    rows = views.header_rows(views.headers(spark, sf))
    return rows.select("event_id", controls.clamped_window(controls.header_value(F.col("headers"), "x-refinement-window-sec"), 60.0).alias("window_s"))


def track_routing(spark, sf):
    rows = parsed(spark, sf).where(controls.routed(F.col("controls"), "final", "qwen"))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def unsafe_policy(spark, sf):
    rows = parsed(spark, sf).withColumn("reason", F.when(controls.unsafe_policy(F.col("controls")), "unsafe-policy"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def overrides(spark, sf):
    raw = views.headers(spark, sf).select("event_id", F.col("window_raw").try_cast("double").alias("w"))
    made = controls.effective_realtime(F.col("w"), F.col("w") / 2 - 1, F.col("w") * 2, (10.0, 1.0, 0.7))
    return raw.select("event_id", made["window_s"].alias("window_s"), made["overlap_s"].alias("overlap_s"), made["emit_s"].alias("emit_s"))


def config_conflicts(spark, sf):
    raw = views.headers(spark, sf).select("session_id", controls.clamped_window(F.col("window_raw"), 60.0).alias("window_s"))
    return validate.config_conflicts(raw, KEY, ["window_s"])


def header_upsert(spark, sf):
    rows = views.header_rows(views.headers(spark, sf))
    rows = rows.withColumn("headers", controls.upsert_header(F.col("headers"), "x-outputs", formats.trace_id(F.concat(F.lit("a-"), F.col("event_id")))))
    return rows.select("event_id", F.size("headers").cast("long").alias("n_headers"), controls.header_value(F.col("headers"), "X-OUTPUTS").alias("outputs"))


def defective_chunks(spark, sf):
    """Chunks with one defect in every few dozen, of each kind."""
    n = F.col("event_id")
    return views.chunks(spark, sf).select(
        "session_id", "event_id", F.col("seq").alias("arrival"),
        F.when(n % 97 == 0, 99).otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when(n % 89 == 0, "xx").when(F.col("session_id") % 7 == 0, "").otherwise("en").alias("lang"),
        (F.col("seq") + F.when(n % 83 == 0, 1).otherwise(0)).alias("seq"),
        F.when(n % 79 == 0, 8000).otherwise(16000).alias("sample_rate"),
        F.when(n % 71 == 0, 0).otherwise(F.col("n_samples") * 2 + F.when(n % 73 == 0, 1).otherwise(0)).alias("payload_bytes"),
    )


DEFECTS = f"""{CHUNKS}, defective AS (
  SELECT session_id, event_id, seq AS arrival, CASE WHEN event_id % 97 = 0 THEN 99 ELSE tenant_id END AS tenant_id, CASE WHEN event_id % 89 = 0 THEN 'xx' WHEN session_id % 7 = 0 THEN '' ELSE 'en' END AS lang,
         seq + CASE WHEN event_id % 83 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN event_id % 79 = 0 THEN 8000 ELSE 16000 END AS sample_rate, CASE WHEN event_id % 71 = 0 THEN 0 ELSE n_samples * 2 + CASE WHEN event_id % 73 = 0 THEN 1 ELSE 0 END END AS payload_bytes
  FROM chunks
), validated AS (
  SELECT *, CASE WHEN tenant_id IS DISTINCT FROM first(tenant_id) OVER w THEN 'tenant-changed' WHEN lang IS DISTINCT FROM first(lang) OVER w THEN 'language-changed' WHEN lang NOT IN ('', 'en') THEN 'unsupported-language' WHEN seq <> lag(seq) OVER w + 1 THEN 'sequence-gap'
                 WHEN sample_rate <> 16000 THEN 'sample-rate' WHEN payload_bytes = 0 THEN 'empty-payload' WHEN payload_bytes % 2 <> 0 THEN 'odd-payload' WHEN payload_bytes > 32000 THEN 'payload-too-long' END AS reason,
         CASE WHEN seq <> lag(seq) OVER w + 1 THEN 'sequence-gap' WHEN sample_rate <> 16000 THEN 'sample-rate' WHEN payload_bytes % 2 <> 0 THEN 'odd-payload' WHEN payload_bytes > 1048576 THEN 'payload-too-long'
              WHEN row_number() OVER w = 1 AND lang NOT IN ('', 'en') THEN 'unsupported-language' WHEN lang IS DISTINCT FROM first(lang) OVER w THEN 'language-changed' WHEN tenant_id IS DISTINCT FROM first(tenant_id) OVER w THEN 'tenant-changed' END AS native_reason
  FROM defective WINDOW w AS (PARTITION BY session_id ORDER BY arrival)
)"""


def chunk_validation(spark, sf):
    return validate.validate_chunks(defective_chunks(spark, sf), KEY, ["en"]).select("event_id", "reason")


def valid_prefix(spark, sf):
    good = validate.valid_prefix(validate.validate_chunks(defective_chunks(spark, sf), KEY, ["en"], "native"), KEY)
    return good.groupBy("session_id").agg(F.count("*").alias("n"), F.max("arrival").alias("last_arrival"))


def upload_validation(spark, sf):
    rows = views.uploads(spark, sf)
    reason = F.coalesce(validate.upload_reason(F.col("session_id"), F.col("tenant_id"), F.col("source_url"), "speech"), validate.upload_bounds(F.col("n_bytes"), most_bytes=3000))
    return rows.select("page_id", reason.alias("reason"))


def upload_failures(spark, sf):
    from speechframes.sources import sinks

    rows = views.uploads(spark, sf)
    reason = validate.upload_reason(F.col("session_id"), F.col("tenant_id"), F.col("source_url"), "speech")
    rejected = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return sinks.failure_events(rejected, F.timestamp_seconds(F.lit(1767323045)))


def session_recordings(spark, sf):
    made = sessions.recording_summary(views.chunks(spark, sf), KEY, 16000, F.col("seq"), latest=["event_type"])
    return made.select("session_id", "tenant_id", "total_samples", "n_chunks", "duration_ms", "first_us", "last_us", F.col("event_type").alias("last_type"))


def idle_sessions(spark, sf):
    marked = sessions.idle_sessions(views.chunks(spark, sf), KEY, IDLE_US)
    made = sessions.recording_summary(marked, ["session_id", "recording"], 16000, F.col("seq"))
    return made.select("session_id", "recording", "total_samples", "n_chunks", "first_us", "last_us")


def idle_session_windows(spark, sf):
    """The same closes through Spark's session windows."""
    rows = views.chunks(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    made = rows.groupBy("session_id", F.session_window("ts", f"{IDLE_US // 1_000_000} seconds").alias("w")).agg(F.sum("n_samples").alias("total_samples"), F.count("*").alias("n_chunks"))
    return made.select("session_id", F.unix_micros("w.start").alias("first_us"), (F.unix_micros("w.end") - IDLE_US).alias("last_us"), "total_samples", "n_chunks")


def end_marker_sessions(spark, sf):
    marked = sessions.end_marker_sessions(views.chunks(spark, sf), KEY)
    return marked.groupBy("session_id", "recording").agg(F.count("*").alias("n_chunks"), F.sum("n_samples").alias("total_samples"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def two_source_mix(spark, sf):
    rows = views.chunks(spark, sf).withColumn("call_id", F.expr("session_id div 2"))
    block = lambda side: rows.where(F.col("session_id") % 2 == side).select("call_id", "seq", F.array(F.col("n_samples") / 5000.0 - 1, 1 - F.col("n_samples") / 4000.0).alias("samples"))
    mixed = sessions.two_source_mix(block(0), block(1), ["call_id", "seq"])
    return mixed.select("call_id", "seq", F.round(F.element_at("samples", 1), 6).alias("left_sample"), F.round(F.element_at("samples", 2), 6).alias("right_sample"))


def track_union(spark, sf):
    rows = views.chunks(spark, sf)
    track = lambda kind: rows.where(F.col("event_type") == kind)
    made = assemble.union_tracks(realtime=track("view").select("session_id", "seq"), refined=track("click").select("session_id", "n_samples"), final=track("purchase").select("session_id", "seq", "n_samples"))
    return made.groupBy("track").agg(F.count("*").alias("n"), F.count("seq").alias("n_seq"), F.sum("n_samples").alias("n_samples"))


def replay_dedup(spark, sf):
    rows = views.chunks(spark, sf).withColumn("slice", F.expr("n_samples div 1000"))
    return sessions.replay_dedup(rows, ["session_id", "slice"], ["ts_us", "seq"]).select("session_id", "slice", "seq", "event_id")


def retention_plan(spark, sf):
    rows = parsed(spark, sf)
    done = views.chunks(spark, sf).where("event_type <> 'error' AND n_samples % 3 <> 0").select("event_id")
    return sessions.deletable_recordings(rows, done, ["event_id"]).select("event_id", "session_id")


def pending_outputs(spark, sf):
    rows = views.chunks(spark, sf)
    done, waiting = sessions.published_or_pending(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'").select("session_id", F.expr("n_samples div 100 * 100").alias("n_samples")), ["session_id", "n_samples"])
    return assemble.union_tracks(done=done.select("event_id"), pending=waiting.select("event_id")).select("track", "event_id")


def iso_keys(spark, sf):
    rows = views.chunks(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    tenant = F.when(F.col("tenant_id") == 0, "").otherwise(F.concat(F.lit("t"), F.col("tenant_id")))
    return rows.select("event_id", formats.recording_key("/audio/", tenant, F.col("ts"), F.col("session_id").cast("string")).alias("object_key"), formats.utc_ms_iso(F.timestamp_millis(F.expr("ts_us div 1000"))).alias("iso"))


def gallery_mean(spark, sf):
    made = gallery.gallery(views.probes(spark, sf))
    return made.select("tenant_id", "label", "n_samples", F.round("mean_norm", 5).alias("mean_norm"), F.round(F.element_at("embedding", 1), 5).alias("first"), F.round(gallery.dot(F.col("embedding"), F.col("embedding")), 5).alias("norm2"))


def speakers(spark, sf):
    """Each label of a tenant enrolled by one to three speakers."""
    return views.probes(spark, sf).withColumn("speaker_id", F.col("label") * 10 + F.when(F.col("label") % 2 == 0, F.col("vec_id") % 2).otherwise(0))


def gallery_strict(spark, sf):
    return gallery.strict_gallery(speakers(spark, sf)).select("tenant_id", "label", "speaker_id", "n_samples", F.round("mean_norm", 5).alias("mean_norm"))


def gallery_last_wins(spark, sf):
    return gallery.gallery(speakers(spark, sf), speaker="speaker_id").select("tenant_id", "label", "speaker_id", "n_samples")


def enroll_match(spark, sf):
    rows = views.probes(spark, sf)
    made = gallery.match(rows.withColumnRenamed("label", "own"), gallery.gallery(rows))
    return made.select("vec_id", "best_label", F.round("similarity", 5).alias("similarity"), "accepted")


def enroll_margin(spark, sf):
    rows = views.probes(spark, sf)
    made = gallery.margin_match(rows.withColumnRenamed("label", "own"), gallery.gallery(rows), 0.3, 0.05)
    return made.select("vec_id", "best_label", F.round("similarity", 5).alias("similarity"), F.round("runner_up", 5).alias("runner_up"))


GALLERY = f"""{PROBES}, dims AS (SELECT tenant_id, label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM probes, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL),
means AS (SELECT tenant_id, label, list(x ORDER BY i) AS m, max(n) AS n_samples FROM dims GROUP BY ALL),
gallery AS (SELECT *, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS mean_norm FROM means),
g AS (SELECT tenant_id, label, n_samples, mean_norm, list_transform(m, lambda x: x / (mean_norm + 1e-12)) AS e FROM gallery)"""
RANKED = f"""{GALLERY}, scored AS (SELECT p.vec_id, g.label, list_sum(list_transform(range(1, 65), lambda i: CAST(p.embedding[i] AS DOUBLE) * g.e[i])) AS sim FROM probes p JOIN g USING (tenant_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label {{}}) AS r FROM scored)"""


def kinds(spark, sf):
    """Events as updates: purchases are final."""
    rows = views.chunks(spark, sf)
    return rows.withColumn("kind", F.when(F.col("event_type") == "purchase", "FINAL").otherwise("PARTIAL")).withColumn("text", F.when(F.col("event_type") == "error", " ").otherwise(F.concat("event_type", F.expr("n_samples div 2000"))))


KINDS = f"""{CHUNKS}, kinds AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'FINAL' ELSE 'PARTIAL' END AS kind, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type || (n_samples // 2000) END AS text FROM chunks)"""


def stream_stats(spark, sf):
    return reports.stream_stats(kinds(spark, sf), KEY, F.col("seq"))


def cadence_report(spark, sf):
    return reports.cadence(kinds(spark, sf), KEY, ["ts_us", "seq"])


def outcome_histogram(spark, sf):
    return reports.histogram(views.table(spark, sf, "events"), ["event_type"], "value", 0, 200, 10)


def peak_concurrency(spark, sf):
    spans = views.chunks(spark, sf).select(F.col("ts_us").alias("at_us"), (F.col("ts_us") + F.col("n_samples") * 100_000).alias("until_us"))
    opened = reports.concurrency(spans, "at_us", "until_us", 86_400_000_000)
    return opened.agg(F.max("open").alias("peak"), F.count("*").alias("n_changes"), F.count_if(F.col("open") > 4).alias("n_over_capacity"))


def audio_check(spark, sf):
    rows = kinds(spark, sf).withColumn("speaker", F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "view", F.format_string("SPEAKER_%02d", F.col("seq") % 3)).otherwise(F.concat(F.lit("p"), F.col("seq") % 4)))
    return reports.audio_check(rows, KEY)


def live_line(spark, sf):
    return updates.live_line(kinds(spark, sf), KEY, ["ts_us", "seq"])


def native_update_dedup(spark, sf):
    return updates.dedup_updates(kinds(spark, sf), KEY, ["seq"]).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("seq").alias("sum_seq"))


def replacement_interval(spark, sf):
    return updates.replacement_start(kinds(spark, sf).withColumn("end_at", F.col("ts_us") + F.col("n_samples")), KEY, ["seq"], "end_at").select("event_id", "start_at")


def monotonic_errors(spark, sf):
    line = F.max("n_samples").over(Window.partitionBy("session_id"))
    rows = views.chunks(spark, sf).withColumn("duration", line + 1000).withColumn("end_at", F.col("n_samples") + F.col("seq") % 1500)
    return updates.monotonic_errors(rows, KEY, ["seq"], "n_samples", "end_at", "duration", 2000).select("event_id")


def turn_crops(spark, sf):
    """Byte ranges of the session's chunks that each turn covers, on a clock of ten samples a millisecond."""
    turned = views.turns(spark, sf)
    pieces = views.words(spark, sf).select("session_id", "turn", "idx", "s_ms", (F.col("s_ms") + 250).alias("e_ms"))
    pairs = intervals.overlapping_pairs(turned, pieces, KEY)
    return pairs.groupBy("session_id", "turn_ord").agg(F.count("*").alias("n_pieces"), F.sum(F.col("overlap") * 20).alias("n_bytes"))


def language_lookup(spark, sf):
    n = F.col("event_id") % 6
    given = F.when(n == 0, "German").when(n == 1, "en-US").when(n == 2, " FR ").when(n == 3, "xx-YY").when(n == 4, "").otherwise(None)
    made = languages.public_language(views.chunks(spark, sf).withColumn("lang", given), "lang", "und")
    return made.select("event_id", "language")


def fluent_drafts(spark, sf):
    """Drafts of five chunks each; one with a high ratio is withheld whole."""
    rows = views.chunks(spark, sf).select("session_id", F.expr("seq div 5").alias("draft"), "seq", (F.col("n_samples") / 8000).alias("ratio"))
    return languages.keep_fluent_drafts(rows, ["session_id", "draft"], "ratio", 2.4).groupBy("session_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def activity(spark, sf):
    """First and last activity of each session, its longest silence, and the sessions' wall-clock base."""
    line = Window.partitionBy("session_id").orderBy("ts_us", "seq")
    rows = views.chunks(spark, sf).withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(line))
    return rows.groupBy("session_id").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max("gap").alias("longest_gap_us"), F.min(F.expr("ts_us - n_samples * 1000000 div 16000")).alias("wall_base_us"))


QUERIES = {f.__name__: f for f in (
    stream_controls, window_clamp, track_routing, unsafe_policy, overrides, config_conflicts, header_upsert, chunk_validation, valid_prefix, upload_validation, upload_failures,
    session_recordings, idle_sessions, idle_session_windows, end_marker_sessions, two_source_mix, track_union, replay_dedup, retention_plan, pending_outputs, iso_keys,
    gallery_mean, gallery_strict, gallery_last_wins, enroll_match, enroll_margin, stream_stats, cadence_report, outcome_histogram, peak_concurrency, audio_check, live_line,
    native_update_dedup, replacement_interval, monotonic_errors, turn_crops, language_lookup, fluent_drafts, activity,
)}

REASON = """CASE WHEN NOT regexp_full_match(session_id, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}') THEN 'invalid-session-id'
 WHEN NOT regexp_full_match(tenant_id, '[A-Za-z0-9_-]{1,64}') THEN 'invalid-tenant-id'
 WHEN regexp_extract(source_url, '^s3://([^/]+)/(.+)$', 1) <> 'speech' OR regexp_extract(source_url, '^s3://([^/]+)/(.+)$', 2) <> tenant_id || '/uploads/' || session_id || '/source' THEN 'foreign-source' """
STRICT = f"{PROBES}, sp AS (SELECT *, label * 10 + CASE WHEN label % 2 = 0 THEN vec_id % 2 ELSE 0 END AS speaker_id FROM probes)"

ORACLES = {
    "stream_controls": f"WITH {CONTROLS} SELECT event_id, want_realtime, want_refined, want_final, store_recording, array_to_string(tracks, '|') AS final_tracks FROM controls",
    "window_clamp": f"WITH {HEADERS}, v AS (SELECT event_id, try_cast(trim(window_raw) AS DOUBLE) AS w FROM headers) SELECT event_id, CASE WHEN w IS NULL OR isnan(w) OR isinf(w) THEN 60.0 ELSE least(greatest(w, 10.0), 600.0) END AS window_s FROM v",
    "track_routing": f"WITH {CONTROLS} SELECT session_id, count(*) AS n, min(event_id) AS first_event FROM controls WHERE want_final AND list_contains(tracks, 'qwen') GROUP BY session_id",
    "unsafe_policy": f"WITH {CONTROLS} SELECT CASE WHEN len(tracks) > 1 AND NOT store_recording THEN 'unsafe-policy' END AS reason, count(*) AS n FROM controls GROUP BY ALL",
    "overrides": f"""WITH {HEADERS}, v AS (SELECT event_id, try_cast(window_raw AS DOUBLE) AS w FROM headers), a AS (SELECT *, w IS NOT NULL AND NOT isnan(w) AND NOT isinf(w) AS f FROM v), b AS (SELECT *, CASE WHEN f AND w > 0.1 THEN w ELSE 10.0 END AS window_s FROM a)
SELECT event_id, window_s, CASE WHEN f AND w / 2 - 1 >= 0 AND w / 2 - 1 < window_s THEN w / 2 - 1 ELSE 1.0 END AS overlap_s, CASE WHEN f AND w * 2 > 0 THEN least(w * 2, window_s) ELSE 0.7 END AS emit_s FROM b""",
    "config_conflicts": f"WITH {HEADERS} SELECT session_id, count(DISTINCT w) AS n_configs FROM (SELECT session_id, CASE WHEN v IS NULL THEN 60.0 ELSE least(greatest(v, 10.0), 600.0) END AS w FROM (SELECT session_id, try_cast(nullif(window_raw, 'nan') AS DOUBLE) AS v FROM headers)) GROUP BY session_id HAVING count(DISTINCT w) > 1",
    "header_upsert": f"WITH {HEADERS} SELECT event_id, 1 + CAST(store_raw IS NOT NULL AS BIGINT) + CAST(tracks_raw IS NOT NULL AS BIGINT) + CAST(window_raw IS NOT NULL AS BIGINT) AS n_headers, 'a' || event_id AS outputs FROM headers",
    "chunk_validation": f"WITH {DEFECTS} SELECT event_id, reason FROM validated",
    "valid_prefix": f"WITH {DEFECTS}, b AS (SELECT *, max(CAST(native_reason IS NOT NULL AS INT)) OVER (PARTITION BY session_id ORDER BY arrival) AS bad FROM validated) SELECT session_id, count(*) AS n, max(arrival) AS last_arrival FROM b WHERE bad = 0 GROUP BY session_id",
    "upload_validation": f"WITH {UPLOADS} SELECT page_id, {REASON} WHEN n_bytes = 0 THEN 'no-audio' WHEN n_bytes > 3000 THEN 'too-large' END AS reason FROM uploads",
    "upload_failures": f"""WITH {UPLOADS}, r AS (SELECT *, {REASON} END AS reason FROM uploads) SELECT session_id AS key, '{{"schema_version":1,"session_id":"' || session_id || '","tenant_id":"' || tenant_id || '","reason":"' || reason || '","created_at":"2026-01-02T03:04:05.000Z"}}' AS value FROM r WHERE reason = 'foreign-source'""",
    "session_recordings": f"WITH {CHUNKS} SELECT session_id, arg_min(tenant_id, seq) AS tenant_id, CAST(sum(n_samples) AS BIGINT) AS total_samples, count(*) AS n_chunks, CAST(sum(n_samples) * 1000 // 16000 AS BIGINT) AS duration_ms, min(ts_us) AS first_us, max(ts_us) AS last_us, arg_max(event_type, seq) AS last_type FROM chunks GROUP BY session_id",
    "idle_sessions": f"WITH {CHUNKS}, n AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) > {IDLE_US} THEN 1 ELSE 0 END AS new FROM chunks), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS BIGINT) AS recording FROM n) SELECT session_id, recording, CAST(sum(n_samples) AS BIGINT) AS total_samples, count(*) AS n_chunks, min(ts_us) AS first_us, max(ts_us) AS last_us FROM r GROUP BY session_id, recording",
    "idle_session_windows": f"WITH {CHUNKS}, n AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) > {IDLE_US} THEN 1 ELSE 0 END AS new FROM chunks), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS recording FROM n) SELECT session_id, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(sum(n_samples) AS BIGINT) AS total_samples, count(*) AS n_chunks FROM r GROUP BY session_id, recording",
    "end_marker_sessions": f"WITH {CHUNKS}, m AS (SELECT *, coalesce(sum(CAST(end_marker AS INT)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM chunks), d AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY seg) - 1 AS recording FROM m WHERE NOT end_marker) SELECT session_id, recording, count(*) AS n_chunks, CAST(sum(n_samples) AS BIGINT) AS total_samples, min(seq) AS first_seq, max(seq) AS last_seq FROM d GROUP BY session_id, recording",
    "two_source_mix": f"WITH {CHUNKS}, b AS (SELECT session_id // 2 AS call_id, session_id % 2 AS side, seq, n_samples / 5000.0 - 1 AS x, 1 - n_samples / 4000.0 AS y FROM chunks) SELECT call_id, seq, round(greatest(-1.0, least(1.0, coalesce(a.x, 0.0) + coalesce(c.x, 0.0))), 6) AS left_sample, round(greatest(-1.0, least(1.0, coalesce(a.y, 0.0) + coalesce(c.y, 0.0))), 6) AS right_sample FROM (SELECT * FROM b WHERE side = 0) a FULL JOIN (SELECT * FROM b WHERE side = 1) c USING (call_id, seq)",
    "track_union": f"WITH {CHUNKS} SELECT CASE event_type WHEN 'view' THEN 'realtime' WHEN 'click' THEN 'refined' ELSE 'final' END AS track, count(*) AS n, count(CASE WHEN event_type <> 'click' THEN seq END) AS n_seq, CAST(sum(CASE WHEN event_type <> 'view' THEN n_samples END) AS BIGINT) AS n_samples FROM chunks WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL",
    "replay_dedup": f"WITH {CHUNKS}, s AS (SELECT *, n_samples // 1000 AS slice FROM chunks) SELECT session_id, slice, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, slice ORDER BY ts_us, seq) AS r FROM s) WHERE r = 1",
    "retention_plan": f"WITH {CONTROLS}, {CHUNKS} SELECT event_id, session_id FROM controls WHERE len(tracks) = 1 AND NOT store_recording AND event_id IN (SELECT event_id FROM chunks WHERE event_type <> 'error' AND n_samples % 3 <> 0)",
    "pending_outputs": f"WITH {CHUNKS}, o AS (SELECT DISTINCT session_id, n_samples // 100 * 100 AS n_samples FROM chunks WHERE event_type = 'click') SELECT CASE WHEN o.session_id IS NULL THEN 'pending' ELSE 'done' END AS track, event_id FROM chunks c LEFT JOIN o ON c.session_id = o.session_id AND c.n_samples = o.n_samples WHERE event_type = 'purchase'",
    "iso_keys": f"WITH {CHUNKS} SELECT event_id, 'audio/' || CASE WHEN tenant_id = 0 THEN 'default' ELSE 't' || tenant_id END || strftime(make_timestamp(ts_us), '/%Y/%m/%d/') || session_id || '/audio.wav' AS object_key, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM chunks",
    "gallery_mean": f"WITH {GALLERY} SELECT tenant_id, label, n_samples, round(mean_norm, 5) AS mean_norm, round(e[1], 5) AS first, round(list_sum(list_transform(e, lambda x: x * x)), 5) AS norm2 FROM g",
    "gallery_strict": f"WITH {STRICT}, dims AS (SELECT tenant_id, label, speaker_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM sp, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY ALL), m AS (SELECT tenant_id, label, speaker_id, max(n) AS n_samples, sqrt(sum(x * x)) AS mean_norm FROM dims GROUP BY ALL) SELECT tenant_id, label, speaker_id, n_samples, round(mean_norm, 5) AS mean_norm FROM m QUALIFY count(*) OVER (PARTITION BY tenant_id, label) = 1 AND count(*) OVER (PARTITION BY tenant_id) <= 256",
    "gallery_last_wins": f"WITH {STRICT} SELECT tenant_id, label, max(speaker_id) AS speaker_id, arg_max(n, speaker_id) AS n_samples FROM (SELECT tenant_id, label, speaker_id, count(*) AS n FROM sp GROUP BY tenant_id, label, speaker_id) GROUP BY tenant_id, label",
    "enroll_match": f"WITH {RANKED.format('')} SELECT vec_id, label AS best_label, round(sim, 5) AS similarity, sim >= 0.30 AS accepted FROM ranked WHERE r = 1",
    "enroll_margin": f"WITH {RANKED.format('DESC')}, two AS (SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS label, max(CASE WHEN r = 1 THEN sim END) AS s1, coalesce(max(CASE WHEN r = 2 THEN sim END), -1.0) AS s2 FROM ranked WHERE r <= 2 GROUP BY vec_id) SELECT vec_id, CASE WHEN s1 >= 0.3 AND s1 - s2 >= 0.05 THEN label END AS best_label, round(s1, 5) AS similarity, round(s2, 5) AS runner_up FROM two",
    "stream_stats": f"WITH {KINDS} SELECT session_id, count(*) AS n_events, CAST(sum(n_samples) AS BIGINT) AS n_samples, count(*) FILTER (kind = 'PARTIAL') AS n_partial, count(*) FILTER (kind = 'FINAL') AS n_final, arg_min(kind, seq) AS first_kind, max(ts_us) - min(ts_us) AS span_us FROM kinds GROUP BY session_id",
    "cadence_report": f"WITH {KINDS}, g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS gap FROM kinds) SELECT session_id, quantile_cont(gap, 0.5) AS median_gap_us, max(gap) AS max_gap_us, min(CASE WHEN kind = 'FINAL' THEN ts_us END) - min(ts_us) AS first_final_us FROM g GROUP BY session_id",
    "outcome_histogram": "SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 11 ELSE floor(value / 20) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "peak_concurrency": f"WITH {CHUNKS}, s AS (SELECT ts_us AS t, 1 AS d FROM chunks UNION ALL SELECT ts_us + n_samples * 100000, -1 FROM chunks), a AS (SELECT t, sum(d) AS d FROM s GROUP BY t), o AS (SELECT t, sum(d) OVER (ORDER BY t) AS o FROM a) SELECT CAST(max(o) AS BIGINT) AS peak, count(*) AS n_changes, count(*) FILTER (o > 4) AS n_over_capacity FROM o",
    "audio_check": f"WITH {KINDS}, s AS (SELECT *, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN printf('SPEAKER_%02d', seq % 3) ELSE 'p' || (seq % 4) END AS speaker FROM kinds) SELECT session_id, count(*) AS n_events, count(*) FILTER (kind = 'FINAL') AS n_finals, count(DISTINCT nullif(speaker, '')) AS n_speakers, count(DISTINCT CASE WHEN NOT starts_with(speaker, 'SPEAKER_') THEN nullif(speaker, '') END) AS n_enrolled FROM s GROUP BY session_id",
    "live_line": f"WITH {KINDS}, f AS (SELECT session_id, count(*) FILTER (kind = 'FINAL') AS n_finals, max(CASE WHEN kind = 'FINAL' THEN seq END) AS lf, max(CASE WHEN kind = 'PARTIAL' THEN seq END) AS lp, arg_max(text, seq) FILTER (kind = 'PARTIAL') AS t FROM kinds GROUP BY session_id) SELECT session_id, n_finals, CASE WHEN lf IS NULL OR lp > lf THEN t END AS live_text FROM f",
    "native_update_dedup": f"WITH {KINDS}, t AS (SELECT *, trim(text) AS tx FROM kinds WHERE trim(text) <> ''), l AS (SELECT *, lag(tx) OVER (PARTITION BY session_id ORDER BY seq) AS pt, lag(kind) OVER (PARTITION BY session_id ORDER BY seq) AS pk FROM t) SELECT session_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq FROM l WHERE kind = 'FINAL' OR pt IS NULL OR pt <> tx OR pk = 'FINAL' GROUP BY session_id",
    "replacement_interval": f"WITH {KINDS} SELECT event_id, coalesce(last_value(CASE WHEN kind = 'FINAL' THEN ts_us + n_samples END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM kinds",
    "monotonic_errors": f"WITH {CHUNKS}, m AS (SELECT *, max(n_samples) OVER (PARTITION BY session_id) + 1000 AS duration, n_samples + seq % 1500 AS end_at, coalesce(lag(n_samples) OVER (PARTITION BY session_id ORDER BY seq), 0) AS prev FROM chunks) SELECT event_id FROM m WHERE NOT (prev - 2000 <= n_samples AND n_samples <= end_at AND end_at <= duration)",
    "turn_crops": f"WITH {TURNS} SELECT t.session_id, turn_ord, count(*) AS n_pieces, CAST(sum((least(t.e_ms, w.s_ms + 250) - greatest(t.s_ms, w.s_ms)) * 20) AS BIGINT) AS n_bytes FROM turns t JOIN words w ON t.session_id = w.session_id AND w.s_ms < t.e_ms AND t.s_ms < w.s_ms + 250 GROUP BY ALL",
    "language_lookup": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' ELSE 'und' END AS language FROM events",
    "fluent_drafts": f"WITH {CHUNKS}, d AS (SELECT session_id, seq // 5 AS draft, seq, max(n_samples / 8000) OVER (PARTITION BY session_id, seq // 5) AS worst FROM chunks) SELECT session_id, count(*) AS n, min(seq) AS first_seq FROM d WHERE worst <= 2.4 GROUP BY session_id",
    "activity": f"WITH {CHUNKS}, g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, seq) AS gap FROM chunks) SELECT session_id, min(ts_us) AS first_us, max(ts_us) AS last_us, max(gap) AS longest_gap_us, min(ts_us - n_samples * 1000000 // 16000) AS wall_base_us FROM g GROUP BY session_id",
}
