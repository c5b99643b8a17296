"""Exports and sinks: subtitles, text lines, idempotent appends, failure events, session audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechframes.functions import formats
from speechframes.functions.text import strip


def srt_cues(segments: DataFrame, keys: list[str], start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """Subtitle cues (speaker: text), numbered without gaps after blank texts have gone."""
    spoken = segments.where(strip("text") != "")
    line = Window.partitionBy(*keys).orderBy(start, "island")
    cue = spoken.withColumn("cue", F.row_number().over(line).cast("long"))
    text = F.concat_ws("\n", F.col("cue").cast("string"), F.concat(formats.srt_time(F.col(start)), F.lit(" --> "), formats.srt_time(F.col(end))), F.concat(F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")), F.lit(": "), strip("text")), F.lit(""))
    return cue.withColumn("cue_text", text)


def write_lines(segments: DataFrame, path: str, keys: list[str], start: str = "s_ms", end: str = "e_ms") -> None:
    """One text line per segment, in order within each key's folder."""
    lines = segments.withColumn("value", formats.txt_line(F.col(start), F.col(end), F.col("speaker"), F.col("text")))
    lines.repartition(*keys).sortWithinPartitions(*keys, start).select(*keys, "value").write.partitionBy(*keys).text(path)


def write_srt(segments: DataFrame, path: str, keys: list[str]) -> None:
    cues = srt_cues(segments, keys).withColumn("value", F.col("cue_text"))
    cues.repartition(*keys).sortWithinPartitions(*keys, "cue").select(*keys, "value").write.partitionBy(*keys).text(path)


def failure_events(rejects: DataFrame, created_at) -> DataFrame:
    """Compact JSON failure events keyed by session, for rows that name a valid session and tenant."""
    named = rejects.where(F.col("session_id").rlike(formats.UUID) & F.col("tenant_id").rlike(formats.TENANT))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), "session_id", "tenant_id", "reason", formats.utc_ms_iso(created_at).alias("created_at")))
    return named.select(F.col("session_id").alias("key"), body.alias("value"))


def upsert(path: str, keys: list[str], order: list[str] = (), parts: int = 64, by: list[str] = (), replace: bool = True):
    """A foreachBatch function: a Parquet table with one row for each key, in folders by ``by`` (a date, say) and a hash of the key.

    A batch reads and rewrites the folders that its keys fall into, and no
    others; their list is as long as the batch has different ones, at most
    ``parts`` for each value of ``by``. With ``replace`` a key keeps the row that is last
    by ``order`` (the batch's among equal ones), so neither a replayed nor a late
    batch undoes a newer one; else it keeps the row that came first.

    The merged folders are written aside first and then put in place by dynamic
    partition overwrite. A run that dies in between leaves them complete below
    ``_pending``, and the next batch puts them in place again before its own.
    ``by`` must be the same for all rows of a key. The table has a column key_part.
    """
    folders = [*by, "key_part"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        context = spark.sparkContext
        made = lambda p: context._jvm.org.apache.hadoop.fs.Path(p)
        files = made(path).getFileSystem(context._jsc.hadoopConfiguration())
        pending = f"{path}/_pending"

        def put_in_place(schema) -> None:
            ready = spark.read.schema(schema).parquet(pending)
            ready.repartition(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
            files.delete(made(pending), True)

        rows = batch.withColumn("key_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        if files.exists(made(f"{pending}/_SUCCESS")):
            put_in_place(spark.read.parquet(pending).schema)
        named = context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        strings = rows.select(*[F.col(c).cast("string") for c in folders]).distinct().collect()
        touched = ["/".join([path, *(named(c, r[c]) for c in folders)]) for r in strings]
        if not touched:
            return
        there = [p for p in touched if files.exists(made(p))]
        rest = [c for c in rows.columns if c not in keys]
        both = rows.withColumn("_new", F.lit(1))
        if there:
            both = both.unionByName(spark.read.schema(rows.schema).option("basePath", path).parquet(*there).withColumn("_new", F.lit(0)))
        if replace:
            kept = F.max_by(F.struct(*rest), F.struct(*order, "_new"))
        else:
            kept = F.min_by(F.struct(*rest), F.struct("_new", *order))
        merged = both.groupBy(*keys).agg(kept.alias("_row")).select(*keys, "_row.*")
        merged.repartition(*folders).write.mode("overwrite").partitionBy(*folders).parquet(pending)
        put_in_place(rows.schema)

    return write


def append_once(path: str, keys: list[str], parts: int = 64):
    """A foreachBatch function: adds rows whose key the table does not have yet; replayed and repeated rows add nothing."""
    return upsert(path, keys, parts=parts, replace=False)


def refined_sink(path: str, parts: int = 64):
    """One row for each window of a session's track; the first one stays."""
    return append_once(path, ["tenant_id", "session_id", "track_id", "window_sec", "slice_index"], parts)


def transcript_sink(path: str, model: str, parts: int = 64):
    """One row for each track of a session, the latest by created_at_ns, with the model that made it."""
    write = upsert(path, ["tenant_id", "session_id", "track_id"], ["created_at_ns"], parts)
    return lambda batch, batch_id: write(batch.withColumn("model", F.lit(model)), batch_id)


def finished_events(recordings: DataFrame, final_tracks) -> DataFrame:
    """recordings with the headers that the finalizer reads: keep the recording or not, final output, its tracks."""
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value"))
    store = F.when(F.col("store_recording"), "true").otherwise("false")
    return recordings.withColumn("headers", F.array(header("x-store-recording", store), header("x-outputs", F.lit("final")), header("x-final-tracks", F.array_join(final_tracks, ","))))


def asr_events(results: DataFrame, default_lang: str = "", default_profile: str = "") -> DataFrame:
    """Public event rows of recognition results (session_id, start_s, end_s, text, is_final, lang, speaker); no null or blank language while there is a default."""
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit(default_lang))
    kind = F.when(F.col("is_final"), "FINAL").otherwise("PARTIAL")
    return results.select("session_id", "start_s", "end_s", F.coalesce("text", F.lit("")).alias("text"), kind.alias("type"), lang.alias("lang"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.lit(default_profile).alias("provider_profile_id"))


def refined_lines(events: DataFrame) -> DataFrame:
    """events with a line to read: session (the message key where it lacks one), span, speaker, text. For a console or memory sink."""
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    session = blank("session_id", F.col("key").cast("string") if "key" in events.columns else F.lit(""))
    span = F.format_string("%.2f-%.2fs", "start_s", "end_s")
    return events.withColumn("line", F.concat_ws(" ", F.concat(F.lit("session="), F.coalesce(session, F.lit(""))), span, F.concat(F.lit("speaker="), blank("speaker", F.lit("?"))), F.concat(F.lit("text="), F.coalesce("text", F.lit("")))))
