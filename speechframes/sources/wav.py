"""WAV files and enrollment folders as tables; session audio as partitioned files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from speechframes.functions import audio, formats

AUDIO_NAMES = "*.{wav,flac,mp3,ogg}"


def read_files(spark: SparkSession, path: str, names: str = "*.wav") -> DataFrame:
    """Files as rows (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)


PIECE_BYTES = 8 << 20  # of audio that a Python worker gives back at once


def in_pieces(rows: Iterable[dict], kind: pa.Schema, audio_column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as batches that hold little more than so many bytes of audio, however many rows there are."""
    piece, held = [], 0
    for row in rows:
        piece.append(row)
        held += len(row[audio_column] or b"")
        if held >= most or len(piece) == 10_000:
            yield pa.RecordBatch.from_pylist(piece, schema=kind)
            piece, held = [], 0
    if piece:
        yield pa.RecordBatch.from_pylist(piece, schema=kind)


def _opened(batches: Iterable[pa.RecordBatch], recording: bool) -> Iterator[tuple[str | None, dict, str | None]]:
    """(path, format fields and payload, reason) of each file; payloads are views of the batch, not copies."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data = memoryview(content.as_buffer() if content.is_valid else b"")
            fields = audio.wav_fields(data)
            yield path.as_py(), fields, audio.acceptable(fields, len(data), recording)


def scan_wavs(files: DataFrame, recording: bool = False) -> DataFrame:
    """files (path, content) with channels, rate, width, n_frames, pcm (of accepted files) and reason (of others)."""
    schema = "path string, channels int, rate int, width int, n_frames long, pcm binary, reason string"
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for path, fields, reason in _opened(batches, recording):
            frame = max(1, fields.get("width", 1) * fields.get("channels", 1))
            row = {c: fields.get(c) for c in ("channels", "rate", "width")}
            # a copy: pyarrow keeps the memory of every memoryview that it converts
            yield {"path": path, **row, "n_frames": len(fields.get("pcm", b"")) // frame, "pcm": bytes(fields["pcm"]) if reason is None else None, "reason": reason}

    return files.select("path", "content").mapInArrow(lambda batches: in_pieces(scanned(batches), kind, "pcm"), schema)


def normalise_audio(files: DataFrame) -> DataFrame:
    """files (path, content) as mono 16 kHz PCM with its level, or the reason against them.

    Files are opened and resampled one by one in the same worker.
    """
    schema = "path string, n_samples long, level double, pcm16 binary, reason string"
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for path, fields, reason in _opened(batches, False):
            if reason is not None:
                yield {"path": path, "n_samples": None, "level": None, "pcm16": None, "reason": reason}
                continue
            x = audio.resample(audio.decode(fields["pcm"], fields["width"], fields["channels"]), fields["rate"])
            bad = None if np.isfinite(x).all() else "not-finite"
            level = float(np.sqrt((x.astype(np.float64) ** 2).mean())) if len(x) else 0.0
            yield {"path": path, "n_samples": len(x), "level": level if bad is None else None, "pcm16": audio.encode(x) if bad is None else None, "reason": bad}

    return files.select("path", "content").mapInArrow(lambda batches: in_pieces(normalised(batches), kind, "pcm16"), schema)


def write_session_wavs(recordings: DataFrame, path: str) -> None:
    """recordings (tenant_id, session_id, ts, pcm) as RIFF bytes, one row each, partitioned by tenant and UTC date."""
    tenant = F.coalesce(F.nullif("tenant_id", F.lit("")), F.lit("default"))
    rows = recordings.withColumn("object_key", formats.recording_key("", tenant, F.col("ts"), F.col("session_id").cast("string")))
    rows.select(tenant.alias("tenant"), F.to_date("ts").alias("date"), "session_id", "object_key", audio.riff_column(F.col("pcm")).alias("wav")).write.partitionBy("tenant", "date").parquet(path)


MOST_RIFF = (1 << 32) - 37  # bytes of PCM that a RIFF head can name


def write_recordings(chunks: DataFrame, root: str, key_schema: str = "tenant_id string, session_id string", order: str = "seq", ts: str = "ts", pcm: str = "pcm", rate: int = audio.RATE) -> DataFrame:
    """Each session's chunks as one WAV file below root, under its tenant and the UTC date of its first chunk; returns the index.

    Rows of the index: keys, object_key, path (below root), n_bytes, reason.
    Sizes are summed first, so the head is right from the start and the chunks
    stream through a task in order, one at a time. Every attempt of a task writes
    files of its own name; only what the index, a Parquet table in root/_index,
    lists is accepted, so a killed attempt leaves nothing that is read. Sessions
    without audio, or with more than a RIFF file can hold, have a reason and no
    file. root is a folder or an address that all executors can write to.
    """
    keys = [part.strip().split(" ")[0] for part in key_schema.split(",")]
    schema = f"{key_schema}, object_key string, path string, n_bytes long, reason string"
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    sizes = chunks.groupBy(F.struct(*keys).alias("_key")).agg(F.coalesce(F.sum(F.octet_length(pcm)), F.lit(0)).cast("long").alias("_total"), F.min(ts).alias("_first"))
    tenant = F.coalesce(F.nullif(F.col("_key")[keys[0]], F.lit("")), F.lit("default"))
    sizes = sizes.withColumn("object_key", formats.recording_key("", tenant, F.col("_first"), F.coalesce(F.col("_key")[keys[1]].cast("string"), F.lit(""))))
    rows = chunks.select(F.struct(*keys).alias("_key"), order, F.col(pcm).alias("_pcm")).join(sizes.drop("_first"), "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:12]}"
        last, out = None, None
        for batch in batches:
            done = []
            named = batch.select(["_key", "_total", "object_key"]).to_pylist()
            for row, data in zip(named, batch.column("_pcm"), strict=True):
                if row["_key"] != last:
                    if out:
                        out.close()
                    last, out = row["_key"], None
                    total, place = row["_total"], None
                    reason = "no-audio" if not total else "too-large" if total > MOST_RIFF else None
                    if reason is None:
                        place = f"{row['object_key'].removesuffix('.wav')}.{attempt}.wav".lstrip("/")
                        files.create_dir(f"{base}/{place}".rsplit("/", 1)[0], recursive=True)
                        out = files.open_output_stream(f"{base}/{place}")
                        out.write(audio.riff_head(total, rate))
                    done.append({**last, "object_key": row["object_key"], "path": place, "n_bytes": total, "reason": reason})
                if out and data.is_valid:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_pylist(done, schema=kind)
        if out:
            out.close()

    spark = chunks.sparkSession
    index = f"{root.rstrip('/')}/_index"
    rows.repartition("_key").sortWithinPartitions("_key", order).mapInArrow(run, schema).write.mode("append").parquet(index)
    return spark.read.schema(schema).parquet(index)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Speaker manifests below root/tenant/speakers/speaker/, with tenant and folder from the path."""
    from speechframes.sources import schemas

    read = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(f"{root.rstrip('/')}/*/speakers/*/speaker.json")
    where = F.col("_metadata.file_path")
    return read.select("*", F.regexp_extract(where, "/([^/]+)/speakers/([^/]+)/speaker.json$", 1).alias("tenant_id"), F.regexp_extract(where, "/([^/]+)/speakers/([^/]+)/speaker.json$", 2).alias("folder"))


def listed_speakers(manifests: DataFrame, index: DataFrame | None) -> DataFrame:
    """The manifests that a tenant's index lists, or all of them where the index is missing or empty."""
    if index is None:
        return manifests
    listed = index.select("tenant_id", F.explode("speakers").alias("s")).select("tenant_id", F.col("s.speaker_id").alias("folder")).where("folder <> ''").distinct()
    having = listed.select("tenant_id").distinct()
    return manifests.join(listed, ["tenant_id", "folder"], "left_semi").unionByName(manifests.join(having, "tenant_id", "left_anti"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    from speechframes.sources import schemas

    return spark.read.schema(schemas.SPEAKER_INDEX).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{root.rstrip('/')}/*/speakers/index.json")


def legacy_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a flat folder; the label is the name before the first underscore."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", AUDIO_NAMES).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", "content", F.split(stem, "_")[0].alias("label"))


def sample_rows(manifests: DataFrame) -> DataFrame:
    """One row per sample with a readable url; the scheme must be file, s3 or none."""
    rows = manifests.select("tenant_id", "speaker_id", "label", F.posexplode("samples").alias("pos", "sample"))
    url = F.col("sample.url")
    scheme = F.regexp_extract(url, "^([A-Za-z0-9+.-]+)://", 1)
    return rows.select("tenant_id", "speaker_id", "label", "pos", url.alias("url"), F.when(~scheme.isin("", "file", "s3"), "unknown-scheme").alias("reason"))
