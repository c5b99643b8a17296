"""Time stamps, object keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^(urn:uuid:)?\{?[0-9A-Fa-f]{8}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{4}-?[0-9A-Fa-f]{12}\}?$"
TENANT = r"^[A-Za-z0-9_-]{1,64}$"


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative counts as 0."""
    t = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000)


def txt_line(s_ms: Column, e_ms: Column, speaker: Column, text: Column) -> Column:
    """[start - end] speaker: text, in seconds with two decimals."""
    return F.format_string("[%.2f - %.2f] %s: %s", s_ms / 1000, e_ms / 1000, F.coalesce(F.nullif(speaker, F.lit("")), F.lit("UNKNOWN")), text)


def iso_or_null(text: Column) -> Column:
    """ISO-8601 text, a trailing Z among its forms, as a timestamp; null if it is none."""
    return F.try_to_timestamp(text)


def in_utc(ts: Column) -> Column:
    """A timestamp that the session's time zone shows as UTC does."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def utc_ms_iso(ts: Column) -> Column:
    return F.date_format(in_utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def recording_key(prefix: str, tenant: Column, ts: Column, session: Column) -> Column:
    """prefix/tenant/YYYY/MM/DD/session/audio.wav; an empty tenant is called default."""
    return F.concat_ws("/", F.lit(prefix.strip("/") or None), F.coalesce(F.nullif(tenant, F.lit("")), F.lit("default")), F.date_format(in_utc(ts), "yyyy/MM/dd"), session, F.lit("audio.wav"))


def speaker_label(tag: Column) -> Column:
    """Native tags 1 to 4 become SPEAKER_00 to SPEAKER_03; others are blank."""
    return F.when(tag.between(1, 4), F.format_string("SPEAKER_%02d", tag - 1)).otherwise("")


def epoch_label(epoch: Column, label: Column) -> Column:
    return F.format_string("EPOCH_%04d/%s", epoch, label)


def trace_id(session: Column) -> Column:
    return F.replace(session, F.lit("-"), F.lit(""))


def s3_bucket(url: Column) -> Column:
    return F.regexp_extract(url, "^s3://([^/]+)/(.+)$", 1)


def s3_key(url: Column) -> Column:
    return F.regexp_extract(url, "^s3://([^/]+)/(.+)$", 2)
