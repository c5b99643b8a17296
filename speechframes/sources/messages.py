"""Message rows (key, value, headers, partition, offset, timestamp) of any source as typed tables, and back.

Values are JSON text with binary fields in base64. Both directions are plain
projections, so they work on batches and on streams alike. Rows that cannot be
read are kept apart with their reason, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframes.sources import schemas

BAD = "_corrupt_record"


def decoded(messages: DataFrame, schema: str) -> DataFrame:
    """One row for each message: the schema's columns, arrival (the offset, which orders a key's messages), arrived, partition, key, value and reason.

    Reasons, the first that holds: no-value, malformed (not an object of these
    types), missing-session-id. A session that the value does not name is the
    message's key; headers and the time of arrival are the message's own.
    """
    fields = T.StructType.fromDDL(schema).fields
    told = [f for f in fields if f.name not in ("headers", "arrived")]
    parsed = F.from_json(F.col("value").cast("string"), T.StructType([*told, T.StructField(BAD, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = messages.select("key", "value", "headers", "partition", "offset", "timestamp", parsed.alias("_told"))

    def column(f: T.StructField) -> Column:
        if f.name == "headers":
            return F.col("headers").cast(f.dataType).alias("headers")
        if f.name == "arrived":
            return F.col("timestamp").alias("arrived")
        if f.name == "session_id":
            return F.coalesce(F.nullif("_told.session_id", F.lit("")), F.col("key").cast("string")).alias("session_id")
        return F.col(f"_told.{f.name}").alias(f.name)

    none = F.coalesce(F.octet_length("value"), F.lit(0)) == 0
    wrong = F.col("_told").isNull() | F.col(f"_told.{BAD}").isNotNull()
    made = rows.select(*[column(f) for f in fields], F.col("offset").alias("arrival"), "partition", "key", "value", F.when(none, "no-value").when(wrong, "malformed").alias("_why"))
    nameless = F.coalesce("session_id", F.lit("")) == ""
    return made.withColumn("reason", F.coalesce("_why", F.when(nameless, "missing-session-id"))).drop("_why")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("reason", "key", "value")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select("partition", F.col("arrival").alias("offset"), "key", "value", "reason")


def audio_chunks(messages: DataFrame) -> DataFrame:
    """Chunks with arrival, and reason where a message is none: see ``decoded``."""
    return decoded(messages, schemas.AUDIO_CHUNKS)


def recordings(messages: DataFrame) -> DataFrame:
    """Recordings, uploaded or finished, with the headers that say what becomes of them."""
    return decoded(messages, schemas.RECORDINGS)


def encoded(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows as messages: key, value (JSON without null fields) and headers, for a message sink."""
    told = [c for c in rows.columns if c != "headers"]
    headers = F.col("headers") if "headers" in rows.columns else F.array().cast(schemas.HEADERS)
    return rows.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*told)).cast("binary").alias("value"), headers.alias("headers"))
