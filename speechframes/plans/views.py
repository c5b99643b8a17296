"""Speech-shaped views over the driver's tables, and the same views as DuckDB text.

The library's operators take any DataFrames of these shapes; the views let every
registered query run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words() -> Column:
    return F.array_remove(F.split("text", "[ \n]+"), "")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of a conversation, on a clock in milliseconds."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.posexplode(split_words()).alias("idx", "word"))
    at = F.col("turn") * 20000 + F.col("idx") * 250
    return rows.select("session_id", "turn", "role", "idx", "word", at.alias("s_ms"), (at + 40 + F.length("word") * 20).alias("e_ms"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One speaker turn per conversation turn; turns overlap each other."""
    spoken = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.size(split_words()).alias("n")).where("n > 0")
    spoken = spoken.groupBy("session_id", "turn", "role").agg(F.sum("n").alias("n"))
    start = F.col("turn") * 20000 + (F.col("session_id") % 3) * 100
    end = start + F.col("n") * 250 + ((F.col("session_id") * 7 + F.col("turn") * 13) % 5) * 100 - 200
    return spoken.select("session_id", F.col("turn").alias("turn_ord"), F.col("role").alias("speaker"), start.alias("s_ms"), end.alias("e_ms"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio chunks: one per event, with a sample count and end markers."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        (F.col("user_id") % 5).alias("tenant_id"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts_us"),
        F.floor(F.col("value") * 100).cast("long").alias("n_samples"),
        (F.col("event_type") == "signup").alias("end_marker"),
        "event_id",
        "event_type",
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control headers as raw text, absent and empty ones among them."""
    kind, n = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.when(kind == "view", None).when(kind == "click", "").when(kind == "purchase", "refined, FINAL").when(kind == "signup", "realtime,bogus").otherwise(" final ").alias("outputs_raw"),
        F.when(n % 5 == 0, None).when(n % 5 == 1, "false").when(n % 5 == 2, "YES").when(n % 5 == 3, "maybe").otherwise("0").alias("store_raw"),
        F.when(n % 4 == 0, None).when(n % 4 == 1, "").when(n % 4 == 2, "whisperx, qwen").otherwise("parakeet").alias("tracks_raw"),
        F.when(n % 4 == 0, None).when(n % 4 == 1, "nan").when(n % 4 == 2, "abc").otherwise(F.get_json_object("props", "$.k")).alias("window_raw"),
    )


def header_rows(raw: DataFrame) -> DataFrame:
    """The raw headers as an array of (key, value), as a message source delivers them."""
    names = {"X-Outputs": "outputs_raw", "x-store-recording": "store_raw", "X-Final-Tracks": "tracks_raw", "x-refinement-window-sec": "window_raw"}
    made = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(F.col(c), "UTF-8").alias("value")) for k, c in names.items()])
    return raw.withColumn("headers", F.filter(made, lambda h: h["value"].isNotNull()))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("tenant_id"), F.col("label").cast("int").alias("label"), "embedding")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events; each sixth breaks one rule."""
    n = F.col("page_id")
    uuid = F.format_string("00000000-0000-4000-8000-%012d", n)
    tenant = F.concat(F.lit("tenant_"), (n % 7).cast("string"))
    bad = n % 6
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(bad == 1, "not-a-uuid").otherwise(uuid).alias("session_id"),
        F.when(bad == 2, "bad tenant!").otherwise(tenant).alias("tenant_id"),
        F.concat(F.lit("s3://"), F.when(bad == 3, "elsewhere").otherwise("speech"), F.lit("/"), tenant, F.lit("/uploads/"), F.when(bad == 4, "another").otherwise(uuid), F.lit("/source")).alias("source_url"),
        F.length("html").cast("long").alias("n_bytes"),
    )


WORDS = """words AS (
  SELECT conv_id AS session_id, turn, role, (i-1)::INT AS idx, ws[i] AS word,
         turn*20000 + (i-1)*250 AS s_ms, turn*20000 + (i-1)*250 + 40 + length(ws[i])*20 AS e_ms
  FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '') AS ws FROM conversations) t,
       LATERAL (SELECT unnest(generate_series(1, len(ws))) AS i) u
)"""
TURNS = (
    WORDS
    + """, turns AS (
  SELECT session_id, turn AS turn_ord, role AS speaker,
         turn*20000 + (session_id%3)*100 AS s_ms,
         turn*20000 + (session_id%3)*100 + count(*)*250 + ((session_id*7 + turn*13)%5)*100 - 200 AS e_ms
  FROM words GROUP BY session_id, turn, role
)"""
)
CHUNKS = """chunks AS (
  SELECT user_id AS session_id, user_id%5 AS tenant_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         epoch_us(ts) AS ts_us, CAST(floor(value*100) AS BIGINT) AS n_samples,
         event_type = 'signup' AS end_marker, event_id, event_type
  FROM events
)"""
HEADERS = """headers AS (
  SELECT event_id, user_id AS session_id,
         CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' WHEN 'purchase' THEN 'refined, FINAL'
                         WHEN 'signup' THEN 'realtime,bogus' ELSE ' final ' END AS outputs_raw,
         CASE event_id%5 WHEN 0 THEN NULL WHEN 1 THEN 'false' WHEN 2 THEN 'YES' WHEN 3 THEN 'maybe' ELSE '0' END AS store_raw,
         CASE event_id%4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'whisperx, qwen' ELSE 'parakeet' END AS tracks_raw,
         CASE event_id%4 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN 'abc' ELSE props->>'$.k' END AS window_raw
  FROM events
)"""
PROBES = "probes AS (SELECT vec_id, vec_id%3 AS tenant_id, label, embedding FROM embeddings)"
UPLOADS = """uploads AS (
  SELECT page_id,
         CASE WHEN page_id%6 = 1 THEN 'not-a-uuid' ELSE u END AS session_id,
         CASE WHEN page_id%6 = 2 THEN 'bad tenant!' ELSE t END AS tenant_id,
         's3://' || CASE WHEN page_id%6 = 3 THEN 'elsewhere' ELSE 'speech' END || '/' || t || '/uploads/' || CASE WHEN page_id%6 = 4 THEN 'another' ELSE u END || '/source' AS source_url,
         CAST(length(html) AS BIGINT) AS n_bytes
  FROM (SELECT *, printf('00000000-0000-4000-8000-%012d', page_id) AS u, 'tenant_' || CAST(page_id%7 AS VARCHAR) AS t FROM pages)
)"""
