"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names it. Only a local session may
    lack that setting; it then gets a temporary folder, which is right there
    because driver and executors are one process on one machine.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/speechframes/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows reads files that every executor can
    reach, so a lost executor costs its running tasks only.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made. Nothing that is still to run may read them."""
    for made in tables:
        context = made.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(made.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text) -> F.Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most_bytes`` in a column of texts, bytes or lists (or one row)."""
    values = batch.column(column)
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    sizes = length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(values.type):
        sizes *= 4
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def fold(id_col, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; null ids fall into fold -1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(-1))


def ordered_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs with __sf_key, a number in the order of the ids, and whether that is the id itself."""
    plain = docs.withColumn("__sf_key", F.col(id_col).cast("long"))
    counted = plain.groupBy("__sf_key").agg(F.count("*").alias("n")).where("n > 1 OR __sf_key IS NULL").limit(1).count()
    if not counted:
        return plain.withColumn("__sf_key", F.coalesce("__sf_key", F.lit(LOWEST))), True
    # ids that repeat or lack: number the pairs of id and text hash
    hashed = plain.withColumn("__sf_hash", F.xxhash64(utf8(F.col(text_col)))).withColumn("__sf_id", F.coalesce("__sf_key", F.lit(LOWEST))).drop("__sf_key")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = written(
        hashed.select("__sf_id", "__sf_hash").distinct().repartitionByRange(parts, "__sf_id", "__sf_hash").sortWithinPartitions("__sf_id", "__sf_hash").withColumn("__sf_part", F.spark_partition_id()).withColumn("__sf_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "row-keys",
    )
    # one row for each partition
    before = F.sum("__sf_rows").over(Window.orderBy("__sf_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = pairs.groupBy("__sf_part").agg(F.count("*").alias("__sf_rows")).select("__sf_part", F.coalesce(before, F.lit(0)).alias("__sf_shift"))
    numbered = pairs.join(F.broadcast(shifts), "__sf_part").select("__sf_id", "__sf_hash", (F.col("__sf_nth") + F.col("__sf_shift")).alias("__sf_key"))
    return hashed.join(numbered, ["__sf_id", "__sf_hash"]).drop("__sf_id", "__sf_hash").withColumn("__sf_key", F.coalesce("__sf_key", F.lit(LOWEST))), False
