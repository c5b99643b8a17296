"""Balanced shards by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id), so equal texts lie together. The
splitters between shards are found by counting: each round sums the exact bytes
of the rows below every candidate boundary (256 probes inside each interval
that is still open), keeps the probe interval that holds the target, and
refines it, until a probe lies within the tolerance of its target. One range
exchange then brings the rows into shard order.

Only histograms reach the driver: at most 256 rows for each open splitter and
round, whatever the size of the table.

Defined cases: a null text has no bytes (size 1) and the CRC of the empty
text; null ids come first among equal texts; repeated rows share a key and stay
in one shard; a group of equal texts stays in one shard unless keeping it whole
would move a boundary by more than the tolerance, as a group with a third of all
rows would; an empty table gives an empty result; further columns of the input
are ignored by ``plan_shards`` and kept by ``shard_documents``, which replaces
columns named like its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechframes.llm.common import table, utf8, written

PROBE_BITS = 8
KEY_DIGITS = 8  # of PROBE_BITS each, for either part of the key
LOWEST = -(1 << 63)


@dataclass
class _Splitter:
    target: int
    digits: tuple[int, ...] = ()
    below: int = 0
    bound: tuple[int, int] | None = None
    tried: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


def _digit(level: int) -> F.Column:
    part = F.col("_key") if level < KEY_DIGITS else F.col("_tie")
    shift = 64 - PROBE_BITS * (level % KEY_DIGITS + 1)
    return F.shiftrightunsigned(part.bitwiseXOR(F.lit(LOWEST)), shift).bitwiseAND(F.lit(255)).cast("int")


def _prefix_number(digits: tuple[int, ...]) -> int:
    """The signed 64-bit number whose leading digits these are, zeros after."""
    n = 0
    for d in digits:
        n = n << PROBE_BITS | d
    return (n << PROBE_BITS * (KEY_DIGITS - len(digits))) + LOWEST


def _as_bound(digits: tuple[int, ...]) -> tuple[int, int]:
    """The least (key, tie) with these leading digits; past-the-end digits carry."""
    digits = list(digits)
    for i in range(len(digits) - 1, 0, -1):
        if digits[i] == 256:
            digits[i] = 0
            digits[i - 1] += 1
    if digits[0] == 256:
        return ((1 << 63) - 1, (1 << 63) - 1)
    key, tie = tuple(digits[:KEY_DIGITS]), tuple(digits[KEY_DIGITS:])
    return _prefix_number(key), _prefix_number(tie) if tie else LOWEST


def _within(digits: tuple[int, ...]) -> F.Column:
    """Rows whose key begins with these digits."""
    if not digits:
        return F.lit(True)
    key = digits[:KEY_DIGITS]
    shift = 64 - PROBE_BITS * len(key)
    same = F.shiftright(F.col("_key"), shift) == F.lit(_prefix_number(key) >> shift)
    if len(digits) > KEY_DIGITS:
        tie = digits[KEY_DIGITS:]
        shift = 64 - PROBE_BITS * len(tie)
        same &= F.shiftright(F.col("_tie"), shift) == F.lit(_prefix_number(tie) >> shift)
    return same


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (key, tie): a row belongs to as many shards to the right as boundaries it reaches."""
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    allowed = tolerance * total / shards
    splitters = [_Splitter(target=total * i // shards) for i in range(1, shards)]
    for level in range(2 * KEY_DIGITS):
        waiting = [s for s in splitters if s.bound is None]
        if not waiting or not total:
            break
        prefixes = sorted({s.digits for s in waiting})
        which = F.lit(None).cast("int")
        for i, p in enumerate(prefixes):
            which = F.when(_within(p), i).otherwise(which)
        counted = (
            keyed.select(which.alias("_which"), _digit(level).alias("_probe"), "_size")
            .where(F.col("_which").isNotNull())
            .groupBy("_which", "_probe")
            .agg(F.sum("_size").alias("_bytes"))
            .collect()
        )
        bytes_of = {(r["_which"], r["_probe"]): r["_bytes"] for r in counted}
        for s in waiting:
            w = prefixes.index(s.digits)
            below = s.below
            for probe in range(256):
                here = bytes_of.get((w, probe), 0)
                if below + here >= s.target:
                    break
                below += here
            s.tried += [(abs(below - s.target), (*s.digits, probe)), (abs(below + here - s.target), (*s.digits, probe + 1))]
            off, digits = min(s.tried)
            if off <= allowed or level == 2 * KEY_DIGITS - 1:
                s.bound = _as_bound(digits)
            else:
                s.digits, s.below = (*s.digits, probe), below
    return [s.bound or (LOWEST, LOWEST) for s in splitters]


def _keys(id_col: str, text_col: str) -> dict[str, F.Column]:
    data = utf8(F.col(text_col))
    return {
        "_tie": F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)),
        "_key": F.xxhash64(data),
        "_size": (F.length(data) + 1).cast("long"),
    }


def _shard_of(splitters: list[tuple[int, int]]) -> F.Column:
    shard = F.lit(0)
    for key, tie in splitters:
        reached = (F.col("_key") > key) | ((F.col("_key") == key) & (F.col("_tie") >= tie))
        shard += F.when(reached, 1).otherwise(0)
    return shard


def plan_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    ``tolerance`` is the part of a shard by which a boundary may miss its exact
    place; it is met unless single rows are larger than it.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in _keys(id_col, text_col).items()], F.crc32(utf8(F.col(text_col))).alias("_crc"))
    keyed = written(keyed, "shard-keys")
    shard = _shard_of(find_splitters(keyed, shards, tolerance))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(
        keyed.withColumn("_shard", shard)
        .repartitionByRange(parts, "_shard", "_key", "_tie")
        .sortWithinPartitions("_shard", "_key", "_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "shard-order",
    )
    # one row for each shard in each partition: bounded by partitions + shards
    runs = ordered.groupBy("_part", "_shard").agg(F.min("_nth").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", "_shard", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return ordered.join(F.broadcast(runs), ["_part", "_shard"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_nth") + F.col("_shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> DataFrame:
    """Write whole rows as Parquet below ``path``, one folder for each shard, in key order; returns what was written."""
    keyed = docs.withColumns(_keys(id_col, text_col))
    shard = _shard_of(find_splitters(written(keyed.select("_tie", "_key", "_size"), "shard-keys"), shards, tolerance))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = keyed.withColumn("shard", shard).repartitionByRange(parts, "shard", "_key", "_tie").sortWithinPartitions("shard", "_key", "_tie")
    out.select(*[c for c in docs.columns if c != "shard"], "shard").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_shards(table(spark, sf_dir, "documents"), 8)
