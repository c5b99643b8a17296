"""Ordered scans over sessions that are cut into bins, so that one session is the work of many tasks.

Rows go to bins of their leading order column. Each bin is summarised by a small
row, the summaries of a session (thousands for the longest) are scanned in
order, and every bin is finished with what it is carried from the bins before
or after it. Rows cross the network once, by session and bin; a summary and the
pass that uses it read the same exchange, because both ask for the whole row.

Null keys are a session like any other, and null order values come first, in a
bin of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_BIN = -(1 << 62)
AT = ["_key", "_bin"]


def bin_number(rows: DataFrame, lead: str, width: int) -> Column:
    """A bin spans ``width`` of a numeric lead, or as many seconds of a timestamp."""
    kind = rows.schema[lead].dataType
    if isinstance(kind, T.TimestampType):
        at = F.unix_micros(lead) / 1_000_000
    elif isinstance(kind, T.NumericType):
        at = F.col(lead)
    else:
        at = F.lit(0)  # no distance: the session stays in one bin
    return F.coalesce(F.floor(at / width).cast("long"), F.lit(FIRST_BIN))


def packed(rows: DataFrame, keys: list[str], lead: str, width: int) -> DataFrame:
    """Rows as _key (their keys), _bin (see bin_number) and _row, each bin of a session in one task."""
    return rows.select(F.struct(*keys).alias("_key"), bin_number(rows, lead, width).alias("_bin"), F.struct("*").alias("_row")).repartition(*AT)


def within(order: Iterable[str | Column], *further: str) -> WindowSpec:
    """The rows of a bin in order; names are columns of _row."""
    return Window.partitionBy(*AT, *further).orderBy(*[F.col(f"_row.{o}") if isinstance(o, str) else o for o in order])


def unpacked(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns of _row, and further ones.

    The row is opened as a whole: fields taken one by one would be pruned below
    the exchange, which the summaries then could not share.
    """
    return rows.select(F.inline(F.array("_row")), *columns)


def bins() -> WindowSpec:
    """The bins of a session in order."""
    return Window.partitionBy("_key").orderBy("_bin")


def earlier() -> WindowSpec:
    return bins().rowsBetween(Window.unboundedPreceding, -1)


def later() -> WindowSpec:
    return bins().rowsBetween(1, Window.unboundedFollowing)


def summaries(rows: DataFrame, every: bool = False, **columns: Column) -> DataFrame:
    """One row for each bin of each session, with its first and last row (by _nth) and further columns.

    Running columns are complete at a bin's last row, so its first and last rows are all that is looked at, unless ``every`` one is asked for.
    """
    seen = rows if every else rows.where("_nth = 1 OR _final")
    return seen.groupBy(*AT).agg(F.min_by("_row", "_nth").alias("_head"), F.max_by("_row", "_nth").alias("_last"), *[c.alias(n) for n, c in columns.items()])


def carried(rows: DataFrame, bins: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their bin's summary."""
    return rows.join(bins.select(*AT, *columns), AT)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their number in the bin and whether they are its last."""
    return rows.withColumns({"_nth": F.row_number().over(within(order)), "_final": F.lead(F.lit(1)).over(within(order)).isNull()})


def with_previous(rows: DataFrame, keys: list[str], order: list[str], width: int, previous: str = "_previous", head: str | None = None) -> DataFrame:
    """rows with the struct of the row before each in its session (null for the first), and that of the session's first row."""
    line = numbered(packed(rows, keys, order[0], width), order).withColumn("_lag", F.lag("_row").over(within(order)))
    summed = summaries(line).select(*AT, F.lag("_last").over(bins()).alias("_before"), F.first("_head").over(bins().rowsBetween(Window.unboundedPreceding, 0)).alias("_start"))
    made = carried(line, summed, "_before", "_start")
    added = [F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_lag")).alias(previous)] + ([F.col("_start").alias(head)] if head else [])
    return unpacked(made, *added)


def before_first(rows: DataFrame, keys: list[str], order: list[str], width: int, stop: Column) -> DataFrame:
    """The rows of each session before its first one for which ``stop`` holds."""
    line = numbered(packed(rows.withColumn("_stop", F.coalesce(stop, F.lit(False))), keys, order[0], width), order)
    line = line.withColumn("_met", F.max("_row._stop").over(within(order).rowsBetween(Window.unboundedPreceding, 0)))
    summed = summaries(line, _any=F.max("_met")).where("_head IS NOT NULL").withColumn("_earlier", F.coalesce(F.max("_any").over(earlier()), F.lit(False)))
    kept = carried(line, summed, "_earlier").where("NOT _earlier AND NOT _met")
    return unpacked(kept).drop("_stop")
