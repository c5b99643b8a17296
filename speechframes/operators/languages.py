"""Languages by name, code or locale; requested sets against supported ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechframes.functions.text import strip

# fixed values: names and codes of the languages that the models share
NAMES = [("de", "German"), ("en", "English"), ("es", "Spanish"), ("fr", "French"), ("it", "Italian"), ("ja", "Japanese"), ("ko", "Korean"), ("nl", "Dutch"), ("pl", "Polish"), ("pt", "Portuguese"), ("ru", "Russian"), ("zh", "Chinese")]


def public_language(rows: DataFrame, column: str, fallback: str = "", out: str = "language", names: list[tuple[str, str]] | None = None) -> DataFrame:
    """rows with the code of a language given by code, name or locale (its part before the dash), else the fallback.

    The table of names is a literal map in the plan: no join, no shuffle.
    """
    known = {x.lower(): code for code, name in names or NAMES for x in (code, name)}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    given = F.lower(strip(F.col(column)))
    found = F.coalesce(F.try_element_at(table, given), F.try_element_at(table, F.split(given, "[-_]")[0]))
    return rows.withColumn(out, F.coalesce(found, F.lit(fallback)))


def unsupported(requested: Column, supported: list[str]) -> Column:
    """What was requested and is not supported, in order, each once."""
    return F.array_distinct(F.array_except(requested, F.array(*map(F.lit, supported))))


def keep_fluent_drafts(hypotheses: DataFrame, keys: list[str], ratio: str, most: float) -> DataFrame:
    """hypotheses of the drafts of which none exceeds the compression ratio; a repetitive draft is withheld whole."""
    bad = hypotheses.where(F.col(ratio) > most).select(*keys).distinct()
    return hypotheses.join(bad, keys, "left_anti")
