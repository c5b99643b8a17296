"""Every registered query with a DuckDB equivalent gives the same rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from speechframes import registry

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "embeddings", "events", "pages")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    value = value.item() if isinstance(value, np.generic) else value
    return int(value) if isinstance(value, float) and value == int(value) else value


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_duckdb(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert table(got) == table(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_text_merge_matches_direct_loop(spark):
    from speechframes.functions.text import merge_echo, novel_text

    got = {(r["session_id"], r["turn"]): (r["novel"], r["committed_chars"]) for r in registry.QUERIES["text_merge"](spark, SF).collect()}
    said = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        said.setdefault(r["conv_id"], {})[r["turn"]] = r["text"].strip(" ")
    want = {}
    for session, turns in said.items():
        committed, before = "", None
        for turn in sorted(turns):
            text = turns[turn] if before is None else f"{before[-40:].strip(' ')} {turns[turn]}"
            new = novel_text(committed, text)
            committed = merge_echo(committed, text)
            want[(session, turn)] = new, len(committed)
            before = turns[turn]
    assert got == want
