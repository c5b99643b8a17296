"""Sharding and license scan."""

import re
import textwrap
import zlib

import duckdb
from pyspark.sql import functions as F

from speechframes.llm import licenses, sharding


def shards(df, n=8):
    return sharding.plan_shards(df, n).collect()


def test_shards_balance_and_slots(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    df = df.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "same").otherwise(F.col("doc_id").cast("string"))))
    got = shards(df)
    total = sum(r["size"] for r in got)
    assert len({r["doc_id"] for r in got}) == len(got) == 5000
    for s in range(8):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) < 0.02 * total / 8 + 100


def test_shards_split_a_hot_group_only(spark):
    data = [(i, "hot") for i in range(1000)] + [(i, f"text {i % 700}") for i in range(1000, 3000)]
    got = shards(spark.createDataFrame(data, "doc_id long, text string"), 4)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes)
    text = dict(data)
    where = {}
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 3


def test_shards_odd_rows(spark, odd_docs, no_docs):
    got = shards(odd_docs)
    assert len(got) == 8 and shards(no_docs) == []
    by = {(r["doc_id"], r["size"]): r["text_crc32"] for r in got}
    assert by[(1, 1)] == 0 and by[(3, 12)] == zlib.crc32(b"the cat sat")
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_shard_documents_writes_all(spark, odd_docs, tmp_path):
    out = sharding.shard_documents(odd_docs.withColumn("shard", F.lit("clash")), str(tmp_path / "s"), 3)
    assert out.count() == 8 and set(out.columns) == {*odd_docs.columns, "shard"}


def license_rows(spark, rows, data):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("license_id", F.lit("clash"))
    found = licenses.scan(df, licenses.template_frame(spark))
    long = lambda c: F.col(c).cast("long")
    return rows(found, "doc_id", "unit", long("line_no"), long("n_lines"), "license_id", long("part"), "shared", F.round("dice", 6))


def test_licenses_match_duckdb(spark, rows):
    data = [(1, "Intro\nReleased under the MIT License.\nmore text here"), (2, "released UNDER the mit license!!"), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0"), (5, "Licensed under CC BY-NC 4.0"), (6, "Licensed under the Apache License Version 2 0 today"), (7, "word"), (8, "Released under\nthe MIT License."), (9, "the the the the the the")]
    prose = "\n".join(f"some line of prose number {i} that goes on" for i in range(30))
    for i, (license_id, parts) in enumerate(licenses.TEXTS.items()):
        wrapped = "\n\n".join(textwrap.fill(p, 60) for p in parts)
        data.append((100 + i, f"{prose}\n\nCopyright (c) 2020 {license_id} people\n\n{wrapped}\n\n{prose}"))
    data += [(200, "\n".join(["", " ", "!!", "Licensed under", "CC BY", "4.0", ""])), (201, "x\n" * 5 + "\n \n" + "y\n" * 6)]
    got = license_rows(spark, rows, data)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    want = con.execute(f"SELECT doc_id, unit, line_no, n_lines, license_id, part, shared, dice FROM ({licenses.ORACLE})").fetchall()
    assert got == sorted(want, key=repr)
    assert (1, "lines", 1, 1, "MIT", 0, 4, 1.0) in got and (8, "lines", 0, 2, "MIT", 0, 4, 1.0) in got and (8, "document", -1, 2, "MIT", 0, 4, 1.0) in got
    assert sum(r[0] == 5 for r in got) == 2
    found = {(r[0], r[4]) for r in got}
    assert all((100 + i, license_id) in found for i, license_id in enumerate(licenses.TEXTS))


def test_notice_wrapped_over_lines_is_found(spark, rows):
    notice = dict(licenses.TEMPLATES)["0BSD"]
    text = "first line of prose\n" + textwrap.fill(notice, 70) + "\nlast line of prose\n" * 3
    assert [r[1:6] for r in license_rows(spark, rows, [(1, text)]) if r[2] == 1] == [("lines", 1, 2, "0BSD", 0)]


def test_license_ids_and_long_texts(spark, rows):
    """Rows of one id are judged apart; ties between templates go to the smaller id; a text of over a megabyte is read whole."""
    data = [(None, "Released under the MIT License."), (None, "Licensed under CC BY 4.0."), (1, "filler words here\n" * 70_000 + "Released under the MIT License.")]
    got = license_rows(spark, rows, data)
    assert {(r[0], r[4]) for r in got} == {(None, "MIT"), (None, "CC-BY-4.0"), (1, "MIT")} and (1, "lines", 70_000, 1, "MIT", 0, 4, 1.0) in got
    twins = spark.createDataFrame([("b", 0, "one two three four"), ("a", 0, "one two three four")], "license_id string, part int, text string")
    assert rows(licenses.scan(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), twins), "license_id") == [("a",)]


def test_licenses_empty(spark, no_docs):
    assert licenses.scan(no_docs, licenses.template_frame(spark)).count() == 0


def test_license_scan_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = licenses.scan(spark.read.parquet(str(tmp_path / "docs")), licenses.template_frame(spark))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_paragraphs_between_odd_blank_lines(spark, rows):
    """The paragraphs are those that the text's blank lines part, also at its ends and where blank lines hold other spaces."""
    body = textwrap.fill(licenses.TEXTS["MIT"][0], 40)
    data = [(i, f"{head}{body}{gap}{body}{tail}") for i, (head, gap, tail) in enumerate([("", "\n\n", ""), ("\n", "\n \t\r\n\n", "\n"), ("\n\n", "\n\u00a0\n", "\n\n"), (" \n\n\n", "\n \n", "\n\n \n"), ("\n \n", "\n", "\n \n\n"), ("!\n", "\n\n\n\n", "\n\x0b\n")])]
    got = {(r[0], r[2], r[3]) for r in license_rows(spark, rows, data) if r[1] == "paragraph"}
    split = {i: [p.count("\n") + 1 for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", t)] for i, t in data}
    want = {(i, n, size) for i, sizes in split.items() for n, size in enumerate(sizes) if size > licenses.RUN}
    assert got == want - {(2, 1, 25), (4, 1, 24)} and len(got) == 8  # pairs that no blank line parts are too long
