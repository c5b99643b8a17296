"""The keyed table that micro-batches write."""

import pytest
from pyspark.sql import functions as F

from speechframes.sources import sinks

ROW = "tenant_id string, session_id string, track_id string, created_at_ns long, full_text string"


def transcripts(spark, *rows):
    return spark.createDataFrame([("t", s, "final", at, text) for s, at, text in rows], ROW)


def test_replays_and_late_batches_change_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "table")
    write = sinks.transcript_sink(path, "model-1", parts=4)
    first, second = transcripts(spark, ("a", 1, "old"), ("b", 1, "b"), ("a", 2, "new")), transcripts(spark, ("b", 5, "better"), ("c", 1, "c"))
    want = [("a", 2, "new", "model-1"), ("b", 5, "better", "model-1"), ("c", 1, "c", "model-1")]
    for batch in (first, second, second, first):  # the last ones are replays, of which one is older
        write(batch, 0)
        if batch is second:
            assert rows(spark.read.parquet(path), "session_id", "created_at_ns", "full_text", "model") == want
    assert rows(spark.read.parquet(path), "session_id", "created_at_ns", "full_text", "model") == want
    sinks.transcript_sink(path, "model-2", parts=4)(transcripts(spark, ("c", 1, "again")), 4)  # an equal time: the batch's row
    assert ("c", 1, "again", "model-2") in rows(spark.read.parquet(path), "session_id", "created_at_ns", "full_text", "model")


def test_first_rows_stay(spark, tmp_path, rows):
    path = str(tmp_path / "table")
    write = sinks.append_once(path, ["session_id"], parts=3)
    for text in ("one", "two"):
        write(transcripts(spark, ("a", 1, text)).unionByName(transcripts(spark, (text, 1, text))), 0)
    write(transcripts(spark), 1)
    assert rows(spark.read.parquet(path), "session_id", "full_text") == [("a", "one"), ("one", "one"), ("two", "two")]


def test_a_batch_reads_and_rewrites_its_own_folders_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    write = sinks.upsert(path, ["session_id"], ["created_at_ns"], parts=64)
    write(transcripts(spark, *((f"s{i}", 1, "x") for i in range(3000))), 0)
    folders = sorted(p.name for p in (tmp_path / "table").glob("key_part=*"))
    assert len(folders) == 64
    state = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "table").glob("key_part=*/*.parquet")}
    before = state()
    read = []
    from pyspark.sql import DataFrameReader

    parquet = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **o: read.extend(paths) or parquet(self, *paths, **o))
    write(transcripts(spark, ("s7", 2, "y")), 1)
    after = state()
    assert len([p for p in read if "key_part=" in p]) == 1
    assert len(after.keys() - before.keys()) == len(before.keys() - after.keys()) == 1
    assert all(after[f] == before[f] for f in after.keys() & before.keys())
    assert spark.read.parquet(path).where("full_text = 'y'").count() == 1 and spark.read.parquet(path).count() == 3000


def test_a_run_that_dies_before_the_table_is_in_place_is_finished_by_the_next(spark, tmp_path, rows):
    path = str(tmp_path / "table")
    write = sinks.upsert(path, ["session_id"], ["created_at_ns"], parts=2)
    write(transcripts(spark, ("a", 1, "old"), ("b", 1, "b")), 0)
    # what a batch leaves that has merged its folders and then lost one of them while they were put in place
    merged = spark.read.parquet(path).withColumn("full_text", F.concat("full_text", F.lit("+")))
    merged.write.partitionBy("key_part").parquet(f"{path}/_pending")
    for folder in (tmp_path / "table").glob("key_part=*"):
        for f in folder.iterdir():
            f.unlink()
        folder.rmdir()
        break
    write(transcripts(spark, ("c", 1, "c")), 1)
    assert rows(spark.read.parquet(path), "session_id", "full_text") == [("a", "old+"), ("b", "b+"), ("c", "c")]
    assert not (tmp_path / "table" / "_pending").exists()
    # merged folders that were not written to their end do not count
    merged.limit(0).write.parquet(f"{path}/_pending")
    (tmp_path / "table" / "_pending" / "_SUCCESS").unlink()
    write(transcripts(spark, ("d", 1, "d")), 2)
    assert spark.read.parquet(path).count() == 4


@pytest.mark.parametrize("replace", [True, False])
def test_folders_by_date(spark, tmp_path, replace):
    path = str(tmp_path / "table")
    write = sinks.upsert(path, ["session_id"], ["created_at_ns"], parts=2, by=["day"], replace=replace)
    for day, text in (("2026-01-01", "a"), ("a/b=c", "b"), (None, "c")):
        write(transcripts(spark, (text, 1, text), (text, 0, "before")).withColumn("day", F.lit(day).cast("string")), 0)
        write(transcripts(spark, (text, 2, "after")).withColumn("day", F.lit(day).cast("string")), 1)
    got = {(r["day"], r["session_id"]): r["full_text"] for r in spark.read.schema(ROW + ", day string, key_part int").parquet(path).collect()}
    assert got == ({("2026-01-01", "a"): "after", ("a/b=c", "b"): "after", (None, "c"): "after"} if replace else {("2026-01-01", "a"): "before", ("a/b=c", "b"): "before", (None, "c"): "before"})
