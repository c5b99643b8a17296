import datetime as dt

from pyspark.sql import functions as F

from speechframes.operators import ordered, windows
from speechframes.streaming import sessions as S

SCHEMA = "session_id long, seq long, n_samples long, ts timestamp, end_marker boolean, ts_us long, text string, speech boolean"
T0 = dt.datetime(2026, 1, 1)


def chunks(session, n, samples, at=0):
    return [(session, i, samples, T0 + dt.timedelta(seconds=at + i), False, (at + i) * 1_000_000, f"t{i}", True) for i in range(n)]


def run(spark, tmp_path, batches, make, sort=True):
    """Each batch is a file; availableNow reads one file a micro-batch."""
    source = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    stream = spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")
    query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


LATER = [(9, 0, 1, T0 + dt.timedelta(hours=5), False, 0, "", True)]  # moves the watermark past all others


def test_slices_equal_batch(spark, tmp_path, rows):
    data = chunks(1, 10, 700) + chunks(2, 3, 1000)
    got = run(spark, tmp_path, [data[:4], data[4:], LATER], lambda s: S.slices(s, ["session_id"], "session_id long", 1500, "1 second", 30_000))
    want = windows.slices(spark.createDataFrame(data, SCHEMA), ["session_id"], 1500)
    columns = ["session_id", "slice_index", "n_samples", "base_sample", "flush_reason"]
    assert rows(got.where("session_id <> 9"), *columns) == rows(want, *columns)


def test_marked_recordings(spark, tmp_path, rows):
    data = [list(r) for r in chunks(1, 6, 100)]
    data[0][4] = data[3][4] = True
    got = run(spark, tmp_path, [[tuple(r) for r in data], LATER], lambda s: S.marked_recordings(s, ["session_id"], "session_id long", "1 second", 30_000))
    assert rows(got.where("session_id = 1")) == [(1, 0, 2, 200, "marker"), (1, 1, 2, 200, "idle")]


def test_partials_equal_batch(spark, tmp_path, rows):
    data = chunks(1, 25, 16_000)
    got = run(spark, tmp_path, [data[:7], data[7:], LATER], lambda s: S.partial_updates(s, ["session_id"], "session_id long", "1 second", 30_000))
    want = ordered.partial_updates(spark.createDataFrame(data, SCHEMA), ["session_id"], "session_id long", ["seq"])
    columns = ["kind", "start_sample", "end_sample", "text"]
    tail = [("FINAL", 320_000, 400_000, "")]
    assert rows(got.where("session_id = 1"), *columns) == sorted(rows(want, *columns) + tail, key=repr)


def test_idle_recordings(spark, tmp_path, rows):
    data = chunks(1, 3, 100) + chunks(1, 2, 100, at=32) + chunks(1, 2, 50, at=90)
    got = run(spark, tmp_path, [data, LATER], lambda s: S.idle_recordings(s, ["session_id"], "30 seconds", "1 second"))
    assert rows(got.where("session_id = 1"), "total_samples", "n_chunks") == [(100, 2), (500, 5)]  # 30 s apart still joins


def test_novel_epochs(spark, tmp_path, rows):
    data = [(1, i, 0, T0 + dt.timedelta(seconds=i), False, 0, t, True) for i, t in enumerate(["the quick brown fox", "brown fox jumps over", "over the dog"])]
    got = run(spark, tmp_path, [data[:2], data[2:], LATER], lambda s: S.novel_epochs(s.withColumnRenamed("seq", "epoch"), ["session_id"], "session_id long", "1 second", 30_000, tail=5))
    assert rows(got.where("session_id = 1"), "epoch", "novel", "context") == [(0, "the quick brown fox", "n fox"), (1, "jumps over", " over"), (2, "the dog", "e dog")]


def test_publish_is_replay_safe(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(chunks(1, 4, 10) + chunks(1, 4, 10), SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    for run_no in range(2):  # a lost checkpoint replays everything
        S.publish(stream, out, str(tmp_path / f"cp{run_no}"), ["session_id", "seq"], lambda df: df.withColumn("loaded", F.lit(run_no))).awaitTermination(60)
    assert rows(spark.read.parquet(out), "seq", "loaded") == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_live_lines(spark, rows):
    data = [(1, i, T0 + dt.timedelta(seconds=i), k, t) for i, (k, t) in enumerate([("PARTIAL", "a"), ("FINAL", "b"), ("PARTIAL", "c"), ("PARTIAL", "d")])]
    df = spark.createDataFrame(data + [(2, 0, T0, "PARTIAL", "x"), (2, 1, T0, "FINAL", "y")], "session_id long, seq long, ts timestamp, kind string, text string")
    assert rows(S.live_lines(df, ["session_id"])) == [(1, "d"), (2, None)]


def test_gallery_is_reloaded_after_its_time_to_live_and_after_an_invalidation(spark, tmp_path):
    """A load serves until 10 s later, an enrolment in between waits for it, an invalidation does not."""
    schema = "tenant_id string, ts_us long, kind string, version long, ts timestamp"
    at = lambda s, kind, version=None, tenant="t": (tenant, s * 1_000_000, kind, version, T0 + dt.timedelta(seconds=s))
    data = [at(999, "gallery", 1), at(1000, "use"), at(1002, "gallery", 2), at(1005, "use"), at(1015, "use"), at(1015, "use", tenant="u"), at(1016, "invalidate"), at(1017, "use"), at(1027, "use"), at(1028, "gallery", 3), at(1028, "use"), at(1040, "use")]
    want = [("t", 1000, 1000, 1), ("t", 1005, 1000, 1), ("t", 1015, 1015, 2), ("t", 1017, 1017, 2), ("t", 1027, 1017, 2), ("t", 1028, 1028, 3), ("t", 1040, 1040, 3), ("u", 1015, 1015, None)]
    plain = lambda df: sorted((r["tenant_id"], r["ts_us"] // 10**6, r["loaded_us"] // 10**6, r["version"]) for r in df.collect())
    assert plain(ordered.gallery_in_use(spark.createDataFrame(data, schema), "tenant_id string", ["ts_us"], 10_000_000)) == want
    source = str(tmp_path / "in")
    for i, rows in enumerate([data[:4], data[4:7], data[7:]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/b={i}")
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")
    made = S.gallery_in_use(stream, "tenant_id string", ["ts_us"], "1 second", 10_000)
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and plain(spark.read.parquet(str(tmp_path / "out"))) == want


def test_streams_keep_null_and_large_numbers(spark, tmp_path, rows):
    large = 2**53 + 1
    data = [(None, 0, 5, T0, False, large, None, None), (large, 0, 7, T0, False, 0, "a", True), (large - 1, 0, 9, T0, False, 0, "b", True)]
    got = run(spark, tmp_path, [data, LATER], lambda s: S.slices(s, ["session_id"], "session_id long", 100, "1 second", 30_000))
    assert rows(got.where("session_id IS NULL OR session_id > 9"), "session_id", "n_samples") == sorted([(None, 5), (large, 7), (large - 1, 9)], key=repr)
