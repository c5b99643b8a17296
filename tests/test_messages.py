"""Messages to typed rows and back."""

import datetime as dt

from pyspark.sql import functions as F

from speechframes.sources import messages as M

MESSAGE = "key binary, value binary, headers array<struct<key:string,value:binary>>, partition int, offset long, timestamp timestamp"
T0 = dt.datetime(2026, 1, 1)


def test_chunks_and_their_rejects(spark, rows):
    head = [("X-Outputs", b"final")]
    values = [
        b'{"session_id": "s1", "seq": 4, "sample_rate": 16000, "pcm16_le": "AQIDBA==", "lang": "en"}',
        b'{"session_id": "", "seq": 5}',
        b'{"seq": "five"}',
        b"not json",
        None,
        b"",
        b'{"seq": 1}',
    ]
    data = [(None if i == 6 else b"k1", v, head if i == 0 else None, i % 2, 100 + i, T0) for i, v in enumerate(values)]
    made = M.audio_chunks(spark.createDataFrame(data, MESSAGE))
    good = M.accepted(made)
    assert rows(good, "session_id", "seq", "pcm16_le", "lang", "arrival", "arrived") == [("k1", 5, None, None, 101, T0), ("s1", 4, bytearray(b"\x01\x02\x03\x04"), "en", 100, T0)]
    assert good.where("session_id = 's1'").select("headers").first()[0][0]["value"] == b"final"
    assert rows(M.rejected(made), "offset", "reason") == [(102, "malformed"), (103, "malformed"), (104, "no-value"), (105, "no-value"), (106, "missing-session-id")]


def test_recordings_come_back_as_they_went(spark, rows):
    from speechframes.sources import sinks

    made = spark.createDataFrame([("s1", "t", 1.5, True), ("s2", None, None, False)], "session_id string, tenant_id string, duration_s double, store_recording boolean")
    sent = M.encoded(sinks.finished_events(made, F.array(F.lit("qwen"), F.lit("whisperx"))))
    back = M.accepted(M.recordings(sent.withColumns({"partition": F.lit(0), "offset": F.lit(7).cast("long"), "timestamp": F.lit(T0)})))
    assert rows(back, "session_id", "tenant_id", "duration_s", "arrival") == [("s1", "t", 1.5, 7), ("s2", None, None, 7)]
    told = {r["session_id"]: {h["key"]: bytes(h["value"]).decode() for h in r["headers"]} for r in back.collect()}
    assert told["s1"] == {"x-store-recording": "true", "x-outputs": "final", "x-final-tracks": "qwen,whisperx"} and told["s2"]["x-store-recording"] == "false"


def test_a_stream_of_messages(spark, tmp_path, rows):
    spark.createDataFrame([(b"k", b'{"seq": 1}', None, 0, 0, T0), (b"k", b"{", None, 0, 1, T0)], MESSAGE).write.parquet(str(tmp_path / "in"))
    stream = M.audio_chunks(spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in"))).select("session_id", "seq", "arrival", "reason")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("k", 1, 0, None), ("k", None, 1, "malformed")]
