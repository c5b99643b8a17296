import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from speechframes.llm import warc
from speechframes.llm.common import new_path

PAGES = "page_id long, url string, html string"


def crawl(spark, data, least=0):
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(data, PAGES).repartition(3).withColumn("payload", F.lit("clash")), folder, least_bytes=least)
    return folder, index, warc.read_records(index, folder)


def test_round_trip_and_revisits(spark):
    data = [(3, "http://a/é", "same é"), (1, "http://b", "same é"), (2, "http://c\r\nX: y", "other"), (4, None, None), (5, "", ""), (6, "u", "x" * 300_000), (None, "n", "same é"), (1, "http://b2", "same é")]
    folder, index, read = crawl(spark, data)
    got = sorted((tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "url").collect()), key=repr)
    name = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = sorted(((r[0], r[3], r[4]) for r in got), key=repr)
    assert kinds == sorted([(1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "revisit", 4), (6, "response", None), (None, "response", None)], key=repr)
    text = {1: "same é", 2: "other", 3: "same é", 4: "", 5: "", 6: "x" * 300_000, None: "same é"}
    for page, size, digest, kind, _, payload, _ in got:
        assert (size, digest) == (len(text[page].encode()), name(text[page]))
        assert payload is None if kind == "revisit" else bytes(payload).decode() == text[page]
    assert {r[6] for r in got if r[0] == 2} == {"http://c%0D%0AX: y"}


def test_index_addresses_single_records(spark):
    folder, index, _ = crawl(spark, [(i, f"u{i}", "y" * i) for i in range(50)])
    some = warc.read_records(index.where("page_id % 7 = 3"), folder)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in some.collect()) == [(i, i) for i in range(50) if i % 7 == 3]
    row = index.where("page_id = 10").first()
    where, path = warc.filesystem(f"{folder}/archives")
    data = where.open_input_file(f"{path}/{row['archive']}").read_at(row["length"], row["offset"])
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_least_bytes_and_empty(spark):
    _, _, read = crawl(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "longer"), (4, "d", "longer")], least=5)
    assert sorted((r["page_id"], r["record_type"]) for r in read.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    _, index, read = crawl(spark, [])
    assert index.count() == 0 and read.count() == 0


def test_rolled_archives_and_named_targets(spark, monkeypatch):
    data = [(1, "http://a", "same"), (2, "http://b", "same"), (None, "u", "n1"), (None, "u", "n2")]
    folder, index, _ = crawl(spark, data)
    where, path = warc.filesystem(f"{folder}/archives")
    heads = {}
    for row in index.collect():
        with where.open_input_file(f"{path}/{row['archive']}") as f:
            fields, _ = warc.parse(memoryview(f.read_at(row["length"], row["offset"])))
        heads[fields["WARC-Record-ID"]] = fields
    assert len(heads) == 4  # pages without id get records with ids of their own
    revisit = next(f for f in heads.values() if f["WARC-Type"] == "revisit")
    assert heads[revisit["WARC-Refers-To"]]["X-Page-ID"] == "1" and revisit["WARC-Refers-To-Target-URI"] == "http://a"
    out = []

    class Task:
        partitionId = taskAttemptId = staticmethod(lambda: 0)

    monkeypatch.setattr(warc, "ROLL", 1)
    monkeypatch.setattr(warc.TaskContext, "get", staticmethod(Task))
    rows = pa.RecordBatch.from_pylist([{"page_id": i, "url": "u", "payload": b"x", "refers_to": None, "target": None} for i in range(3)], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("refers_to", pa.int64()), ("target", pa.string())]))
    for batch in warc._writer(f"{folder}/rolled")(iter([rows])):
        out += batch.to_pylist()
    assert len({r["archive"] for r in out}) == 3 and {r["offset"] for r in out} == {0}
