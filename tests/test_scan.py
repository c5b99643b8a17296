"""Scans over sessions that are cut into bins give what one pass over the whole session gives."""

import random

import pytest
from pyspark.sql import functions as F

from speechframes.operators import intervals, scan, updates, validate

SPAN = "session_id long, idx long, s_ms long, e_ms long, speaker string"


def random_spans(rng, sessions=(1, 2, None), n=150, reach=3000):
    rows = []
    for session in sessions:
        at = rng.randint(-500, 500)
        for i in range(n):
            at += rng.choice((0, 1, 5, 40, 40, 300))
            rows.append((session, i, at, at + rng.choice((0, 1, 30, 30, 400, reach)), rng.choice(("A", "A", "B", None, ""))))
    rng.shuffle(rows)
    return rows


def one_pass_islands(rows, same, gap):
    """(session, idx) -> island."""
    found = {}
    for session in {r[0] for r in rows}:
        last, reach, island = "none yet", None, 0
        for r in sorted((r for r in rows if r[0] == session), key=lambda r: (r[2], r[1])):
            changed = last == "none yet" or (same and r[4] != last)
            if changed or (gap is not None and r[2] - reach > gap):
                island += 1
            reach = r[3] if changed else max(reach, r[3])
            last = r[4]
            found[session, r[1]] = island
    return found


@pytest.mark.parametrize("bin_width", [7, 400, 10**9])
@pytest.mark.parametrize("same,gap", [(["speaker"], None), (["speaker"], 35), ([], 35), ([], -1), (["speaker"], 0)])
def test_islands_equal_one_pass(spark, bin_width, same, gap):
    rows = random_spans(random.Random(bin_width))
    made = intervals.gap_islands(spark.createDataFrame(rows, SPAN), ["session_id"], same, gap, ["s_ms", "idx"], bin_width=bin_width)
    assert made.columns == ["session_id", "idx", "s_ms", "e_ms", "speaker", "island"]
    assert {(r["session_id"], r["idx"]): r["island"] for r in made.collect()} == one_pass_islands(rows, same, gap)


@pytest.mark.parametrize("bin_width", [5, 600, 10**9])
def test_nearest_turn_equals_all_turns(spark, bin_width):
    rng = random.Random(bin_width)
    points = [(s, i, a, a + rng.randint(0, 9)) for s in (1, 2, 3) for i in range(80) for a in [rng.randint(0, 5000)]]
    turns = [(s, k, a, a + rng.randint(0, 300), f"t{k}") for s in (1, 2) for k in range(12 if s == 1 else 1) for a in [rng.randint(0, 5000)]]
    got = intervals.nearest_turn(spark.createDataFrame(points, "session_id long, idx long, s_ms long, e_ms long"), spark.createDataFrame(turns, "session_id long, turn_ord long, s_ms long, e_ms long, speaker string"), ["session_id"], bin_width=bin_width)
    for r in got.collect():
        near = [(min(abs(r["s_ms"] + r["e_ms"] - 2 * t[2]), abs(r["s_ms"] + r["e_ms"] - 2 * t[3])), t[1], t[4]) for t in turns if t[0] == r["session_id"]]
        assert r["speaker"] == (min(near)[2] if near else None)
    assert got.count() == len(points)


def test_a_session_of_five_million_words_is_the_work_of_all_tasks(spark):
    n, parts = 5_000_000, 8
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the exchange as declared
    try:
        i = F.col("id")
        words = spark.range(n).select(F.lit(1).alias("session_id"), i.alias("idx"), (i * 250).alias("s_ms"), (i * 250 + 200).alias("e_ms"), F.expr("if(id % 1000 < 700, 'A', 'B')").alias("speaker"))
        shares = [r["count"] for r in scan.packed(words, ["session_id"], "s_ms", intervals.BIN_MS).groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) == parts and max(shares) <= 2 * n / parts
        made = intervals.gap_islands(words, ["session_id"], ["speaker"], None, ["s_ms", "idx"])
        found = made.agg(F.max("island"), F.count_if((F.col("idx") % 1000 == 0) & (F.col("island") != 1 + 2 * F.expr("idx div 1000"))), F.count("*")).first()
        assert tuple(found) == (2 * n // 1000, 0, n)
    finally:
        for name, value in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"), before):
            spark.conf.set(name, value)


@pytest.mark.parametrize("width", [3, 10**6])
def test_previous_rows_and_prefixes(spark, width):
    rng = random.Random(width)
    rows = [(s, i * 2, rng.random() < 0.02) for s in (1, None, 2) for i in range(100)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "session_id long, seq long, bad boolean")
    for r in scan.with_previous(df, ["session_id"], ["seq"], width, "prev", "head").collect():
        assert (r["prev"] and r["prev"]["seq"]) == (r["seq"] - 2 if r["seq"] else None) and r["head"]["seq"] == 0
    first = {s: min((q for t, q, bad in rows if t == s and bad), default=10**9) for s in (1, None, 2)}
    got = scan.before_first(df, ["session_id"], ["seq"], width, F.col("bad"))
    assert sorted(((r["session_id"], r["seq"]) for r in got.collect()), key=repr) == sorted(((s, q) for s, q, _ in rows if q < first[s]), key=repr)


def test_orders_without_distance_and_timestamps(spark):
    import datetime as dt

    rows = [(1, f"k{i:03}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=100 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id long, name string, at timestamp")
    for order in ("name", "at"):
        got = scan.with_previous(df, ["session_id"], [order], 900).collect()
        assert all((r["_previous"] and r["_previous"]["name"]) == (f"k{int(r['name'][1:]) - 1:03}" if r["name"] != "k000" else None) for r in got)


def test_streams_longer_than_a_bin_are_validated_across_bins(spark, monkeypatch):
    monkeypatch.setattr(validate, "BIN", 4)
    rows = [(s, i, i if s == 1 else i + (i > 10), "en" if i < 14 else "de", "t", 16000, 2) for s in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "session_id long, arrival long, seq long, lang string, tenant_id string, sample_rate int, payload_bytes long")
    judged = validate.validate_chunks(df, ["session_id"], ["en", "de"])
    why = {(r["session_id"], r["arrival"]): r["reason"] for r in judged.collect()}
    assert judged.columns == [*df.columns, "reason"]
    assert why[1, 13] is None and why[1, 14] == "language-changed" and why[2, 11] == "sequence-gap" and why[2, 12] is None
    kept = validate.valid_prefix(judged, ["session_id"]).groupBy("session_id").agg(F.max("arrival").alias("n")).collect()
    assert {r["session_id"]: r["n"] for r in kept} == {1: 13, 2: 10}
    late = updates.monotonic_errors(df.withColumn("end", F.col("seq")).withColumn("all", F.lit(100)), ["session_id"], ["arrival"], "seq", "end", "all")
    assert late.count() == 0 and late.columns == [*df.columns, "end", "all"]
