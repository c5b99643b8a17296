"""Mixing: targets, quotas and what is taken of every document."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from speechframes.llm import mixing as M


def plain_targets(sizes, weights, most):
    """Share by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if got[s] + share * weight[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                got[s] += share * weight[s]
            break
        # those that reach their limit first leave; the others share what they cannot take
        for s in full:
            left -= most * sizes[s] - got[s]
            got[s] = most * sizes[s]
        open_ -= full
    return got


def corpus(spark, shape, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choices(*zip(*shape.items()))[0]) for i in range(700)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


SHAPES = [
    {"b": 5, "a": 5, None: 5, "": 5},
    {"b": 90, "a": 1, "é": 3, None: 6, "z": 1},  # the heavy weight is on a small source
    {"only": 1},
    {str(i): 1 + (i * i) % 17 for i in range(30)},
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("most", [3, 1])
def test_targets_and_takes(spark, shape, most):
    rows, df = corpus(spark, shape)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = plain_targets(dict(sizes), (5, 2, 1), most)
    made = M.mix(df, most=most).collect()
    by_id = {d: (t, s) for d, t, s in rows}
    taken = Counter()
    for r in made:
        text, source = by_id[r["doc_id"]]
        assert r["size"] == len(text.split()) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(expected[source])
        assert 0 <= r["taken"] <= most * r["size"]
        taken[source] += r["taken"]
    assert len(made) == len(rows)
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t)
    again = M.mix(df.repartition(2), most=most)
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in made}


def test_seats_are_sainte_lague_and_shards_even(spark):
    rows, df = corpus(spark, {"a": 1, "b": 1, "c": 1})
    sources = M.targets(df.groupBy("source").agg(F.sum(M.word_count(F.col("text"))).alias("words")), (5, 2, 1), 3).withColumn("block", F.lit(7).cast("long"))
    got = M.picks(sources, 3, 4).collect()
    seats = Counter(r["nth"] for r in got)
    state = {r["nth"]: r for r in sources.collect()}
    assert not any(r["full"] for r in state.values())
    total, plain = sum(seats.values()), Counter()
    for _ in range(total):
        plain[max(state, key=lambda n: (state[n]["weight"] / (2 * plain[n] + 1), -n))] += 1
    assert seats == plain and abs(total * 7 - state[0]["mix"]) <= 7
    shards = Counter(r["shard"] for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1
    each = Counter((r["shard"], r["nth"]) for r in got)
    for (shard, nth), n in each.items():  # integer quotas of every shard stay near the shares
        assert abs(n - shards[shard] * seats[nth] / total) < 2


def test_texts_of_the_mix_are_what_was_taken(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(i % 23)), "ab"[i % 2]) for i in range(300)] + [(999, " ".join(f"999.{k}" for k in range(5000)), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x"))
    options = {"blocks": 200, "shards": 4, "seed": 3}
    taken = {r["doc_id"]: r["taken"] for r in M.mix(df, **options).collect()}
    words, passes = Counter(), defaultdict(Counter)
    pieces = M.mixed_texts(df, **options)
    assert set(pieces.columns) == {"doc_id", "text", "source", "shard", "pass", "block_no", "from_word"}
    for r in pieces.collect():
        said = r["text"].split()
        assert said == [f"{r['doc_id']}.{k}" for k in range(r["from_word"], r["from_word"] + len(said))]
        words[r["doc_id"]] += len(said)
        for w in said:
            passes[r["doc_id"], w][r["pass"]] += 1
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert all(set(c.values()) == {1} for c in passes.values())  # no word twice in a pass


def test_odd_rows(spark, odd_docs, no_docs):
    made = M.mix(odd_docs.withColumn("taken", F.lit(1))).collect()
    assert len(made) == odd_docs.count() and sum(r["taken"] for r in made) == sum(r["size"] for r in made)
    assert M.mix(no_docs).count() == 0 and M.mixed_texts(no_docs).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, " \x0b", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix(wordless).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        M.mix(no_docs, weights=(1, 0))


def test_equal_rows_are_parted(spark):
    """A third of all rows equal, ids and all: they take their part together, row by row."""
    df = spark.createDataFrame([(None, "a b c", "s")] * 500 + [(i, "d e f g", "s") for i in range(500)] + [(9000 + i, "h", "t") for i in range(500)], "doc_id long, text string, source string")
    made = M.mix(df, weights=(1, 1)).collect()
    assert len(made) == 1500
    per = Counter()
    for r in made:
        per[r["source_size"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert per == {500: 1500, 3500: 2500}


def test_a_text_over_a_megabyte(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in M.mix(df).collect()}
    assert got[2] == (2, 6) and got[1][0] == 300_000 and abs(got[1][1] - 299_996) <= 4
