"""Language ID and toxicity: brute force on small cases, held-out accuracy on the given tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframes.llm import language as L
from speechframes.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def by_hand(p: L.Profiler, text: str) -> np.ndarray:
    """The bundle of a text, letter by letter."""
    symbols = [32]
    for c in text.lower() + " ":
        if c.isalpha() or symbols[-1] != 32:
            symbols.append(ord(c) if c.isalpha() else 32)
    out = np.zeros(p.dimensions)
    for i in range(len(symbols) - p.gram + 1):
        v = np.ones(p.dimensions)
        for k, s in enumerate(symbols[i : i + p.gram]):
            v = v * np.roll(p._random(s), p.gram - 1 - k)
        out += v
    return out


def test_bundles_match_hand_work():
    texts = ["Hello, world", "", "éé ß!", "a", "x\0yz abc", "  . "]
    p = L.Profiler()
    made, letters = p.bundle(texts)
    assert letters.tolist() == [10, 0, 3, 1, 6, 0]
    for text, row in zip(texts, made, strict=True):
        assert np.allclose(row, by_hand(L.Profiler(), text))


def test_bundles_of_many_short_texts_need_bounded_memory():
    """5,000 short texts of a large alphabet: blocks of vectors, not documents x n-grams."""
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, 80))) for _ in range(5000)]
    p = L.Profiler()
    tracemalloc.start()
    made = [(a, b, p.bundle(texts[a:b])[0]) for a, b in list(L._chunks(texts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6, peak
    for i in (0, 1234, 4999):
        a, _, rows = next(x for x in made if x[0] <= i < x[1])
        assert np.allclose(rows[i - a], by_hand(L.Profiler(), texts[i]))


def test_bundles_by_blocks_agree(monkeypatch):
    texts = ["the cat sat on the mat", "le chat", "", "xyz " * 50]
    want = L.Profiler().bundle(texts)[0]
    for cells, sparse in ((2048, 32), (2048, 0), (1 << 23, 0), (2048, 1 << 30)):
        monkeypatch.setattr(L, "BLOCK_CELLS", cells)
        monkeypatch.setattr(L, "SPARSE", sparse)
        assert (L.Profiler().bundle(texts)[0] == want).all()


def test_language_held_out_accuracy(spark):
    got = L.op5_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = got.join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd_docs, no_docs):
    prototypes = L.train(odd_docs)
    assert list(prototypes) == ["en", "fr"]
    got = L.identify(odd_docs.withColumn("score", F.lit("clash")), prototypes).collect()
    assert {r["lang_pred"] for r in got if not r["text"]} == {"und"} and all(r["score"] == 0 for r in got if not r["text"])
    assert {r["lang_pred"] for r in got if r["text"] == "the cat sat"} == {"en"}
    assert {r["lang_pred"] for r in L.identify(odd_docs, {}).collect()} == {"und"}
    assert L.train(no_docs) == {} and L.identify(no_docs, prototypes).count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    t = np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([5, 3, 1])
    e = np.exp(rng.normal(size=(3, 5)))
    odds = X._odds_chain(e, t, lengths)
    for row, n in enumerate(lengths):
        weight = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([e[row, i] if s else 1 for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            for i, s in enumerate(path):
                weight[i, s] += w
        assert np.allclose(odds[row, :n], weight[:, 1] / weight[:, 0])
    p, expected, log_z = X._pairwise(e[:1], t)
    assert np.allclose(p[0], odds[0] / (1 + odds[0])) and math.isclose(expected.sum(), 4)
    assert math.isfinite(log_z)


def test_toxicity_finds_marked_words(spark, odd_docs, no_docs):
    clean = [(f"some plain words number {i} you find in a text that is calm", 0) for i in range(40)]
    toxic = [(f"some plain words number {i} you {w} in a text", 1) for i, w in zip(range(40), ["scum", "idiot"] * 20)]
    model = X.fit(clean + toxic)
    df = spark.createDataFrame([(1, "calm words"), (2, "You SCUM, really"), (3, None), (4, ""), (2, "You SCUM, really")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.score(df.withColumn("score", F.lit("clash")), model).collect()}
    assert got[2]["score"] > 0.5 > got[1]["score"] and [(s["start"], s["end"]) for s in got[2]["toxic_spans"]] == [(4, 8)]
    assert got[3]["score"] == got[4]["score"] < 0.5
    assert X.score(odd_docs, model).count() == 8 and X.score(no_docs, model).count() == 0
    assert {r["score"] for r in X.score(odd_docs, None).collect()} == {0.0}
    assert X.fit([]) is None and X.fit([("a", 1)]) is None and X.fit([("a b", 1), ("c d", 0)]) is not None


def test_toxicity_held_out(spark):
    """Per language: most toxic documents are found, clean ones are left alone."""
    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = X.op6_toxicity(spark, sf).join(truth, "doc_id").where("held_out").collect()
    for lang in (None, "de", "en", "es", "fr"):
        clean, toxic = ([r["predicted"] for r in rows if r["toxic"] == y and lang in (None, r["lang"])] for y in (0, 1))
        assert len(toxic) > 5 and np.mean(toxic) >= (0.8 if len(toxic) < 10 else 0.85) and np.mean(clean) <= 0.05, lang


def test_marking_words_count_near_copies_once(spark):
    """A word of one group of copies marks nothing, a rare one of five unlike documents does; frequent ones set no bar."""
    rows = [(i, f"scum a{i} b{i * 7} c{i * 11} d{i * 13}", 1) for i in range(200)]
    rows += [(300 + i, f"gredin e{i} f{i * 7} g{i * 11} h{i * 13}", 1) for i in range(9)]
    rows += [(400 + i, "copied once more", 1) for i in range(50)]
    rows += [(500 + i, f"calm text {i} of j{i * 3} k{i * 5}", 0) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "scum"), (5000, None), (5001, "scum calm")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 0), (5000, 1), (5001, 0), (5001, 1), (7, None)], "doc_id long, toxic int")
    found = X.marking_words(docs, labels)
    assert set(found) == {"scum", "gredin"}
    groups = lambda y, word="": len({X.near_copy_key(r[1].split()) for r in rows if r[2] == y and word in r[1]})
    assert math.isclose(found["gredin"], X.log_odds(groups(1, "gredin"), 0, groups(1), groups(0)))
    # copies of toxic and of clean rows change nothing
    more = docs.unionByName(docs.where("doc_id < 1100").crossJoin(spark.range(20)).select((F.col("doc_id") + 10_000 * (1 + F.col("id"))).alias("doc_id"), F.concat("text", F.lit(" again")).alias("text")))
    told = labels.unionByName(labels.where("doc_id < 1100").crossJoin(spark.range(20)).select((F.col("doc_id") + 10_000 * (1 + F.col("id"))).alias("doc_id"), "toxic"))
    copied = X.marking_words(more, told)
    assert set(copied) == set(found)
    assert X.marking_words(docs, labels.where("toxic = 1")) == {} and X.marking_words(docs.limit(0), labels) == {}


def test_toxicity_training_needs_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    assert X.sample(no_docs, labels, "doc_id", "text", "toxic") == []
    assert set(X.sample(odd_docs, labels, "doc_id", "text", "toxic")) == {("the cat sat", 1), ("the cat sat", 0), ("le chat est là", 0)}


def test_chain_of_short_windows_matches_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    t = np.exp(rng.normal(size=(2, 2)))
    lengths = np.array([4, 2, 1])
    e = np.exp(rng.normal(size=(3, 4)))
    p, expected, log_z = X._pairwise(e, t, lengths)
    pairs, total = np.zeros((2, 2)), 0.0
    for row, n in enumerate(lengths):
        weight, moved, z = np.zeros(n), np.zeros((2, 2)), 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.prod([e[row, i] if s else 1 for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:])])
            z += w
            weight += w * np.array(path)
            for a, b in zip(path, path[1:]):
                moved[a, b] += w
        assert np.allclose(p[row, :n], weight / z) and not p[row, n:].any()
        pairs, total = pairs + moved / z, total + math.log(z)
    assert np.allclose(expected, pairs) and math.isclose(log_z, total)


def test_toxicity_learns_from_short_texts_beside_long_ones(spark):
    clean = [(" ".join(f"plain{(i * 7 + k) % 90} calm words you number" for k in range(30)), 0) for i in range(40)]
    toxic = [(f"you {w} number {i}", 1) for i, w in zip(range(40), ["scum", "idiot"] * 20)]
    model = X.fit(clean + toxic)
    df = spark.createDataFrame([(1, "calm words"), (2, "hear me SCUM, really")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.score(df, model).collect()}
    assert got[2]["score"] > 0.5 > got[1]["score"]
    assert [(s["start"], s["end"]) for s in got[2]["toxic_spans"]] == [(8, 12)]
    assert X.fit([("", 1), ("!", 0)]) is not None


@pytest.mark.parametrize("toxic_words,clean_words", [(3, 900), (900, 3), (40, 40)])
def test_a_score_of_a_half_needs_a_span(spark, toxic_words, clean_words):
    """Whatever the lengths of the texts that teach, none without a tagged word is predicted toxic."""
    rng = np.random.default_rng(toxic_words)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 400, n)]
    rows = [(" ".join([*words(clean_words), f"c{i}"]), 0) for i in range(30)] + [(" ".join([*words(toxic_words), "scum", f"t{i}"]), 1) for i in range(30)]
    model = X.fit(rows, {"scum": 5.0})
    texts = [None, "", "calm", " ".join(words(5)), " ".join(words(2000)), "you scum", " ".join([*words(300), "scum"])]
    got = X.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert all(r["score"] < 0.5 and not r["toxic_spans"] for r in got[:5])
    assert all(r["score"] > 0.5 and r["toxic_spans"] for r in got[5:])


def test_toxicity_sample_passes_over_long_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE_CHARS", 100)
    docs = spark.createDataFrame([(i, "x" * 101 if i % 3 == 0 else f"text {i}") for i in range(12)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, toxic int")
    got = X.sample(docs, labels, "doc_id", "text", "toxic")
    assert sorted(got) == sorted((f"text {i}", i % 2) for i in range(12) if i % 3)
    # only long rows in one class: the shortest teaches by its beginning
    docs = spark.createDataFrame([(1, "a" * 300), (3, "b" * 200), (2, "short"), (4, "c" * 400)], "doc_id long, text string")
    assert sorted(X.sample(docs, labels, "doc_id", "text", "toxic")) == [("b" * 50, 1), ("short", 0)]
