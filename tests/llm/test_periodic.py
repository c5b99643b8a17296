"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import pytest

from speechframes.llm import periodic as P


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng, most):
    words = []
    while len(words) < most:
        kind = rng.random()
        if kind < 0.5:
            words += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        elif kind < 0.8:
            unit = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
            words += (unit * 6)[: rng.randint(1, len(unit) * 6)]
        else:
            words += ["x"] * rng.randint(1, 40)
    return words


@pytest.mark.parametrize("spread_bytes", [0, 300, 1 << 30])
@pytest.mark.parametrize("least", [12, 3])
def test_runs_equal_a_plain_search_however_texts_are_spread(spark, spread_bytes, least, monkeypatch):
    rng = random.Random(spread_bytes + least)
    monkeypatch.setattr(P, "CORE", 64)
    P.octave.cache_clear()
    texts = [" ".join(random_words(rng, rng.randint(0, 260))) for _ in range(60)]
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in P.find_runs(df, min_length=least, spread_bytes=spread_bytes).collect():
        words = texts[r["doc_id"]].split()
        expected = plain_runs(words, least)
        assert [tuple(x) for x in r["runs"]] == expected
        assert (r["n_words"], r["collapsed"]) == (len(words), plain_collapse(words, expected))
    P.octave.cache_clear()


def test_a_long_text_is_the_work_of_many_tiles():
    words = (["a b c d e f g"] * 30_000 + ["tail"]) * 2
    codes = P.word_codes(" ".join(words).encode())
    tiles = list(P.tiles_of(codes, 12))
    assert len(tiles) > 100 and len(codes) > 400_000
    low = [t for t in tiles if t[3] == 1]  # the lowest octaves tile the text without gap
    assert [t[1] for t in low] == list(range(0, len(codes), P.CORE)) and max(len(t[-1]) for t in low) < 2 * P.CORE


@pytest.mark.parametrize("spread_bytes", [0, 1 << 30])
def test_texts_over_a_megabyte(spark, spread_bytes):
    rng = random.Random(5)
    unit = [f"w{rng.randrange(900)}" for _ in range(4321)]
    text = " ".join([f"u{i}" for i in range(20_000)] + unit * 60 + [f"v{i}" for i in range(100)])
    assert len(text) > 1 << 20
    (r,) = P.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), spread_bytes=spread_bytes).collect()
    assert [tuple(x) for x in r["runs"] if x["period"] == 4321] == [(20_000, 4321 * 60, 4321)]


def test_digests_of_planted_runs(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t in corpus] + [(None, "a " * 20), (7000, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in P.digests(P.find_runs(P.with_planted_runs(df))).collect()}
    planted = 0
    for doc, text in [*corpus, (None, "a " * 20), (7000, None)]:
        words, h = (text or "").encode().split(), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        words = [w.decode() for w in words]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if runs else None
        assert tuple(got[doc])[1:] == (len(runs), *best, exponent, sha(lines), sha(plain_collapse(words, runs)))
    assert planted > 3


def test_odd_rows(spark, odd_docs, no_docs):
    made = P.find_runs(odd_docs.withColumnRenamed("source", "runs"))
    assert made.columns == ["doc_id", "text", "lang", "n_chars", "n_words", "runs", "collapsed"] and made.count() == odd_docs.count()
    assert {len(r["runs"]) for r in made.collect()} == {0}
    assert P.find_runs(no_docs, spread_bytes=0).count() == P.find_runs(no_docs).count() == 0
    blanks = spark.createDataFrame([(1, "a\x0b" * 6 + "a\x0c" * 6 + "\x1ca \xa0a"), (2, "é " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in P.find_runs(blanks).collect()}
    assert got == {1: [(0, 12, 1)], 2: [(0, 12, 1)]}
    with pytest.raises(ValueError):
        P.find_runs(blanks, min_length=1)
