"""Suffix-array dedup, n-gram Jaccard join, fingerprints."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframes.llm import fingerprints as O
from speechframes.llm import jaccard as J
from speechframes.llm import suffixes as S


def removed_bytes(docs):
    """Byte flags by document, by trying every window."""
    seen, out = set(), {}
    for i, text in docs:
        data = (text or "").encode()
        flags = bytearray(len(data))
        for p in range(len(data) - S.LENGTH + 1):
            window = data[p : p + S.LENGTH]
            if window in seen:
                flags[p : p + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(window)
        out[i] = data, flags
    return out


@pytest.mark.parametrize(("most", "lpf"), [(1000, 6 << 20), (2, 6 << 20), (1000, 500)])
def test_suffix_dedup_matches_brute_force(spark, corpus, corpus_df, monkeypatch, most, lpf):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "LPF_BYTES", lpf)
    want = {}
    for i, (data, flags) in removed_bytes(corpus).items():
        runs = sum(1 for a, b in zip([0, *flags], flags, strict=False) if b and not a)
        want[i] = (len(data), sum(flags), runs, hashlib.sha256(bytes(c for c, f in zip(data, flags, strict=True) if not f)).hexdigest())
    assert sum(w[1] for w in want.values()) > 5000
    assert {r[0]: tuple(r)[1:] for r in S.digests(corpus_df).collect()} == want


def test_suffix_dedup_odd_rows(spark, odd_docs, no_docs):
    assert S.digests(no_docs).count() == 0 and S.deduplicate(no_docs).count() == 0
    got = S.digests(odd_docs).collect()
    assert len(got) == 8 and sum(r["n_removed"] for r in got) == 0
    long = "".join(chr(0xE0 + i) for i in range(80))
    df = spark.createDataFrame([(1, "z" + long), (1, "z" + long), (None, "w" + long), (2, "q" + long), (2, "p" + long)], "doc_id long, text string").withColumn("removed", F.lit("clash"))
    cut = sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in S.deduplicate(df).collect()), key=repr)
    assert cut == sorted([(None, 0, "w" + long), (1, 160, "z"), (1, 160, "z"), (2, 160, "p"), (2, 160, "q")], key=repr)
    # the second byte of the first character is shared, its first byte is not: the character goes
    df = spark.createDataFrame([(1, "\u00e9" + long), (2, "ab\u0169" + long)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in S.deduplicate(df).collect()) == [(1, 0, "\u00e9" + long), (2, 161, "ab")]


def test_previous_smaller():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50):
        v = rng.permutation(n)
        assert S.previous_smaller(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]


def brute_join(docs, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    rep = {}
    for i in sorted(sets):
        if sets[i]:
            rep.setdefault(sets[i], i)
    links = [(a, b) for s, a in rep.items() for t, b in rep.items() if a < b and len(s & t) / len(s | t) >= threshold]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    n = collections.Counter(x for pair in links for x in pair)
    own = {i: rep.get(s, i) for i, s in sets.items()}
    return {i: (root[r], n[r], r) for i, r in own.items()}


@pytest.mark.parametrize("block", [1024, 4])
def test_join_matches_brute_force(spark, corpus, corpus_df, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    want = brute_join(corpus)
    assert sum(w[1] for w in want.values()) > 10
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["text_class"]) for r in J.join(corpus_df).collect()}
    assert got == want
    kept = {r["doc_id"] for r in J.keep_one(corpus_df).collect()}
    assert kept == {i for i, w in want.items() if w[0] == i}


def test_join_counts_links_once_where_blocks_stay_empty(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 60)
    docs = []
    for group in range(12):  # two to four near copies, each group of several blocks
        base = [f"w{group}x{k}" for k in range(60)]
        docs += [(10 * group + k, " ".join([*base, f"end{k}"])) for k in range(2 + group % 3)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["text_class"]) for r in J.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_join(docs)
    assert {n for _, n, _ in got.values()} == {1, 2, 3}


def test_join_odd_rows(spark, odd_docs, no_docs):
    assert J.join(no_docs).count() == 0 and J.keep_one(no_docs).count() == 0
    got = sorted((tuple(r) for r in J.join(odd_docs).select("doc_id", "class_id", "n_links").collect()), key=repr)
    assert got == sorted([(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, None, 0), (3, None, 0), (4, None, 0), (4, 4, 0)], key=repr)
    kept = J.keep_one(odd_docs.withColumns({c: F.lit("clash") for c in ("_first", "_key", "key", "one", "labels")})).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "", "", "le chat est là", "the cat sat"]


def test_depth_reaches_the_recall():
    d = J.depth_for(0.8)
    assert 1 - (1 - 0.8**d) ** J.TREES >= J.RECALL and (d == J.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** J.TREES < J.RECALL)


def test_prefix_is_shortened_until_the_measured_recall():
    many = lambda **by: {i: {int(d[1:]): n for d, n in by.items()} for i in range(J.LEAST_PROBES)}
    assert J.depth_to_use({}, 0.8) == J.depth_for(0.8) == 6
    assert J.depth_to_use(many(d8=3), 0.8) == 8
    assert J.depth_to_use(many(d8=999, d7=1), 0.8) == 7
    assert J.depth_to_use(many(d8=90, d5=10), 0.8) == 6  # the threshold's own recall ends it
    few = dict(list(many(d8=3).items())[1:])
    assert J.depth_to_use(few, 0.8) == 6


def test_probes_measure_links_exactly(corpus):
    texts = [t for _, t in corpus if t]
    probes = J.Probes(texts[:30])
    for text in texts:
        found = J.shingles(text)
        path = J.paths(found)
        want = []
        for i, other in enumerate(texts[:30]):
            theirs = J.shingles(other)
            shared = len(np.intersect1d(found, theirs))
            if shared < len(found) + len(theirs) - shared and shared / (len(found) + len(theirs) - shared) >= 0.8:
                common = [next((d for d in range(J.DEPTH) if a[d] != b[d]), J.DEPTH) for a, b in zip(path, J.paths(theirs), strict=True)]
                want.append((i, max(common)))
        assert probes.links(found, path, 0.8) == want


def test_join_of_a_large_group_in_bounded_tasks(spark, monkeypatch):
    """600 different near copies beside unlike texts of the same boilerplate: exact counts, no task with the whole group."""
    monkeypatch.setattr(J, "BLOCK", 100)
    monkeypatch.setattr(J, "HUB", 50)
    base = [f"w{k}" for k in range(100)]
    docs = [(i, " ".join([*base[: i % 97], f"x{i}", *base[i % 97 + 1 :]])) for i in range(600)]
    docs += [(1000 + i, " ".join([*base[:55], *[f"y{i}z{k}" for k in range(45)]])) for i in range(60)]
    sizes = []
    in_blocks = J.in_blocks
    monkeypatch.setattr(J, "in_blocks", lambda members, *rest: sizes.append(members.groupBy("root").count().agg({"count": "max"}).first()[0]) or in_blocks(members, *rest))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["text_class"]) for r in J.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute_join(docs)
    assert sizes[-1] == 600  # links are counted inside the class alone


def test_components(spark, rows):
    ties = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5)]
    got = dict(rows(J.components(spark.createDataFrame(ties, "a long, b long"), "test-components")))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200}


def test_fingerprints_pair_and_compare(spark, corpus, corpus_df):
    got = {r["doc_id"]: r for r in O.compare_with_next(corpus_df).collect()}
    texts = dict(corpus)
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - n] + texts[j][:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(texts[i])
        a, b, c = O.sketch(texts[i]), O.sketch(edited), O.sketch(texts[j])
        assert got[i]["fingerprint"] == O.as_text(a) and got[i]["edited_fingerprint"] == O.as_text(b)
        assert got[i]["near_edited"] == O.likeness(a, b) and got[i]["near_next"] == O.likeness(a, c)
    by = collections.defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())


def test_sketch_matches_plain_selection():
    text = "abcdefgh abcdefgh xyz abcdefgh qrs tuvw"
    kmers = O.numbered_kmers(text)
    assert len(set(kmers.tolist())) == len(kmers)  # occurrences tell repeats apart
    made = O.sketch(text)
    for j in (0, 17, 63):
        h = [((int(k) ^ int(O._FLIPS[j])) * int(O._TIMES[j])) & 0xFFFFFFFF for k in kmers]
        at = sorted(sorted(range(len(h)), key=lambda i: h[i])[: O.MINIMA])
        out = np.zeros(1, np.uint64)
        for i in at:
            out = O._mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(int(kmers[i]) + 1))
        assert made[j] == int(out[0]) >> 48
    shuffled = " ".join(reversed(text.split()))
    assert O.likeness(made, O.sketch(text)) == 1 and O.likeness(made, O.sketch(shuffled)) < 1


def test_fingerprints_blocks_of_columns_agree(monkeypatch):
    text = "".join(chr(97 + i * 7 % 26) for i in range(3000)) + "tail"
    want = O.sketch(text)
    monkeypatch.setattr(O, "COLUMNS", 100)
    assert (O.sketch(text) == want).all()


def test_fingerprints_odd_rows(spark, odd_docs, no_docs):
    assert O.compare_with_next(no_docs).count() == 0
    got = O.compare_with_next(odd_docs).collect()
    assert len(got) == 8
    one = O.compare_with_next(spark.createDataFrame([(7, "only one here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert {r["fingerprint"] for r in O.fingerprint(odd_docs.withColumn("fingerprint", F.lit(1))).where("text = ''").collect()} == {"0" * 4 * O.SKETCHES}


def test_fingerprints_hot_null_ids(spark):
    data = [(None, f"text number {i} of those without id") for i in range(400)] + [(i, f"document {i}") for i in range(100)] + [(-(1 << 63), "the least id"), ((1 << 63) - 1, "the greatest")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    ranges = O.in_next_order(docs, "doc_id", "text").where("_ghost = 0 AND id IS NULL").select("_range").distinct().count()
    assert ranges > 3
    got = O.compare_with_next(docs).collect()
    assert len(got) == len(data)
    # each text is the next one of exactly one document
    whole = dict(data[400:])
    by_edit = {r["edited_sha256"] for r in got if r["doc_id"] == 0}
    ends = {hashlib.sha256((whole[0][:-3] + t[:3]).encode()).hexdigest() for i, t in data if i == -(1 << 63)}
    assert by_edit == ends
    n = len(whole[-(1 << 63)]) // 3
    first_unnamed = {hashlib.sha256((whole[-(1 << 63)][:-n] + t[:n]).encode()).hexdigest() for i, t in data if i is None}
    assert {r["edited_sha256"] for r in got if r["doc_id"] == -(1 << 63)} <= first_unnamed


def test_kmers_are_numbered_by_occurrence():
    text = "abababab" * 5 + "xyz"
    seen, numbered = collections.Counter(), []
    for i in range(len(text) - O.K + 1):
        gram = text[i : i + O.K]
        numbered.append((gram, seen[gram]))
        seen[gram] += 1
    made = O.numbered_kmers(text).tolist()
    assert len(made) == len(numbered) and len(set(made)) == len(set(numbered))
    longer = O.numbered_kmers(text + "tail").tolist()
    assert longer[: len(made)] == made  # a k-mer's number counts what stands before it
