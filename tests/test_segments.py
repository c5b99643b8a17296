"""Segments of words, put together from pieces of bins, against a plain loop over each session."""

import random

import pytest
from pyspark.sql import functions as F

from speechframes.operators import assemble, intervals
from speechframes.plans import timed

SCHEMA = "session_id long, turn int, idx int, speaker string, word string, s_ms long, e_ms long"


def made_up(seed=5, sessions=6, n=160):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        who, at = "a", 0
        for i in range(n):
            who = r.choice(["a", "b", None, "a"]) if r.random() < 0.15 else who
            at += r.choice([0, 10, 50, 50, 200, 1_500])
            long = 4_000 if r.random() < 0.05 else r.choice([5, 40, 90])
            rows.append((None if s == 0 else s, i // 7, i % 7, who, r.choice(["one", "Two", ",", "\u00e9t\u00e9", "3", " ", None]), None if r.random() < 0.02 else at, None if r.random() < 0.02 else at + long))
    return rows


def by_loop(rows, gap, separator):
    out, sessions = [], {}
    for r in rows:
        sessions.setdefault(r[0], []).append(r)
    for key, line in sessions.items():
        groups, reach = [], None
        for r in sorted(line, key=lambda r: r[1:3]):
            same = bool(groups) and groups[-1][-1][3] == r[3]
            if same and (gap is None or (r[5] is not None and reach is not None and r[5] - reach <= gap)):
                groups[-1].append(r)
            else:
                groups.append([r])
            # the greatest end of the run of one speaker, over its pauses
            reach = max((x for x in ((reach if same else None), r[6]) if x is not None), default=None)
        for n, g in enumerate(groups, 1):
            said = [r[4] for r in g if r[4] is not None]
            text = {"space": " ", "raw": ""}.get(separator)
            text = text.join(said) if text is not None else "".join(f" {w}" if w[0].isalnum() else w for w in said)
            if text.strip():
                least, most = (f((r[c] for r in g if r[c] is not None), default=None) for f, c in ((min, 5), (max, 6)))
                out.append((key, n, g[0][3], least, most, len(g), text.strip(), [r[4] for r in g]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("gap", "separator", "width"), [(100, "smart", 1), (100, "space", 4), (1_000, "raw", 60_000), (None, "smart", 3)])
def test_segments_of_pieces(spark, gap, separator, width):
    data = made_up()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = assemble.word_segments(df, ["session_id"], ["turn", "idx"], gap, separator, with_words=True, bin_width=width)
    got = [(*r[:7], [w["text"] for w in r["words"]]) for r in got.select("session_id", "island", "speaker", "s_ms", "e_ms", "n_words", "text", "words").collect()]
    assert sorted(got, key=repr) == by_loop(data, gap, separator)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("gap", "separator"), [(1_000, "smart"), (1_000, "space"), (None, "raw")])
def test_words_are_sorted_once(spark, gap, separator):
    """Once by bin and, as pieces, once by session; a task takes no more words where Spark would coalesce."""
    df = spark.createDataFrame(made_up(n=10), SCHEMA)
    plan = plan_of(assemble.word_segments(df, ["session_id"], ["turn", "idx"], gap, separator).withColumn("x", F.md5("text")))
    assert plan.count(" Sort [") <= 2 and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2


def test_words_of_transcripts_are_sorted_once(spark):
    df = spark.createDataFrame(made_up(n=10), SCHEMA)
    plan = plan_of(assemble.transcripts(assemble.word_segments(df, ["session_id"], ["s_ms", "turn", "idx"], with_words=True), ["session_id"]))
    assert plan.count(" Sort [") <= 2 and plan.count("Exchange hashpartitioning") == 2


TURNS = "session_id long, turn_ord long, speaker string, s_ms long, e_ms long"


def with_turns(seed, n=150):
    """Words that pass bins, lie outside all turns or have no length; turns that overlap, touch, tie or have no speaker."""
    r = random.Random(seed)
    words, turns = [], []
    for s in range(5):
        at = r.randrange(0, 300)
        for i in range(n):
            at += r.choice([0, 5, 30, 30, 200])
            words.append((s, i // 9, i % 9, None, r.choice(["one", "Two", ",", "3"]), at, at + r.choice([0, 5, 20, 20, 400, -7])))
        for i in range(0 if s == 4 else r.choice([1, 6, 40])):
            at = r.randrange(0, 6_000)
            turns.append((s, i, r.choice(["a", "b", "c", "", None]), at, at + r.choice([0, 10, 300, 900])))
    return words, turns


def speaker_of(word, turns, coverage):
    s, e = word[5:7]
    over = [(min(e, t[4]) - max(s, t[3]), -t[1], t[2]) for t in turns if t[3] < e and s < t[4]]
    if over:
        o, _, who = max(over)
        if who and e > s and o * coverage[1] >= (e - s) * coverage[0]:
            return who
    near = [(min(abs(s + e - 2 * t[3]), abs(s + e - 2 * t[4])), t[1], t[2]) for t in turns]
    return (min(near)[2] if near else None) or ""


@pytest.mark.parametrize(("seed", "width"), [(1, 50), (2, 700), (3, 60_000)])
def test_segments_of_speakers(spark, seed, width):
    words, turns = with_turns(seed)
    given = [(*w[:3], speaker_of(w, [t for t in turns if t[0] == w[0]], (1, 10)), *w[4:]) for w in words]
    w, t = spark.createDataFrame(words, SCHEMA).repartition(3).drop("speaker"), spark.createDataFrame(turns, TURNS)
    alone = intervals.speakers_in_bins(w, t, ["session_id"], ["turn", "idx"], bin_width=width)
    assert sorted(tuple(r) for r in alone.select("_key.session_id", "turn", "idx", "speaker").collect()) == sorted(g[:4] for g in given)
    made = assemble.speaker_segments(w, t, ["session_id"], ["turn", "idx"], with_words=True, bin_width=width)
    known = spark.createDataFrame(given, SCHEMA)
    same = assemble.word_segments(known, ["session_id"], ["s_ms", "turn", "idx"], with_words=True, bin_width=width)
    names = ["session_id", "island", "speaker", "s_ms", "e_ms", "n_words", "text", "words"]
    assert sorted(map(repr, made.select(*names).collect())) == sorted(map(repr, same.select(*names).collect()))


@pytest.mark.parametrize("query", ["transcript_assembly", "shifted_segments", "speaker_segments"])
def test_words_meet_turns_in_one_exchange(spark, query):
    """Words are made, shuffled by bin and sorted once; they are not paired, grouped and joined back in further shuffles of all of them."""
    df = timed.QUERIES[query](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0].splitlines()
    assert "isFinalPlan=true" in plan[0]
    assert sum("posexplode(array_remove" in x for x in plan) == 1
    assert sum(" Sort [" in x and "s_ms" in x for x in plan) == 1
