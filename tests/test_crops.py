"""Audio of turns against bytes that are cut by hand; jobs and replays on top."""

import random

import pytest
from pyspark.sql import functions as F

from speechframes.operators import crops, ordered, reports
from speechframes.plans import jobs

CHUNK = "session_id long, seq long, pcm binary"
TURN = "session_id long, turn_ord long, speaker string, s long, e long"


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    chunks, turns = [], []
    for session in range(6):
        for seq in range(rng.randint(1, 30)):
            chunks.append((session, seq, rng.choice([None, b"", rng.randbytes(rng.randint(1, 101)), rng.randbytes(2 * rng.randint(1, 60))])))
        for k in range(12):
            at = rng.randint(-20, 900)
            turns.append((session, k, rng.choice(["A", "B", ""]), at, at + rng.choice([-3, 0, 1, 17, 150, 700])))
    turns.append((99, 0, "A", 0, 100))  # a session without audio
    return chunks, turns


def whole(chunks, session):
    return b"".join((p or b"")[: len(p or b"") // 2 * 2] for s, _, p in sorted(chunks, key=lambda c: c[:2]) if s == session)


@pytest.mark.parametrize("bin_samples", [16, 10**6])
def test_turns_and_speakers_equal_slices(spark, cases, bin_samples):
    chunks, turns = cases
    c, t = spark.createDataFrame(chunks, CHUNK).repartition(3), spark.createDataFrame(turns, TURN)
    cut = lambda s, a, b: whole(chunks, s)[2 * max(0, a) : 2 * max(0, b)]
    want = {(s, k): cut(s, a, b) for s, k, _, a, b in turns if b > a and cut(s, a, b)}
    got = crops.turn_audio(c, t, ["session_id"], bin_samples=bin_samples).collect()
    assert {(r["session_id"], r["turn_ord"]): bytes(r["pcm"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_samples"] * 2 == len(r["pcm"]) for r in got)
    spoken = {}
    for s, k, who, a, b in sorted(turns, key=lambda t: (max(0, t[3]), min(t[4], len(whole(chunks, t[0])) // 2), t[1])):
        if who and (s, k) in want:
            spoken[s, who] = spoken.get((s, who), b"") + want[s, k]
    limited = {k: v[:800] for k, v in spoken.items() if len(v) >= 300}
    made = crops.speaker_audio(c, t, ["session_id"], 150, 400, bin_samples=bin_samples).collect()
    assert {(r["session_id"], r["speaker"]): bytes(r["pcm"]) for r in made} == limited and limited != spoken


def test_each_turn_is_heard_by_itself(spark, rows):
    """Two speakers: crops go to the model, their segments come back in place and with names."""
    asr = spark.createDataFrame([(1, 0, 0, 10_000, "Hello world"), (2, 0, 0, 900, "alone")], "session_id long, idx long, s_ms long, e_ms long, text string")
    turns = spark.createDataFrame([(1, 0, "A", 0, 2000), (1, 1, "B", 2000, 4000), (2, 0, "A", 0, 900)], "session_id long, turn_ord long, speaker string, s_ms long, e_ms long")
    pcm = b"\x01\x00" * 32_000 + b"\x02\x00" * 32_000 + b"\x00\x00" * 96_000
    chunks = spark.createDataFrame([(1, i, pcm[i * 7001 : (i + 1) * 7001 - (i + 1) * 7001 % 2]) for i in range(0)] + [(1, 0, pcm[:50_002]), (1, 1, pcm[50_002:]), (2, 0, b"\x01\x00" * 16_000)], CHUNK)
    hear = lambda p: [(0, 1000, {1: " aaa", 2: "bbb"}[p[0]]), (1500, 1600, " ")]
    columns = ["session_id", "turn_ord", "s_ms", "e_ms", "text", "speaker", "mode"]
    job = lambda hear, **more: jobs.transcribe_by_turn(asr, turns, ["session_id"], "session_id long", chunks, hear, **more)
    made = job(hear)
    assert rows(made, *columns) == [(1, 1, 0, 1000, "aaa", "A", "turn"), (1, 2, 2000, 3000, "bbb", "B", "turn"), (2, None, 0, 900, "alone", "A", "overlap")]
    names = spark.createDataFrame([(1, "B", "Bea"), (2, "A", "Ann")], "session_id long, speaker string, name string")
    assert rows(job(hear, names=names), "text", "speaker") == [("aaa", "A"), ("alone", "Ann"), ("bbb", "Bea")]
    # crops that all come back empty, and audio that is too long: the recognised segments stand
    for empty in (job(lambda p: []), job(hear, longest=5_000)):
        assert rows(empty, *columns) == [(1, None, 0, 10_000, "Hello world", "A", "overlap"), (2, None, 0, 900, "alone", "A", "overlap")]
    # one turn with a result is enough
    assert rows(job(lambda p: hear(p) if p[0] == 2 else []), "text", "mode") == [("alone", "overlap"), ("bbb", "turn")]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_admissions_equal_a_replay(spark, most):
    rng = random.Random(most)
    spans = []
    for key in (1, None):
        at = 0
        for i in range(300):
            at += rng.choice((0, 0, 1, 3, 10, 60))
            spans.append((key, i, at, at + rng.choice((0, 1, 5, 25, 40)) - (i % 50 == 0)))
    made = reports.admissions(spark.createDataFrame(spans, "k long, id long, at_us long, until_us long").repartition(3), ["k"], "k long", "id", most)
    got = {(r["k"], r["id"]): (r["admitted"], r["open"]) for r in made.collect()}
    refused = 0
    for key in (1, None):
        ends = []
        for _, i, a, b in sorted((s for s in spans if s[0] == key), key=lambda s: (s[2], s[1])):
            ends = [e for e in ends if e > a]
            admitted = len(ends) < most
            ends += [max(a, b)] if admitted else []
            refused += not admitted
            assert got[key, i] == (admitted, len(ends))
    assert refused or most == 5
    with pytest.raises(ValueError):
        reports.admissions(spark.createDataFrame(spans, "k long, id long, at_us long, until_us long"), ["k"], "k long", "id", 0)


def test_fold_keeps_null_and_large_keys(spark, rows):
    """A null key is one session, and neighbouring numbers past 2**53 are two."""
    schema = "session_id long, seq long, n_samples long, kind string"
    large = 2**53
    data = [(None, i, 5, "PARTIAL") for i in range(3)] + [(large + 1, 0, 5, "PARTIAL"), (large, 0, 5, "PARTIAL"), (large, 1, 5, "PARTIAL")]
    got = ordered.forced_endpoints(spark.createDataFrame(data, schema), ["session_id"], "session_id long", ["seq"], 10)
    assert rows(got, "session_id", "seq", "forced", "since_final") == sorted([(None, 0, False, 5), (None, 1, True, 0), (None, 2, False, 5), (large, 0, False, 5), (large, 1, True, 0), (large + 1, 0, False, 5)], key=repr)
    words = spark.createDataFrame([(1.5, 0, large + 1, large + 3, 7, None), (float("nan"), 0, 1, 2, 0, "x"), (float("nan"), 1, 1, 2, 1, "y")], "k double, w long, s_ms long, e_ms long, idx long, word string")
    made = ordered.new_words(words, ["k"], "k double", "w", ["s_ms", "idx"], slack=0)
    assert sorted((r["s_ms"], r["word"]) for r in made.collect()) == [(1, "x"), (large + 1, None)]


def test_bounded_echoes_equal_the_whole_transcript(spark, rows):
    """Random epochs that repeat parts of each other; the state keeps its size over ten thousand of them."""
    import json

    from speechframes.functions import text as T

    rng = random.Random(6)
    said, whole, state, largest = ["start"], "", ordered.echo_state(), 0
    for epoch in range(10_000):
        echo = said[-rng.randint(0, min(12, len(said))) :] if rng.random() < 0.8 else []
        echo = [w.upper() if rng.random() < 0.2 else w + rng.choice(("", "", ",")) for w in echo]
        new = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(0, 9))]
        hypothesis = " ".join(echo + new)
        made = ordered.echo_step(state, hypothesis, 200, 50)
        if epoch < 1500:  # the whole transcript takes its time
            merged = T.merge_echo(whole, hypothesis)
            assert made["novel"] == T.added(whole, merged) and made["committed_chars"] == len(merged) and made["context"] == merged[-50:]
            whole = merged
        said = (said + new)[-40:]
        largest = max(largest, len(json.dumps(state)))
    assert largest < 450
    data = [(1, i, t) for i, t in enumerate(["the quick brown fox", "brown fox  jumps over", "over the\ndog"])]
    df = spark.createDataFrame(data, "session_id long, epoch long, text string")
    got = ordered.merge_epochs(df, ["session_id"], ["epoch"], "session_id long", tail=5, longest=40)
    assert rows(got, "epoch", "novel", "committed_chars", "context") == [(0, "the quick brown fox", 19, "n fox"), (1, "jumps over", 30, " over"), (2, "the dog", 38, "e dog")]
    with pytest.raises(ValueError):
        ordered.merge_epochs(df, ["session_id"], ["epoch"], "session_id long", longest=40)


def test_groups_are_filled_across_batches(spark, rows):
    """Arrow batches of three rows still give groups of sixteen, and every row its own result."""
    import pandas as pd

    data = [(i, ("en", "de", None)[i % 3], 10 + i % 7) for i in range(150)]
    df = spark.createDataFrame(data, "id long, lang string, n long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        score = lambda some: [pd.DataFrame({"id": [i], "of": [i * 2], "size": [len(some)], "kinds": [some["lang"].nunique(dropna=False)]}) for i in some["id"]]
        schema = "id long, of long, size long, kinds long"
        got = jobs.score_windows(df, score, schema).collect()
        assert sorted((r["id"], r["of"]) for r in got) == [(i, 2 * i) for i in range(150)]
        assert {r["kinds"] for r in got} == {1} and sorted(r["size"] for r in got) == [2] * 6 + [16] * 144
        bounded = jobs.score_windows(df, score, schema, samples="n", most_samples=40, spread=["id"], salts=2).collect()
        assert len(bounded) == 150 and max(r["size"] for r in bounded) == 4
        tall = jobs.score_windows(df, score, schema, samples="n", most_samples=5).collect()
        assert {r["size"] for r in tall} == {1}
        with pytest.raises(Exception, match="results came out"):
            jobs.score_windows(df, lambda some: score(some)[1:], schema).collect()
        profiled = df.withColumn("provider_profile_id", F.expr("CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN '' ELSE 'x' END"))
        named = lambda name: lambda some: [pd.DataFrame({"id": [i], "by": [name]}) for i in some["id"]]
        made, unknown = jobs.score_profiles(profiled, {"a": named("a"), "b": named("b")}, "b", "id long, by string")
        assert sorted((r["id"], r["by"]) for r in made.collect()) == sorted((i, "a" if i % 4 == 0 else "b") for i in range(150) if i % 4 < 3)
        assert {r["id"] % 4 for r in unknown.collect()} == {3} and unknown.count() == 37
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_recordings_are_files_that_others_can_open(spark, tmp_path):
    import datetime as dt
    import wave

    from speechframes.sources import wav

    rng = random.Random(2)
    t0 = dt.datetime(2026, 3, 4, 23, 59)
    data = [(("t1", "", None)[s % 3], f"s{s}", i, t0 + dt.timedelta(seconds=40 * i), rng.randbytes(2 * rng.randint(0, 400)) if i % 5 else None) for s in range(7) for i in range(30)]
    data += [("t1", "silent", 0, t0, None)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "tenant_id string, session_id string, seq long, ts timestamp, pcm binary").repartition(4)
    root = f"file://{tmp_path}/audio"
    index = wav.write_recordings(df, root).collect()
    (tmp_path / "audio" / "stray.0-dead.wav").write_bytes(b"RIFF")  # of an attempt that was killed
    assert len(index) == 8 and {(r["session_id"], r["reason"], r["path"]) for r in index if r["reason"]} == {("silent", "no-audio", None)}
    for r in index:
        if r["reason"] is None:
            want = b"".join(p or b"" for _, s, _, _, p in sorted(data, key=lambda d: d[2]) if s == r["session_id"])
            assert "2026" in r["path"] and r["session_id"] in r["path"] and ("default" in r["path"]) == (r["tenant_id"] != "t1")
            with wave.open(f"{tmp_path}/audio/{r['path']}") as f:
                assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (16000, 1, 2)
                assert f.readframes(f.getnframes()) == want and r["n_bytes"] == len(want)
    # a later batch adds to the index
    more = df.where("session_id = 's0'").withColumn("session_id", F.lit("later"))
    assert wav.write_recordings(more, root).count() == 9


def test_epochs_are_restored_and_enriched(spark, rows):
    word = "struct<start_s:double,end_s:double,text:string>"
    data = [
        (1, 0, "Hi,  you there.", 10_000, 12_000, [(0.0, 0.4, "hi"), (0.5, 0.9, "you"), (1.0, 1.5, "there")]),
        (1, 1, "lost words", 12_000, 14_000, [(0.0, 0.4, "other")]),
        (1, 2, "no words", 14_000, 16_000, None),
        (1, 3, " ", 16_000, 18_000, [(0.0, 0.4, "x")]),
    ]
    epochs = spark.createDataFrame(data, f"session_id int, epoch int, text string, s_ms long, e_ms long, words array<{word}>")
    turns = spark.createDataFrame([(1, e, k, a, b, who) for e in range(4) for k, (a, b, who) in enumerate([(10_000, 10_450, "A"), (10_450, 18_000, "B")])], "session_id int, epoch int, turn_ord int, s_ms long, e_ms long, speaker string")
    made = jobs.enrich_transcripts(epochs, turns, ["session_id"])
    assert rows(made, "epoch", "speaker", "text", "s_ms", "e_ms") == [
        (0, "EPOCH_0000/A", "Hi,", 10_000, 10_400), (0, "EPOCH_0000/B", "you there.", 10_500, 11_500),
        (1, "", "lost words", 12_000, 14_000), (2, "", "no words", 14_000, 16_000),
    ]
