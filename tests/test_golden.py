"""Small golden cases, as rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframes.functions import audio, controls, formats
from speechframes.functions import text as T
from speechframes.operators import assemble, gallery, intervals, ordered, reports, sessions, validate, windows
from speechframes.plans import jobs
from speechframes.sources import sinks, wav

TURN = "session_id int, turn_ord int, s_ms long, e_ms long, speaker string"


def turns(spark, *items):
    return spark.createDataFrame([(1, i, s, e, w) for i, (s, e, w) in enumerate(items)], TURN)


def test_merge_turns(spark, rows):
    df = turns(spark, (1700, 2500, "A"), (2600, 3400, "B"), (0, 800, "A"), (-500, -100, "A"), (100, 200, " ")).withColumn("w", F.lit(4000).cast("long"))
    assert rows(intervals.merge_turns(df, ["session_id"], 750, "w"), "speaker", "s_ms", "e_ms") == [("A", 0, 800), ("A", 1700, 2500), ("B", 2600, 3400)]


def test_merge_turns_capped(spark, rows):
    df = turns(spark, (0, 300, "A"), (300, 1000, "A"), (1050, 2000, "A"), (2200, 3000, "B"), (3050, 3600, "B"))
    assert rows(intervals.merge_turns_capped(df, ["session_id"], 500, 150, 40), "speaker", "s_ms", "e_ms") == [("A", 300, 2000), ("B", 2200, 3600)]
    assert rows(intervals.merge_turns_capped(df, ["session_id"], 500, 150, 1), "speaker", "s_ms", "e_ms") == [("A", 300, 2000), ("B", 2200, 3000)]


def loop_merge(items, gap):
    out = []
    for s, e, w in sorted(items):
        if out and out[-1][2] == w and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, w])
    return sorted((w, s, e) for s, e, w in out)


def test_merge_turns_random(spark, rows):
    rng = random.Random(7)
    data, want = [], []
    for session in range(60):
        items = [(s := rng.randrange(40), s + rng.randrange(1, 12), rng.choice("AB")) for _ in range(rng.randrange(1, 14))]
        data += [(session, i, s, e, w) for i, (s, e, w) in enumerate(items)]
        want += [(session, *x) for x in loop_merge(items, 2)]
    got = rows(intervals.merge_turns(spark.createDataFrame(data, TURN), ["session_id"], 2), "session_id", "speaker", "s_ms", "e_ms")
    assert got == sorted(want, key=repr)


def test_overlap_and_nearest_random(spark, rows):
    rng = random.Random(8)
    words, spoken, want = [], [], []
    for session in range(40):
        own = [(i, s := rng.randrange(300_000), s + rng.randrange(1, 90_000), rng.choice("ABC")) for i in range(rng.randrange(1, 6))]
        spoken += [(session, *t) for t in own]
        for idx in range(20):
            s = rng.randrange(300_000)
            e = s + rng.randrange(0, 70_000)
            words.append((session, idx, s, e))
            best = max(own, key=lambda t: (min(e, t[2]) - max(s, t[1]), -t[0]))
            over = min(e, best[2]) - max(s, best[1])
            near = min(own, key=lambda t: (min(abs(s + e - 2 * t[1]), abs(s + e - 2 * t[2])), t[0]))
            want.append((session, idx, best[3] if over > 0 and e > s and over * 10 >= e - s else "", near[3]))
    w = spark.createDataFrame(words, "session_id int, idx int, s_ms long, e_ms long")
    t = spark.createDataFrame(spoken, TURN)
    got = intervals.nearest_turn(intervals.assign_by_overlap(w, t, ["session_id"], ["idx"]), t, ["session_id"], out="near")
    assert rows(got, "session_id", "idx", "speaker", "near") == sorted(want, key=repr)


def test_low_coverage_gives_default(spark, rows):
    seg = spark.createDataFrame([(1, 0, 0, 1000)], "session_id int, idx int, s_ms long, e_ms long")
    assert rows(intervals.assign_by_overlap(seg, turns(spark, (0, 50, "A")), ["session_id"], ["idx"], "?", (1, 5)), "speaker") == [("?",)]


def test_ownership_at_seams(spark, rows):
    words = spark.createDataFrame([(1, 0, "alpha", 9400, 9800), (1, 1, "boundary", 9800, 10200), (1, 2, "omega", 10300, 10800), (1, 3, "later", 11000, 11500)], "session_id int, idx int, word string, s_ms long, e_ms long")
    commits = windows.commit_windows(spark.createDataFrame([(1, 12_000)], "session_id int, n_samples long"), 10_000, 1_000, 250)
    got = intervals.owned_words(words, commits, ["session_id"])
    assert rows(got, "commit", "word") == [(0, "alpha"), (1, "boundary"), (1, "later"), (1, "omega")]
    finals = jobs.realtime_finals(words, turns(spark, (0, 20_000, "A")), commits, ["session_id"])
    assert rows(finals, "commit", "text", "speaker") == [(0, "alpha", "A"), (1, "boundary omega later", "A")]


def test_commit_windows_tail(spark, rows):
    made = windows.commit_windows(spark.createDataFrame([(1, 10_500), (2, 10_100)], "session_id int, n_samples long"), 10_000, 1_000, 250)
    assert rows(made, "session_id", "commit", "a_start", "a_end") == [(1, 0, 0, 10_500), (1, 1, 9_000, 10_500), (2, 0, 0, 10_100)]


def test_controls(spark, rows):
    data = [(0, None), (1, [("X-Outputs", b"")]), (2, [("x-outputs", b"Refined, nope"), ("x-store-recording", b"off"), ("x-final-tracks", b"a, b")]), (3, [("x-outputs", b"\xfffinal")])]
    df = spark.createDataFrame(data, "id int, headers array<struct<key:string,value:binary>>")
    value = lambda n: controls.header_value(F.col("headers"), n)
    df = df.withColumn("c", controls.stream_controls(value("x-outputs"), value("x-store-recording"), value("x-final-tracks")))
    got = rows(df, "id", "c.want_realtime", "c.want_refined", "c.want_final", "c.store_recording", F.array_join("c.final_tracks", "|"), controls.unsafe_policy(F.col("c")))
    assert got == [(0, True, True, True, True, "whisperx", False), (1, False, False, False, True, "whisperx", False), (2, False, True, False, False, "a|b", True), (3, False, False, True, True, "whisperx", False)]


@pytest.mark.parametrize(("text", "want"), [("5", 10.0), ("9999", 600.0), ("20", 20.0), (None, 60.0), ("nan", 60.0), ("x", 60.0), ("inf", 60.0)])
def test_window_clamp(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(controls.clamped_window(F.col("t"), 60.0)).first()[0] == want


def test_validation_prefix(spark, rows):
    data = [(1, i, "t", "en", q, r, b) for i, (q, r, b) in enumerate([(5, 16000, 10), (6, 16000, 10), (8, 16000, 10), (9, 16000, 10)])] + [(2, 0, "t", "en", 0, 8000, 10), (3, 0, "t", "en", 0, 16000, 0), (4, 0, "t", "en", 0, 16000, 9)]
    df = spark.createDataFrame(data, "session_id int, arrival int, tenant_id string, lang string, seq long, sample_rate int, payload_bytes long")
    judged = validate.validate_chunks(df, ["session_id"], ["en"])
    assert rows(judged.where("reason IS NOT NULL"), "session_id", "arrival", "reason") == [(1, 2, "sequence-gap"), (2, 0, "sample-rate"), (3, 0, "empty-payload"), (4, 0, "odd-payload")]
    assert rows(validate.valid_prefix(judged, ["session_id"]), "session_id", "arrival") == [(1, 0), (1, 1)]


def test_galleries(spark, rows):
    data = [("t", "x", "s1", [1.0, 0.0]), ("t", "x", "s1", [0.0, 1.0]), ("t", "y", "s2", [1.0, 0.0]), ("t", "y", "s3", [0.0, 1.0]), ("t", "z", "s4", [0.0, 0.0]), ("u", "w", "s5", [1.0, 0.0])]
    df = spark.createDataFrame(data, "tenant_id string, label string, speaker_id string, embedding array<double>")
    assert rows(gallery.strict_gallery(df), "tenant_id", "label") == [("t", "x"), ("u", "w")]
    assert rows(gallery.strict_gallery(df, most=3), "tenant_id", "label") == [("u", "w")]
    lenient = gallery.gallery(df, speaker="speaker_id")
    assert rows(lenient.where("label = 'y'"), "speaker_id") == [("s3",)]
    probes = spark.createDataFrame([(1, "t", [1.0, 0.0]), (2, "u", [1.0, 0.0]), (3, "u", [-1.0, 0.0]), (4, "none", [1.0, 0.0])], "id int, tenant_id string, embedding array<double>")
    people = spark.createDataFrame([("t", "a", [1.0, 0.0]), ("t", "b", [1.0, 0.0]), ("u", "w", [1.0, 0.0])], "tenant_id string, label string, embedding array<double>")
    assert rows(gallery.match(probes, people), "id", "best_label", "accepted") == [(1, "a", True), (2, "w", True), (3, "w", False), (4, None, False)]
    assert rows(gallery.margin_match(probes, people), "id", "best_label") == [(1, None), (2, "w"), (3, None), (4, None)]


def test_text_helpers():
    assert T.merge_echo("hello brave new world", "New World order") == "hello brave new world order"
    assert T.merge_echo("one two, three", "Three! four") == "one two, three four"
    assert T.merge_echo("abc", "xyz") == "abc xyz"
    assert T.merge_echo("", " x ") == "x" and T.merge_echo(" x ", None) == "x"
    assert T.novel_text("good morning all", "morning all of you") == "of you"
    assert T.merge_echo("the end is near the end", "near the end of it") == "the end is near the end of it"
    assert T.overlap("aabaab", "aabaac") == 3 and T.overlap("aaaa", "aa") == 2 and T.overlap(["a", ""], ["", "b"]) == 0 and T.overlap("", "a") == 0 == T.overlap("a", "")


def test_echo_matches_trying_every_length():
    rng = random.Random(3)
    for _ in range(2000):
        left, right = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert T.overlap(left, right) == max(n for n in range(min(len(left), len(right)) + 1) if left.endswith(right[:n]))


def test_restored_words(spark, rows):
    data = [(1, "Hello, world!", [(0.0, 1.0, "hello"), (1.0, 2.0, "world"), (2.0, 2.0, "gone")]), (2, "Hello", [(0.0, 1.0, "nope")]), (3, "a b", [(2.0, 3.0, "a"), (1.0, 2.0, "b")]), (4, "a", []), (5, "a", [(0.0, 9.0, "a"), (float("nan"), 1.0, "x"), (0.0, 1.0, " \n")])]
    df = spark.createDataFrame([(i, t, 5.0, w) for i, t, w in data], "id int, transcript string, duration_s double, words array<struct<start_s:double,end_s:double,text:string>>")
    got = rows(ordered.restore_text(df, ["id"]), "id", "idx", "start_s", "end_s", "text", "reason")
    assert got == [(1, 0, 0.0, 1.0, "Hello, ", None), (1, 1, 1.0, 2.0, "world!", None), (2, 0, None, None, None, "mismatch"), (3, 0, None, None, None, "nonmonotonic"), (4, 0, None, None, None, "empty"), (5, 0, 0.0, 5.0, "a", None)]


def test_native_turns(spark, rows):
    text = "Hello, world!  Yes, I agree."
    tagged = [("Hello,", 0.0, 0.8, 1), ("world!", 0.9, 1.8, 1), ("Yes,", 2.0, 2.4, 2), ("I", 2.5, 2.7, 2), ("agree.", 3.0, 4.8, 2)]
    late = [(w, s, 2.3 if w == "world!" else e, k) for w, s, e, k in tagged]
    data = [(1, text, 0.0, 5.0, tagged), (2, text, 0.0, 5.0, late), (3, text, 0.0, 5.0, tagged[:-1]), (4, "Hi", 0.0, 1.0, [("Hi", 0.0, 1.0, 7)]), (5, "Hi", 0.0, 1.0, [])]
    df = spark.createDataFrame(data, "id int, text string, start_s double, end_s double, words array<struct<text:string,start_s:double,end_s:double,speaker:int>>")
    got = rows(ordered.native_turns(df, ["id"]), "id", "pos", "start_s", "end_s", "text", "speaker")
    first, second = ("Hello, world!", "SPEAKER_00"), ("Yes, I agree.", "SPEAKER_01")
    assert got == [(1, 0, 0.0, 1.8, *first), (1, 1, 2.0, 4.8, *second), (2, 0, 0.0, 2.0, *first), (2, 1, 2.0, 4.8, *second), (3, 0, 0.0, 5.0, text, ""), (4, 0, 0.0, 1.0, "Hi", ""), (5, 0, 0.0, 1.0, "Hi", "")]


def test_chunk_rules_of_each_profile(spark, rows):
    data = [("a", 0, "t", "", 0, 16000, 10), ("b", 0, "t", "en", 0, 16000, 0), ("c", 0, "t", "xx", 0, 8000, 1), ("d", 0, "t" * 300, "en", 0, 16000, 40_000), ("e e", 0, "t", "en", 3, 16000, 10), ("f", 0, "t", "en", 1, 16000, 10), ("f", 1, "u", "fr", 3, 16000, 10)]
    df = spark.createDataFrame(data, "session_id string, arrival int, tenant_id string, lang string, seq long, sample_rate int, payload_bytes long")
    found = lambda p: {(s, n): r for s, n, r in rows(validate.validate_chunks(df, ["session_id"], ["en", "fr"], p).where("reason IS NOT NULL"), "session_id", "arrival", "reason")}
    assert found("strict") == {("b", 0): "empty-payload", ("c", 0): "unsupported-language", ("d", 0): "tenant-too-long", ("f", 1): "tenant-changed"}
    assert found("epoch") == {("c", 0): "sample-rate", ("f", 1): "sequence-gap"}
    assert found("native") == {("c", 0): "sample-rate", ("d", 0): "invalid-tenant-id", ("e e", 0): "invalid-session-id", ("f", 1): "sequence-gap"}


def test_white_space_of_every_kind(spark):
    df = spark.createDataFrame([("no\n", "10d", "\t\u00a0 a\u2003\n")], "b string, n string, t string")
    got = df.select(controls.lenient_bool(F.col("b"), True), controls.clamped_window(F.col("n"), 60.0), controls.clamped_window(F.lit("15f"), 60.0), controls.clamped_window(F.lit(" 1.5e1\n"), 60.0), T.strip("t")).first()
    assert tuple(got) == (False, 60.0, 60.0, 15.0, "a")
    headers = spark.createDataFrame([([("k", "x\ufffdy".encode() + b"\xff")],)], "h array<struct<key:string,value:binary>>")
    assert headers.select(controls.header_value(F.col("h"), "K")).first()[0] == "x\ufffdy"


def test_extensible_pcm_and_riff_column(spark):
    import struct

    pcm = bytes(range(60))
    fmt = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 16000, 48000, 3, 24, 22, 24, 4) + audio.PCM_GUID
    data = b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm
    assert audio.acceptable(audio.wav_fields(data), len(data)) is None
    floats = data.replace(audio.PCM_GUID, b"\x03" + audio.PCM_GUID[1:])
    assert audio.acceptable(audio.wav_fields(floats), len(floats)) == "compressed"
    df = spark.createDataFrame([(b"\x01\x02" * 300,), (b"",), (None,)], "pcm binary")
    made = [r[0] and bytes(r[0]) for r in df.select(audio.riff_column(F.col("pcm"))).collect()]
    assert made == [audio.riff(b"\x01\x02" * 300), audio.riff(b""), None]


def test_audio_helpers(spark, rows):
    assert np.allclose(audio.decode(b"\x00\x80\xff\x7f"), [-1, 32767 / 32768])
    assert np.allclose(audio.decode(b"\x00\xff", 1), [-1, 127 / 128])
    assert np.allclose(audio.decode(b"\x00\x00\x80\xff\xff\x7f", 3), [-1, 1], atol=1e-6)
    assert audio.decode(b"\x00\x40\x00\xc0", 2, 2).tolist() == [0.0]
    assert len(audio.resample(np.ones(441), 44100)) == 160 and len(audio.resample(np.ones(1), 16000)) == 0
    assert audio.wav_fields(audio.riff(b"\x01\x02" * 5))["rate"] == 16000
    assert audio.acceptable(audio.wav_fields(audio.riff(b"")), 44) == "frames"
    assert audio.wav_fields(audio.riff(b"\x01\x02")[:-1]) == {"reason": "wrong-length"} and audio.wav_fields(b"x") == {"reason": "not-wav"}
    stereo = np.stack([np.sin(np.arange(100)), np.sin(np.arange(100))], 1)
    assert np.allclose(audio.downmix(stereo, 50), 1.4 * stereo[:, 0])
    df = spark.createDataFrame([([3.0, 4.0],), ([],)], "x array<double>")
    assert [round(r[0], 6) for r in df.select(audio.rms(F.col("x"))).collect()] == [round(math.sqrt(12.5), 6), 0.0]
    files = spark.createDataFrame([("a", audio.riff(b"\x00\x10" * 100)), ("b", b"junk")], "path string, content binary")
    assert rows(wav.normalise_audio(files), "path", "n_samples", "reason") == [("a", 100, None), ("b", None, "not-wav")]


def test_formats(spark):
    row = spark.range(1).select(formats.srt_time(F.lit(3_723_004)), formats.srt_time(F.lit(-5)), formats.speaker_label(F.lit(2)), formats.speaker_label(F.lit(0)), formats.iso_or_null(F.lit("2026-01-02T03:04:05Z")).isNotNull(), formats.iso_or_null(F.lit("x")).isNull()).first()
    assert tuple(row) == ("01:02:03,004", "00:00:00,000", "SPEAKER_01", "", True, True)


def test_new_words_and_forced_endpoints(spark, rows):
    data = [(1, 0, 0, 1, 50, "zero"), (1, 0, 0, 10, 100, "a"), (1, 0, 1, 100, 300, "b"), (1, 1, 1, 100, 300, "b"), (1, 1, 2, 400, 500, "c")]
    df = spark.createDataFrame(data, "session_id long, window long, idx long, s_ms long, e_ms long, word string")
    assert rows(ordered.new_words(df, ["session_id"], "session_id long", "window", ["idx"]), "word") == [("a",), ("b",), ("c",)]
    up = spark.createDataFrame([(1, i, 10, "FINAL" if i == 2 else "PARTIAL") for i in range(7)], "session_id long, seq long, n_samples long, kind string")
    assert [r for r in rows(ordered.forced_endpoints(up, ["session_id"], "session_id long", ["seq"], 30), "seq", "forced") if r[1]] == [(5, True)]


def fed(*items, **options):
    c = ordered.PARTIALS | {"rate": 1000, "window": 10_000, "context": 1_000, "least": 250, "min_buffer": 700, "min_transcribe": 700, "emit_every": 700} | options
    state, out = ordered.partial_state(), []
    for n, ts, text, done in items:
        out.append([(x["kind"], x["start_sample"], x["end_sample"]) for x in ordered.partial_step(state, {"n_samples": n, "ts_us": ts, "text": text, "speech": True, "done_us": done}, c)])
    return out


def test_partial_gate():
    s = 1_000_000
    assert fed((8000, 8 * s, "a", None), (2000, 10 * s, "b", None), (1000, 11 * s, "c", None)) == [[("PARTIAL", 0, 8000)], [], [("FINAL", 0, 10_000)]]
    slow = fed((1000, 1 * s, "a", 9 * s), (1000, 10 * s, "b", None))  # eight seconds of decoding
    assert slow[1] == []
    idle = fed((1000, 1 * s, "a", None), (1000, 6 * s, "b", None))  # a true pause
    assert idle[1] == [("PARTIAL", 0, 2000)]
    assert fed((1000, s, "a", None), (1000, 2 * s, "a", None), repeats=2) == [[], [("PARTIAL", 0, 2000)]]


def test_sessions_and_reports(spark, rows):
    data = [(1, 0, 100, 0, False), (1, 1, 100, 10, False), (1, 2, 0, 11, True), (1, 3, 50, 12, False), (1, 4, 0, 13, True), (1, 5, 0, 14, True)]
    df = spark.createDataFrame(data, "session_id int, seq long, n_samples long, ts_us long, end_marker boolean")
    assert rows(sessions.end_marker_sessions(df, ["session_id"]), "seq", "recording") == [(0, 0), (1, 0), (3, 1)]
    assert rows(sessions.idle_sessions(df, ["session_id"], 9), "seq", "recording")[:3] == [(0, 0), (1, 1), (2, 1)]
    pcm = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab"), (2, 0, b"x" * 9)], "session_id int, seq long, pcm binary")
    assert [(a, bytes(b) if b else None, c) for a, b, c in rows(sessions.assemble_pcm(pcm, ["session_id"], 8), "session_id", "pcm", "reason")] == [(1, b"abcd", None), (2, None, "too-large")]
    spans = spark.createDataFrame([(0, 10), (5, 15), (10, 20), (30, 31)], "a long, b long")
    assert rows(reports.concurrency(spans, "a", "b", 7))[:3] == [(0, 1), (10, 2), (15, 1)] and reports.concurrency(spans, "a", "b", 7).agg(F.max("open")).first()[0] == 2


def test_slices_conserve_samples(spark, rows):
    rng = random.Random(3)
    data = [(s, i, rng.randrange(0, 900)) for s in range(20) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(data, "session_id int, seq long, n_samples long")
    got = {(a, b): n for a, b, n in rows(windows.slices(df, ["session_id"], 256), "session_id", "slice_index", "n_samples")}
    for s in range(20):
        total = sum(n for a, _, n in data if a == s)
        assert [got.pop((s, k)) for k in range(-(-total // 256))] == [256] * (total // 256) + ([total % 256] if total % 256 else [])
    assert not got


def test_exports(spark, tmp_path, rows):
    seg = spark.createDataFrame([(1, 1, 0, 900, "A", "hi"), (1, 2, 1000, 1500, "", " "), (1, 3, 2000, 2500, None, "there")], "session_id int, island long, s_ms long, e_ms long, speaker string, text string")
    assert rows(sinks.srt_cues(seg, ["session_id"]), "cue", "text") == [(1, "hi"), (2, "there")]
    assert sinks.srt_cues(seg, ["session_id"]).orderBy("cue").first()["cue_text"] == "1\n00:00:00,000 --> 00:00:00,900\nA: hi\n"
    sinks.write_lines(seg, str(tmp_path / "txt"), ["session_id"])
    assert rows(spark.read.text(str(tmp_path / "txt")), "value")[2] == ("[2.00 - 2.50] UNKNOWN: there",)
    bad = spark.createDataFrame([("00000000-0000-4000-8000-000000000001", "t", "r"), ("x", "t", "r")], "session_id string, tenant_id string, reason string")
    assert [r[1] for r in rows(sinks.failure_events(bad, F.lit("2026-01-01").cast("timestamp")))] == ['{"schema_version":1,"session_id":"00000000-0000-4000-8000-000000000001","tenant_id":"t","reason":"r","created_at":"2026-01-01T00:00:00.000Z"}']


def test_manifests(spark, tmp_path, rows):
    import json

    def put(tenant, speaker, body):
        folder = tmp_path / tenant / "speakers" / speaker
        folder.mkdir(parents=True)
        (folder / "speaker.json").write_text(json.dumps(body))

    put("t", "s1", {"speaker_id": "s1", "label": "Ann", "samples": [{"url": f"file:{tmp_path}/t/speakers/s1/samples/a.wav"}]})
    put("t", "s2", {"speaker_id": "s2", "label": "", "samples": []})
    put("u", "s3", {"speaker_id": "s3", "label": "Bob", "samples": [{"url": "ftp://x/y"}]})
    (tmp_path / "t" / "speakers" / "index.json").write_text(json.dumps({"tenant_id": "t", "speakers": [{"speaker_id": "s1"}]}))
    found = wav.read_manifests(spark, str(tmp_path))
    assert rows(found, "tenant_id", "folder") == [("t", "s1"), ("t", "s2"), ("u", "s3")]
    assert rows(wav.listed_speakers(found, wav.read_index(spark, str(tmp_path))), "folder") == [("s1",), ("s3",)]
    vectors = found.select(F.explode("samples.url").alias("url")).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    made, rejected = jobs.build_gallery(found, vectors)
    assert rows(made, "tenant_id", "label") == [("t", "Ann")] and rows(rejected, "folder", "reason") == [("s2", "missing-label")]


def test_jobs(spark, rows):
    header = [("x-outputs", b"refined,final"), ("x-refinement-tracks", b"qwen"), ("x-final-tracks", b"qwen")]
    chunk = spark.createDataFrame([("t", "s", i, 16_000, i * 1_000_000, False, header) for i in range(3)] + [("t", "other", 0, 16_000, 0, False, [("x-outputs", b"")])], "tenant_id string, session_id string, seq long, n_samples long, ts_us long, end_marker boolean, headers array<struct<key:string,value:binary>>")
    assert rows(jobs.record_sessions(chunk, 30_000_000), "session_id", "total_samples", "duration_ms", "n_chunks") == [("s", 48_000, 3000, 3)]
    words = spark.createDataFrame([("t", "s", 1, 0, "hi", 0, 400), ("t", "s", 1, 1, "there", 500, 900)], "tenant_id string, session_id string, slice_index long, idx long, word string, s_ms long, e_ms long")
    spoken = spark.createDataFrame([("t", "s", 1, 0, 0, 450, "A"), ("t", "s", 1, 1, 450, 1000, "B")], "tenant_id string, session_id string, slice_index long, turn_ord long, s_ms long, e_ms long, speaker string")
    made = jobs.refine_windows(chunk, words, spoken, 32_000, "qwen")
    seg = made.select("text", "start_s", "end_s", F.explode("segments").alias("g")).select("text", "start_s", "end_s", "g.speaker", "g.start_s", F.col("g.words")[0]["end_s"])
    assert sorted(map(tuple, seg.collect())) == [("hi there", 2.0, 3.0, "A", 2.0, 2.4), ("hi there", 2.0, 3.0, "B", 2.5, 2.9)]
    scored = jobs.score_windows(spark.createDataFrame([(1, "en"), (2, "de")], "id int, lang string"), lambda part: [part.assign(text=part["lang"] + "!").iloc[[i]] for i in range(len(part))], "id int, lang string, text string")
    assert rows(scored, "id", "text") == [(1, "en!"), (2, "de!")]


def test_finalize(spark, rows):
    rec = spark.createDataFrame([("t", "a", (True, True, True, True, ["q"], [])), ("t", "b", (True, True, True, False, ["q", "w"], []))], "tenant_id string, session_id string, controls struct<want_realtime:boolean,want_refined:boolean,want_final:boolean,store_recording:boolean,final_tracks:array<string>,refinement_tracks:array<string>>")
    seg = "tenant_id string, session_id string, idx long, text string, s_ms long, e_ms long"
    asr = spark.createDataFrame([("t", "a", 0, " hello ", 0, 1000), ("t", "a", 1, " ", 1000, 1100), ("t", "b", 0, "x", 0, 10)], seg)
    aligned = spark.createDataFrame([("t", "a", 0, "short", 0, 100)], seg)
    spoken = spark.createDataFrame([("t", "a", 0, 0, 900, "A")], "tenant_id string, session_id string, turn_ord long, s_ms long, e_ms long, speaker string")
    made, rejected = jobs.finalize_recordings(rec, asr, aligned, spoken, "q")
    assert rows(made, "session_id", "full_text") == [("a", "hello")] and rows(rejected, "session_id", "reason") == [("b", "unsafe-policy")]


def test_transcript_fallback_text(spark, rows):
    seg = spark.createDataFrame([(1, 1, 0, 10, "", " ", "raw")], "session_id int, island long, s_ms long, e_ms long, speaker string, text string, raw string")
    assert rows(assemble.transcripts(seg, ["session_id"], raw_text="raw"), "full_text") == [("raw",)]


def test_enrich_epochs_and_split(spark, rows):
    words = spark.createDataFrame([(1, 0, 0, "Hi, ", 0, 400), (1, 0, 1, "you. ", 500, 900), (1, 0, 2, "Far", 5000, 5200)], "session_id int, epoch int, idx int, word string, s_ms long, e_ms long")
    spoken = spark.createDataFrame([(1, 0, 0, 0, 1000, "A"), (1, 0, 1, 4000, 4900, "B")], "session_id int, epoch int, turn_ord int, s_ms long, e_ms long, speaker string")
    assert rows(jobs.enrich_epochs(words, spoken, ["session_id"]), "speaker", "text", "s_ms", "e_ms") == [("EPOCH_0000/A", "Hi, you.", 0, 900), ("EPOCH_0000/B", "Far", 5000, 5200)]
    asr = spark.createDataFrame([(1, 0, 0, 900), (2, 0, 0, 900)], "session_id int, idx int, s_ms long, e_ms long")
    two = turns(spark, (0, 1000, "A"), (1100, 3000, "B")).unionByName(spark.createDataFrame([(2, 0, 0, 800, "A")], TURN))
    assert rows(jobs.split_by_turn(asr, two, ["session_id"]), "session_id", "speaker", "mode") == [(1, "A", "turn"), (1, "B", "turn"), (2, "A", "overlap")]
    assert rows(jobs.offline_crops(turns(spark, (0, 70_000, "A"), (60_000, 80_000, "B")), ["session_id"]), "speaker", "crop_s", "crop_e") == [("A", 0, 30_000), ("A", 30_000, 60_000), ("A", 60_000, 70_000), ("B", 70_000, 80_000)]


def test_epochs_that_fail_give_their_whole_text(spark, rows):
    words = spark.createDataFrame([(1, 0, 0, "Hi, ", 0, 400), (1, 0, 1, "you. ", 500, 900), (1, 1, 0, None, None, None), (1, 2, 0, "No turns", 20_000, 20_500)], "session_id int, epoch int, idx int, word string, s_ms long, e_ms long")
    spoken = spark.createDataFrame([(1, 0, 0, 0, 1000, "A"), (1, 1, 0, 10_000, 11_000, "B")], "session_id int, epoch int, turn_ord int, s_ms long, e_ms long, speaker string")
    epochs = spark.createDataFrame([(1, 0, "Hi, you.", 0, 10_000), (1, 1, " Not aligned. ", 10_000, 20_000), (1, 2, "No turns", 20_000, 30_000), (1, 3, "No words", 30_000, 40_000), (1, 4, " ", 40_000, 50_000)], "session_id int, epoch int, text string, s_ms long, e_ms long")
    got = rows(jobs.enrich_epochs(words, spoken, ["session_id"], epochs), "epoch", "speaker", "text", "s_ms", "e_ms")
    assert got == [(0, "EPOCH_0000/A", "Hi, you.", 0, 900), (1, "", "Not aligned.", 10_000, 20_000), (2, "", "No turns", 20_000, 30_000), (3, "", "No words", 30_000, 40_000)]


def test_commits_without_word_times_give_their_text(spark, rows):
    words = spark.createDataFrame([(1, 0, "alpha", 1000, 1500)], "session_id int, idx int, word string, s_ms long, e_ms long")
    commits = spark.createDataFrame([(1, 0, 0, 10_000, 0, 11_000), (1, 1, 10_000, 20_000, 9_000, 21_000), (1, 2, 20_000, 30_000, 19_000, 30_000)], "session_id int, commit int, c_start long, c_end long, a_start long, a_end long")
    said = spark.createDataFrame([(1, 0, "alpha"), (1, 1, " untimed text "), (1, 2, "")], "session_id int, commit int, text string")
    got = rows(jobs.realtime_finals(words, turns(spark, (0, 20_000, "A")), commits, ["session_id"], transcripts=said), "commit", "text", "speaker", "s_ms", "e_ms")
    assert got == [(0, "alpha", "A", 1000, 1500), (1, "untimed text", "", 10_000, 20_000)]


def test_offline_crops_give_segments_with_words(spark, rows):
    spoken = turns(spark, (0, 40_000, "A"), (50_000, 52_000, "B"), (60_000, 61_000, "A"))
    said = [(1, 0, 0, " Hi, you. ", [(0.5, 0.9, "hi"), (1.0, 1.5, "you")]), (1, 0, 30_000, "More", [(0.0, 99.0, "more")]), (1, 1, 50_000, "Other words", [(0.0, 1.0, "mismatch")]), (1, 2, 60_000, " ", None)]
    said = spark.createDataFrame(said, "session_id int, turn_ord int, crop_s long, text string, words array<struct<start_s:double,end_s:double,text:string>>")
    got = rows(jobs.offline_crops(spoken, ["session_id"], hypotheses=said), "speaker", "s_ms", "e_ms", "text", F.to_json("words"))
    first = '[{"start_s":0.5,"end_s":0.9,"text":"Hi, "},{"start_s":1.0,"end_s":1.5,"text":"you."}]'
    assert got == [("A", 0, 30_000, "Hi, you.", first), ("A", 30_000, 40_000, "More", '[{"start_s":30.0,"end_s":40.0,"text":"More"}]'), ("B", 50_000, 52_000, "Other words", None)]


def test_ingest_uploads(spark, rows):
    good, bad = "00000000-0000-4000-8000-00000000000%d", "nope"
    url = lambda i: f"s3://b/t/uploads/{good % i}/source"
    events = spark.createDataFrame([(good % 1, "t", url(1)), (good % 2, "t", url(2)), (bad, "t", url(3)), (good % 4, "t", url(4))], "session_id string, tenant_id string, recording_url string")
    files = [(url(1), audio.riff(b"\x00\x10" * 160)), (url(2), b"junk")]
    df = spark.createDataFrame([(p, len(c), c) for p, c in files], "path string, length long, content binary")
    made, failed = jobs.ingest_uploads(events, df, "b", F.lit("2026-01-01").cast("timestamp"))
    assert rows(made, "session_id", "n_samples", "duration_s") == [(good % 1, 160, 0.01)]
    assert rows(failed, "key", F.get_json_object("value", "$.reason")) == [(good % 2, "not-wav"), (good % 4, "missing-source")]


def test_session_audio_files(spark, tmp_path, rows):
    import datetime as dt

    rec = spark.createDataFrame([("", "s1", dt.datetime(2026, 3, 4, 5), b"\x01\x02"), ("t", "s2", dt.datetime(2026, 3, 5), None)], "tenant_id string, session_id string, ts timestamp, pcm binary")
    wav.write_session_wavs(rec, str(tmp_path / "wav"))
    back = spark.read.parquet(str(tmp_path / "wav"))
    assert rows(back, "tenant", "session_id", "object_key") == [("default", "s1", "default/2026/03/04/s1/audio.wav"), ("t", "s2", "t/2026/03/05/s2/audio.wav")]
    assert bytes(back.where("session_id = 's1'").first()["wav"]) == audio.riff(b"\x01\x02")
    folder = tmp_path / "flat"
    folder.mkdir()
    for name in ("ann_1.wav", "bob.wav", "note.txt"):
        (folder / name).write_bytes(audio.riff(b"\x01\x02" * 4))
    assert rows(wav.legacy_samples(spark, str(folder)), "label") == [("ann",), ("bob",)]
    scanned = wav.scan_wavs(wav.read_files(spark, str(folder)), recording=True)
    assert rows(scanned, "n_frames", "reason") == [(4, None), (4, None)]


def test_strict_manifests(spark, rows):
    url = "s3://b/root/t/speakers/s1/samples/%s"
    data = [("s1", "Ann", [url % "a.wav"]), ("s9", "Ann", [url % "a.wav"]), ("s1", "SPEAKER_01", [url % "a.wav"]), ("s1", "Ann", [url % "../x"]), ("s1", "Ann", [url % i for i in range(6)]), ("s1", "Ann", ["s3://b/root/t/speakers/s2/samples/a"])]
    df = spark.createDataFrame([(i, s, l, [(u,) for u in us]) for i, (s, l, us) in enumerate(data)], "id int, speaker_id string, label string, samples array<struct<url:string>>")
    reason = validate.strict_manifest_reason(F.lit("s1"), "s3://b/root", F.lit("t"))
    assert rows(df, "id", reason.alias("r")) == [(0, None), (1, "foreign-folder"), (2, "bad-label"), (3, "foreign-sample"), (4, "too-many-samples"), (5, "foreign-sample")]


def test_word_timings_and_unsupported(spark):
    from speechframes.operators import languages

    df = spark.createDataFrame([([(0.0, 1.0, "a", None), (None, 1.0, "b", None), (1.0, 2.0, None, " c "), (2.0, 3.0, " ", None)], ["en", "xx", "xx", "de"])], "words array<struct<start:double,end:double,word:string,text:string>>, langs array<string>")
    row = df.select(assemble.word_timings(F.col("words")).alias("w"), languages.unsupported(F.col("langs"), ["en", "de"]).alias("u")).first()
    assert [w["text"] for w in row["w"]] == ["a", "c"] and row["u"] == ["xx"]


def test_event_rows_and_lines(spark, rows):
    from speechframes.sources import sinks

    results = spark.createDataFrame([("s", 0.0, 1.5, "hi", True, None, None), ("s", 1.5, 2.0, None, False, "de", "A")], "session_id string, start_s double, end_s double, text string, is_final boolean, lang string, speaker string")
    assert rows(sinks.asr_events(results, "en", "p")) == [("s", 0.0, 1.5, "hi", "FINAL", "en", "", "p"), ("s", 1.5, 2.0, "", "PARTIAL", "de", "A", "p")]
    events = spark.createDataFrame([("", "k1", 0.0, 1.5, None, "hi"), ("s", "k2", 1.0, 12.25, "A", "yo")], "session_id string, key string, start_s double, end_s double, speaker string, text string")
    assert rows(sinks.refined_lines(events), "line") == [("session=k1 0.00-1.50s speaker=? text=hi",), ("session=s 1.00-12.25s speaker=A text=yo",)]


def test_profiles_and_embeddings(spark, rows):
    data = spark.createDataFrame([(1, None, "en"), (2, "b", "en"), (3, "x", "de"), (4, "", None)], "id long, provider_profile_id string, lang string")
    scorer = lambda tag: lambda part: [part[["id"]].iloc[[i]].assign(text=tag) for i in range(len(part))]
    made, rejected = jobs.score_profiles(data, {"a": scorer("A"), "b": scorer("B")}, "a", "id long, text string")
    assert rows(made) == [(1, "A"), (2, "B"), (4, "A")]
    assert rows(rejected, "id", "reason") == [(3, "unknown-profile")]
    samples = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "id long, content binary")
    got = {r["id"]: r["embedding"] for r in jobs.embed_samples(samples, lambda c: [len(c), c[0]]).collect()}
    assert got == {1: [2.0, 97.0], 2: None}
