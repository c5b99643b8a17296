"""Texts are restored in one pass over a crop, whatever its length."""

import time


from speechframes.operators import ordered


def test_restored_texts(spark, rows):
    word = lambda i, w: (float(i), i + 0.5, w)
    data = [
        (1, 1, "Été, \U0001f600 \U00010400b—İx ½!", [word(0, "étÉ"), word(1, "\U00010428B"), word(2, "ix"), word(3, "½")]),
        (1, 2, "a a a.", [word(0, "a"), None, word(1, " "), (None, 2.0, "b"), word(2, "A!"), word(9, "gone")]),
        (1, 3, "a", [word(0, "...")]), (2, 1, None, [word(0, "a")]), (2, 2, "a b", None), (2, 3, "b a", [word(0, "a"), word(1, "b")]), (None, 4, "", []),
    ]
    df = spark.createDataFrame([(*r[:3], 5.0, r[3]) for r in data], "id int, turn int, transcript string, duration_s double, words array<struct<start_s:double,end_s:double,text:string>>")
    got = rows(ordered.restore_text(df, ["id", "turn"]), "id", "turn", "idx", "start_s", "text", "reason")
    assert got == sorted([
        (1, 1, 0, 0.0, "Été, \U0001f600 ", None), (1, 1, 1, 1.0, "\U00010400b—", None), (1, 1, 2, 2.0, "İx ", None), (1, 1, 3, 3.0, "½!", None),
        (1, 2, 0, 0.0, "a ", None), (1, 2, 1, 2.0, "a a.", None), (1, 3, 0, None, None, "mismatch"), (2, 1, 0, 0.0, None, None), (2, 3, 0, None, None, "mismatch"), (None, 4, 0, None, None, "empty"),
    ], key=repr)


def test_long_crop_takes_linear_time(spark):
    """Forty thousand words in one crop; looking each up from the text's beginning takes minutes."""
    said = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(1, ", ".join(said), 1e6, [(float(i), i + 0.5, w) for i, w in enumerate(said)])], "id int, transcript string, duration_s double, words array<struct<start_s:double,end_s:double,text:string>>")
    began = time.time()
    assert ordered.restore_text(df, ["id"]).where("reason IS NULL").count() == 40_000
    assert time.time() - began < 30
