"""Hard negatives against scores of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechframes.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<long>"


def plain(rows, is_anchor, k=5, n=5, low=80, high=100):
    good = [(i, r) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and None not in r[2]]
    width = max((len(r[2]) for _, r in good), default=0)
    vectors = {i: list(r[2]) + [0] * (width - len(r[2])) for i, r in good}
    score = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    order = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is None, f[1]))
    out = []
    for a, anchor in good:
        if anchor[0] is None or not is_anchor(anchor[0]):
            continue
        scores = [(score(a, i), r[0], r[1]) for i, r in good if i != a]
        for s, pid, _ in order([f for f in scores if f[2] == anchor[1]])[:k]:
            window = order([f for f in scores if f[2] != anchor[1] and low * s <= 100 * f[0] <= high * s])[:n]
            out += [(anchor[0], pid, rank + 1, nid, s, t) for rank, (t, nid, _) in enumerate(window)]
    return sorted(out, key=repr)


def mined(spark, rows, step=10, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in N.mine(df, F.col("vec_id") % step == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [N.BLOCK_BYTES, 4096])
@pytest.mark.parametrize("spread", [2, 300])
def test_equal_to_all_pairs(spark, block_bytes, spread, monkeypatch):
    """Small components give many ties; small blocks a grid of groups."""
    rng = random.Random(spread)
    monkeypatch.setattr(N, "BLOCK_BYTES", block_bytes)
    centres = [[rng.randint(-spread, spread) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(240):
        vector = [x + rng.randint(-1, 1) * (spread // 2) for x in rng.choice(centres)]
        rows.append((i, rng.randrange(4), vector))
    rows += [(1000, 1, [0] * 12), (1001, 2, [0] * 12), (1010, 3, []), (1020, 2, [1]), (None, 1, centres[0]), (None, 2, centres[0]), (1030, None, centres[1]), (1040, 1, None), (1050, 1, [1, None])]
    rows += [rows[0]] * 3 + [rows[10]] * 8 + [(20, 3, centres[2])]
    assert mined(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_other_windows_and_numbers(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(3), [rng.randint(-50, 90) for _ in range(20)]) for i in range(150)]
    got = mined(spark, rows, positives=2, negatives=3, low=50, high=90)
    assert got and got == plain(rows, lambda i: i % 10 == 0, 2, 3, 50, 90)
    with pytest.raises(ValueError):
        mined(spark, rows, low=0)


def test_scores_past_the_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.randint(1 << 28, 1 << 29) for _ in range(8)]) for i in range(60)]
    got = mined(spark, rows)
    assert got == plain(rows, lambda i: i % 10 == 0) and max(r[4] for r in got) > 1 << 53


def test_index_finds_all_pairs_and_leaves_parts_out():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(700, 40)) * 100).astype(np.int64) // np.arange(1, 41)
    rows[:300] //= 20  # short ones list few parts
    index = N.Index(rows)
    anchors = rows[[500, 10, 699]]
    for part in (0.9, 0.5, 0.1, 0.0):
        t = np.floor(np.sqrt((anchors**2).sum(axis=1)) * index.tails[0].max() * part).astype(np.int64)
        i, j, score = index.above(anchors, t)
        scores = anchors @ rows.T
        assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(scores >= t[:, None])))
        assert (score == scores[i, j]).all()


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []
    assert mined(spark, [(10, 1, [1])]) == []
    with_more = spark.createDataFrame([(10, 1, [3], "x"), (11, 1, [3], "y"), (12, 2, [3], "z")], SCHEMA + ", rank string")
    assert [tuple(r) for r in N.mine(with_more, F.col("vec_id") == 10).collect()] == [(10, 11, 1, 12, 9, 9)]


def test_query_rules(spark, tmp_path):
    """Labels of every seventh row move on, components are floored, rows that are not finite go."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, 9, [0.5, -0.001]), (1, 0, [0.5, 0.0]), (2, 3, [0.49, 0.0]), (7, 0, [0.48, 0.0]), (3, 0, [nan, 0.0]), (4, 1, [inf, 0.0]), (5, 1, [None, 0.0]), (6, None, [0.5, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding_label int, embedding array<float>").withColumnRenamed("embedding_label", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in N.op13_hard_negatives(spark, str(tmp_path)).orderBy("rank").collect()]
    # anchor 0 has label 0 after the move; its other row of label 0 is 1; 7 has label 1 then
    assert got == [(0, 1, 1, 2, 128 * 128, 128 * 125), (0, 1, 2, 7, 128 * 128, 128 * 122)]
