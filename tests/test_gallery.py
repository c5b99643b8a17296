"""Matching against galleries of any size, in tiles, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from speechframes.operators import gallery

PROBE = "id long, tenant_id long, embedding array<float>"
PERSON = "tenant_id long, label string, embedding array<double>"


@pytest.mark.parametrize("tile,part", [(1024, 4096), (4, 5)])
def test_tiles_equal_all_pairs(spark, monkeypatch, tile, part):
    monkeypatch.setattr(gallery, "TILE", tile)
    monkeypatch.setattr(gallery, "PART", part)
    rng = random.Random(tile)
    vector = lambda: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(5)]  # noqa: E731 - many ties
    people = [(t, f"p{k:02}", vector()) for t in (1, 2) for k in range(23 if t == 1 else 1)]
    probes = [(i, i % 4, vector()) for i in range(120)] + [(500, 1, None), (501, 1, [1.0]), (502, None, vector())]
    probes += [probes[0], probes[1], probes[1]]
    p, g = spark.createDataFrame(probes, PROBE), spark.createDataFrame(people, PERSON)
    scored = {}
    for i, t, v in probes:
        scored[i] = [(sum(a * b for a, b in zip(v, w)), name) for u, name, w in people if u == t] if v and len(v) == 5 else []
    best = {r["id"]: r for r in gallery.match(p, g, 0.3).collect()}
    twice = {r["id"]: r for r in gallery.margin_match(p, g, 0.3, 0.4).collect()}
    assert gallery.match(p, g).count() == gallery.margin_match(p, g).count() == len(probes)
    assert gallery.match(p, g).where("id IN (0, 1)").groupBy("id").count().orderBy("id").collect() == [(0, 2), (1, 3)]
    for i, found in scored.items():
        top = min(found, key=lambda f: (-f[0], f[1]), default=(None, None))
        assert (best[i]["similarity"], best[i]["best_label"], best[i]["accepted"]) == (*top, bool(found) and top[0] >= 0.3)
        ranked = sorted(found, reverse=True)
        first, second = (ranked[0] if ranked else (None, None)), (ranked[1][0] if len(ranked) > 1 else -1.0)
        clear = bool(ranked) and first[0] >= 0.3 and first[0] - second >= 0.4
        assert (twice[i]["similarity"], twice[i]["runner_up"], twice[i]["best_label"]) == (first[0], second, first[1] if clear else None)


def test_a_tenant_with_twenty_thousand_labels(spark):
    n = 20_000
    person = spark.range(n).select(F.lit(7).cast("long").alias("tenant_id"), F.format_string("p%05d", "id").alias("label"), F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n)).alias("embedding"))
    probe = spark.range(0, n, 997).select("id", F.lit(7).cast("long").alias("tenant_id"), F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n)).alias("embedding"))
    got = gallery.match(probe, person).collect()
    assert len(got) == 21 and all(r["best_label"] == f"p{r['id']:05d}" for r in got)


def test_no_probes_and_no_people(spark):
    p, g = spark.createDataFrame([(1, 1, [1.0])], PROBE), spark.createDataFrame([(1, "a", [1.0])], PERSON)
    assert gallery.match(p.limit(0), g).count() == 0
    assert [tuple(r)[3:] for r in gallery.match(p, g.limit(0)).collect()] == [(None, None, False)]
