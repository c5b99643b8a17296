"""Speaker galleries from sample embeddings, and matching against them.

A strict gallery has at most ``MOST_SPEAKERS`` labels for each tenant; a lenient
one has what the tenant enrolled, without a bound of its own. Probes and labels
meet in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE, PART = 1024, 4096  # labels and probes that meet in one group
MOST_SPEAKERS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_embeddings(samples: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """Mean of each dimension by key, its length, and the mean scaled to length one."""
    spread = samples.where(F.size(embedding) > 0).select(*keys, F.posexplode(embedding).alias("_dim", "_x"))
    means = spread.groupBy(*keys, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_x"), F.count("*").alias("_n"))
    made = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_dim", "_x"))), lambda p: p["_x"]).alias("_mean"), F.max("_n").alias("n_samples"))
    made = made.withColumn("mean_norm", F.sqrt(dot(F.col("_mean"), F.col("_mean"))))
    return made.withColumn(embedding, F.transform("_mean", lambda x: x / (F.col("mean_norm") + 1e-12))).drop("_mean")


def gallery(samples: DataFrame, tenant: str = "tenant_id", label: str = "label", speaker: str | None = None) -> DataFrame:
    """Lenient gallery: of speakers that share a label the last one (by speaker id) stands."""
    if speaker is None:
        return mean_embeddings(samples, [tenant, label])
    made = mean_embeddings(samples, [tenant, label, speaker])
    rest = [c for c in made.columns if c not in (tenant, label)]
    return made.groupBy(tenant, label).agg(F.max_by(F.struct(*rest), speaker).alias("_row")).select(tenant, label, "_row.*")


def strict_gallery(samples: DataFrame, tenant: str = "tenant_id", label: str = "label", speaker: str = "speaker_id", most: int = MOST_SPEAKERS) -> DataFrame:
    """Strict gallery: labels of several speakers are out, so are means without direction; a tenant with over ``most`` speakers has none."""
    made = mean_embeddings(samples, [tenant, label, speaker])
    counted = made.withColumn("_same", F.count("*").over(Window.partitionBy(tenant, label))).withColumn("_all", F.count("*").over(Window.partitionBy(tenant)))
    fine = (F.col("_same") == 1) & (F.col("_all") <= most) & (F.col("mean_norm") >= 1e-8) & ~F.isnan("mean_norm")
    return counted.where(fine).drop("_same", "_all")


def _rows_of(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of this width as a matrix, and which rows are such vectors (others are zero)."""
    found, good, at = np.zeros((len(vectors), width)), np.zeros(len(vectors), dtype=bool), 0
    for chunk in vectors.chunks:
        lengths = chunk.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        values = chunk.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(chunk)), np.maximum(lengths, 0))
        whole = (lengths == width) & (np.bincount(row, weights=np.isnan(values), minlength=len(chunk)) == 0)
        found[at : at + len(chunk)][whole] = values[whole[row]].reshape(-1, width)
        good[at : at + len(chunk)] = whole
        at += len(chunk)
    return found, good


def _two_best(tenant: str, label: str, embedding: str, least_label: bool):
    def score(probes: pa.Table, people: pa.Table) -> pa.Table:
        """The two most similar people of a tile to each probe of a part."""
        names = people.column(label).to_pylist()
        order = sorted((i for i in range(len(names)) if names[i] is not None), key=lambda i: names[i], reverse=not least_label)
        width = max((len(v) for v in people.column(embedding).to_pylist() if v is not None), default=0)
        theirs, known = _rows_of(people.column(embedding).take(pa.array(order, pa.int64())), width)
        own, asked = _rows_of(probes.column(embedding), width)
        similar = np.zeros((len(own), len(theirs)))
        for d in range(width):  # in the order of the dimensions, as a row by itself would be
            similar += np.multiply.outer(own[:, d], theirs[:, d])
        similar[:, ~known] = -np.inf
        similar[~asked] = -np.inf
        out = probes.drop_columns(["_tile", "_part"])
        row = np.arange(len(own))
        for nth in ("_sim1", "_sim2"):
            if len(theirs):
                place = similar.argmax(axis=1)  # of equal ones the first in the order of labels
                sim = similar[row, place]
                similar[row, place] = -np.inf
            else:
                place, sim = np.zeros(len(own), np.int64), np.full(len(own), -np.inf)
            missing = np.isneginf(sim)
            named = [None if m else names[order[p]] for p, m in zip(place, missing)]
            out = out.append_column(nth, pa.array(sim, mask=missing)).append_column(nth.replace("sim", "label"), pa.array(named, people.schema.field(label).type))
        return out

    return score


def _scored(probes: DataFrame, people: DataFrame, tenant: str, label: str, embedding: str, least_label: bool) -> DataFrame:
    """probes with _scores, up to two (sim, label), the best first.

    A tenant's labels lie in tiles of ``TILE`` and its probes in parts of ``PART``,
    by hash (copies of a probe go to any part); each part meets each tile in one group, so no gallery, and no
    tenant, is ever in one place. Each tile gives a probe's two best, and the best
    of all tiles stand.
    """
    kind = people.schema[label].dataType.simpleString()
    own = [c for c in probes.columns if c not in ("_tile", "_part")]
    tiles = people.groupBy(tenant).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    parts = probes.groupBy(tenant).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    grid = tiles.join(parts, tenant)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = probes.select(*own, F.xxhash64(*own).alias("_h1"), F.xxhash64(F.lit(1), *own).alias("_h2"))
    some = asked.join(grid, tenant).withColumn("_part", F.pmod(F.xxhash64("_h1", F.monotonically_increasing_id()), F.col("_parts")).cast("int")).withColumn("_tile", every("_tiles")).drop("_parts", "_tiles")
    listed = people.select(F.col(tenant).alias("_of"), label, embedding).join(grid.withColumnRenamed(tenant, "_of"), "_of")
    listed = listed.withColumn("_t", F.pmod(F.xxhash64(label), F.col("_tiles")).cast("int")).withColumn("_p", every("_parts")).drop("_parts", "_tiles")
    listed = listed.select(*[F.col(c).alias(c) for c in listed.columns])  # columns of their own, wherever the two tables come from
    scores = f"_sim1 double, _label1 {kind}, _sim2 double, _label2 {kind}"
    schema = T.StructType([*some.drop("_part", "_tile").schema.fields, *T.StructType.fromDDL(scores).fields])
    met = some.groupBy(tenant, "_tile", "_part").cogroup(listed.groupBy("_of", "_t", "_p")).applyInArrow(_two_best(tenant, label, embedding, least_label), schema)
    pair = lambda n: F.when(F.col(f"_sim{n}").isNotNull(), F.struct(F.col(f"_sim{n}").alias("sim"), F.col(f"_label{n}").alias("label")))
    # equal rows of a table are merged by their hashes and come back as often as they were
    merged = met.groupBy("_h1", "_h2").agg(F.first(F.struct(*own)).alias("_own"), F.count("*").alias("_n"), F.array_union(F.collect_set(pair(1)), F.collect_set(pair(2))).alias("_scores"))
    sizes = merged.select("_own.*", "_n", "_scores").join(tiles, tenant)
    smaller = F.when(F.lit(least_label), -1).otherwise(1)
    order = lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["label"] < b["label"], smaller).when(a["label"] > b["label"], -smaller).otherwise(0)
    found = sizes.select(*own, F.slice(F.array_sort("_scores", order), 1, 2).alias("_scores"), F.explode(F.sequence(F.lit(1), F.expr("CAST(_n div _tiles AS INT)")))).drop("col")
    rest = probes.select(*own).join(people.select(tenant).distinct(), tenant, "left_anti")
    return found.unionByName(rest.withColumn("_scores", F.array().cast(found.schema["_scores"].dataType)).select(*found.columns))


def match(probes: DataFrame, people: DataFrame, threshold: float = 0.30, tenant: str = "tenant_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """probes with the most similar label of their tenant (the least of equal ones), its similarity, and whether it passes."""
    best = F.get("_scores", F.lit(0))
    found = _scored(probes, people, tenant, label, embedding, True)
    return found.withColumn("best_label", best["label"]).withColumn("similarity", best["sim"]).withColumn("accepted", F.coalesce(best["sim"] >= threshold, F.lit(False))).drop("_scores")


def margin_match(probes: DataFrame, people: DataFrame, threshold: float = 0.65, margin: float = 0.1, tenant: str = "tenant_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """probes with the best label if it passes the threshold and leads the runner-up (-1 if there is none) by the margin."""
    first, second = F.get("_scores", F.lit(0)), F.get("_scores", F.lit(1))
    found = _scored(probes, people, tenant, label, embedding, False)
    found = found.withColumn("similarity", first["sim"]).withColumn("runner_up", F.coalesce(second["sim"], F.lit(-1.0)))
    clear = (F.col("similarity") >= threshold) & (F.col("similarity") - F.col("runner_up") >= margin)
    return found.withColumn("best_label", F.when(clear, first["label"])).drop("_scores")


def apply_names(segments: DataFrame, names: DataFrame, keys: list[str], raw: str = "speaker", name: str = "name") -> DataFrame:
    """segments with the mapped name of their speaker, else the raw label, else blank."""
    mapped = names.select(*keys, F.col(raw).alias("_raw"), F.col(name).alias("_name"))
    joined = segments.join(mapped, [*[segments[k] == mapped[k] for k in keys], segments[raw] == mapped["_raw"]], "left")
    for k in keys:
        joined = joined.drop(mapped[k])
    return joined.withColumn(raw, F.coalesce(F.nullif("_name", F.lit("")), raw, F.lit(""))).drop("_raw", "_name")


def speaker_budget(turns: DataFrame, keys: list[str], least: int, cap: int, start: str = "s_ms", end: str = "e_ms") -> DataFrame:
    """The part of each turn that speaker embeddings may use: speakers with at least ``least``, their first ``cap`` only."""
    line = Window.partitionBy(*keys, "speaker").orderBy(start, end, "turn_ord").rowsBetween(Window.unboundedPreceding, -1)
    length = F.greatest(F.lit(0).cast("long"), F.col(end) - F.col(start))
    rows = turns.withColumn("_len", length).withColumn("_used", F.coalesce(F.sum("_len").over(line), F.lit(0)))
    rows = rows.withColumn("_total", F.sum("_len").over(Window.partitionBy(*keys, "speaker")))
    rows = rows.withColumn("take", F.greatest(F.lit(0).cast("long"), F.least(F.col("_len"), F.lit(cap) - F.col("_used"))))
    return rows.where((F.col("_total") >= least) & (F.col("take") > 0)).drop("_len", "_used", "_total")
