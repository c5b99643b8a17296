"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

The words of each source stand in a seeded order of its documents (hash of seed,
id and text) and are cut into blocks of B words; the last one may be shorter.
B is the size of the mix over ``blocks``, at least 1: a mix has about ``blocks``
blocks at any size, so quotas are precise to a part of it and tables of blocks
are bounded by ``blocks`` and the number of sources.

Targets: sources in code point order, null last, share the mix by their weights;
a target stops at ``most`` times its source and the excess is shared again by
weight until none is above. Sources at that limit give every block ``most``
times. The seats that are left go to the others by highest quotients weight /
(2 j + 1), ties to the earlier source. All picks in the order of their quotients
are cut into shards of equal numbers of blocks, which gives each shard integer
quotas. A source's picks are whole passes over its blocks, and for the last,
partial pass the first ones in a seeded order of blocks; so no word is taken more
than ``most`` times, and none twice before all others once.

Documents meet blocks without being cut: the words that the mix takes from the
first x words of a source are a running sum over its blocks, so a document's are
the difference at its two ends. Ranges of documents, not sources, are what tasks
get; equal rows have a number, so that any group of them can be parted.

Defined cases: a null text has no words; a null source is a source of its own,
the empty one too; null ids are allowed; repeated rows each count (their
``taken`` may differ, which of them has which is not defined); a source without
words has target 0; an empty table gives an empty result; further columns are
ignored by ``mix`` and kept by ``mixed_texts``, which replaces columns named like
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechframes.llm.common import table, utf8, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds nth, weight, mix (words of all), full (whether at its limit) and target to (source, words).

    One task sees all sources, a few numbers each.
    """
    everywhere = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(everywhere.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), (nth % len(weights)).cast("int")).cast("long")
    held = sources.select("source", "words", nth.alias("nth"), weight.alias("weight"), F.sum("words").over(everywhere).alias("mix"))
    # sources that reach their limit first come first; what is left for one and those after it, by weight
    ordered = everywhere.orderBy(F.col("words") / F.col("weight"), "nth")
    earlier, on = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("mix") - most * F.coalesce(F.sum("words").over(earlier), F.lit(0))
    per_weight = left / F.sum("weight").over(on)
    rated = held.withColumn("rate", per_weight).withColumn("full", most * F.col("words") <= F.col("rate") * F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.struct((-F.col("words") / F.col("weight")).alias("a"), (-F.col("nth")).alias("b"), F.col("rate").alias("rate")))).over(everywhere)["rate"]
    target = F.when(F.col("full"), (most * F.col("words")).cast("double")).otherwise(common * F.col("weight"))
    return rated.select("source", "words", "nth", "weight", "mix", "full", target.alias("target"))


def picks(sources: DataFrame, most: int, shards: int) -> DataFrame:
    """The picked blocks of each source in order: nth, pick (from 0), shard. sources has block (its words)."""
    everywhere = Window.partitionBy(F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("target"))).over(everywhere)
    rated = sources.select(
        "*",
        F.floor(F.coalesce(open_, F.lit(0.0)) / F.col("block") + 0.5).alias("seats"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(everywhere).alias("weights"),
        F.sum(F.when(~F.col("full"), 1)).over(everywhere).alias("others"),
    )
    # a source has no more seats than this: those of a divisor at which all have half a seat too many
    fair = F.floor((F.col("seats") + F.col("others") / 2) * F.col("weight") / F.col("weights") + 0.5) + 1
    slots = most * F.ceil(F.col("words") / F.col("block"))
    count = F.when(F.col("full"), slots).otherwise(F.when(F.col("seats") > 0, F.least(fair, slots)).otherwise(0))
    claims = rated.where(count > 0).select("nth", "full", "seats", "target", "block", "weight", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("pick"))
    odd = 2 * F.col("pick") + 1
    rank = F.row_number().over(Window.partitionBy("full").orderBy(F.desc(F.col("weight") / odd), "nth"))
    given = claims.withColumn("rank", rank).where("full OR rank <= seats")
    quotient = F.col("target") / F.col("block") / odd
    return given.select("nth", "pick", (F.row_number().over(everywhere.orderBy(F.desc(quotient), "nth")) - 1).alias("at"), F.count("*").over(everywhere).alias("n")).select(
        "nth", "pick", F.expr(f"CAST(at * {int(shards)} div n AS INT)").alias("shard")
    )


def chosen_blocks(sources: DataFrame, most: int, shards: int, seed: int) -> DataFrame:
    """nth, block_no, from_word, to_word and the picks (pass, shard) of each block of each source."""
    cut = F.ceil(F.col("words") / F.col("block"))
    blocks = sources.where("words > 0").select("nth", "words", "block", F.explode(F.sequence(F.lit(0).cast("long"), cut.cast("long") - 1)).alias("block_no"), cut.cast("long").alias("n_blocks"))
    taken = picks(sources, most, shards).join(sources.select("nth", cut.cast("long").alias("n_blocks")), "nth")
    taken = taken.select("nth", F.expr("pick div n_blocks").alias("pass"), (F.col("pick") % F.col("n_blocks")).alias("turn"), "shard")
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "nth", "pass", "block_no"))
    passes = passes.withColumn("turn", F.row_number().over(Window.partitionBy("nth", "pass").orderBy(order, "block_no")) - 1)
    met = passes.join(taken, ["nth", "pass", "turn"], "left")
    return met.groupBy("nth", "block_no").agg(
        F.first(F.col("block_no") * F.col("block")).alias("from_word"),
        F.first(F.least((F.col("block_no") + 1) * F.col("block"), F.col("words"))).alias("to_word"),
        F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("pass", "shard")))).alias("picks"),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _planned(docs: DataFrame, carried: list[Column], id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, blocks: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with the words of their source before them, blocks with their picks)."""
    if most < 1 or blocks < 1 or shards < 1 or not weights or min(weights) <= 0:
        raise ValueError("most, blocks, shards and all weights must be positive")
    spark = docs.sparkSession
    text_hash = F.md5(utf8(F.col(text_col)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_hash))
    keyed = docs.select(*carried, F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), order.alias("_order"), F.monotonically_increasing_id().alias("_tie"))
    keyed = written(keyed, "mix-keys")
    sources = targets(keyed.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("words")), weights, most)
    sources = written(sources.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("mix") / blocks)).cast("long")), "mix-sources")
    chosen = written(chosen_blocks(sources, most, shards, seed), "mix-blocks")
    known = keyed.join(sources.drop("mix", "full", "weight"), F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(known.repartitionByRange(parts, "nth", "_order", "_tie").withColumn("_part", F.spark_partition_id()), "mix-order")
    inside = Window.partitionBy("_part", "nth").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each source in each part
    runs = ranged.groupBy("_part", "nth").agg(F.sum("_size").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy("nth").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = written(runs.select("_part", "nth", F.coalesce(before, F.lit(0)).alias("_before")), "mix-parts")
    placed = ranged.withColumn("_to", F.sum("_size").over(inside)).join(runs, ["_part", "nth"]).withColumn("_to", F.col("_to") + F.col("_before"))
    return placed.withColumn("_from", F.col("_to") - F.col("_size")).drop("_before", "_part", "_order", "_tie"), chosen


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, blocks: int = 1 << 18, shards: int = 8, seed: int = 0) -> DataFrame:
    """One row per input row: id, size, source_size, target (its source's) and taken (words that the mix takes of it)."""
    placed, chosen = _planned(docs, [F.col(id_col).alias("_id")], id_col, text_col, source_col, weights, most, blocks, shards, seed)
    times = F.size("picks").cast("long")
    before = F.sum(times * (F.col("to_word") - F.col("from_word"))).over(Window.partitionBy("nth").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(chosen.select("nth", "block_no", (F.coalesce(before, F.lit(0)) - times * F.col("from_word")).alias("base"), times.alias("times")), "mix-sums")
    first, last = (sums.select("nth", F.col("block_no").alias(n), F.col("base").alias(n + "_base"), F.col("times").alias(n + "_times")) for n in ("_first", "_last"))
    ends = placed.withColumn("_first", F.expr("_from div block")).withColumn("_last", F.expr("(_to - 1) div block"))
    ends = ends.join(first, ["nth", "_first"], "left").join(last, ["nth", "_last"], "left")
    taken = F.col("_last_base") + F.col("_last_times") * F.col("_to") - F.col("_first_base") - F.col("_first_times") * F.col("_from")
    return ends.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("words").alias("source_size"),
        "target",
        F.when(F.col("_size") > 0, taken).otherwise(0).cast("long").alias("taken"),
    )


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, blocks: int = 1 << 18, shards: int = 8, seed: int = 0) -> DataFrame:
    """The mix itself: for each document, block and pass the words that it gives, joined by one blank.

    Columns of docs, with the text replaced by the piece, and shard, pass,
    block_no, from_word (in the document). Here the texts themselves move.
    """
    own = ("shard", "pass", "block_no", "from_word")
    kept = [c for c in docs.columns if c not in own]
    placed, chosen = _planned(docs, [F.struct(*kept).alias("_row")], id_col, text_col, source_col, weights, most, blocks, shards, seed)
    words = F.filter(F.split(F.col("_row")[text_col], r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def cut(bound: Column) -> Column:  # the words, bound once for each document
        def piece(block_no: Column) -> Column:
            start = F.greatest(block_no * F.col("block"), F.col("_from")) - F.col("_from")
            stop = F.least((block_no + 1) * F.col("block"), F.col("_to")) - F.col("_from")
            return F.struct(block_no.alias("block_no"), start.alias("from_word"), F.array_join(F.slice(bound, (start + 1).cast("int"), (stop - start).cast("int")), " ").alias("piece"))

        return F.transform(F.sequence(F.expr("_from div block"), F.expr("(_to - 1) div block")), piece)

    pieces = placed.where("_size > 0").select("nth", F.col("_row").dropFields(text_col).alias("_row") if len(kept) > 1 else F.lit(None).alias("_row"), F.explode(F.flatten(F.transform(F.array(words), cut))).alias("_piece"))
    pieces = pieces.select("nth", "_row", "_piece.*")
    met = pieces.join(chosen.select("nth", "block_no", F.explode("picks").alias("_pick")), ["nth", "block_no"])
    return met.select(*[F.col("piece").alias(text_col) if c == text_col else F.col("_row")[c].alias(c) for c in kept], "_pick.shard", "_pick.pass", "block_no", "from_word")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
