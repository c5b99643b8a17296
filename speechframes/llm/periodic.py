"""Runs of words that repeat periodically, solved in tiles of a document.

A run is a maximal stretch of consecutive words with smallest period q whose
length is at least ``max(min_length, 2 * q)``. In other words: a maximal
interval of positions i with word i = word i + q that holds at least
``max(min_length - q, q)`` of them.

Every document is exploded into tiles. Periods are taken by octave (a to
2a - 1); an octave has boundaries every ``step`` words, no more than the shortest
interval that counts, so that an interval that counts meets a boundary. A tile
holds 4,096 words or 16 a, whichever is more, with the words beyond its ends
that its boundaries look at; octaves whose tiles are the same stretch share one
row. Tiles are dealt to tasks on their own, so a long document is worked on by
many. At each boundary Z-functions of the words after it, and of the words
before it read backwards, tell for all periods of the octave how far the
equality reaches to the right and to the left, up to the neighbouring
boundaries. Reaches that touch are joined within the tile; what is left are
interval fragments, shuffled by document and period and stitched where they
touch. A stretch found under several periods keeps the smallest (the others are
its multiples).

Texts under 32 kB are not moved: their tiles are solved and their fragments
stitched by the same functions in the task that reads them. Fragments are keyed by a 128-bit hash of the text, so that copies of a text,
rows without id and rows that share one need no numbering; equal fragments of
copies are combined before the shuffle.

Defined cases: words are maximal stretches without blank, tab, line feed,
vertical tab, form feed and carriage return, compared as they stand; a null
text has no words; no words or no run gives an empty list; repeated rows give
equal results; an empty table gives an empty result; all columns of the input
are kept, those named like the result's (``prefix`` changes its names) replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechframes.llm.common import pieces, table, utf8, written

CORE = 4096  # words of a tile at least
GRAM = 8  # equal words, at most, that a boundary must show before its Z-functions are worked out
CELLS = 1 << 21  # cells of the window matrix worked on at a time
SPREAD_BYTES = 1 << 15  # texts from this size on are spread over tasks
RUN = "array<struct<start:long,length:long,period:long>>"
TILE = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("core_from", pa.int64()), ("core_to", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("width", pa.int8()), ("codes", pa.binary())])
FRAGMENT = pa.schema([("key", pa.binary()), ("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def shortest(periods, min_length: int):
    """Equal pairs at distance q that a run with period q has at least."""
    return np.maximum(min_length - periods, periods)


@functools.cache
def octave(a: int, min_length: int) -> tuple[int, int, int]:
    """(first period, step between boundaries, words of a tile at least)."""
    least = int(shortest(np.arange(a, min(2 * a, max(a, min_length) + 1)), min_length).min())
    step = 1 << (least.bit_length() - 1)
    return a, step, max(CORE, 16 * a, 16 * step)


def octaves(n_words: int, min_length: int) -> list[tuple[int, int, int]]:
    """The octaves with a period of which n_words can hold a run."""
    return [octave(1 << k, min_length) for k in range((n_words // 2).bit_length())]


def word_codes(text: bytes) -> np.ndarray:
    """The words of a text as numbers, in the smallest unsigned type."""
    words = text.split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    kind = np.uint8 if len(number) <= 1 << 8 else np.uint16 if len(number) <= 1 << 16 else np.uint32
    return np.fromiter(map(number.__getitem__, words), kind, len(words))


def tiles_of(codes: np.ndarray, min_length: int) -> Iterator[tuple]:
    """Rows of TILE without the key."""
    n = len(codes)
    if n < min_length:
        return
    shared: dict[int, list[tuple[int, int]]] = {}
    for a, step, core in octaves(n, min_length):
        shared.setdefault(core if core < n else n, []).append((a, step))
    for core, members in shared.items():
        before, after = max(s for _, s in members), max(2 * a - 1 + s for a, s in members)
        for at in range(0, n, core):
            first, end = max(0, at - before), min(n, at + core + after)
            yield first, at, min(n, at + core), members[0][0], members[-1][0], codes.itemsize, codes[first:end].tobytes()


def cut_tiles(min_length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows, held = [], 0
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                    for tile in tiles_of(word_codes(text.as_py()), min_length):
                        rows.append((key, *tile))
                        held += len(tile[-1])
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TILE)], schema=TILE)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TILE)], schema=TILE)

    return cut


def z_functions(strings: np.ndarray, step: int, last: int) -> np.ndarray:
    """Z-functions of all rows at once, up to position ``last``, values up to ``step``.

    The classical algorithm with its box [left, right), each row at its own
    position: rows skip to their next position whose word equals their first
    one (elsewhere the value is 0). Rows whose first word is negative are all 0.
    """
    n_rows, width = strings.shape
    z = np.zeros((n_rows, last + 1), dtype=np.int32)
    equal = strings[:, 1 : last + 1] == strings[:, :1]
    equal[strings[:, 0] < 0] = False
    row, at = np.nonzero(equal)
    del equal
    at = at + 1
    flat = strings.ravel()
    todo = np.searchsorted(row, np.arange(n_rows), side="left")
    end = np.searchsorted(row, np.arange(n_rows), side="right")
    left, right = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    live = np.flatnonzero(todo < end)
    while len(live):
        i = at[todo[live]]
        inside = i < right[live]
        room = right[live] - i
        known = z[live, np.where(inside, i - left[live], 0)]
        value = np.where(inside, np.minimum(room, known), 1).astype(np.int64)
        grow = np.flatnonzero((~inside | (known >= room)) & (value < step))
        chunk = 8
        while len(grow):
            offset = value[grow][:, None] + np.arange(chunk)
            fits = offset < step
            offset = np.minimum(offset, step - 1)
            base = (live[grow] * width)[:, None]
            same = (flat[base + offset] == flat[base + i[grow][:, None] + offset]) & fits
            gained = np.where(same.all(axis=1), chunk, same.argmin(axis=1))
            value[grow] += gained
            grow = grow[(gained == chunk) & (value[grow] < step)]
            chunk = min(2 * chunk, 512)
        z[live, i] = value
        further = i + value > right[live]
        left[live[further]], right[live[further]] = i[further], (i + value)[further]
        todo[live] += 1
        live = live[todo[live] < end[live]]
    return z


def reaches(words: np.ndarray, bounds: np.ndarray, low: np.ndarray, high: np.ndarray, a: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs at distance a to 2a - 1 from each boundary on, to the left and to the right, up to step.

    ``low`` and ``high`` limit the words that belong to a boundary's tile.
    """
    near, far = np.arange(step), np.arange(a + step - 1)
    offsets = {"right": (near, a + far), "left": (-1 - near, 2 * a - 2 - far)}
    found = {}
    for side, (x, y) in offsets.items():
        strings = np.full((len(bounds), 2 * step + a), -3, dtype=np.int32)
        for columns, moved, outside in ((slice(0, step), x, -1), (slice(step + 1, None), y, -2)):
            place = bounds[:, None] + moved
            beyond = (place < low[:, None]) | (place >= high[:, None])
            np.clip(place, 0, len(words) - 1, out=place)
            part = words[place]
            part[beyond] = outside
            strings[:, columns] = part
        z = z_functions(strings, step, step + a)[:, step + 1 :]
        found[side] = z if side == "right" else z[:, ::-1]
    return found["left"], found["right"]


def gram_hashes(words: np.ndarray, size: int, beyond: int) -> np.ndarray:
    """A hash of the ``size`` words from each position on; ``beyond`` more entries that equal nothing."""
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    found = np.zeros(len(words) + beyond, dtype=np.uint64)
    for k in range(size):
        found *= np.uint64(0xD6E8FEB86659FD93)
        found[: len(words) - k] += mixed[k:]
    found[max(0, len(words) - size + 1) :] = np.arange(len(found) - max(0, len(words) - size + 1), dtype=np.uint64)
    return found


def promising(hashes: np.ndarray, bounds: np.ndarray, size: int, a: int) -> np.ndarray:
    """Boundaries next to which ``size`` equal pairs at some distance from a to 2a - 1 may lie on one side."""
    ahead = np.lib.stride_tricks.sliding_window_view(hashes, a)
    found = np.zeros(len(bounds), dtype=bool)
    rows = max(1, CELLS // a)
    for k in range(0, len(bounds), rows):
        for at in (bounds[k : k + rows], np.maximum(bounds[k : k + rows] - size, 0)):
            found[k : k + rows] |= (ahead[at + a] == hashes[at][:, None]).any(axis=1)
    return found


def joined(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the same group that overlap or touch, joined."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    rank = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    lift = rank * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + lift)
    opens = np.flatnonzero(np.r_[True, start[1:] + lift[1:] > reach[:-1]])
    closes = np.r_[opens[1:], len(start)] - 1
    return group[opens], start[opens], (reach - lift)[closes]


def solve(tiles: pa.RecordBatch, min_length: int, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The fragments of all tiles of a batch, octave by octave: owner, period, start, stop.

    ``owner`` numbers the document of each tile; reaches of one document are joined.
    """
    column = {name: tiles.column(name).to_numpy(zero_copy_only=False) for name in ("first", "core_from", "core_to", "low", "high", "width")}
    parts = [np.frombuffer(c, dtype=f"u{w}").astype(np.int32) for c, w in zip(tiles.column("codes").to_pylist(), column["width"])]
    words = np.concatenate(parts)
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    del parts
    a = int(column["low"].min())
    while a <= column["high"].max():
        _, step, _ = octave(a, min_length)
        mine = np.flatnonzero((column["low"] <= a) & (a <= column["high"]))
        count = -(-(column["core_to"][mine] - column["core_from"][mine]) // step)
        tile = np.repeat(mine, count)
        nth = np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count)
        place = column["core_from"][tile] + nth * step
        shift = at[tile] - column["first"][tile]  # from positions of the document to positions in words
        periods = np.arange(a, 2 * a)
        need = shortest(periods, min_length)
        # an interval that counts has half its pairs on one side of a boundary, or passes the next one there
        size = min(GRAM, -(-int(need.min()) // 2), step)
        likely = promising(gram_hashes(words, size, 2 * a), place + shift, size, a)
        tile, place, shift = tile[likely], place[likely], shift[likely]
        rows = max(1, CELLS // (2 * step + a))
        kept = []
        for k in range(0, len(tile), rows):
            t, m, s = tile[k : k + rows], place[k : k + rows], shift[k : k + rows]
            left, right = reaches(words, m + s, at[t], at[t + 1], a, step)
            b, p = np.nonzero((left == step) | (right == step) | (left + right >= need))
            kept.append((owner[t[b]] * a + p, m[b] - left[b, p], m[b] + right[b, p]))
        group, start, stop = (np.concatenate(c) for c in zip(*kept)) if kept else ([], [], [])
        if len(group):
            group, start, stop = joined(group, start, stop)
            yield group // a, group % a + a, start, stop
        a *= 2


def solve_tiles(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "codes", 1 << 20):
                if batch.num_rows:
                    keys = batch.column("key").dictionary_encode()
                    for owner, *fragment in solve(batch, min_length, keys.indices.to_numpy().astype(np.int64)):
                        for k in range(0, len(owner), 1 << 18):
                            cut = slice(k, k + (1 << 18))
                            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(owner[cut])), *(pa.array(c[cut]) for c in fragment)], schema=FRAGMENT)

    return run


def runs_of_batch(coded: list[np.ndarray], min_length: int) -> pa.ListArray:
    """The runs of some documents that lie in one task."""
    rows = [(d, t) for d, codes in enumerate(coded) for t in tiles_of(codes, min_length)]
    found = []
    at = 0
    while at < len(rows):  # tiles of about a megabyte at a time, whole documents
        end, held = at, 0
        while end < len(rows) and (held < 1 << 20 or rows[end][0] == rows[end - 1][0]):
            held += len(rows[end][1][-1])
            end += 1
        owner = np.array([d for d, _ in rows[at:end]])
        columns = zip(zip(*((b"", *t) for _, t in rows[at:end])), TILE)
        found += list(solve(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=TILE), min_length, owner))
        at = end
    owner, period, start, stop = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    length = stop - start + period
    long = length >= np.maximum(min_length, 2 * period)
    owner, start, length, period = (c[long] for c in (owner, start, length, period))
    order = np.lexsort((period, length, start, owner))  # of the periods of a stretch the smallest
    owner, start, length, period = (c[order] for c in (owner, start, length, period))
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = (c[new] for c in (owner, start, length, period))
    order = np.lexsort((period, start, owner))
    offsets = np.searchsorted(owner[order], np.arange(len(coded) + 1))
    values = pa.StructArray.from_arrays([pa.array(c[order]) for c in (start, length, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(utf8(text)))


def runs_of_texts(docs: DataFrame, text_col: str = "text", min_length: int = 12) -> DataFrame:
    """One row for each text with a run: key (``text_key``) and runs, by start and period."""
    if min_length < 2:
        raise ValueError("min_length must be 2 or more")
    tiles = docs.select(text_key(F.col(text_col)).alias("key"), utf8(F.col(text_col)).alias("text")).mapInArrow(
        cut_tiles(min_length), "key binary, first long, core_from long, core_to long, low long, high long, width byte, codes binary"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fragments = tiles.repartition(parts).mapInArrow(solve_tiles(min_length), "key binary, period long, start long, stop long").distinct()
    ordered = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    stitched = (
        fragments.withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "period", "island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select("key", "period", "start", (F.col("stop") - F.col("start") + F.col("period")).alias("length"))
        .where(F.col("length") >= F.greatest(F.lit(min_length), 2 * F.col("period")))
    )
    runs = stitched.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).cast(RUN).alias("runs"))


def collapsed(words: list[bytes], runs: pa.Scalar) -> bytes:
    """The words, joined, that no run repeats."""
    if runs.is_valid and len(runs):
        start, length, period = (runs.values.field(f).to_numpy() for f in ("start", "length", "period"))
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def finish(min_length: int | None):
    """Replace __sf_text by the number of words, the runs (found here, or given as __sf_runs) and the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__sf_text"):
                texts = batch.column("__sf_text").to_pylist()
                runs = batch.column("__sf_runs") if min_length is None else runs_of_batch([word_codes(t) for t in texts], min_length)
                counts, made = [], []
                for text, found in zip(texts, runs):
                    words = text.split()
                    counts.append(len(words))
                    made.append(collapsed(words, found))
                kept = [n for n in batch.schema.names if n not in ("__sf_text", "__sf_runs")]
                added = [pa.array(counts, pa.int64()), runs, pa.array(made, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + added, names=[*kept, "__sf_n", "__sf_runs", "__sf_collapsed"])

    return run


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12, prefix: str = "", spread_bytes: int = SPREAD_BYTES) -> DataFrame:
    """docs with n_words, runs (start, length, period; words numbered from 0) and collapsed.

    ``collapsed`` has the words, joined by one blank, that stand in no run, or
    in the first period of all runs they stand in.

    Texts below ``spread_bytes`` have their tiles solved and stitched in the task
    that reads them, with the same functions; longer ones are spread over tasks.
    Their runs are written and met again by the hash of the text: Spark
    broadcasts them where their files are small enough for it, or else moves
    these long texts once. The result does not depend on the bound.
    """
    names = [prefix + n for n in ("n_words", "runs", "collapsed")]
    kept = [c for c in docs.columns if c not in names]
    long = F.octet_length(utf8(F.col(text_col))) >= spread_bytes
    spread = docs.where(long)
    runs = written(runs_of_texts(spread, text_col, min_length), "periodic-runs").withColumnRenamed("key", "__sf_key").withColumnRenamed("runs", "__sf_runs")
    met = spread.select(*kept, text_key(F.col(text_col)).alias("__sf_key"), utf8(F.col(text_col)).alias("__sf_text")).join(runs, "__sf_key", "left").drop("__sf_key")
    met = met.withColumn("__sf_runs", F.coalesce("__sf_runs", F.array().cast(RUN)))
    kind = T.StructType([*docs.select(*kept).schema.fields, T.StructField("__sf_n", T.LongType()), met.schema["__sf_runs"], T.StructField("__sf_collapsed", T.StringType())])
    done = docs.where(~long).select(*kept, utf8(F.col(text_col)).alias("__sf_text")).mapInArrow(finish(min_length), kind).unionAll(met.mapInArrow(finish(None), kind))
    return done.select(*kept, F.col("__sf_n").alias(names[0]), F.col("__sf_runs").alias(names[1]), F.col("__sf_collapsed").alias(names[2]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's texts: where crc32(doc_id) divides by ten, the words from a on repeat the first p of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(row: F.Column) -> F.Column:  # bound once for each document: words, a and p
        source = lambda i: F.when(i < row["a"], i).otherwise(row["a"] + (i - row["a"]) % row["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(row["words"]) - F.lit(1).cast("long")), lambda i: F.get(row["words"], source(i).cast("int"))), " ")

    def start(row: F.Column) -> F.Column:
        a = F.floor(h / 10) % F.size(row["words"])
        return F.struct(row["words"].alias("words"), a.alias("a"), (1 + F.floor((F.size(row["words"]) - a) / (3 + F.floor(h / 10) % 8))).alias("p"))

    bound = F.transform(F.transform(F.filter(F.array(F.struct(words.alias("words"))), lambda r: F.size(r["words"]) > 0), start), repeated)
    return docs.select("doc_id", F.when(chosen, F.array_join(bound, "")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), lines.alias("_lines"), "collapsed")
    length, period = F.col("_best")["length"], -F.col("_best")["short"]
    return found.select(
        "doc_id",
        "n_runs",
        (-F.col("_best")["early"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * _best.length div -_best.short").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(find_runs(with_planted_runs(docs)))
