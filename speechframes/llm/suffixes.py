"""Suffix-array dedup: remove bytes of long passages that also start earlier.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier:
in a document of smaller id, or earlier in the same document. Strings are judged
on the input.

Comparing all suffixes of a large corpus would move every text many times. The
job moves little instead, in these steps:

1. Anchors. In every document the ``GRAM``-byte strings of least hash in any
   window of ``LENGTH`` bytes are its anchors. Equal windows have the same
   anchors at the same places, so every match holds an anchor pair. An anchor's
   context is all that a window around it can reach.
2. Equal contexts. Anchors are sorted by (anchor hash, context hash) over all
   documents. Of anchors with equal contexts the first keeps its bytes, all
   windows around the others start earlier too. Tasks first do this for
   the rows of their own batches, so large groups of copies shrink before
   the shuffle; the range exchange splits what one anchor has left.
3. Longest previous factors. Anchors that occur in differing contexts, the
   edges of matches, bring their contexts' bytes together by anchor. On them a
   suffix order is built by rank doubling, the previous and next smaller
   positions in that order give each suffix its longest earlier match (up to
   ``LENGTH``), and a full match marks the window as a later copy.
4. An anchor with more than ``MOST`` differing contexts would be a large group.
   Its contexts are compared by blocks of which every window holds one, and what
   shares a block by the windows themselves, both as grouped minima that
   combine inside tasks. Nothing is dropped.

Hashes are of 64 bits in each of two independent columns (steps 1, 2 and 4).

Defined cases: null and empty texts and texts under ``LENGTH`` bytes lose
nothing; of equal ids the one with the smaller text hash is earlier; rows that
repeat id and text are one document and each gets its result; null ids come
first; an empty table gives an empty result; other columns are kept by
``deduplicate``, columns named like its results are replaced. A task holds one
document, or a chunk of small ones, and some sixty bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import LOWEST, ordered_keys, pieces, table, utf8, written

LENGTH = 100
GRAM = 24
MOST = 1_000
CHUNK = 1 << 19
BLOCK_STEP = 8
LPF_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

_U = np.uint64
_RANDOM = np.random.default_rng(104_729)
_BYTES = [_RANDOM.integers(1, 1 << 63, 256, np.int64).astype(_U) * _U(2) + _U(1) for _ in range(2)]
_RATIO = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(ratio: np.uint64, n: int) -> np.ndarray:
    """ratio**0 .. ratio**n modulo 2**64."""
    have = _powers.get(int(ratio))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, CHUNK + 1), ratio, _U)
        have[0] = 1
        _powers[int(ratio)] = have = np.multiply.accumulate(have)
    return have[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed values: the constants of the public-domain SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any slices of a byte array, in constant time each."""

    def __init__(self, data: np.ndarray, column: int = 0):
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[column][data] * _power(_RATIO, len(data))[: len(data)], dtype=_U)])
        self.back = _power(_BACK, len(data))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(_U))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for each i up to len(x) - width."""
    have, step = x, 1
    while step * 2 <= width:
        have = pick(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor the text's number, the place in it, and the hashes of gram and context."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    if len(data) < LENGTH or sizes.max() < LENGTH:
        return none
    begins = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = (hashes.sums[GRAM:] - hashes.sums[: len(at)]) * hashes.back[: len(at)]
    gram = mixed(gram)
    width = LENGTH - GRAM + 1
    least = sliding(gram, width, np.minimum)  # of the window that starts here
    allowed = np.zeros(len(least), bool)
    for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        if n >= LENGTH:
            allowed[b : b + n - LENGTH + 1] = True
    least = np.where(allowed, least, _U(0))
    padded = np.concatenate([np.zeros(width - 1, _U), least, np.zeros(len(gram) - len(least), _U)])
    chosen = np.flatnonzero((sliding(padded, width, np.maximum)[: len(gram)] == gram) & (gram > 0))
    doc = np.searchsorted(begins + sizes, chosen, side="right")
    place = chosen - begins[doc]
    start = np.maximum(begins[doc], chosen - (width - 1))
    stop = np.minimum(begins[doc] + sizes[doc], chosen + LENGTH)
    context = hashes.of(start, stop) ^ (chosen - start).astype(_U)
    return doc, place, gram[chosen], mixed(context)


def context_of(place: int, size: int) -> tuple[int, int]:
    return max(0, place - (LENGTH - GRAM)), min(size, place + LENGTH)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    keys, texts, total = [], [], 0
    for key, text in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
        if len(text) >= LENGTH:
            keys.append(key)
            texts.append(text)
            total += len(text)
        if total >= CHUNK:
            yield keys, texts
            keys, texts, total = [], [], 0
    if keys:
        yield keys, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(_U).view(np.int64))


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, context, key, place, later); later: a row of this batch with equal context is earlier."""
    for batch in _bounded(batches):
        parts = []
        for keys, texts in _chunks(batch):
            doc, place, gram, context = anchors(texts)
            parts.append((np.array(keys, np.int64)[doc], place, gram, context))
        if not parts:
            continue
        key, place, gram, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, key))
        both = mixed(gram ^ mixed(context))[order]
        order = order[np.argsort(both, kind="stable")]
        key, place, gram, context = key[order], place[order], gram[order], context[order]
        later = np.zeros(len(key), bool)
        later[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1])
        # these need no partner any more: spread them evenly
        gram = np.where(later, mixed(key.astype(_U) * _RATIO + place.astype(_U)), gram)
        yield pa.RecordBatch.from_arrays([_signed(gram), _signed(context), pa.array(key), pa.array(place.astype(np.int32)), pa.array(later)], ["gram", "context", "key", "place", "later"])


def judge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted anchors to rows (gram, key, place, copy): later copies of a context, and edges."""
    last = None
    for batch in batches:
        gram, context, key = (batch.column(c).to_numpy() for c in ("gram", "context", "key"))
        place, later = batch.column("place").to_numpy(), batch.column("later").to_numpy(zero_copy_only=False)
        if not len(gram):
            continue
        new_gram = np.concatenate([[last is None or last[0] != gram[0]], gram[1:] != gram[:-1]])
        new_context = new_gram | np.concatenate([[last is None or last[1] != context[0]], context[1:] != context[:-1]])
        last = gram[-1], context[-1]
        run = np.cumsum(new_gram) - (1 if new_gram[0] else 0)
        contexts = np.bincount(run, weights=new_context & ~later)
        # the first and last run of a batch may go on elsewhere; a later count decides
        edge = new_context & ~later & ((contexts[run] > 1) | (run == run[0]) | (run == run[-1]))
        copy = later | ~new_context
        keep = edge | copy
        yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(key[keep]), pa.array(place[keep]), pa.array(copy[keep])], ["gram", "key", "place", "copy"])


def _bounded(batches: Iterator[pa.RecordBatch], column: str = "data") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, column, BATCH_BYTES)


def _document_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
    yield from zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("spots").to_pylist(), strict=True)


def _in_parts(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]], most: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)], [n for n, _ in types])

    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield flush()
            out.clear()
    if out:
        yield flush()


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with spots (place, gram) to rows (gram, key, start, bytes)."""

    def rows():
        for batch in _bounded(batches):
            for key, data, spots in _document_rows(batch):
                for spot in spots:
                    a, b = context_of(spot["place"], len(data))
                    yield spot["gram"], key, a, data[a:b]

    yield from _in_parts(rows(), [("gram", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())], 5_000)


def _slice_hashes(batch: pa.RecordBatch, slices) -> tuple[np.ndarray, ...] | None:
    """(key, place, one, two, first) of the slices of a batch by key and place; first: the index of the first equal slice here."""
    parts = []
    for key, data, spots in _document_rows(batch):
        array = np.frombuffer(data, np.uint8)
        place, start, stop = slices(np.array(sorted({s["place"] for s in spots}), np.int64), len(array))
        if len(start):
            parts.append((np.full(len(start), key, np.int64), place, Hashes(array).of(start, stop), Hashes(array, 1).of(start, stop)))
    if not parts:
        return None
    key, place, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, key))
    key, place, one, two = key[order], place[order], one[order], two[order]
    order = np.lexsort((two, one))  # stable: equal slices stay in order
    begins = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
    first = np.empty(len(key), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    return key, place, one, two, first


HASHED = "key long, place int, one long, two long, stop int"


def _hashed(key, place, one, two, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(place.astype(np.int32)), _signed(one), _signed(two), pa.array(stop.astype(np.int32), mask=stop < 0)], ["key", "place", "one", "two", "stop"])


def block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each spot the hashes of blocks such that every window around it holds one of them.

    Spots with a block that repeats in the batch come out as such (stop is 0);
    of equal blocks the first stands for all of the batch (stop is null).
    """

    def slices(places, size):
        steps = np.arange(0, LENGTH - GRAM + 1, BLOCK_STEP)
        start = (places[:, None] - steps[None, :]).ravel()
        place = np.repeat(places, len(steps))
        stop = start + LENGTH - BLOCK_STEP + 1
        fits = (start >= 0) & (stop <= size)
        return place[fits], start[fits], stop[fits]

    for batch in _bounded(batches):
        if (made := _slice_hashes(batch, slices)) is None:
            continue
        key, place, one, two, first = made
        own = first == np.arange(len(first))
        repeats = np.bincount(first, minlength=len(first))[first] > 1
        sure = np.flatnonzero(repeats)
        sure = sure[np.concatenate([[True], (np.diff(key[sure]) != 0) | (np.diff(place[sure]) != 0)])] if len(sure) else sure
        yield _hashed(key[own], place[own], one[own], two[own], np.full(own.sum(), -1))
        yield _hashed(key[sure], place[sure], one[sure], two[sure], np.zeros(len(sure), np.int64))


def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all windows around the spots; place is the window's start.

    Windows that repeat in the batch come out as runs (place, stop) of later
    copies; of equal windows the first stands for all of the batch (stop is null).
    """

    def slices(places, size):
        start = np.unique(places[:, None] - np.arange(LENGTH - GRAM + 1)[None, :])
        start = start[(start >= 0) & (start + LENGTH <= size)]
        return start, start, start + LENGTH

    for batch in _bounded(batches):
        if (made := _slice_hashes(batch, slices)) is None:
            continue
        key, place, one, two, first = made
        own = first == np.arange(len(first))
        yield _hashed(key[own], place[own], one[own], two[own], np.full(own.sum(), -1))
        again = np.flatnonzero(~own)
        if len(again):
            begins = np.concatenate([[True], (np.diff(key[again]) != 0) | (np.diff(place[again]) > 1)])
            ends = np.append(begins[1:], True)
            head, tail = again[begins], again[ends]
            yield _hashed(key[head], place[head], one[head], two[head], place[tail] + LENGTH)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, -1 for none.

    Everything between i and its candidate is no smaller than values[i]; a
    candidate that is no smaller either hands over its own candidate.
    """
    at = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[at[open_] >= 0]
        open_ = open_[values[at[open_]] >= values[open_]]
        at[open_] = at[at[open_]]
    return at


def later_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the given window starts those whose window also starts earlier in text.

    Ranks of 8, 16, 32, 64 and LENGTH bytes order the suffixes as far as LENGTH;
    a suffix whose rank is its own cannot match and leaves.
    """
    if len(text) < LENGTH or not len(starts):
        return starts[:0]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    packed = np.zeros(len(text), _U)
    for i in range(8):
        packed = packed << _U(8) | padded[i : i + len(text)]
    _, rank, counts = np.unique(packed, return_inverse=True, return_counts=True)
    lone = counts[rank] < 2
    size = 8
    while size < LENGTH:
        step = min(size, LENGTH - size)
        # places of which this rank is asked for: windows, and what their halves begin with
        wide = size + step
        reach = LENGTH - wide
        asked = np.zeros(len(text), bool)
        if reach:
            mark = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + reach + 1, minlength=len(text) + 1)
            asked = np.cumsum(mark[:-1]) > 0
        else:
            asked[starts] = True
        at = np.flatnonzero(asked)
        at = at[at + step < len(text)]
        at = at[~(lone[at] | lone[at + step])]
        joined = rank[at] * np.int64(len(text) + 1) + rank[at + step]
        _, inverse, counts = np.unique(joined, return_inverse=True, return_counts=True)
        rank = np.zeros(len(text), np.int64)
        rank[at] = inverse
        new_lone = np.ones(len(text), bool)
        new_lone[at] = counts[inverse] < 2
        lone, size = new_lone, wide
        starts = starts[~lone[starts]] if size == LENGTH else starts
    order = starts[np.lexsort((starts, rank[starts]))]  # suffix order, as far as LENGTH
    before = previous_smaller(order)
    after = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    ranks = np.append(rank[order], -1)
    full = ((before >= 0) & (ranks[before] == ranks[:-1])) | ((after < len(order)) & (ranks[np.minimum(after, len(order))] == ranks[:-1]))
    return np.sort(order[full])


def find_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of contexts, equal grams together, to rows (key, start, stop) of later copies."""

    def groups():
        rows, total, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "start", "bytes")), strict=True):
                if total >= LPF_BYTES and row[0] != last:
                    yield rows
                    rows, total = [], 0
                rows.append(row[1:])
                total += len(row[3])
                last = row[0]
        if rows:
            yield rows

    def found():
        for rows in groups():
            rows.sort(key=lambda r: (r[0], r[1]))
            parts: list[tuple[int, int, bytes]] = []  # overlapping contexts of a document become one
            for key, start, data in rows:
                if parts and parts[-1][0] == key and start <= parts[-1][1] + len(parts[-1][2]):
                    had = parts[-1][1] + len(parts[-1][2])
                    if start + len(data) > had:
                        parts[-1] = key, parts[-1][1], parts[-1][2] + data[had - start :]
                else:
                    parts.append((key, start, data))
            sizes = np.array([len(p[2]) for p in parts], np.int64)
            begins = np.cumsum(sizes) - sizes
            windows = np.maximum(sizes - LENGTH + 1, 0)
            ends = np.cumsum(windows)
            starts = np.arange(ends[-1]) + np.repeat(begins - (ends - windows), windows)
            later = later_windows(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), starts)
            if not len(later):
                continue
            part = np.searchsorted(begins, later, side="right") - 1
            first = np.concatenate([[True], (np.diff(later) > 1) | (part[1:] != part[:-1])])
            last = np.append(first[1:], True)
            for a, b, p in zip(later[first].tolist(), later[last].tolist(), part[first].tolist(), strict=True):
                key, start, _ = parts[p]
                yield key, start + a - int(begins[p]), start + b - int(begins[p]) + LENGTH

    yield from _in_parts(found(), [("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())], 20_000)


ANCHORS = "gram long, context long, key long, place int, later boolean"
MARKS = "gram long, key long, place int, copy boolean"


def later_spans(texts: DataFrame) -> DataFrame:
    """texts: key, data. Rows (key, start, stop); their union is what goes."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.mapInArrow(find_anchors, ANCHORS).repartitionByRange(parts, "gram", "context").sortWithinPartitions("gram", "context", "key", "place")
    marks = written(ranged.mapInArrow(judge_contexts, MARKS), "suffix-marks")
    copies = marks.where("copy").select("key", F.greatest(F.lit(0), F.col("place") - (LENGTH - GRAM)).alias("start"), (F.col("place") + LENGTH).alias("stop"))
    edges = marks.where("NOT copy")
    sizes = written(edges.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    edges = edges.join(sizes, "gram")

    def with_spots(spots: DataFrame) -> DataFrame:
        gathered = spots.groupBy("key").agg(F.collect_list(F.struct("place", "gram")).alias("spots"))
        return texts.join(gathered, "key")

    small = with_spots(edges.where(F.col("n") <= MOST).select("key", "place", "gram"))
    contexts = small.mapInArrow(cut_contexts, "gram long, key long, start int, bytes binary").repartition(parts, "gram").sortWithinPartitions("gram")
    found = copies.unionByName(contexts.mapInArrow(find_earlier, "key long, start int, stop int"))
    if not sizes.where(F.col("n") > MOST).limit(1).count():
        return found
    # blocks first, then the windows of what shares a block
    spot = ["key", "place", F.lit(0).cast("long").alias("gram")]
    blocks = written(with_spots(edges.where(F.col("n") > MOST).select(*spot)).mapInArrow(block_hashes, HASHED), "suffix-blocks")
    alone = blocks.where("stop IS NULL")
    shared = alone.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    kept = blocks.where("stop = 0").select(*spot).union(alone.join(shared, ["one", "two"]).select(*spot)).distinct()
    windows = written(with_spots(kept).mapInArrow(window_hashes, HASHED), "suffix-windows")
    alone = windows.where("stop IS NULL")
    firsts = alone.groupBy("one", "two").agg(F.min(F.struct("key", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = alone.join(firsts, ["one", "two"]).where(F.struct("key", "place") > F.col("first"))
    again = again.select("key", F.col("place").alias("start"), (F.col("place") + LENGTH).alias("stop"))
    return found.unionByName(again).unionByName(windows.where("stop IS NOT NULL").select("key", F.col("place").alias("start"), "stop"))


def kept_runs(spans: list[dict] | None, size: int) -> tuple[list[tuple[int, int]], int]:
    """What stays of a text, and the number of maximal runs that go."""
    kept, at, runs = [], 0, 0
    for s in sorted(spans or [], key=lambda s: s["start"]):
        a, b = s["start"], min(s["stop"], size)
        if a > at or (a == 0 and at == 0 and not runs):
            runs += 1
            if a > at:
                kept.append((at, a))
        at = max(at, b)
    if at < size:
        kept.append((at, size))
    return kept, runs


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """docs with __sf_key, the spans that go by key, and whether the key is the id."""
    keyed, plain = ordered_keys(docs, id_col, text_col)
    texts = keyed.select(F.col("__sf_key").alias("key"), utf8(F.col(text_col)).alias("data"))
    spans = later_spans(texts if plain else texts.dropDuplicates(["key"]))
    return keyed, spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), plain


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with text replaced by what stays of it, and n_removed and removed (spans in bytes) added; ``prefix`` goes before both names.

    Characters that a removed run cuts in two go as a whole.
    """
    keyed, spans, _ = _judged(docs, id_col, text_col)
    made_names = [f"{prefix}n_removed", f"{prefix}removed"]
    names = [c for c in docs.columns if c not in made_names]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, text_col):
            texts, removed, gone = [], [], []
            for text, found in zip(batch.column(text_col).to_pylist(), batch.column("__sf_spans").to_pylist(), strict=True):
                data = (text or "").encode()
                kept, _ = kept_runs(found, len(data))
                left = b"".join(data[a:b] for a, b in kept)
                texts.append(text if text is None or len(left) == len(data) else "".join(data[a:b].decode("utf-8", "ignore") for a, b in kept))
                removed.append(len(data) - len(left))
                edges = [0, *[x for k in kept for x in k], len(data)]
                gone.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a])
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(gone, span_type)], [*names, *made_names])

    joined = keyed.select(*names, "__sf_key").join(spans.select(F.col("key").alias("__sf_key"), F.col("spans").alias("__sf_spans")), "__sf_key", "left").select(*names, "__sf_spans")
    schema = docs.select(*names).withColumns(dict(zip(made_names, (F.lit(0).cast("long"), F.lit(None).cast("array<struct<start:bigint,stop:bigint>>")), strict=True))).schema
    return joined.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256)."""
    keyed, spans, plain = _judged(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            out = []
            for data, found in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, runs = kept_runs(found, len(data))
                left = b"".join(data[a:b] for a, b in kept)
                out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest()))
            if out:
                columns = [pa.array(c, pa.int64() if n < 3 else pa.string()) for n, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    texts = keyed.select(F.col("__sf_key").alias("key"), utf8(F.col(text_col)).alias("data"))
    if plain:  # the same columns as in later_spans: Spark then exchanges the texts once
        rows = texts.join(spans, "key", "left")
    else:
        rows = keyed.select(F.col(id_col).cast("long").alias("id"), F.col("__sf_key").alias("key"), utf8(F.col(text_col)).alias("data")).join(spans, "key", "left").drop("key")
    first = rows.columns[0]
    judged = rows.mapInArrow(run, f"{first} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    ids = F.when(F.col("key") != LOWEST, F.col("key")) if plain else F.col("id")
    return judged.select(ids.alias(id_col), *names)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
