"""Join of documents with similar word n-grams: MinHash LSH forest, exact verification.

A document is its set of shingles (``WORDS`` consecutive words, lower case, any
white space between). Documents with equal sets form one text class; its
smallest id stands for it from then on.

Forest. Each of ``TREES`` trees holds every set under a path of ``DEPTH`` MinHash
values. The paths are written sorted, tree by tree, so that the sets below one
trie node lie together; a shorter prefix is a node further up. Prefixes are
shortened from ``DEPTH`` on. How far is measured: up to ``PROBES`` texts are
compared exactly with all documents in the pass that makes the signatures, and
for each link the longest prefix that both share in some tree is counted. The
prefix is shortened until the mean recall of the probes reaches ``RECALL`` (with
fewer than ``LEAST_PROBES`` probes that have links, this says too little), or
until even two sets of just the threshold's similarity share it in some tree
with that probability, 1 - (1 - t^d)^trees.

Verification. At each prefix length a set is tied to one set of another class
below the same node, and the ties are checked exactly; what links joins classes.
So a node whose sets have become one class needs nothing more, and near copies
are checked once and not in every tree. At the last length the nodes that still
hold sets of several classes are checked in full, each pair of different classes
there. Only links join classes: nodes of unlike sets never grow into a group.
Last, links are counted inside each class, by shared shingles as a matrix
product, which needs every pair of the class; a class or node of more than
``BLOCK`` sets (or ``BLOCK_SHINGLES`` shingles) is dealt into blocks and each pair of
blocks is a task of its own. Links come out as numbers, never as all pairs.

Keys that very many rows share (a node, a hub) are salted in joins.

Result: one row for each document with its class (the smallest id of all
documents that links connect it with), its text class, and the number of its
links to different sets.

Defined cases: ids are whole numbers; texts without words are alike to nothing,
each its own class; a text of fewer than ``WORDS`` words has them as its one
shingle; repeated rows are in one class; ids that repeat with different texts are
told apart by the text's hash, null ids come first; for thresholds so low that
even one value misses the recall, the prefix has one value and the recall is
missed; an empty table gives an empty result; other columns are ignored by
``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import LOWEST, discard, ordered_keys, pieces, table, written

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9995
PROBES = 256
PROBE_CHARS = 20_000
LEAST_PROBES = 50
SALTS = 256
HUB = 10_000
BLOCK = 1_024
BLOCK_SHINGLES = 2_000_000
COLUMNS = 2_048

_U = np.uint64
_RANDOM = np.random.default_rng(15_485_863)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.int64).astype(_U) * _U(2) + _U(1)
_RATIO = 0xD1342543DE82EF95  # odd
_TIMES = _RANDOM.integers(0, 1 << 31, TREES * DEPTH, np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FLIPS = _RANDOM.integers(0, 1 << 32, TREES * DEPTH, np.int64).astype(np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed values: the constants of the public-domain SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the ratio and its inverse modulo 2**64, as many as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n).bit_length())
            made = []
            for ratio in (_RATIO, pow(_RATIO, -1, 1 << 64)):
                x = np.full(size, _U(ratio), _U)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's different shingles."""
    data = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, _U)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[data] * up[:-1], dtype=_U)])
    blanks = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.append(blanks, len(data))
    width = min(WORDS, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    return np.unique(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U)))


def depth_for(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall at the threshold itself."""
    for depth in range(DEPTH, 1, -1):
        if 1 - (1 - threshold**depth) ** TREES >= recall:
            return depth
    return 1


def paths(found: np.ndarray) -> np.ndarray:
    """Of each tree the 16-bit MinHash values of a set, TREES x DEPTH."""
    short = (found >> _U(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), COLUMNS):
        part = short[start : start + COLUMNS]
        np.minimum(least, ((part[None, :] ^ _FLIPS[:, None]) * _TIMES[:, None]).min(1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16).reshape(TREES, DEPTH)


def packed(path: np.ndarray) -> np.ndarray:
    """Paths as two 64-bit numbers for each tree, the first values in the highest bits."""
    return path.astype(">u2").reshape(-1, DEPTH // 2).view(">u8").astype(_U).ravel()


def prefix(depth: int) -> F.Column:
    """The trie node at this depth that a row (tree, high, low) lies below."""
    half = DEPTH // 2
    mask = lambda n: F.lit(-1 << 64 - 16 * n if n else 0)
    return F.xxhash64("tree", F.col("high").bitwiseAND(mask(min(depth, half))), F.col("low").bitwiseAND(mask(max(depth - half, 0))))


class Probes:
    """A few texts that every document is compared with."""

    def __init__(self, texts: list[str]):
        sets = [shingles(t) for t in texts]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        every = np.concatenate([*sets, np.zeros(0, _U)])
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.paths = np.array([paths(x) for x in sets], np.uint16).reshape(-1, TREES, DEPTH)

    def links(self, found: np.ndarray, path: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(probe, longest prefix shared in some tree) of every probe that this different set is linked with."""
        first, after = (np.searchsorted(self.shingles, found, side) for side in ("left", "right"))
        counts = after - first
        hit = counts > 0
        if not hit.any():
            return []
        first, counts = first[hit], counts[hit]
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        union = self.sizes + len(found) - shared
        linked = np.flatnonzero((shared / union >= threshold - 1e-12) & (shared < union))
        return [(int(i), int((self.paths[i] == path).cumprod(1).sum(1).max())) for i in linked]


def _prepare(probes, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = probes.value
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            n, one, two, made, links = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                n.append(len(found))
                one.append(int(mixed(found).sum(dtype=_U)))
                two.append(int(mixed(found ^ _U(_RATIO)).sum(dtype=_U)))
                if len(found):
                    path = paths(found)
                    made.append(packed(path))
                    links.append([DEPTH * i + depth - 1 if depth else -1 - i for i, depth in asked.links(found, path, threshold)])
                else:
                    made.append(np.zeros(0, _U))
                    links.append([])
            sizes = np.array([len(m) for m in made])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*made, np.zeros(0, _U)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int32()), *(pa.array(np.array(x, _U).view(np.int64)) for x in (one, two)), lists, pa.array(links, pa.list_(pa.int32()))],
                ["key", "n", "one", "two", "paths", "links"],
            )

    return run


def choose_probes(texts: DataFrame) -> Probes:
    """At most PROBES different texts of at most PROBE_CHARS characters, those of least hash."""
    hashed = texts.where((F.length("text") > 0) & (F.length("text") <= PROBE_CHARS)).groupBy(F.xxhash64("text").alias("h")).agg(F.min("key").alias("key"))
    chosen = [r["key"] for r in hashed.orderBy("h").limit(PROBES).collect()]
    return Probes([r["text"] for r in texts.where(F.col("key").isin(chosen)).dropDuplicates(["key"]).select("text").collect()]) if chosen else Probes([])


def depth_to_use(seen: dict[int, dict[int, int]], threshold: float) -> int:
    """seen: of each probe its links by the longest prefix shared. Shortens from DEPTH on."""
    surest = depth_for(threshold)
    for depth in range(DEPTH, surest, -1):
        recall = [sum(c for d, c in by.items() if d >= depth) / sum(by.values()) for by in seen.values()]
        if len(recall) >= LEAST_PROBES and np.mean(recall) >= RECALL:
            return depth
    return surest


def spread_join(many: DataFrame, few: DataFrame, key: str, count: str, mixing: str, total: int) -> DataFrame:
    """many joined with few on key, where few has one row and its count in many for each key.

    Keys of more than HUB rows and a thousandth of all are salted by ``mixing``;
    there are at most a thousand of them.
    """
    if total <= HUB:  # rows of many; no key can have more
        return many.join(few, key)
    limit = max(HUB, total // 1_000)
    hubs = F.broadcast(few.where(F.col(count) > limit).select(F.col(key).alias("_hub")))
    salted = many.join(hubs, F.col(key) == F.col("_hub"), "left").withColumn("_salt", F.when(F.col("_hub").isNotNull(), F.pmod(F.xxhash64(mixing), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hub")
    copies = few.withColumn("_salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def components(ties: DataFrame, name: str) -> DataFrame:
    """(node, root) for all nodes of the ties (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., Connected
    Components in MapReduce and Beyond). A node's minimum is a grouped minimum,
    and neighbours get it by a salted join. Every round is written, until a round
    changes nothing.
    """
    edges = written(ties.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}-ties")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least, "u", "n", "v", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, "u", "n", "v", state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u > v").distinct()
        edges = written(small, f"{name}-round")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right, i != j) of similarity threshold or more; left and right number the sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, counts = np.unique(every, return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    number, owner = number[shared], owner[shared]
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    at = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + COLUMNS, COLUMNS))
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if a < b:
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[a:b], number[a:b] - i * COLUMNS] = 1
            total += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - total
    hit = (total / union >= threshold - 1e-12) & (left[:, None] != right[None, :])
    return np.nonzero(hit)


def _check_ties(threshold: float):
    """Rows (b, salt, member, a, text), of each group the text of b first, to the ties (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            out = []
            for b, member, a, text in zip(*(batch.column(c).to_pylist() for c in ("b", "member", "a", "text")), strict=True):
                found = shingles(text)
                if not member:
                    hub, own = b, found
                    continue
                if hub != b:
                    raise ValueError("a group of ties lacks its first text")
                shared = len(np.intersect1d(found, own, assume_unique=True))
                if shared / (len(found) + len(own) - shared) >= threshold - 1e-12:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _verify(threshold: float, across: bool):
    def judge(low: int, high: int, rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """rows: (key, class, block, set) of blocks low and high. Of each key its links here and the smallest key they connect it with here."""
        keys = np.array([r[0] for r in rows], np.int64)
        order = np.argsort(keys)
        keys, sets = keys[order], [rows[i][3] for i in order]
        classes, blocks = (np.array([rows[i][k] for i in order]) for k in (1, 2))
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        if not (len(left) and len(right)):  # the other block's own pairs are another task's
            return
        i, j = similar(sets, left, right, threshold)
        a, b = left[i], right[j]
        if across:
            new = classes[a] != classes[b]
            a, b = a[new], b[new]
        links = np.bincount(a, minlength=len(keys))
        if low != high:
            links += np.bincount(b, minlength=len(keys))
        root = np.arange(len(keys))
        while len(a):  # smallest connected number
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield from zip(keys.tolist(), links.tolist(), keys[root].tolist(), strict=True)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple]]]:
        rows, last = [], None
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            for *group, of, block, key, text in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "class", "block", "key", "text")), strict=True):
                if group != last and rows:
                    yield *last[1:], rows
                    rows = []
                last = group
                rows.append((key, of, block, shingles(text)))
        if rows:
            yield *last[1:], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for low, high, rows in groups(batches):
            if len(rows) > 1 and not (across and len({r[1] for r in rows}) < 2):
                out += [x for x in judge(low, high, rows) if x[1]]
            if len(out) >= 20_000:
                yield _ties(out)
                out = []
        if out:
            yield _ties(out)

    return run


def _ties(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "links", "with"])


def join(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, class_id, n_links, text_class (both classes named by an id)."""
    keyed, plain = ordered_keys(docs, id_col, text_col)
    judged = classified(keyed, threshold, text_col, plain)
    if plain:
        as_id = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
        return judged.select(as_id("key").alias(id_col), as_id("class").alias("class_id"), "n_links", as_id("text_class").alias("text_class"))
    ids = keyed.select("__sf_key", F.col(id_col).cast("long").alias("_id")).distinct()
    for column, name in (("key", "_own"), ("class", "class_id"), ("text_class", "_text")):
        judged = judged.join(ids.select(F.col("__sf_key").alias(column), F.col("_id").alias(name)), column)
    rows = keyed.select(F.col("__sf_key").alias("key")).join(judged, "key")  # as often as the row occurs
    return rows.select(F.col("_own").alias(id_col), "class_id", "n_links", F.col("_text").alias("text_class"))


def in_blocks(members: DataFrame, total: int, texts: DataFrame, threshold: float, across: bool, name: str) -> DataFrame:
    """members: (root, key, class, n), so many rows. (key, links, with) inside each root; ``across``: only of different classes."""
    sized = members.groupBy("root").agg(F.count("*").alias("rows"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = spread_join(members, sized, "root", "rows", "key", total).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = placed.join(texts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "class", "block", "key", "text")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(dealt.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(_verify(threshold, across), "key long, links long, with long"), name)


def check_ties(ties: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the ties (a, b) that are links; b's ties are dealt over SALTS groups."""
    salted = ties.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    members = salted.join(texts, F.col("a") == F.col("key")).select("b", "salt", F.lit(1).alias("member"), "a", "text")
    hubs = salted.select("b", "salt").distinct().join(texts, F.col("b") == F.col("key")).select("b", "salt", F.lit(0).alias("member"), F.lit(0).cast("long").alias("a"), "text")
    parts = int(ties.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = members.unionByName(hubs).repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "member")
    return written(grouped.mapInArrow(_check_ties(threshold), "a long, b long"), "jaccard-links")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (key, class, n) after links (a, b) between keys have joined some."""
    of = lambda c: classes.select(F.col("key").alias(c), F.col("class").alias(f"of_{c}"))
    roots = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), "jaccard-classes")
    new = classes.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    return written(new.select("key", F.coalesce("root", "class").alias("class"), "n"), "jaccard-merged")


def linked_classes(forest: DataFrame, texts: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, class, n) of the sets that share a node with another one, and those sets' texts."""
    nodes = forest.groupBy(prefix(depth).alias("node")).agg(F.count("*").alias("rows")).where("rows > 1")
    live = written(spread_join(forest.withColumn("node", prefix(depth)), nodes, "node", "rows", "key", forest.count()).drop("node", "rows"), "jaccard-live")
    total = live.count()
    classes = written(live.groupBy("key").agg(F.first("n").alias("n")).select("key", F.col("key").alias("class"), "n"), "jaccard-merged")
    texts = written(texts.join(classes.select("key"), "key", "left_semi"), "jaccard-texts")

    def placed(depth: int) -> tuple[DataFrame, DataFrame]:
        """Rows (node, key, class, n, rank) and of each node with several classes its first row."""
        rows = live.select(prefix(depth).alias("node"), "key").join(classes, "key").withColumn("rank", F.xxhash64("key", F.lit(depth)))
        first = F.min(F.struct("rank", "key", "class")).alias("first")
        tops = rows.groupBy("node").agg(first, F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("print"))
        return rows, tops.where("low < high")

    for length in range(DEPTH, depth - 1, -1):
        rows, tops = placed(length)
        met = spread_join(rows, tops.select("node", "first", "rows"), "node", "rows", "key", total).where(F.col("class") != F.col("first.class"))
        ties = written(met.groupBy("key").agg(F.min("first").alias("first")).select(F.col("key").alias("a"), F.col("first.key").alias("b")), "jaccard-ties")
        if ties.isEmpty():
            continue
        links = check_ties(ties, texts, threshold)
        if not links.isEmpty():
            classes = merged(classes, links)
    # of nodes with the same sets one is enough
    rows, tops = placed(depth)
    tops = tops.groupBy("rows", "print").agg(F.min("node").alias("node")).select("node", "rows")
    mixed_nodes = written(spread_join(rows, tops, "node", "rows", "key", total).select(F.col("node").alias("root"), "key", "class", "n"), "jaccard-nodes")
    if n_mixed := mixed_nodes.count():
        links = in_blocks(mixed_nodes, n_mixed, texts, threshold, True, "jaccard-across")
        if not links.isEmpty():
            classes = merged(classes, links.select(F.col("key").alias("a"), F.col("with").alias("b")))
    discard(live)
    return classes, texts


def classified(keyed: DataFrame, threshold: float, text_col: str, plain: bool) -> DataFrame:
    """(key, class, n_links, text_class) for each __sf_key."""
    spark = keyed.sparkSession
    texts = keyed.select(F.col("__sf_key").alias("key"), F.col(text_col).alias("text"))
    if not plain:
        texts = texts.dropDuplicates(["key"])
    probes = spark.sparkContext.broadcast(choose_probes(texts))
    sets = written(texts.mapInArrow(_prepare(probes, threshold), "key long, n int, one long, two long, paths array<long>, links array<int>"), "jaccard-sets")
    seen: dict[int, dict[int, int]] = {}  # at most PROBES * (DEPTH + 1) numbers
    for code, count in sets.select(F.explode("links").alias("code")).groupBy("code").count().collect():
        probe, depth = (code // DEPTH, code % DEPTH + 1) if code >= 0 else (-1 - code, 0)
        seen.setdefault(probe, {})[depth] = count
    depth = depth_to_use(seen, threshold)
    # equal sets have equal paths
    firsts = written(sets.where("n > 0").groupBy("one", "two").agg(F.min("key").alias("rep"), F.any_value("n").alias("n"), F.any_value("paths").alias("paths")), "jaccard-firsts")
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.get("paths", 2 * t).alias("high"), F.get("paths", 2 * t + 1).alias("low"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = firsts.select(F.col("rep").alias("key"), "n", tree.alias("at")).select("at.*", "key", "n")
    forest = written(forest.repartitionByRange(parts, "tree", "high", "low").sortWithinPartitions("tree", "high", "low"), "jaccard-forest")
    classes, near = linked_classes(forest, texts, depth, threshold)
    discard(forest)
    several = classes.groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1")
    inside = written(spread_join(classes, several, "class", "rows", "key", classes.count()).select(F.col("class").alias("root"), "key", "class", "n"), "jaccard-inside")
    counted = in_blocks(inside, inside.count(), near, threshold, False, "jaccard-counts").groupBy("key").agg(F.sum("links").alias("n_links"))
    discard(near)
    linked = inside.join(counted, "key").select(F.col("key").alias("text_class"), "n_links", "root")
    members = sets.where("n > 0").join(firsts.select("one", "two", F.col("rep").alias("text_class")), ["one", "two"]).select("key", "text_class")
    members = members.unionByName(sets.where("n = 0").select("key", F.col("key").alias("text_class")))
    found = written(members.join(linked, "text_class", "left").select("key", F.coalesce("root", "text_class").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_class"), "jaccard-classes")
    discard(sets, firsts, inside)
    return found


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document (the first by id) of each class."""
    keyed, plain = ordered_keys(docs, id_col, text_col)
    first = classified(keyed, threshold, text_col, plain).where(F.col("key") == F.col("class")).select(F.col("key").alias("__sf_first"))
    kept = keyed.join(first, F.col("__sf_key") == F.col("__sf_first"), "left_semi")
    return (kept if plain else kept.dropDuplicates(["__sf_key"])).select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
