"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be met with up to e = floor(``ERROR_RATE`` * m)
edits. Cut into e + 1 pieces, at least one piece then stands unchanged in the
text. Each document is searched once for all pieces of all items (one
Aho-Corasick pass); around every piece hit a window is checked with Myers'
bit-parallel edit distance, after the q-gram lemma has turned away windows that
share too few trigrams.

Items and texts are compared in lower case with every run of white space as one
blank; reported offsets are code points of the text as it stands.

The items reach the driver one at a time and the tasks in blocks of at most
``BLOCK_CHARS`` characters (or one item), one pass over the documents for each
block: a task holds one block's automaton, whatever the benchmark's size, and a
benchmark of up to ``BLOCK_CHARS`` costs one pass. Documents are never shuffled.

Defined cases: null and empty texts match nothing; null and blank items are
not searched; items that repeat are reported under each of their ids, and items
that share an id each by their own text and budget; an item of
fewer than 1/``ERROR_RATE`` characters is met exactly; overlapping matches of one
item are reported once, at the least distance, the leftmost of ties; repeated
rows are each reported; empty tables give an empty result; other columns of both
tables are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import pieces, table, written

ERROR_RATE = 0.1
BLOCK_CHARS = 4_000_000
Q = 3


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """Errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' algorithm for one pattern; Python's integers are the bit vectors."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of the pattern to any substring, and the end of the first such one."""
        full, high, masks = (1 << self.size) - 1, 1 << self.size - 1, self.masks
        plus, minus, score = full, 0, self.size
        least, end = score, 0
        for i, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < least:
                    least, end = score, i
            up, down = up << 1 & full, down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return least, end


class Item:
    def __init__(self, item_id, text: str, errors: int):
        self.item_id, self.text, self.errors = item_id, text, errors
        self.forward, self.backward = Pattern(text), Pattern(text[::-1])
        grams = [text[i : i + Q] for i in range(len(text) - Q + 1)]
        self.grams, self.lack = grams, Q * errors

    def match(self, text: str, start: int, end: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best occurrence in text[start:end], if within the budget."""
        window = text[start:end]
        if len(self.grams) > self.lack:
            lacking = 0
            for g in self.grams:
                if g not in window:
                    lacking += 1
                    if lacking > self.lack:
                        return None
        distance, at = self.forward.best(window)
        if distance > self.errors:
            return None
        _, back = self.backward.best(window[:at][::-1])
        return distance, start + at - back, start + at


class Searcher:
    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        import ahocorasick

        self.items = [Item(i, t, int(error_rate * len(t))) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in pieces_of(item.text, item.errors):
                where.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item id, start, end, distance, budget) of every match in a normalised text."""
        spots: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                spots.setdefault(n, set()).add(end + 1 - size - offset)  # where the item would begin
        out = []
        for n, begins in spots.items():
            item, found, run = self.items[n], [], []
            # hits whose windows overlap are checked together
            for b in [*sorted(begins), None]:
                if run and (b is None or b - run[-1] > item.errors):
                    found += self._within(item, text, max(0, run[0] - item.errors), run[-1] + len(item.text) + item.errors)
                    run = []
                if b is not None:
                    run.append(b)
            taken: list[tuple[int, int]] = []
            for distance, start, stop in sorted(found):
                if all(stop <= a or start >= z for a, z in taken):
                    taken.append((start, stop))
                    out.append((item.item_id, start, stop, distance, item.errors))
        return out

    def _within(self, item: Item, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
        """The best match in the window, then those left and right of it."""
        found, windows = [], [(start, min(stop, len(text)))]
        while windows:
            a, z = windows.pop()
            if z - a >= len(item.text) - item.errors and (hit := item.match(text, a, z)):
                found.append(hit)
                windows += [(a, hit[1]), (hit[2], z)]
        return found


def original_offsets(text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as spans of the text."""
    lower = text.lower()
    index = None
    if len(lower) != len(text):  # some characters have a longer lower case
        index = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        if len(index) != len(lower) + 1:
            index = [min(i, len(text)) for i in range(len(lower) + 1)]
    words = [m.span() for m in re.finditer(r"\S+", lower)]
    begins, at = [], 0
    for a, b in words:
        begins.append(at)
        at += b - a + 1

    def back(i: int, end: bool) -> int:
        k = bisect_right(begins, i - end) - 1
        a, b = words[k]
        spot = min(a + i - begins[k], b)
        return index[spot] if index else spot

    return [(back(a, False), back(b, True)) for a, b in places]


def find_matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item_id, start, end, distance, budget), one for each match."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    item_type = benchmark.schema[item_col].dataType
    schema = rows.select("id").withColumns({"item_id": F.lit(None).cast(item_type), "start": F.lit(0).cast("long"), "end": F.lit(0).cast("long"), "distance": F.lit(0).cast("long"), "budget": F.lit(0).cast("long")}).schema

    def run_with(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block.value, error_rate)
            for batch in (part for whole in batches for part in pieces(whole, "text")):
                ids, out = batch.column("id"), []
                for n, text in enumerate(batch.column("text").to_pylist()):
                    if found := searcher.search(normal(text)):
                        spans = original_offsets(text, [x[1:3] for x in found])
                        out += [(n, item, a, b, distance, budget) for (item, _, _, distance, budget), (a, b) in zip(found, spans, strict=True)]
                if out:
                    where, *columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(where)), *(pa.array(c) for c in columns)], ["id", "item_id", "start", "end", "distance", "budget"])

        return run

    result = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        if block:
            part = rows.mapInArrow(run_with(spark.sparkContext.broadcast(block)), schema)
            result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.withColumnRenamed("id", id_col)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most BLOCK_CHARS characters (or one item)."""
    block, chars = [], 0
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").toLocalIterator():
        text = normal(r["text"])
        if not text:
            continue
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r["item"], text))
        chars += len(text)
    yield block


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs without the rows that hold a test item; every row is judged by its own text, whatever its id.

    Between blocks of items the rows left are written, so that a task holds one block.
    """
    spark = docs.sparkSession

    def run_with(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(block.value, error_rate)
            for batch in (part for whole in batches for part in pieces(whole, "text")):
                clean = [not (text and searcher.search(normal(text))) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    kept, searched = docs, False
    for block in item_blocks(benchmark, "item_id", "text"):
        if block:
            kept = written(kept, "decontamination-block") if searched else kept
            kept, searched = kept.mapInArrow(run_with(spark.sparkContext.broadcast(block)), docs.schema), True
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
