"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes the dummy prefix plus itself with blanks written as U+2581, and
falls apart before every run of U+2581, since no piece of the model joins a
character to a following U+2581. These words lie end to end in flat numpy
arrays of symbols. Each round takes the lowest pair rank of each word by a
segmented minimum, merges its leftmost non-overlapping occurrences in all words
at once, and compacts the arrays; words without a mergeable pair leave, until
none remains. Where merging all occurrences could differ from merging them one
by one, because a merge would open a pair of no higher rank, a word merges its
leftmost occurrence only.

Characters outside the vocabulary become byte pieces. Decoding gathers the bytes
of the pieces.

The vocabulary (pieces and pair ranks) is built on the driver from the model
file and broadcast; its size is that of the model, which ``MOST_PIECES`` bounds.
Each task keeps the words it has met, at most ``CACHE_WORDS`` of them.

Defined cases: a null or empty text has no ids and decodes to the empty text;
texts of any length are encoded whole; repeated rows are encoded alike; other
columns of the input stay, ones named like the result's are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechframes.llm.common import pieces, table

CACHE_WORDS = 200_000
CACHED_CHARS = 48
MOST_PIECES = 2_000_000
CHUNK_CHARS = 2_000_000
BLANK = "▁"
NONE = np.iinfo(np.int64).max
WORDS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


@dataclass
class Vocabulary:
    size: int
    char_ids: np.ndarray  # by code point; -1: none
    pair_keys: np.ndarray  # left * size + right, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    byte_ids: np.ndarray
    piece_bytes: np.ndarray  # all pieces' bytes end to end
    piece_starts: np.ndarray
    is_byte: np.ndarray

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in the pair table, -1 for pairs that do not merge."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), at, -1)


def load_vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.vocab_size()
    if n > MOST_PIECES:
        raise ValueError(f"the model has {n} pieces; at most {MOST_PIECES} are broadcast")
    if sp.normalize("  Ａé b ") != f"{BLANK * 3}Ａé{BLANK}b{BLANK}":
        raise ValueError("only models without normalisation and with a dummy prefix are supported")
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    if not all(sp.is_byte(int(i)) for i in byte_ids):
        raise ValueError("only models with byte fallback are supported")
    pieces = [sp.id_to_piece(i) for i in range(n)]
    ids = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    if any(BLANK in p.lstrip(BLANK) for p in ids):
        raise ValueError("a piece spans words")
    scores = np.array([sp.get_score(i) for i in range(n)])
    if np.unique(scores[list(ids.values())], return_counts=True)[1][-1] > 1:  # learned pieces rank below each other, such symbols are all alike
        raise ValueError("models with user-defined symbols are not supported")
    ranks = np.unique(-scores, return_inverse=True)[1]
    char_ids = np.full(0x110000, -1, np.int32)
    table: dict[int, int] = {}
    for p, i in ids.items():
        if len(p) == 1:
            char_ids[ord(p)] = i
        for c in range(1, len(p)):
            left, right = ids.get(p[:c]), ids.get(p[c:])
            if left is not None and right is not None:
                table[left * n + right] = i
    keys = np.array(sorted(table), np.int64)
    made = np.array([table[k] for k in keys.tolist()], np.int64)
    is_byte = np.zeros(n, bool)
    is_byte[byte_ids] = True
    data = [b"" if sp.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
    data[sp.unk_id()] = " ⁇ ".encode()  # fixed value: the library's surface of an unknown id
    for b, i in enumerate(byte_ids.tolist()):
        data[i] = bytes([b])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    return Vocabulary(n, char_ids, keys, ranks[made], made, byte_ids, np.frombuffer(b"".join(data), np.uint8), starts, is_byte)


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and where each word's begin (one more entry than words)."""
    lens = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sym = v.char_ids[points].astype(np.int64)
    sym = np.where(sym < 0, -2 - points, sym)  # below -1: a character that has no piece
    word = np.repeat(np.arange(len(words)), lens)
    done_sym, done_word = [], []
    pair = np.full(len(sym), -1, np.int64)
    if len(sym):
        pair[:-1] = np.where(word[1:] == word[:-1], v.pairs(sym[:-1], sym[1:]), -1)
    while len(sym):
        rank = np.where(pair >= 0, v.pair_ranks[pair], NONE)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        open_ = least < NONE
        if not open_.all():
            stay = np.repeat(open_, sizes)
            done_sym.append(sym[~stay])
            done_word.append(word[~stay])
            sym, word, pair, rank = sym[stay], word[stay], pair[stay], rank[stay]
            sizes, least = sizes[open_], least[open_]
            if not len(sym):
                break
        segment = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == least[segment])
        # of overlapping occurrences every second one merges, from the left
        begins = np.concatenate([[True], (np.diff(at) > 1) | (segment[at[1:]] != segment[at[:-1]])])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        many = np.bincount(segment[at], minlength=len(sizes))[segment[at]] > 1
        if many.any():
            p = at[many]
            z, r = v.pair_ids[pair[p]], rank[p]
            left = np.where((p > 0) & (segment[p - 1] == segment[p]), sym[p - 1], -1)
            after = np.minimum(p + 2, len(sym) - 1)
            right = np.where((p + 2 < len(sym)) & (segment[after] == segment[p]), sym[after], -1)
            rank_of = lambda a, b: np.where((k := v.pairs(a, b)) >= 0, v.pair_ranks[k], NONE)
            opens = np.minimum(np.minimum(rank_of(left, z), rank_of(z, right)), rank_of(z, z)) <= r
            risky = np.zeros(len(sizes), bool)
            risky[segment[p[opens]]] = True
            first = np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])
            at = at[first | ~risky[segment[at]]]
        sym = sym.copy()
        sym[at] = v.pair_ids[pair[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        fresh = np.zeros(len(sym), bool)
        fresh[at] = True
        pair = pair.copy()
        sym, word, pair, fresh = sym[keep], word[keep], pair[keep], fresh[keep]
        redo = np.flatnonzero(fresh | np.append(fresh[1:], False))
        redo_ok = redo[redo + 1 < len(sym)]
        pair[redo] = -1
        same = word[redo_ok] == word[redo_ok + 1]
        redo_ok = redo_ok[same]
        pair[redo_ok] = v.pairs(sym[redo_ok], sym[redo_ok + 1])
    sym = np.concatenate([*done_sym, np.zeros(0, np.int64)])
    word = np.concatenate([*done_word, np.zeros(0, np.int64)])
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    if (sym < 0).any():
        sym, word = _with_bytes(v, sym, word)
    return sym, np.searchsorted(word, np.arange(len(words) + 1))


def _with_bytes(v: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = np.flatnonzero(sym < 0)
    data = [chr(-2 - s).encode("utf-8", "surrogatepass") for s in sym[odd].tolist()]
    counts = np.ones(len(sym), np.int64)
    counts[odd] = [len(d) for d in data]
    out = np.repeat(sym, counts)
    out[np.flatnonzero(np.repeat(sym < 0, counts))] = v.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
    return out, np.repeat(word, counts)


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every slice, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Encoder:
    """Encodes texts in chunks; remembers short words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.told: list[bytes] = []

    def learn(self, words: list[str]) -> None:
        ids, starts = merge_words(self.v, words)
        self.index |= zip(words, range(len(self.told), len(self.told) + len(words)), strict=True)
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        listed, ends = ids.tolist(), starts.tolist()
        self.told += [",".join(map(str, listed[a:b])).encode() for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Of each text its ids, and the decimal ids joined by commas."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text)
            chars += len(text or "")
            if chars >= CHUNK_CHARS:
                yield from self._encode(chunk)
                chunk, chars = [], 0
        yield from self._encode(chunk)

    def _encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        split = [WORDS.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        new = list(set().union(*split) - self.index.keys())
        if len(self.index) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(set().union(*split))
        if new:
            self.learn(new)
        get = self.index.__getitem__
        for words in split:
            at = list(map(get, words))
            told = self.told
            where = np.array(at, np.int64)
            starts = self.starts[where]
            yield self.ids[_gather(starts, self.starts[where + 1] - starts)], b",".join([told[i] for i in at])
        if len(self.index) > CACHE_WORDS // 2 and any(len(w) > CACHED_CHARS for w in new):
            self.forget()


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The UTF-8 text of a sequence of ids."""
    if not len(ids):
        return b""
    starts = v.piece_starts[ids]
    data = v.piece_bytes[_gather(starts, v.piece_starts[ids + 1] - starts)].tobytes()
    if not v.is_byte[ids[0]] and data[:1] == b" ":
        data = data[1:]
    try:
        data.decode()
        return data
    except UnicodeDecodeError:  # byte pieces that are no UTF-8: each such byte becomes U+FFFD
        out, rest = [], data
        while rest:
            try:
                rest.decode()
                out.append(rest)
                break
            except UnicodeDecodeError as e:
                out += [rest[: e.start], "�".encode()]
                rest = rest[e.start + 1 :]
        return b"".join(out)


def _columns_but(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def encode(docs: DataFrame, model_file: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """docs with n_tokens and ids added, and the text decoded from the ids where a column for it is named (it may be text_col)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in (part for whole in batches for part in pieces(whole, text_col)):
            rows = [ids for ids, _ in encoder.encode(batch.column(text_col).to_pylist())]
            sizes = [len(r) for r in rows]
            values = pa.array(np.concatenate(rows).astype(np.int32)) if rows else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
            columns = dict(zip(kept_names, batch.select(kept_names).columns, strict=True)) | {"n_tokens": pa.array(sizes, pa.int64()), "ids": lists}
            if decoded_col:
                columns[decoded_col] = pa.array([decode_ids(shared.value, r).decode() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept_names = _columns_but(docs, "n_tokens", "ids")
    made = docs.select(*kept_names).withColumns({"n_tokens": F.lit(None).cast("long"), "ids": F.lit(None).cast("array<int>")})
    schema = (made.withColumn(decoded_col, F.lit(None).cast("string")) if decoded_col else made).schema
    return docs.select(*kept_names).mapInArrow(run, schema)


def decode(tokens: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """tokens with the decoded text added; null ids decode to the empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    kept_names = _columns_but(tokens, out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, ids_col)):
            lists = batch.column(ids_col)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [decode_ids(shared.value, ids[a:b]).decode() for a, b in zip(ends, ends[1:], strict=False)]
            kept = batch.select(kept_names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], [*kept_names, out_col])

    schema = tokens.select(*kept_names).withColumn(out_col, F.lit(None).cast("string")).schema
    return tokens.select(*kept_names).mapInArrow(run, schema)


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; of each text the number of ids and digests of ids and decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            sizes, told, decoded = [], [], []
            for ids, listed in encoder.encode(batch.column("text").to_pylist()):
                sizes.append(len(ids))
                told.append(hashlib.sha256(listed).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(shared.value, ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
