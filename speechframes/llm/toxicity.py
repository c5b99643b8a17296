"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so token labels come first. ``marking_words`` counts, over
all labelled training rows, in how many groups of near copies (documents of one
least three-word hash) of toxic and of clean documents each word stands, so that
copies change nothing; words of ``LEAST_LOG_ODDS`` or more that stand in
``LEAST_GROUPS`` or more toxic groups mark toxicity, however rare they are beside
others. Their occurrences in toxic documents are the tagged
tokens. On these a conditional random field with two states learns weights for
a word, its neighbours, the step of its log-odds, and the transitions between
states, by the exact gradient from the forward-backward recursions.

For any text the same recursions give each word's marginal probability of being
toxic. Runs of words with a marginal of ``SPAN_AT`` or more are the offending spans.
The largest marginal, the sum over the words in spans and that sum beside the
text's length give the document's score through a logistic model fitted on the
sample's document labels. Its intercept is held so low that a text without a
span stays below 0.5, whatever the lengths of the texts that taught it.

The weights are fitted on a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` rows of each class (least hash of the id first) and
``SAMPLE_CHARS`` characters, of which each class has half and what the other
does not need. A row that does not fit there is passed over; a class of which no
row fits teaches by the beginning of its shortest one. Documents of fewer than
``WINDOW`` words are windows of their own length. The model is broadcast: it has
the words that the sample repeats, and at most ``MOST_MARKS`` marking words; beyond
that those of the least evidence (log-odds times groups) go unmarked. Scoring covers every whole text, without
a shuffle.

Defined cases: null and empty texts have no word and get the score of a text
without any toxic word; rows without id, label or text teach nothing, nor do ids that
have both labels; equal texts teach once; without rows of both classes every score is 0; repeated rows
score alike; extra columns are kept by ``score`` and columns named like its
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechframes.llm.common import fold, pieces, table, written

SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 8_000_000
WINDOW = 48
STEPS = 60
SPAN_AT = 0.5
MOST_MARKS = 500_000  # some 50 MB
LEAST_GROUPS = 5
BROADCAST_LABELS = 2_000_000  # ids and labels, some 50 MB; more of them meet the texts in a shuffle join
STEPS_OF_ODDS = 6
NEIGHBOUR = 0.25  # value of a neighbouring word's feature; the word's own is 1
WORD = re.compile(r"\w+")
LEAST_LOG_ODDS = 3.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def log_odds(toxic: int, clean: int, n: int, m: int) -> float:
    """Of a word in so many of n toxic and m clean groups."""
    return math.log((toxic + 0.5) / (n + 1)) - math.log((clean + 0.5) / (m + 1))


def marking_words_of(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Marking words of a few texts, each of which stands for itself: two toxic texts are enough."""
    sets = [(set(words_of(t)), y) for t, y in rows]
    yes, no = (Counter(w for d, y in sets if y == c for w in d) for c in (1, 0))
    n = sum(y for _, y in rows)
    odds = {w: log_odds(c, no[w], n, len(rows) - n) for w, c in yes.items() if c >= 2}
    return {w: x for w, x in odds.items() if x >= LEAST_LOG_ODDS}


def near_copy_key(words: list[str]) -> int:
    """The least hash of three consecutive words: mostly equal for near copies, and for few others."""
    return min(zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and labels to the (word, group, y) that they hold, each group also under the null word."""
    found: set = set()

    def flush() -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["word", "group", "y"])
        found.clear()
        return made

    for batch in (part for whole in batches for part in pieces(whole, "text")):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            words = words_of(text)
            group = near_copy_key(words)
            found.update((w, group, y) for w in {None, *words})
            if len(found) >= 300_000:
                yield flush()
    if found:
        yield flush()


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """_of and y of the ids that have one label, 0 or 1."""
    rows = labels.select(F.col(id_col).alias("_of"), F.col(label_col).cast("int").alias("y")).where("_of IS NOT NULL AND y IN (0, 1)")
    return rows.groupBy("_of").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other").drop("_other")


def marking_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Marking words and their log-odds, counted over all labelled rows; groups of near copies count once each, in either class."""
    known = known_labels(labels, id_col, label_col)
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(known) if few else known, "_of")
    pairs = rows.select("text", "y").mapInArrow(_count_words, "word string, group long, y int").distinct()
    counted = pairs.groupBy("word").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")).where(F.col("word").isNull() | (F.col("toxic") >= LEAST_GROUPS))
    counted = written(counted, "toxic-words")
    total = counted.where("word IS NULL").first()
    if total is None or not (total["toxic"] and total["clean"]):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1))
    found = counted.where("word IS NOT NULL").withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
    return dict(found.orderBy(F.desc(F.col("odds") * F.col("toxic")), "word").limit(MOST_MARKS).select("word", "odds").collect())


@dataclass
class Model:
    words: dict[str, int]  # 0 stands for all others
    emission: np.ndarray  # 3 x words: the word before, the word, the word after
    bias: float
    transition: np.ndarray  # 2 x 2, log weights
    document: np.ndarray  # of the document's logistic model


def _odds_chain(e: np.ndarray, t: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginal odds of state 1. e: sequences x time (longest first), state 1 over state 0; t: transition weights.

    With two states the recursions need only the ratio of the states' messages.
    """
    rows, steps = e.shape
    active = (lengths[:, None] > np.arange(steps)[None, :]).sum(0)
    forward = np.empty_like(e)
    if steps:
        forward[:, 0] = e[:, 0]
    for i in range(1, steps):
        k = active[i]
        r = forward[:k, i - 1]
        forward[:k, i] = np.clip(e[:k, i] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r), 1e-30, 1e30)
    back = np.ones(rows)
    for i in range(steps - 1, 0, -1):
        k = active[i]
        x = e[:k, i] * back[:k]
        forward[:k, i] *= back[:k]
        back[:k] = np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1e-30, 1e30)
    if steps:
        forward[:, 0] *= back
    return forward


def _pairwise(e: np.ndarray, t: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals, expected transitions and log partition of windows (windows x time, longest first; all full without lengths)."""
    n, steps = e.shape
    active = np.full(steps, n) if lengths is None else (lengths[:, None] > np.arange(steps)[None, :]).sum(0)
    alpha = np.empty((steps, n, 2))
    scale = np.ones((steps, n))
    emit = np.stack([np.ones_like(e), e], axis=2)
    a = emit[:, 0]
    for i in range(steps):
        k = active[i]
        a = (a[:k] @ t) * emit[:k, i] if i else a[:k]
        scale[i, :k] = a.sum(1)
        a = a / scale[i, :k, None]
        alpha[i, :k] = a
    beta = np.ones((n, 2))
    marginal = np.zeros((n, steps))
    expected = np.zeros((2, 2))
    for i in range(steps - 1, -1, -1):
        k = active[i]
        joint = alpha[i, :k] * beta[:k]
        marginal[:k, i] = joint[:, 1] / joint.sum(1)
        if i:
            x = emit[:k, i] * beta[:k] / scale[i, :k, None]
            expected += t * (alpha[i - 1, :k].T @ x)
            beta[:k] = x @ t.T
    return marginal, expected, float(np.log(scale).sum())


def fit(rows: list[tuple[str, int]], marks: dict[str, float] | None = None) -> Model | None:
    """rows: texts and their labels, 0 or 1; marks: marking words with log-odds, else those of the rows."""
    rows = list(dict(rows).items())
    docs = [(words_of(t), y) for t, y in rows]
    if len({y for _, y in docs}) < 2:
        return None
    marks = marking_words_of(rows) if marks is None else marks
    counts = Counter(w for d, _ in docs for w in d)
    words = {w: i for i, w in enumerate(dict.fromkeys(["", *marks, *[w for w, c in counts.most_common() if c > 1]]))}
    grade = np.zeros(len(words), int)  # step of the log-odds, 0 for words that mark nothing
    for w, x in marks.items():
        grade[words[w]] = 1 + max(0, min(STEPS_OF_ODDS - 1, int(x - LEAST_LOG_ODDS)))
    ids = [np.array([0, *[words.get(w, 0) for w in d], 0], np.int32) for d, _ in docs]
    tags = [np.array([y and w in marks for w in d], float) for d, y in docs]
    # windows of equal length; the last one of a document reaches back, a shorter document is padded behind its end
    before, middle, after, gold, lengths = [], [], [], [], []
    for d, g in zip(ids, tags, strict=True):
        n = len(g)
        size = min(n, WINDOW)
        pad = WINDOW - size
        for start in range(0, n, WINDOW):
            a = max(0, min(start, n - WINDOW))
            before.append(np.pad(d[a : a + size], (0, pad)))
            middle.append(np.pad(d[a + 1 : a + 1 + size], (0, pad)))
            after.append(np.pad(d[a + 2 : a + 2 + size], (0, pad)))
            gold.append(np.pad(g[a : a + size], (0, pad)))
            lengths.append(size)
    filled = np.array(lengths, int)
    order = np.argsort(-filled, kind="stable")
    filled = filled[order]
    seen = [np.array(x, int).reshape(-1, WINDOW)[order] for x in (before, middle, after)]
    y = np.array(gold, float).reshape(-1, WINDOW)[order]
    size, total = len(words), max(1, int(filled.sum()))
    steps = STEPS_OF_ODDS + 1
    theta = np.zeros(3 * size + steps + 1 + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    observed = np.zeros((2, 2))
    inside = filled[:, None] > np.arange(1, WINDOW)[None, :]
    np.add.at(observed, (y[:, :-1][inside].astype(int), y[:, 1:][inside].astype(int)), 1)
    graded = grade[seen[1]]
    known = [np.bincount(s.ravel(), weights=y.ravel(), minlength=n) for s, n in zip([*seen, graded], [size, size, size, steps], strict=True)]
    for step in range(1, STEPS + 1):
        w = theta[: 3 * size].reshape(3, size)
        of_grade = theta[3 * size : 3 * size + steps]
        e = np.exp(np.clip(w[1][seen[1]] + NEIGHBOUR * (w[0][seen[0]] + w[2][seen[2]]) + of_grade[graded] + theta[-5], -30, 30))
        marginal, expected, _ = _pairwise(e, np.exp(theta[-4:].reshape(2, 2)), filled)
        grad = np.empty_like(theta)
        for k in range(3):
            grad[k * size : (k + 1) * size] = (1 if k == 1 else NEIGHBOUR) * (known[k] - np.bincount(seen[k].ravel(), weights=marginal.ravel(), minlength=size))
        grad[3 * size : 3 * size + steps] = known[3] - np.bincount(graded.ravel(), weights=marginal.ravel(), minlength=steps)
        grad[-5] = y.sum() - marginal.sum()
        grad[-4:] = (observed - expected).ravel()
        grad = grad / math.sqrt(total) - 1e-3 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta + 0.25 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    values = np.array([NEIGHBOUR, 1, NEIGHBOUR])[:, None]
    emission = theta[: 3 * size].reshape(3, size) * values
    emission[1] += theta[3 * size : 3 * size + steps][grade]
    model = Model(words, emission, float(theta[-5]), theta[-4:].reshape(2, 2), np.zeros(4))
    x = np.array([document_features(p) for p in marginals(model, [d for d, _ in docs])])
    labels = np.array([t for _, t in docs], float)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))  # classes count alike
    b = np.zeros(4)
    for _ in range(30):  # Newton's method, lightly regularised
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (weight * (labels - p)) - 0.05 * b)
    # below SPAN_AT only the largest marginal counts, and it cannot lift the score to a half
    b[1] = max(b[1], 0.0)
    b[0] = min(b[0], -b[1] * SPAN_AT - 1e-6)
    model.document = b
    return model


def marginals(model: Model, docs: list[list[str]]) -> Iterator[np.ndarray]:
    """The marginals of each document's words."""
    get = model.words.get
    ids = [np.array([get(w, 0) for w in d], np.int64) for d in docs]
    lengths = np.array([len(d) for d in ids], np.int64)
    order = np.argsort(-lengths, kind="stable")
    out: list = [None] * len(docs)
    t = np.exp(model.transition)
    start = 0
    while start < len(order):  # blocks of documents of like length
        longest = max(1, lengths[order[start]])
        stop = start + max(1, min(len(order), 2_000_000 // longest))
        block = order[start:stop]
        e = np.zeros((len(block), lengths[block[0]]))
        for row, i in enumerate(block):
            d = ids[i]
            if len(d):
                s = model.emission[1][d] + model.bias
                s[1:] += model.emission[0][d[:-1]]
                s[:-1] += model.emission[2][d[1:]]
                s[0] += model.emission[0][0]
                s[-1] += model.emission[2][0]
                e[row, : len(d)] = s
        odds = _odds_chain(np.exp(np.clip(e, -30, 30)), t, lengths[block])
        for row, i in enumerate(block):
            o = odds[row, : lengths[i]]
            out[i] = o / (1 + o)
        start = stop
    yield from out


def document_features(p: np.ndarray) -> list[float]:
    """A constant, the largest marginal, and of the words in spans the sum, absolute and beside the length; all but the first vanish without evidence."""
    tagged = math.log1p(float(p[p >= SPAN_AT].sum()))
    return [1.0, float(p.max(initial=0.0)), tagged, tagged / math.log(len(p) + 2)]


def document_score(model: Model, p: np.ndarray) -> float:
    return 1 / (1 + math.exp(-float(np.dot(model.document, document_features(p)))))


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words at SPAN_AT or above: offsets in the text (code points) and the largest marginal."""
    lower = text.lower()
    if len(lower) != len(text):  # offsets of the lower-case text would not fit
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(lower)):
        if i < len(p) and p[i] >= SPAN_AT:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def fitting(lengths: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """(number, characters) of the rows that teach, in their order: those that fit their class's part of SAMPLE_CHARS."""
    need = [sum(n for n, y in zip(lengths, labels, strict=True) if y == c) for c in (0, 1)]
    out = []
    for c in (0, 1):
        left = bound = max(SAMPLE_CHARS // 2, SAMPLE_CHARS - need[1 - c])
        own = [i for i, y in enumerate(labels) if y == c]
        taken = []
        for i in own:
            if lengths[i] <= left:
                taken.append((i, lengths[i]))
                left -= lengths[i]
        if own and not any(n for _, n in taken):
            i = min((i for i in own if lengths[i]), key=lambda i: lengths[i], default=None)
            taken += [] if i is None else [(i, bound)]
        out += taken
    return sorted(out)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """At most SAMPLE_ROWS rows of each class and SAMPLE_CHARS characters."""
    known = known_labels(labels, id_col, label_col).withColumnRenamed("y", "_y")
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_of"), "_of").limit(SAMPLE_ROWS)
        chosen = some if chosen is None else chosen.union(some)
    # at most 2 * SAMPLE_ROWS ids; their lengths come first, so that only texts that fit reach the driver
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_of")).select("_id", F.xxhash64("_text").alias("_hash"), F.length("_text").alias("_chars"), "_y").distinct()
    nth = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id", "_hash"))
    found = rows.withColumn("_nth", nth).where(F.col("_nth") <= SAMPLE_ROWS).orderBy(F.xxhash64("_id"), "_id", "_hash", "_y").collect()
    picked = [(i, found[i]["_id"], found[i]["_hash"], n) for i, n in fitting([r["_chars"] for r in found], [r["_y"] for r in found])]
    if not picked:
        return []
    id_type = texts.schema["_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(picked, f"_nth long, _of {id_type}, _same long, _upto int")
    got = texts.join(F.broadcast(wanted), F.col("_id") == F.col("_of")).where(F.xxhash64("_text") == F.col("_same"))
    got = dict(got.select("_nth", F.expr("substring(_text, 1, _upto)").alias("_text")).dropDuplicates(["_nth"]).collect())
    return [(got[i], found[i]["_y"]) for i, *_ in picked]


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with score and toxic_spans added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept_names = [c for c in docs.columns if c not in ("score", "toxic_spans")]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (part for whole in batches for part in pieces(whole, text_col)):
            texts = batch.column(text_col).to_pylist()
            scores, found = [0.0] * len(texts), [[] for _ in texts]
            for i, p in enumerate(marginals(model, [words_of(t) for t in texts]) if model else ()):
                scores[i] = document_score(model, p)
                if p.max(initial=0.0) >= SPAN_AT:
                    found[i] = spans(texts[i], p)
            yield pa.RecordBatch.from_arrays([*batch.select(kept_names).columns, pa.array(scores, pa.float64()), pa.array(found, span_type)], [*kept_names, "score", "toxic_spans"])

    schema = docs.select(*kept_names).withColumns({"score": F.lit(0.0), "toxic_spans": F.lit(None).cast("array<struct<start:bigint,end:bigint,p:double>>")}).schema
    return docs.select(*kept_names).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    return fit(sample(docs, labels, id_col, text_col, label_col), marking_words(docs, labels, id_col, text_col, label_col))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) > 0)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("toxic_spans").alias("n_spans"))
