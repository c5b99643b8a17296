"""Ordered per-session jobs whose next step depends on what came out before.

Sessions are hashed to partitions and sorted by Spark; a task then folds them
row by row, holding the state of one session at a time, so a session of any
length streams through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from speechframes.functions import formats
from speechframes.functions import text as T


def fold_sessions(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], Iterator[dict]], schema: str) -> DataFrame:
    """Run step(state, row) over each key's rows in order; what it yields, with the keys, are the result's rows.

    Null keys are a session like any other.
    """
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():  # plain values: whole numbers of any size, None for null
                key = tuple("NaN" if row[k] != row[k] else row[k] for k in keys)
                if state is None or key != last:
                    last, state = key, start()
                out += [{**{k: row[k] for k in keys}, **made} for made in step(state, row)]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def echo_state() -> dict:
    return {"tail": "", "chars": 0}


def echo_step(state: dict, text: str | None, longest: int, context: int) -> dict:
    """One epoch over a bounded tail: what it adds, the committed length, the context of the next."""
    new, state["tail"], more = T.merge_tail(state["tail"], text, longest)
    state["chars"] += more
    return {"novel": new, "committed_chars": state["chars"], "context": T.context_tail(state["tail"], context)}


def merge_epochs(epochs: DataFrame, keys: list[str], order: list[str], key_schema: str, tail: int = 200, text: str = "text", longest: int | None = None) -> DataFrame:
    """Per epoch its new text, the committed transcript's length, and the context for the next epoch.

    With ``longest``, the most characters of a hypothesis, only the transcript's
    end is kept and looked through, so an epoch costs the same however long the
    session; white space then counts as single blanks. Without it the whole
    transcript is kept, because an echo in other white space changes it from its beginning.
    """
    if longest is not None and longest < tail:
        raise ValueError("the context is part of what is kept: tail must not be greater than longest")

    def step(state, row):
        own = {o: row[o] for o in order}
        if longest is not None:
            yield own | echo_step(state, row[text], longest, tail)
            return
        whole = T.merge_echo(state["committed"], row[text])
        new, state["committed"] = T.added(state["committed"], whole), whole
        yield own | {"novel": new, "committed_chars": len(state["committed"]), "context": T.context_tail(state["committed"], tail)}

    start = echo_state if longest is not None else lambda: {"committed": ""}
    return fold_sessions(epochs, keys, order, start, step, f"{key_schema}, {', '.join(f'{o} long' for o in order)}, novel string, committed_chars long, context string")


def new_words(words: DataFrame, keys: list[str], key_schema: str, window: str, order: list[str], start: str = "s_ms", end: str = "e_ms", slack: int = 1) -> DataFrame:
    """Words of each window that start after the end of all words emitted in windows before."""

    def step(state, row):
        if row[window] != state["window"]:
            state["window"], state["printed"] = row[window], max(state["printed"], state["newest"])
        if row[start] > state["printed"] + slack:
            state["newest"] = max(state["newest"], row[end])
            yield {c: row[c] for c in (window, *order, "word")}

    columns = ", ".join(f"{c} long" for c in (window, *order))
    return fold_sessions(words, keys, [window, *order], lambda: {"window": None, "printed": 0, "newest": 0}, step, f"{key_schema}, {columns}, word string")


def forced_endpoints(updates: DataFrame, keys: list[str], key_schema: str, order: list[str], longest: int) -> DataFrame:
    """updates with forced: set where the audio since the last final reaches ``longest`` samples."""

    def step(state, row):
        state["since"] += row["n_samples"]
        forced = row["kind"] != "FINAL" and state["since"] >= longest
        if forced or row["kind"] == "FINAL":
            state["since"] = 0
        yield {**{o: row[o] for o in order}, "forced": forced, "since_final": state["since"]}

    return fold_sessions(updates, keys, order, lambda: {"since": 0}, step, f"{key_schema}, {', '.join(f'{o} long' for o in order)}, forced boolean, since_final long")


def freshness_step(state: dict, row: dict, ttl_us: int) -> Iterator[dict]:
    """What a tenant's row does to the gallery in use.

    row: kind (gallery: a version is enrolled; invalidate; anything else uses the
    gallery), ts_us, version. A use loads the version enrolled last where none is
    loaded, the load is older than the time to live, or it was invalidated.
    """
    if row["kind"] == "gallery":
        state["enrolled"] = row["version"]
    elif row["kind"] == "invalidate":
        state["loaded_us"] = None
    else:
        if state["loaded_us"] is None or row["ts_us"] - state["loaded_us"] > ttl_us:
            state["loaded_us"], state["version"] = row["ts_us"], state["enrolled"]
        yield {"loaded_us": state["loaded_us"], "version": state["version"]}


def freshness_state() -> dict:
    return {"enrolled": None, "version": None, "loaded_us": None}


def gallery_in_use(rows: DataFrame, key_schema: str, order: list[str], ttl_us: int = 300_000_000, tenant: str = "tenant_id") -> DataFrame:
    """For each use of a tenant's gallery when it was loaded and which version that was (null: none was enrolled yet)."""

    def step(state, row):
        for made in freshness_step(state, row, ttl_us):
            yield {**{o: row[o] for o in order}, **made}

    return fold_sessions(rows, [tenant], order, freshness_state, step, f"{key_schema}, {', '.join(f'{o} long' for o in order)}, loaded_us long, version long")


PARTIALS = {
    "rate": 16000, "window": 160_000, "context": 16_000, "least": 4_000, "min_buffer": 11_200, "min_transcribe": 24_000,
    "emit_every": 11_200, "mode": "cumulative", "lookback": 80_000, "repeats": 1, "max_behind_us": 2_000_000, "idle_reset_us": 3_000_000,
}


def partial_state() -> dict:
    return {"ingested": 0, "commit": 0, "emitted_at": 0, "last_text": "", "pending": "", "seen": 0, "wall_base": None, "done_at": None}


def partial_step(state: dict, row: dict, c: dict = PARTIALS) -> Iterator[dict]:
    """One chunk: the partial it allows, if any, and the commits it completes.

    row: n_samples, ts_us (arrival), done_us (when the chunk before was done
    with; arrival if absent), text (the hypothesis over the buffer), speech.
    """
    now = row["ts_us"]
    if state["wall_base"] is None:
        state["wall_base"] = now
    elif now - state["done_at"] > c["idle_reset_us"]:
        state["wall_base"] = now - state["ingested"] * 1_000_000 // c["rate"]
    state["done_at"] = row.get("done_us") or now
    state["ingested"] += row["n_samples"]
    behind = now - state["wall_base"] - state["ingested"] * 1_000_000 // c["rate"]
    have = state["ingested"] - state["commit"]
    lagging = c["max_behind_us"] > 0 and behind > c["max_behind_us"]
    due = state["ingested"] - state["emitted_at"] >= c["emit_every"]
    if not lagging and max(c["least"], c["min_buffer"]) <= have < c["window"] and due:
        begin = max(state["commit"], state["ingested"] - c["lookback"]) if c["mode"] == "tail" else state["commit"]
        if state["ingested"] - begin >= c["min_transcribe"]:
            state["emitted_at"] = state["ingested"]
            text = (row["text"] or "").strip() if row["speech"] else ""
            if text and text != state["last_text"]:
                state["seen"] = state["seen"] + 1 if text == state["pending"] else 1
                state["pending"] = text
                if state["seen"] >= c["repeats"]:
                    state["last_text"] = text
                    yield {"kind": "PARTIAL", "start_sample": begin, "end_sample": state["ingested"], "text": text}
    while state["ingested"] >= state["commit"] + c["window"] + c["context"]:
        yield {"kind": "FINAL", "start_sample": state["commit"], "end_sample": state["commit"] + c["window"], "text": ""}
        state["commit"] += c["window"]
        state["last_text"] = state["pending"] = ""
        state["seen"] = 0


def partial_updates(chunks: DataFrame, keys: list[str], key_schema: str, order: list[str], **options) -> DataFrame:
    """The partials and commits that a stream of chunks gives."""
    c = PARTIALS | options

    def step(state, row):
        for made in partial_step(state, row, c):
            yield {**{o: row[o] for o in order}, **made}

    return fold_sessions(chunks, keys, order, partial_state, step, f"{key_schema}, {', '.join(f'{o} long' for o in order)}, kind string, start_sample long, end_sample long, text string")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later steps read without working them out anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


CROPS_AT_ONCE = 64


def restore_text(crops: DataFrame, keys: list[str]) -> DataFrame:
    """Words with the transcript's spacing, one row each, or one row with the reason.

    crops: keys, transcript, duration_s, words (array of start_s, end_s, text).
    Each row is a crop, so no grouping is needed; crops without an array of
    words have no rows. A crop is worked through once from left to right, and a
    worker holds the words of a few crops at a time.
    """
    word = lambda w: F.struct(w["start_s"].cast("double").alias("start_s"), w["end_s"].cast("double").alias("end_s"), w["text"].alias("text"))
    rows = crops.where("words IS NOT NULL").select(*keys, "transcript", F.col("duration_s").cast("double").alias("duration_s"), F.transform("words", word).alias("words"))
    schema = StructType([*crops.select(*keys).schema.fields, *StructType.fromDDL("idx long, start_s double, end_s double, text string, reason string").fields])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CROPS_AT_ONCE):
                some = batch.slice(first, CROPS_AT_ONCE)
                said = some.column("words")
                words = zip(*[c.to_pylist() for c in said.flatten().flatten()], strict=True)
                made = []
                for crop, (transcript, duration, n) in enumerate(zip(some.column("transcript").to_pylist(), some.column("duration_s").to_pylist(), said.value_lengths().to_pylist(), strict=True)):
                    found, reason = T.restored(transcript, duration, islice(words, n))
                    made += [(crop, i, *w, None) for i, w in enumerate(found)] if reason is None else [(crop, 0, None, None, None, reason)]
                if made:
                    crop, *columns = zip(*made, strict=True)
                    own = [c.cast(f.type) for c, f in zip(some.select(keys).take(pa.array(crop)).columns, kind, strict=False)]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, f.type) for c, f in zip(columns, list(kind)[len(keys) :], strict=True)]], schema=kind)

    return rows.mapInArrow(run, schema)


def native_turns(finals: DataFrame, keys: list[str]) -> DataFrame:
    """Turns of each final from its tagged words, or the final itself without a speaker if anything about the words is wrong.

    finals: keys, text, start_s, end_s, words (array of text, start_s, end_s, speaker).
    Every character of the text belongs to one turn; a turn ends at the next
    one's first word at the latest.
    """
    rows = once(finals.select(*keys, "text", "start_s", "end_s", "words"), _said=T.tagged_runs(F.col("text"), F.col("words"), F.col("start_s")))

    def turn(r: Column, i: Column) -> Column:
        after = F.get("_said.runs", i + 1)
        said = F.substr(F.col("text"), r["begin"], F.coalesce(after["begin"], F.length("text") + 1) - r["begin"])
        begin, end = F.greatest(F.col("start_s").cast("double"), r["start"]), F.least(F.col("end_s").cast("double"), r["stop"], after["start"])
        return F.struct(i.cast("long").alias("pos"), begin.alias("start_s"), end.alias("end_s"), said.alias("text"), formats.speaker_label(r["speaker"]).alias("speaker"))

    rows = once(rows, _turns=F.transform("_said.runs", turn))
    fits = (F.size("words") > 0) & ~F.col("_said.wrong") & (T.strip(F.substr(F.col("text"), F.col("_said.at"))) == "") & F.forall("_turns", lambda t: t["end_s"] > t["start_s"])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), F.col("text").alias("text"), F.lit("").alias("speaker")))
    made = rows.select(*keys, F.inline(F.when(F.coalesce(fits, F.lit(False)), F.col("_turns")).otherwise(whole)))
    return made.withColumn("text", T.strip("text"))
