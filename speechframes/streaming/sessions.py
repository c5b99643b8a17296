"""Streaming twins of the session operators.

Rows of a session are folded in order by the same step functions as the batch
jobs; the state is one small JSON value for each session, kept by Spark. A
session ends when the watermark passes its last row by the idle time: what is
left comes out and the state goes. Rows later than the watermark are dropped
by Spark and counted among its metrics.

Idle times run on event time, so a replay gives the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from speechframes.functions import text as T
from speechframes.operators import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def idle_recordings(chunks: DataFrame, keys: list[str], idle: str, late: str, ts: str = "ts") -> DataFrame:
    """Recordings closed after more than ``idle`` without a chunk."""
    made = chunks.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, idle).alias("w")).agg(F.sum("n_samples").alias("total_samples"), F.count("*").alias("n_chunks"))
    return made.select(*keys, F.col("w.start").alias("first_ts"), (F.col("w.end") - F.expr(f"INTERVAL {idle}")).alias("last_ts"), "total_samples", "n_chunks")


class Fold(StatefulProcessor):
    """Folds each key's rows in order; an event-time timer ends idle keys."""

    def __init__(self, keys, order, start, step, finish, idle_ms: int, columns: list[str], ts: str):
        self.keys, self.order, self.start, self.step, self.finish = keys, order, start, step, finish
        self.idle_ms, self.columns, self.ts = idle_ms, columns, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def _rows(self, key, made: Iterator[dict]) -> Iterator[Row]:
        named = dict(zip(self.keys, key, strict=True))
        for found in made:
            values = {**named, **found}
            yield Row(**{c: values[c] for c in self.columns})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        # within a micro-batch the rows of a key come in any order; nulls are first, as in a batch's sort
        batch = sorted((r.asDict() for r in rows), key=lambda r: [(r[o] is not None, r[o]) for o in self.order])
        out = [made for row in batch for made in self.step(state, row)]
        last = max([state.get("_last", 0), *(int(r[self.ts].timestamp() * 1000) for r in batch)])
        self.state.update((json.dumps({**state, "_last": last}),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out = list(self.finish(json.loads(self.state.get()[0]))) if self.state.exists() else []
        self.state.clear()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, finish: Callable, schema: str, late: str, idle_ms: int, ts: str = "ts") -> DataFrame:
    """The streaming form of ``operators.ordered.fold_sessions``; needs the RocksDB state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]
    return rows.withWatermark(ts, late).groupBy(*keys).transformWithState(statefulProcessor=Fold(keys, order, start, step, finish, idle_ms, columns, ts), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def slice_step(size: int) -> Callable:
    def step(state: dict, row: dict) -> Iterator[dict]:
        left = int(row["n_samples"])
        while left:
            taken = min(left, size - state["have"])
            state["have"] += taken
            left -= taken
            if state["have"] == size:
                yield {"slice_index": state["index"], "n_samples": size, "base_sample": state["index"] * size, "flush_reason": "slice"}
                state["index"], state["have"] = state["index"] + 1, 0

    return step


def slice_finish(size: int) -> Callable:
    def finish(state: dict) -> Iterator[dict]:
        if state["have"]:
            yield {"slice_index": state["index"], "n_samples": state["have"], "base_sample": state["index"] * size, "flush_reason": "idle"}

    return finish


def slices(chunks: DataFrame, keys: list[str], key_schema: str, size: int, late: str, idle_ms: int, order: list[str] = ("seq",)) -> DataFrame:
    """Tumbling slices of ``size`` samples as they fill; the tail once the session is idle."""
    schema = f"{key_schema}, slice_index long, n_samples long, base_sample long, flush_reason string"
    return fold_stream(chunks, keys, list(order), lambda: {"index": 0, "have": 0}, slice_step(size), slice_finish(size), schema, late, idle_ms)


def marker_step(state: dict, row: dict) -> Iterator[dict]:
    """A recording ends at its end marker; a marker without audio before it is ignored."""
    if row["end_marker"]:
        if state["n_chunks"]:
            yield {"recording": state["recording"], "n_chunks": state["n_chunks"], "total_samples": state["total"], "closed_by": "marker"}
            state |= {"recording": state["recording"] + 1, "n_chunks": 0, "total": 0}
        return
    state["n_chunks"] += 1
    state["total"] += int(row["n_samples"])


def marker_finish(state: dict) -> Iterator[dict]:
    if state["n_chunks"]:
        yield {"recording": state["recording"], "n_chunks": state["n_chunks"], "total_samples": state["total"], "closed_by": "idle"}


def marked_recordings(chunks: DataFrame, keys: list[str], key_schema: str, late: str, idle_ms: int, order: list[str] = ("seq",)) -> DataFrame:
    """Recordings closed by ordered end markers, or by idleness."""
    schema = f"{key_schema}, recording long, n_chunks long, total_samples long, closed_by string"
    return fold_stream(chunks, keys, list(order), lambda: {"recording": 0, "n_chunks": 0, "total": 0}, marker_step, marker_finish, schema, late, idle_ms)


def partial_updates(chunks: DataFrame, keys: list[str], key_schema: str, late: str, idle_ms: int, order: list[str] = ("seq",), **options) -> DataFrame:
    """Partials while a window fills, finals once its right context has come, the tail as a final when idle."""
    c = ordered.PARTIALS | options

    def step(state: dict, row: dict) -> Iterator[dict]:
        row = {**row, "n_samples": int(row["n_samples"]), "ts_us": int(row["ts_us"])}
        yield from ordered.partial_step(state, row, c)

    def finish(state: dict) -> Iterator[dict]:
        while state["ingested"] - state["commit"] >= c["least"]:
            end = min(state["commit"] + c["window"], state["ingested"])
            yield {"kind": "FINAL", "start_sample": state["commit"], "end_sample": end, "text": ""}
            state["commit"] = end

    return fold_stream(chunks, keys, list(order), ordered.partial_state, step, finish, f"{key_schema}, kind string, start_sample long, end_sample long, text string", late, idle_ms)


def novel_epochs(epochs: DataFrame, keys: list[str], key_schema: str, late: str, idle_ms: int, tail: int = 200, order: list[str] = ("epoch",), longest: int = 4_000) -> DataFrame:
    """Each epoch's new text. The state is the end of the session's transcript, at most 2 * ``longest``
    characters, where ``longest`` is the most that a hypothesis has; white space counts as single blanks."""

    def step(state: dict, row: dict) -> Iterator[dict]:
        made = ordered.echo_step(state, row["text"], longest, tail)
        yield {"epoch": int(row["epoch"]), "novel": made["novel"], "context": made["context"]}

    return fold_stream(epochs, keys, list(order), ordered.echo_state, step, lambda state: iter(()), f"{key_schema}, epoch long, novel string, context string", late, idle_ms)


class Freshness(StatefulProcessor):
    """One tenant's gallery: enrolled last, and loaded, with a timer that ends the load after its time to live."""

    def __init__(self, tenant: str, order: list[str], ttl_ms: int, columns: list[str]):
        self.tenant, self.order, self.ttl_ms, self.columns = tenant, order, ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gallery", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else ordered.freshness_state()
        before = state["loaded_us"]
        for row in sorted((r.asDict() for r in rows), key=lambda r: [(r[o] is not None, r[o]) for o in self.order]):
            for made in ordered.freshness_step(state, row, self.ttl_ms * 1000):
                values = {self.tenant: key[0], **{o: row[o] for o in self.order}, **made}
                yield Row(**{c: values[c] for c in self.columns})
        self.state.update((json.dumps(state),))
        if state["loaded_us"] != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state["loaded_us"] is not None:
                self.handle.registerTimer(state["loaded_us"] // 1000 + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the enrolled version stays; the next use loads it
        if self.state.exists():
            self.state.update((json.dumps({**json.loads(self.state.get()[0]), "loaded_us": None, "version": None}),))
        yield from ()

    def close(self) -> None:
        pass


def gallery_in_use(rows: DataFrame, key_schema: str, order: list[str], late: str, ttl_ms: int = 300_000, tenant: str = "tenant_id", ts: str = "ts") -> DataFrame:
    """The streaming form of ``operators.ordered.gallery_in_use``: the load that each use of a tenant's gallery sees.

    Join its version with the table of galleries to get the embeddings. State is a
    tenant's version and load stamp, so it stays small whatever the gallery.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = f"{key_schema}, {', '.join(f'{o} long' for o in order)}, loaded_us long, version long"
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]
    made = rows.withWatermark(ts, late).groupBy(tenant)
    return made.transformWithState(statefulProcessor=Freshness(tenant, order, ttl_ms, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def live_lines(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The live line of each session, for output mode update: the latest partial after the last final."""
    at = F.struct("ts", "seq")
    partial = F.col("kind") == "PARTIAL"
    made = updates.groupBy(*keys).agg(F.max(F.when(~partial, at)).alias("_final"), F.max(F.when(partial, F.struct(at.alias("at"), "text"))).alias("_partial"))
    return made.select(*keys, F.when(F.col("_final").isNull() | (F.col("_partial.at") > F.col("_final")), F.col("_partial.text")).alias("live_text"))


def publish(stream: DataFrame, path: str, checkpoint: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Append each key once, whatever is replayed. ``prepare`` runs on every micro-batch, so tables that it
    reads (a speaker gallery, say) are as fresh as the batch."""
    from speechframes.sources.sinks import append_once

    write = append_once(path, keys)
    return stream.writeStream.foreachBatch(lambda df, i: write(prepare(df) if prepare else df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
