"""Structured Streaming: bars from events, keyed upserts of arriving bars, a quality gate and safe resumption.

Sinks are versioned tables (:mod:`panelforge.sources.versioned`): a batch's rows and the stream's progress become visible in one step, a
batch that runs again is recognised, and readers pin a version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from panelforge.sources.versioned import Conflict, Table

DAY = 86_400_000_000
BARS = "kind string, sym long, start timestamp, open double, high double, low double, close double, n long, event_id long, ts timestamp, value double"
OUT = Row("kind", "start", "sym", "open", "high", "low", "close", "n", "event_id", "us", "value", "unknown")

#: Symbols are in so many groups by a hash; a window's state is a list a group. Checkpoints rely on it.
GROUPS = 256
#: Events, or bars, that a task holds at once, and bars in one piece of state or output.
HELD, PIECE = 1 << 19, 1 << 14
#: ``unknown``: 1 if the value is null, 2 if the id is null. An event without id comes after all others of its time.
EVENT = np.dtype([("sym", "<i8"), ("us", "<i8"), ("event_id", "<i8"), ("value", "<f8"), ("unknown", "<i1")])
BAR = np.dtype([("sym", "<i8"), ("open", "<f8"), ("open_us", "<i8"), ("open_id", "<i8"), ("high", "<f8"), ("low", "<f8"), ("close", "<f8"), ("close_us", "<i8"), ("close_id", "<i8"), ("n", "<i8")])
LAST_ID = np.iinfo(np.int64).max


class Refused(ValueError):
    """Rows that would repeat what is committed or leave out what lies between."""


def read_files(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """Files of a folder as a stream, all that are there at once or ``files`` a batch (oldest first)."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a window and group as blocks of bytes (``EVENT``), up to ``HELD`` events of a task at a time: state is handled by the block, not by the event."""

    def sent(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(own)
        start, grp = t["start"].to_numpy(), t["grp"].to_numpy()
        order = np.lexsort((grp, start))
        start, grp, events = start[order], grp[order], np.empty(len(order), EVENT)
        for c, unknown in (("sym", 0), ("us", 0), ("event_id", LAST_ID), ("value", np.nan)):
            events[c] = t[c].fill_null(unknown).to_numpy()[order]
        events["unknown"] = (t["value"].is_null().to_numpy() + 2 * t["event_id"].is_null().to_numpy())[order]
        first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (grp[1:] != grp[:-1])])
        ends = (np.r_[first, len(order)] * EVENT.itemsize).astype(np.int32)
        block = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(events)])
        return pa.RecordBatch.from_arrays([pa.array(start[first]), pa.array(grp[first]), block], ["start", "grp", "block"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield sent(held)
            held, n = [], 0
    if n:
        yield sent(held)


def _each(events: np.ndarray) -> np.ndarray:
    """A bar of each event."""
    own = np.empty(len(events), BAR)
    own["sym"], own["n"] = events["sym"], 1
    for c in ("open", "high", "low", "close"):
        own[c] = events["value"]
    for c in ("open", "close"):
        own[f"{c}_us"], own[f"{c}_id"] = events["us"], events["event_id"]
    return own


def _merged(own: np.ndarray) -> np.ndarray:
    """One bar a symbol from bars of one window in the order of their arrival; of equal times and ids the first that came counts. NaN is no value."""
    first = own[np.lexsort((own["open_id"], own["open_us"], own["sym"]))]
    last = own[np.lexsort((-np.arange(len(own)), own["close_id"], own["close_us"], own["sym"]))]
    at = np.flatnonzero(np.r_[True, first["sym"][1:] != first["sym"][:-1]])
    end, out = np.r_[at[1:], len(own)] - 1, first[at]
    out["high"], out["low"], out["n"] = np.fmax.reduceat(first["high"], at), np.fmin.reduceat(first["low"], at), np.add.reduceat(first["n"], at)
    for c in ("close", "close_us", "close_id"):
        out[c] = last[c][end]
    return out


def _pieces(own: np.ndarray) -> Iterator[np.ndarray]:
    return (own[k : k + PIECE] for k in range(0, len(own), PIECE))


class _Bars(StatefulProcessor):
    """The bars of each key (start, grp): kept until the watermark passes their window's end, then written, once.

    A batch only adds its own bars to the state; they are merged when the window closes, or when they are twice as many as after the last merge.
    """

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", "block binary")
        self.size = handle.getValueState("size", "n long, merged long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, _ = key
        end = (start + self.width) // 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            for r in rows:
                for e in _pieces(np.frombuffer(r.block, EVENT)):
                    yield OUT("late", start, e["sym"].copy(), [], [], [], [], [], *(e[c].copy() for c in ("event_id", "us", "value", "unknown")))
            return
        parts, n, most = [], 0, HELD
        for r in rows:
            parts.append(_each(np.frombuffer(r.block, EVENT)))
            n += len(parts[-1])
            if n >= most:
                parts = [_merged(np.concatenate(parts))]
                n, most = len(parts[0]), 2 * len(parts[0]) + HELD
        own, found = _merged(np.concatenate(parts)), self.size.get()
        if found is None:
            self.handle.registerTimer(end)
            n = merged = len(own)
        else:
            n, merged = found[0] + len(own), found[1]
        if n > 2 * merged + PIECE:
            own = _merged(np.concatenate([*self.held(), own]))
            n = merged = len(own)
            self.bars.put([(x.tobytes(),) for x in _pieces(own)])
        else:
            self.bars.appendList([(x.tobytes(),) for x in _pieces(own)])
        self.size.update((n, merged))

    def held(self) -> list[np.ndarray]:
        return [np.frombuffer(x[0], BAR) for x in self.bars.get()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        own = _merged(np.concatenate(self.held()))
        self.bars.clear()
        self.size.clear()
        for b in _pieces(own):
            yield OUT("bar", key[0], *(b[c].copy() for c in ("sym", "open", "high", "low", "close", "n")), [], [], [], [])

    def close(self) -> None:
        pass


def bars_from_events(events: DataFrame, width: int = DAY, late: str = "1 day") -> DataFrame:
    """Rows of ``BARS`` from events (``ts, user_id, event_id, value``): of kind `bar` when a window closes, once each, and of kind `late`.

    A window of ``width`` microseconds closes when the watermark (the latest ``ts`` of earlier batches less ``late``) reaches its end; an event
    of a closed window is a row of kind `late` with all that it holds. So bars and late events add up to all events, but for windows
    that are open at the end. Open and close are by (``ts``, ``event_id``); a null value counts in ``n`` alone; events without ``ts`` or ``user_id``
    are left out. State is the bars of each open window, at most about twice, in ``GROUPS`` lists a window.
    """
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("sym"), F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))
    # Behind the watermark the time goes on as a number, so late rows are not dropped before they reach the operator.
    timed = own.where("ts IS NOT NULL AND sym IS NOT NULL").withWatermark("ts", late).select("sym", F.unix_micros("ts").alias("us"), "event_id", "value")
    placed = timed.withColumn("start", F.floor(F.col("us") / width) * width)
    grouped = placed.select("start", F.pmod(F.xxhash64("sym"), F.lit(GROUPS)).cast("int").alias("grp"), "sym", "us", "event_id", "value")
    raw = "kind string, start long, sym array<long>, open array<double>, high array<double>, low array<double>, close array<double>, n array<long>, event_id array<long>, us array<long>, value array<double>, unknown array<tinyint>"
    out = grouped.mapInArrow(_blocks, "start long, grp int, block binary").groupBy("start", "grp").transformWithState(_Bars(width), raw, "append", "eventtime")
    many = ("sym", "open", "high", "low", "close", "n", "event_id", "us", "value", "unknown")
    rows = out.select("kind", F.timestamp_micros("start").alias("start"), F.inline(F.arrays_zip(*many)))
    known = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    whole = [F.when(F.col("unknown").bitwiseAND(bit) == 0, F.col(c)).alias(c) for c, bit in (("event_id", 2), ("value", 1))]
    return rows.select("kind", "sym", "start", *known, "n", whole[0], F.timestamp_micros("us").alias("ts"), whole[1])


def fresh(rows: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Rows without repetitions of ``keys`` within the watermark on ``ts``; rows later than it go."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def quality_split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and, with a ``reason``, rejected ones."""
    reason = F.when(F.col("sym").isNull(), "no symbol").when(F.col("ts").isNull(), "no time").when(~F.coalesce(F.col("value") > 0, F.lit(False)), "bad value")
    marked = batch.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def commit_into(table: Table, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None, next_of: Callable[[object], object] | None = None):
    """A ``foreachBatch`` function: append each batch to ``table`` and note, in the same manifest, how far stream ``name`` has come.

    A batch that the same query has committed before (it failed between the commit and its own checkpoint) is passed over. With ``order``, a
    column whose values only grow, a batch with rows at or before the last committed value is refused, as it is after a restart without
    the old checkpoint; with ``next_of``, which gives the value that has to follow, a batch that begins beyond it is refused. Refusals raise
    :class:`Refused` and commit nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        query = table.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or name
        own, part, parts = prepare(batch), None, None
        while True:
            m = table.manifest()
            done = m["streams"].get(name)
            if done and done["query"] == query and number <= done["batch"]:
                return
            last = done["last"] if done else None
            if part is None:
                if parts is None:
                    parts = table.written(own)
                span = [] if order is None else [F.min(order).cast("string").alias("first"), F.max(order).cast("string").alias("last")]
                part = table.spark.read.schema(own.schema).parquet(*[f"{table.path}/{p['folder']}" for p in parts]).agg(F.count(F.lit(1)).alias("n"), *span).first() if parts else None
            n = part.n if part else 0
            if n and order:
                if last is not None and part.first <= last:
                    raise Refused(f"stream {name}: rows of {part.first}, but all up to {last} is committed")
                if last is not None and next_of and (due := next_of(last)) is not None and part.first > str(due):
                    raise Refused(f"stream {name}: rows begin at {part.first}, but {due} has to follow {last}")
            streams = m["streams"] | {name: {"query": query, "batch": number, "last": part.last if n and order else last, "rows": n + (done["rows"] if done else 0)}}
            try:
                table.commit(m["version"], m["parts"] + (parts if n else []), own.schema, f"{name} {number}", streams)
                return
            except Conflict:
                continue  # another stream or a compaction was quicker; the written rows are still right

    return run


def folded(rows: DataFrame, keys: list[str], latest: list[str], seq: str, added: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: of ``latest`` the values at the highest ``seq``, of ``added`` the sums. Folding again changes nothing, so it also compacts."""
    own = rows.groupBy(*keys).agg(F.max_by(F.struct(*latest, seq), F.col(seq)).alias("_r"), *(F.sum(c).alias(c) for c in added))
    return own.select(*keys, *(F.col(f"_r.{c}") for c in (*latest, seq)), *added)


def gate_into(good_path: str, rejected_path: str):
    """A ``foreachBatch`` function with two sinks; a batch that runs again replaces its own files."""

    def run(batch: DataFrame, number: int) -> None:
        good, rejected = quality_split(batch)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return run


def state_rows(query: StreamingQuery) -> int:
    """Rows that the run's stateful steps hold after its last batch."""
    done = [p for p in query.recentProgress if p["stateOperators"]]
    return sum(s["numRowsTotal"] for s in done[-1]["stateOperators"]) if done else 0


def late_rows(query: StreamingQuery) -> int:
    """Rows that the run's stateful steps dropped as later than the watermark (after partial aggregation, a row per group and task)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def run_available(df: DataFrame, checkpoint: str, sink=None, path: str | None = None, mode: str = "append", partitions: int | None = None) -> StreamingQuery:
    """Process what is there and stop; the next run resumes from the checkpoint. ``mode`` is for a ``sink``; files are appended.

    State is kept in RocksDB, so it may outgrow an executor's memory. It has as many partitions as shuffles have, or ``partitions`` if these are
    fewer: each is opened and committed in every batch, whatever it holds. The first run of a checkpoint settles their number.
    """
    provider, shuffled = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in (provider, shuffled)}
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.outputMode(mode) if sink else writer
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(shuffled, min(int(before[shuffled]), partitions or int(before[shuffled])))
    try:
        query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", path).outputMode("append").start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    return query
