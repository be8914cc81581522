"""State machines and sinks on Structured Streaming.

A stream runs the same step functions as the batch operators. The machine's state is one JSON string per key in the state
store (or per group of a few hundred short keys); rows that wait for the watermark lie beside it in small blocks keyed by event time, so no state value grows with the table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import steps
from ..operators.folds import RowFold, by_row, records
from ..runtime import cut, scratch

#: Rows of one block of waiting rows, and event-time slots into which the lateness of a stream is cut.
BLOCK_ROWS, SLOTS = 1024, 16
#: Rows of one key that a slice of a replayed table may bring.
SLICE_ROWS = 20_000
#: Keys that one state holds where a replayed table has many, and states below which none is shared.
GROUP_KEYS, GROUPS = 256, 64

AT = "__us"  # event time of a row in microseconds
GROUP = "__group"  # number of the state that holds a row's key


def timed(stream: DataFrame, column: str, late: int, unit: str = "millis", shift: int = 0) -> DataFrame:
    """Give a stream its event time from an integer column; rows may come `late` units behind later ones.

    A stream's watermark begins at 1970, and rows up to it count as late: `shift` is added to counters that begin at zero or below.
    """
    at = {"millis": F.timestamp_millis, "micros": F.timestamp_micros}[unit](F.col(column).cast("long") + shift)
    out = stream.withColumn("__at", at).withColumn(AT, F.unix_micros("__at")).withWatermark("__at", f"{late} {'milliseconds' if unit == 'millis' else 'microseconds'}")
    out.slot_us = max(1, late * (1000 if unit == "millis" else 1) // SLOTS)
    return out


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as Arrow, in order, which a later schema check can read again."""
    batch = pa.record_batch([pa.array(rows[c].to_numpy(), from_pandas=True) for c in rows.columns], names=list(rows.columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(data).read_all()
    values = lambda c: c.to_pandas().to_numpy() if c.null_count else c.to_numpy()
    return pd.DataFrame({c: values(table.column(c)) for c in table.column_names})


class Machine(StatefulProcessor):
    """Folds the rows of a key in event-time order once the watermark has passed them.

    State of a key: `machine`, one value of the machine's state, the index of the blocks that wait, the timer, and up to BLOCK_ROWS waiting rows; `waiting`, a map from
    (slot of event time, block number) to as many rows. Rows beyond BLOCK_ROWS go to the map; a batch only adds blocks there and a passed watermark only takes whole
    slots out (rows of the slot that it cuts stay), so every value is bounded, however many rows wait. An event-time timer stands at the
    first row that waits, or where `idle` asks to be woken.
    """

    def __init__(self, columns, keys, order, run: Callable, start, names, idle: Callable | None, slot: int):
        self.columns = list(columns)
        self.keys, self.order, self.run, self.start, self.names, self.idle, self.slot = list(keys), list(order), run, json.dumps(start), list(names), idle, slot

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, blocks string, number bigint, timer bigint, recent binary")
        self.waiting = handle.getMapState("waiting", "slot bigint, block bigint", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if any(pd.isna(k) for k in key) or GROUP in self.columns and key[-1] < 0:  # a row without key only moves the watermark
            return
        yield from self._fold(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._fold(key, (), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _fold(self, key, rows, mark_ms: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        mark = mark_ms * 1000
        state, blocks, number, timer, recent = self.machine.get() or (self.start, "[]", 0, None, None)
        if expired is not None and timer not in (None, expired):  # a later call has set another timer, which will come
            return
        blocks, now, timer = [tuple(b) for b in json.loads(blocks)], json.loads(state), None if timer == expired else timer
        recent = _unpacked(bytes(recent)) if recent else None
        for pdf in rows:
            pdf.columns = self.columns
            pdf = pdf.drop(columns=["__at", GROUP], errors="ignore")
            recent = pdf if recent is None else pd.concat([recent, pdf], ignore_index=True)
            if len(recent) > BLOCK_ROWS:
                for slot, part in recent.groupby(recent[AT] // self.slot):
                    for at in range(0, len(part), BLOCK_ROWS):
                        self.waiting.updateValue((int(slot), number), (_packed(part.iloc[at:at + BLOCK_ROWS]),))
                        blocks.append((int(slot), number))
                        number += 1
                recent = None
        due = [b for b in sorted(blocks) if b[0] * self.slot <= mark]
        blocks = [b for b in blocks if b[0] * self.slot > mark]
        while due or recent is not None and len(recent) and recent[AT].min() <= mark:
            parts, upto = [], due[0][0] if due else None
            while due and (due[0][0] == upto or sum(map(len, parts)) < BLOCK_ROWS):  # whole slots, about a block of rows at a time
                upto = due[0][0]
                parts.append(_unpacked(bytes(self.waiting.getValue(due[0])[0])))
                self.waiting.removeKey(due.pop(0))
            if recent is not None:
                own = recent[AT] < (upto + 1) * self.slot if due else recent[AT] <= mark
                parts.append(recent if own.all() else recent[own])
                recent = None if own.all() else recent[~own]
            pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            passed = pdf[AT] <= mark
            ready, rest = (pdf, pdf[:0]) if passed.all() else (pdf[passed], pdf[~passed])
            for at in range(0, len(rest), BLOCK_ROWS):
                part = rest.iloc[at:at + BLOCK_ROWS]
                self.waiting.updateValue((int(mark // self.slot), number), (_packed(part),))
                blocks.append((int(mark // self.slot), number))
                number += 1
            if len(ready):
                now, out = self.run(now, ready.sort_values(self.order, kind="stable").reset_index(drop=True))
                yield self._rows(key, out)
        recent = None if recent is None or not len(recent) else recent
        waits = [max(s * self.slot, mark + 1) for s, _ in blocks] + ([int(recent[AT].min())] if recent is not None else [])
        first = min(waits) if waits else None
        if self.idle and first is None:
            now, out, first = self.idle(now, mark)
            if out:
                yield self._rows(key, pd.DataFrame(out, columns=self.names))
        if first is not None:
            wake = max(-(-first // 1000), mark_ms + 1)
            if wake != timer:
                self.handle.registerTimer(wake)
                timer = wake
        self.machine.update((json.dumps(now), json.dumps(blocks), number, timer, None if recent is None else _packed(recent)))

    def _rows(self, key, out: pd.DataFrame) -> pd.DataFrame:
        out = out[self.names].copy()
        if out.isna().to_numpy().any():
            out = out.astype(object).where(out.notna(), None)
        for i, c in enumerate(self.keys):
            out.insert(i, c, key[i])
        return out


def shared(run: Callable, keys, start, names) -> Callable:
    """`run` over the rows of several keys, sorted by key: the state is a dict of one state a key, the output rows begin with their key."""
    keys, blank = list(keys), json.dumps(start)

    def fold(states, pdf):
        pdf = pdf.dropna(subset=keys)
        values = [pdf[c].to_numpy() for c in keys]
        at = [0, *(np.flatnonzero(reduce(np.logical_or, [v[1:] != v[:-1] for v in values])) + 1).tolist(), len(pdf)] if len(pdf) else [0]
        frames, made, rows = [], [], records(pdf)
        for lo, hi in pairwise(at):
            key = [v[lo:lo + 1].tolist()[0] for v in values]
            name = json.dumps(key, default=str)
            state = states[name] if name in states else json.loads(blank)
            if isinstance(run, RowFold):
                for row in islice(rows, hi - lo):
                    state, out = run.step(state, row)
                    made.extend((*key, *o) for o in out)
            else:
                state, out = run(state, pdf.iloc[lo:hi].reset_index(drop=True))
                frames.append(out.assign(**dict(zip(keys, key))))
            states[name] = state
        return states, pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(made, columns=[*keys, *getattr(run, "names", names)])

    return fold


#: Where Spark keeps states made of several variables.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A batch then writes what it has changed, and the whole store only now and then.
CHANGES = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def stateful(stream: DataFrame, keys, order, run: Callable, start, schema: str, idle: Callable | None = None) -> DataFrame:
    """Fold a stream (made by `timed`) per key with `run(state, rows) -> (state, output rows)`.

    Rows wait in the state until the watermark has passed them and are then folded in event-time order, so neither the order of
    files nor the cut into micro-batches shows in the result. The state holds the machine's state and, in blocks, the rows of one key that are
    younger than the watermark. `idle(state, watermark) -> (state, output rows, next deadline)` is asked when no row waits (times in microseconds). `order` must begin
    with the event time or follow it: rows of different times are folded in the order of these.

    A call of Python costs milliseconds whatever a key brings. A replay of many short keys therefore says how many `groups` they make: a state then holds the machines of
    about GROUP_KEYS keys, and their rows wait together. With `idle` every key has its own.
    """
    keys, order = list(keys), list(order)
    for setting in (PROVIDER, CHANGES):
        stream.sparkSession.conf.set(*setting)
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in keys)
    slot, groups = getattr(stream, "slot_us", 1_000_000), None if idle else getattr(stream, "groups", None)
    # A null among the keys of a batch would make pandas read its whole numbers as doubles, which name no state: rows without key are group -1 and have 0 for such a key.
    known = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys])
    number = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(groups)) if groups else F.lit(0)
    whole = {k: F.coalesce(F.col(f"`{k}`"), F.lit(0).cast(stream.schema[k].dataType)) for k in keys if isinstance(stream.schema[k].dataType, T.IntegralType)}
    stream = stream.withColumns({GROUP: F.when(known, number).otherwise(-1).cast("long"), **whole})
    by = [GROUP] if groups else [*keys, GROUP]
    if groups:
        machine = Machine(stream.columns, [], [*keys, *order], shared(run, keys, start, names), {}, [*keys, *names], None, slot)
    else:
        machine = Machine(stream.columns, keys, order, run, start, names, idle, slot)
    plain = stream.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stream.columns)])  # names that any row type can hold
    return plain.groupBy(*[f"c{stream.columns.index(k)}" for k in by]).transformWithStateInPandas(machine, f"{kinds}, {schema}", "append", "eventTime")


class Replay:
    """A table as a stream of files in the shared folder.

    The table is written once, in slices of event time; each slice is a file or a folder that is moved into the stream's folder in one step, so it is one micro-batch (or as many as
    its files ask for, with `files` to one). Rows are in no order inside a slice, so they come at most one slice late, and the watermark follows by that much.
    There are so many slices that none brings more than `slice_rows` rows of one key (of `keys`; without them, of all), unless they share one time.
    More than GROUPS keys share states (see `stateful`): GROUP_KEYS to one, and so few that a group brings about `slice_rows` rows a slice at most.
    """

    def __init__(self, spark, d: DataFrame, name: str, order: str, unit: str = "millis", slices: int = 4, files: int | None = None, keys=(), slice_rows: int = SLICE_ROWS):
        self.spark, self.order, self.path, self.staged = spark, order, scratch(spark, name), scratch(spark, f"{name}-staged")
        d = cut(d)
        low, high = d.agg(F.min(order), F.max(order)).first()
        self.low, self.high = (low, high) if low is not None else (0, 0)
        span = self.high - self.low + 1
        while True:
            width = max(1, -(-span // slices))
            slot = F.floor((F.col(order) - self.low) / width)
            most = d.groupBy(*keys, slot.alias("__slice")).count().agg(F.max("count")).first()[0] or 0
            if most <= slice_rows or width == 1:
                break
            slices = min(16 * slices, max(slices + 1, -(-slices * most * 21 // (slice_rows * 20))))  # as many as even slices need and a twentieth more; some may be fuller
        self.late = width + 1
        self.slices = -(-span // width)
        self.keys, rows = d.select(*keys).groupBy(*keys).count().agg(F.count(F.lit(1)), F.sum("count")).first() if keys else (1, 0)
        staged = d.withColumn("__slice", slot)
        (staged if files else staged.hint("rebalance", "__slice")).write.partitionBy("__slice").parquet(self.staged)  # few files a slice, however many tasks
        self._fs().mkdirs(self._at(self.path))
        source = spark.readStream.schema(d.schema).option("recursiveFileLookup", "true")
        self.stream = timed((source.option("maxFilesPerTrigger", files) if files else source).parquet(self.path), order, self.late, unit, max(0, 1000 - self.low))
        if self.keys > GROUPS:
            self.stream.groups = min(self.keys, max(GROUPS, self.keys // GROUP_KEYS, rows // (self.slices * slice_rows)))
        self.states = getattr(self.stream, "groups", self.keys)
        self.columns = d.schema

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def feed(self, query) -> None:
        """Move the slices in, then two rows without key far ahead, which let the watermark pass all that waits."""
        for k in range(self.slices):
            folder = self._at(f"{self.staged}/__slice={k}")
            if self._fs().exists(folder):
                files = self._fs().listStatus(folder)
                whole, name = (files[0].getPath(), f"{k:06d}-{files[0].getPath().getName()}") if len(files) == 1 else (folder, f"{k:06d}")  # a stream lists one folder faster than hundreds
                self._fs().rename(whole, self._at(f"{self.path}/{name}"))
                query.processAllAvailable()
        for k in (4, 8):
            end = self.spark.range(0, 1, 1, 1).select(*[F.lit(self.high + k * self.late + 10_000_000_000 if f.name == self.order else None).cast(f.dataType).alias(f.name) for f in self.columns])
            end.write.mode("append").parquet(self.path)
            query.processAllAvailable()


#: Whether Spark runs a batch without rows when only the watermark has moved.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


#: Over how many stores a query spreads its states; each is opened and written in every batch, with rows or without.
STORES = "spark.sql.shuffle.partitions"


def _without_empty_batches(spark, start: Callable, states: int):
    """Start a query whose input always goes on: what a watermark has passed is folded in the next batch with rows, and the last two rows of a replay see to the rest.

    So a key is called once a slice, not once more for the watermark behind it. There are no more stores than `states`, but for a few that keep these apart.
    """
    before = {c: spark.conf.get(c) for c in (EMPTY_BATCHES, STORES)}
    spark.conf.set(EMPTY_BATCHES, "false")
    spark.conf.set(STORES, str(min(int(before[STORES]), max(8, states))))
    try:
        return start()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def to_table(stream: DataFrame, name: str, replay: Replay | None = None, mode="append") -> DataFrame:
    """Run all input into a Parquet table of the shared folder and read it back."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    w = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", scratch(spark, f"{name}-ckpt"))
    if replay is None:
        w.trigger(availableNow=True).start().awaitTermination()
    else:
        q = _without_empty_batches(spark, w.start, replay.states)
        try:
            replay.feed(q)
        finally:
            q.stop()
    return spark.read.schema(stream.schema).parquet(path)


def debounced(stream, keys, gap, releases=steps.RELEASES) -> DataFrame:
    return stateful(stream, keys, ["t", "name"], by_row(steps.debounce(gap, releases), ("t", "name")), None, "t bigint, name string")


def phases(stream, keys, open_label=None, **kw) -> DataFrame:
    step = steps.phase_tracker(**kw) if open_label is None else steps.open_tracker(open_label=open_label, **kw)
    start = [0, 0, 0, 0] if open_label is None else [[0, 0, 0, 0], 0]
    return stateful(stream, keys, ["n"], by_row(step, ("n", "stable", "phase")), start, "n bigint, stable int, phase int")


def gestures(stream, keys, stable_ms=120) -> DataFrame:
    return stateful(stream, keys, ["t", "id"], by_row(steps.gesture_events(stable_ms), ("t", "kind", "gesture", "held")), [steps.GESTURE_START, 0],
                    "t bigint, kind string, gesture int, held bigint")


def press_release(stream, keys, minimum) -> DataFrame:
    return stateful(stream, keys, ["t", "name"], by_row(steps.press_release(minimum), ("t", "name", "synthetic", "held", "hold_ok")), None,
                    "t bigint, name string, synthetic boolean, held bigint, hold_ok boolean")


def audited(stream, keys) -> DataFrame:
    return stateful(stream, keys, ["t"], by_row(steps.sequence_audit, ("t", "lost_before", "duplicate", "late")), None,
                    "t bigint, lost_before int, duplicate boolean, late boolean")


def accepted(stream, keys, strict=True) -> DataFrame:
    """Rows whose time passes the last accepted one; arrival order is the row id."""
    return stateful(stream, keys, ["id"], by_row(steps.drop_late(strict), ("t", "id")), None, "t bigint, id bigint")


def threshold_events(stream, keys, classes, thresholds, gap, releases=steps.RELEASES) -> DataFrame:
    """Rising edges against the previous frame, one winner per frame, debouncing. Rows: n and one column per class."""
    keep = steps.debounce(gap, releases)

    def step(state, r):
        before, last = state
        up = [(-r[c], i, c) for i, (c, t) in enumerate(zip(classes, thresholds)) if r[c] >= t and (before is None or before[i] < t)]
        last, out = keep(last, {"name": min(up)[2], "t": r["n"]}) if up else (last, [])
        return [[r[c] for c in classes], last], out

    return stateful(stream, keys, ["n"], by_row(step, ("t", "name")), [None, None], "t bigint, name string")


def calibrate_run(stream, keys, first_rows: int, channels, target=16.0) -> DataFrame:
    """The first rows of a device fit its scale (median |x| / 16); later rows leave scaled."""
    channels = list(channels)

    def run(state, pdf):
        scale, held = state
        x = pdf[channels].to_numpy(dtype=float)
        n = pdf["n"].to_numpy()
        if scale is None:
            take = min(len(x), first_rows - len(held))
            held, x, n = held + x[:take].tolist(), x[take:], n[take:]
            if len(held) >= first_rows:
                flat = pd.Series([abs(v) for r in held for v in r])
                scale, held = float(flat.median()) / target, []
        out = x / scale if scale else x[:0]
        return [scale, held], pd.DataFrame({"n": n[:len(out)], **{c: out[:, i] for i, c in enumerate(channels)}})

    return stateful(stream, keys, ["n"], run, [None, []], "n bigint, " + ", ".join(f"{c} double" for c in channels))


def gestures_with_timeout(stream, keys, limit_ms=1000) -> DataFrame:
    """Stable gesture per device; silence of `limit_ms` of event time forces none."""
    step = steps.gesture_frames(0)
    names = ("t", "kind", "gesture")

    def run(state, pdf):
        now, last = state
        out = []
        for r in pdf.to_dict("records"):
            if now[0] != 0 and last and r["t"] - last >= limit_ms:
                out.append((last + limit_ms, "forced", 0))
                now = list(steps.GESTURE_START)
            now, made = step(now, r)
            out += [(t, "frame", g) for t, _, g, _ in made]
            last = int(r["t"])
        return [now, last], pd.DataFrame(out, columns=names)

    def idle(state, mark):
        now, last = state
        if now[0] == 0 or not last:
            return state, [], None
        if (last + limit_ms) * 1000 > mark:
            return state, [], (last + limit_ms) * 1000
        return [list(steps.GESTURE_START), last], [(last + limit_ms, "forced", 0)], None

    return stateful(stream, keys, ["t", "id"], run, [list(steps.GESTURE_START), 0], "t bigint, kind string, gesture int", idle)


def hop_windows(d: DataFrame, ts: str, keys, size: str, hop: str, aggs, late: str | None = None) -> DataFrame:
    """Sliding event-time windows; the same call serves batch and stream (with a watermark)."""
    if late:
        d = d.withWatermark(ts, late)
    return d.groupBy(*keys, F.window(ts, size, hop).alias("w")).agg(*aggs)


def tumble(d: DataFrame, ts: str, keys, size: str, aggs, late: str | None = None) -> DataFrame:
    return hop_windows(d, ts, keys, size, size, aggs, late)


def gap_sessions(d: DataFrame, ts: str, keys, gap: str, aggs, late: str | None = None) -> DataFrame:
    """Sessions closed by silence."""
    if late:
        d = d.withWatermark(ts, late)
    return d.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)


def append_session(batch: DataFrame, kind: str, path: str, number: int) -> None:
    """Append one micro-batch of raw rows; the order is in sample_index, not in the files. A batch that is tried again overwrites itself."""
    batch.write.mode("overwrite").partitionBy("session_no").parquet(f"{path}/{kind}/batch={number}")


def batch_sink(stream: DataFrame, name: str, write: Callable, mode="append") -> None:
    """Run all available input through `write(batch, batch_id)`."""
    spark = stream.sparkSession
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def audit_split(stream: DataFrame, path: str, is_ok) -> None:
    """Every packet to the audit, only accepted packets onward. The batch id in the path makes a retried batch overwrite itself."""
    def write(batch, i):
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{path}/audit/batch={i}")
        kept.where(is_ok).write.mode("overwrite").parquet(f"{path}/accepted/batch={i}")
        kept.unpersist()
    batch_sink(stream, "audit-split", write)


def snapshots(stream: DataFrame, path: str, summarise: Callable) -> None:
    """Running aggregate; each batch writes its own snapshot, so a retried batch overwrites itself and the last one is current."""
    batch_sink(summarise(stream), "snapshots", lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}"), "complete")
