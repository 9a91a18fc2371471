"""Operators with state of their own over streams whose rows come out of order.

Rows wait in the state store, in slots of event time, until the watermark has passed the slot; a timer then hands them, each key's in order of time, to a fold, whose
own state of the key goes on to the next slot. So the result is that of the fold over all rows in order, whatever the order in which they came, as long as none is later than
the watermark allows (those are dropped, as by Spark's own windows). State is kept by RocksDB: what waits needn't fit in memory, and only what changes is saved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.recurrence import s4d_steps

#: What stands for a step that is missing.
_NO_STEP = -(1 << 62)
#: Rows from which on what slots hold is folded before further slots are read.
_FOLDED = 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which operators with timers need; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class Frames:
    """The fold of running_frame(): Welford's sums."""

    columns = "center double, scale double, z double"

    def start(self) -> tuple:
        return 0.0, 0.0, 0.0

    def step(self, values: np.ndarray, state: tuple) -> tuple[list[np.ndarray], tuple]:
        n, mean, m2 = state
        out = np.zeros((3, len(values)))
        for i, v in enumerate(values.tolist()):
            seen = math.isfinite(v)
            if seen:
                n += 1
                d = v - mean
                mean += d / n
                m2 += d * (v - mean)
            scale = math.sqrt(m2 / max(n, 1)) + 1e-5 + 1e-6 * abs(mean)
            out[:, i] = mean, scale, (v - mean) / scale if seen else 0.0
        out[2] = np.arcsinh(out[2])
        return list(out), (n, mean, m2)


class StateSpace:
    """The fold of state_space(): a diagonal filter's complex state, real parts before imaginary ones."""

    columns = "y double"

    def __init__(self, a, b, c, dt: float, skip: float):
        self.poles, self.dt, self.skip = [np.array(x, complex) for x in (a, b, c)], dt, skip

    def start(self) -> tuple:
        return (0.0,) * (2 * len(self.poles[0]))

    def step(self, values: np.ndarray, state: tuple) -> tuple[list[np.ndarray], tuple]:
        re, im = np.array(state, float).reshape(2, -1)
        y, x = s4d_steps(np.nan_to_num(values), *self.poles, self.dt, self.skip, re + 1j * im)
        return [y], (*x.real.tolist(), *x.imag.tolist())


class InOrder(StatefulProcessor):
    """Holds the rows of a bucket of keys by slots of event time and folds the slots that the watermark has passed, key by key. With idle, a key that had no row for longer
    starts from rest again, and its state goes when the watermark tells."""

    def __init__(self, fold, kind: str, key: str, ts: str, step: str, value: str, slot_ms: int, idle_ms: int | None):
        self.fold, self.kind, self.names, self.slot, self.idle = fold, kind, (key, ts, step, value), slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long, part long", f"key array<{self.kind}>, ts array<long>, step array<long>, value array<double>")
        self.parts = handle.getValueState("parts", "n long")
        self.state = handle.getValueState("state", f"key array<{self.kind}>, last array<long>, folded array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        name, ts, step, value = self.names
        part = before = self.parts.get()[0] if self.parts.exists() else 0
        told: set[int] = set()
        for pdf in rows:
            keys, values = pdf[name].to_numpy(object), pdf[value].astype(float).to_numpy()
            us = pdf[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
            slots, steps = us // (self.slot * 1000), pdf[step].fillna(_NO_STEP).to_numpy(np.int64)
            for slot in np.unique(slots).tolist():
                end = (slot + 1) * self.slot
                if end <= passed:
                    continue  # later than the watermark allows
                mine = slots == slot
                self.held.updateValue((slot, part), (keys[mine].tolist(), us[mine].tolist(), steps[mine].tolist(), values[mine].tolist()))
                told.add(end)
            part += 1
        for end in told:
            self.handle.registerTimer(end)
        if part > before:
            self.parts.update((part,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()  # all that it has passed goes with the first timer
        held = sorted(tuple(k) for k in self.held.keys())
        due = [k for k in held if (k[0] + 1) * self.slot <= passed]
        if not due and not self.idle:
            return
        width, folded = len(self.fold.start()), {}
        if self.state.exists():
            names, last, flat = self.state.get()
            folded = {k: (t, tuple(flat[i * width : (i + 1) * width])) for i, (k, t) in enumerate(zip(names, last))}
        gathered, taken = [], 0
        for i, at in enumerate(due):
            gathered.append(self.held.getValue(at))
            self.held.removeKey(at)
            taken += len(gathered[-1][1])
            if i + 1 == len(due) or taken >= _FOLDED and due[i + 1][0] > at[0]:  # whole slots
                yield self._fold(gathered, folded)
                gathered, taken = [], 0
        kept = {k: x for k, x in folded.items() if not self.idle or self._rest(x[0]) > passed}
        if kept:
            self.state.update((list(kept), [t for t, _ in kept.values()], [x for _, xs in kept.values() for x in xs]))
            if self.idle:
                self.handle.registerTimer(min(self._rest(t) for t, _ in kept.values()))
        elif folded:
            self.state.clear()

    def _fold(self, gathered: list, folded: dict) -> pd.DataFrame:
        """The fold's rows of slots that were held; folded (last time and state of each key) goes on."""
        keys = [k for piece in gathered for k in piece[0]]
        us, step, value = (np.concatenate([np.array(piece[i], kind) for piece in gathered]) for i, kind in ((1, np.int64), (2, np.int64), (3, float)))
        codes, names = pd.factorize(pd.Series(keys, dtype=object))
        order = np.lexsort((step, us, codes))
        codes, us, step, value = codes[order], us[order], step[order], value[order]
        outs = []
        bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for lo, hi in zip(bounds, bounds[1:]):
            name, mine = names[codes[lo]], us[lo:hi]
            last, state = folded.get(name, (int(mine[0]), self.fold.start()))
            cuts = [hi]
            if self.idle:
                fresh = np.diff(mine, prepend=last) > self.idle * 1000
                cuts = [*(lo + np.flatnonzero(fresh)).tolist(), hi]
                if fresh[0]:
                    cuts, state = cuts[1:], self.fold.start()
            for a, b in zip([lo, *cuts], cuts):
                if a > lo:
                    state = self.fold.start()
                out, state = self.fold.step(value[a:b], state)
                outs.append(out)
            folded[name] = int(mine[-1]), state
        columns = [np.concatenate(x) for x in zip(*outs)]
        frame = pd.DataFrame(dict(zip([self.names[0], self.names[2], *(c.split()[0] for c in self.fold.columns.split(", "))], [pd.Series(keys, dtype=object).iloc[order].reset_index(drop=True), pd.array(step, "Int64"), *columns])))
        frame[self.names[2]] = frame[self.names[2]].mask(frame[self.names[2]] == _NO_STEP)
        return frame

    def _rest(self, last: int) -> int:
        """From when on no row can come that goes on from one at last: the end of the slot in which the key has been idle for long enough."""
        return ((last // 1000 + self.idle) // self.slot + 1) * self.slot

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, fold, key: str, ts: str = "ts", step: str = "step", value: str = "value", late: str = "10 minutes", slot: int = 60, idle: int | None = None, buckets: int = 1024) -> DataFrame:
    """key, step and the fold's columns of each row, in order of ts, then step. Rows may come late by up to late; slot (seconds) is how much time is folded at once; after idle
    seconds without a row a key starts anew. Rows without a time or key are passed over, of equal times those without a step come first. Rows are given out once the watermark has passed their slot: closed() ends a bounded stream. Start it within rocksdb().

    Keys share state and timers by buckets of their hash, so that a call serves many keys: with one of its own for each, calls are most of the work. A task holds a bucket's rows of a slot and the
    folded state of its keys; let buckets grow with the keys. A stream that goes on from a checkpoint needs the number it began with."""
    kind = dict(stream.dtypes)
    processor = InOrder(fold, kind[key], key, ts, step, value, slot * 1000, idle * 1000 if idle else None)
    rows = stream.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value)).where(F.col(ts).isNotNull()).withWatermark(ts, late)
    schema = f"{key} {kind[key]}, {step} long, {fold.columns}"
    told = rows.where(F.when(F.col(ts).isNotNull(), F.col(key).isNotNull()))  # names ts, so as not to be pushed below the watermark, which is to see what closes the stream
    dealt = told.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").transformWithStateInPandas(processor, StructType.fromDDL(schema), "append", "eventTime")


def running_frame(stream: DataFrame, key: str, **how) -> DataFrame:
    """key, step, center, scale, z: each value in the frame of all values of its key up to and with it; rows in any order (see in_order)."""
    return in_order(stream, Frames(), key, **how)


def state_space(stream: DataFrame, key: str, a: list[complex], b: list[complex], c: list[complex], dt: float = 1.0, skip: float = 0.0, **how) -> DataFrame:
    """key, step, y: a diagonal state-space filter; a missing value counts as 0; rows in any order (see in_order)."""
    return in_order(stream, StateSpace(a, b, c, dt, skip), key, **how)


def closed(df: DataFrame, ts: str, by: str) -> DataFrame:
    """df and one row of nulls but for ts, which lies by (an interval) after the last: it lets the watermark of a replay pass all rows. It has no key, so operators pass over it, and comes last."""
    end = df.agg((F.max(ts) + F.expr(f"INTERVAL {by}")).alias(ts)).where(F.col(ts).isNotNull())
    return df.unionByName(end.select(*(F.col(c) if c == ts else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns)))
