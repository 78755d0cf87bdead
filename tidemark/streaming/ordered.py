"""Folds over keyed streams whose rows may come out of order, with typed state and event-time timers.

Rows of a key wait in the state of its bucket (a hash of the key) until the watermark has passed them; then they are applied in order of
(time, tie) and leave the state. What stays for a key is the fold's own few numbers and the rows of the
last watermark delay. A timer at the earliest waiting row wakes a bucket without new rows. Rows at or before
the watermark when they arrive are too late: Spark drops them (numRowsDroppedByWatermark counts them), so
nothing that was given out is ever changed.

The state store must be RocksDB (`spark.sql.streaming.stateStore.providerClass`); `with_rocksdb` sets it
for the time of a call.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.sources.scratch import scratch_path
from tidemark.streaming.recurrent import LocalLevel

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(Protocol):
    """state: schema of what is kept; out: schema of the result without the key; step: (state or None, row) -> (state, result or None)."""

    state: str
    out: str

    def step(self, state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]: ...


@dataclass(frozen=True)
class LevelFold:
    """The local-level filter over (event_id, x): event_id, before, level, gain."""

    q: float = 0.05
    window: int = 60
    least: int = 20
    state: str = "level double, variance double, started boolean, past array<double>"
    out: str = "event_id bigint, before double, level double, gain double"

    def step(self, state, row):
        f = LocalLevel(self.q, self.window, self.least)
        if state is not None:
            f.level, f.variance, f.started, f.past = state[0], state[1], state[2], list(state[3])
        before = f.level if f.started else None
        x = row[1]
        level, gain = f.step(None if x is None or math.isnan(x) else float(x))
        return (f.level, f.variance, f.started, f.past), (row[0], before, level, gain)


@dataclass(frozen=True)
class AsofFold:
    """(decision, session, revision, value): a row with a decision asks for the value of the latest session, and of that
    the highest revision, among the rows before it; any other row is history. Of equal times history comes first by its tie."""

    state: str = "session bigint, revision bigint, value double"
    out: str = "decision bigint, session bigint, revision bigint, value double"

    def step(self, state, row):
        decision, session, revision, value = row
        if decision is None:
            return (max(state, (session, revision, value), key=lambda r: r[:2]) if state else (session, revision, value)), None
        return state, (decision, *(state or (None, None, None)))


@dataclass(frozen=True)
class TransitionFold:
    """(event_id, label): a result for each row whose label is not the one before: event_id, from_label, to_label, run (rows that the label had lasted)."""

    state: str = "label string, run bigint"
    out: str = "event_id bigint, from_label string, to_label string, run bigint"

    def step(self, state, row):
        if state is not None and state[0] == row[1]:
            return (row[1], state[1] + 1), None
        return (row[1], 1), (row[0], state[0] if state else None, row[1], state[1] if state else 0)


class InOrder(StatefulProcessor):
    """Applies a fold to the rows of each key in order of time, once the watermark has passed them.

    Each call of the state store costs about a millisecond, as much as some twenty rows, so keys share
    their state by buckets: a bucket is read and written once a batch, whatever the number of its keys."""

    def __init__(self, fold: Fold, key: str, key_type: str, payload: list[tuple[str, str]]):
        self.fold, self.columns = fold, [key, "us", "tie", *[c for c, _ in payload]]
        self.kept_schema = f"every array<struct<k: {key_type}, {_fields(fold.state)}>>"
        self.waiting_schema = f"every array<struct<k: {key_type}, us: bigint, tie: bigint{''.join(f', `{c}`: {t}' for c, t in payload)}>>"
        self.result = Row(key, *[c.split()[0] for c in fold.out.split(", ")])

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.kept_schema)
        self.waiting = handle.getValueState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new, place = [], None
        for r in rows:
            place = place or [r.__fields__.index(c) for c in self.columns]
            new.append(tuple(r[i] for i in place))
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, new: list[tuple], watermark: int) -> Iterator[Row]:
        waiting = self.waiting.get()
        held = [tuple(r) for r in waiting[0]] if waiting is not None else []
        every = sorted(held + new, key=lambda r: r[1:3])
        n = bisect_right(every, watermark * 1000, key=lambda r: r[1])
        if n:
            kept = self.kept.get()
            states: dict[Any, tuple] = {_same(r[0]): tuple(r) for r in kept[0]} if kept is not None else {}
            for r in every[:n]:
                k = _same(r[0])
                state, found = self.fold.step(states[k][1:] if k in states else None, r[3:])
                if state is not None:
                    states[k] = (r[0], *state)
                if found is not None:
                    yield self.result(r[0], *found)
            self.kept.update((list(states.values()),))
        rest = every[n:]
        if rest:
            if n or new:
                self.waiting.update((rest,))
            self.handle.registerTimer(-(-rest[0][1] // 1000) + 1)
        elif held:
            self.waiting.clear()


def _same(key):
    """The key for a dictionary, where NaN is one key as it is for Spark."""
    return key if key == key else "NaN"


def _fields(schema: str) -> str:
    """Columns as fields of a struct: name: type."""
    return ", ".join(f"{c.split(' ', 1)[0]}: {c.split(' ', 1)[1]}" for c in schema.split(", "))


def folded(rows: DataFrame, key: str, time: str, tie: str, payload: list[str], fold: Fold, delay: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """The fold's results over a stream (or a table), rows of a key in order of (time, tie) within the delay.

    buckets: groups of keys that share a state, fixed for the life of a checkpoint; some dozens of keys each are best, and
    each bucket's state has to fit a task."""
    types = dict(rows.dtypes)
    put = [(c, types[c]) for c in payload]
    at = F.col(time).cast("timestamp")
    own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    timed = rows.select(own.alias("_bucket"), F.col(key), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("tie"), *payload)
    timed = timed.withWatermark("ts", delay)
    return timed.groupBy("_bucket").transformWithState(InOrder(fold, key, types[key], put), f"`{key}` {types[key]}, {fold.out}", "Append", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """The RocksDB state store for queries that start within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def replayed(rows: DataFrame, key: str, time: str, tie: str, payload: list[str], fold: Fold, batches: int = 4, delay_seconds: int = 600, jitter_seconds: int = 0) -> DataFrame:
    """A table run through the streaming form in micro-batches, and what came out of it.

    Rows are dealt to batches by time plus a hashed jitter, so that batches overlap in time; with a jitter
    under the delay no row is late. A last row without a key, a year after all others, brings the watermark past them."""
    spark = rows.sparkSession
    base = scratch_path(spark, "replay")
    kind = dict(rows.dtypes)
    more = [c for c in payload if c not in (key, tie)]
    rows = rows.select(key, F.col(time).cast("timestamp").alias(time), tie, *more).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    us = F.unix_micros(time)
    seen = rows.agg(F.min(us).alias("a"), F.max(us).alias("b"), F.approx_count_distinct(key).alias("keys")).first()
    if seen.a is None:
        return spark.createDataFrame([], f"`{key}` {kind[key]}, {fold.out}")
    span = seen.b - seen.a + jitter_seconds * 1_000_000 + 1
    moved = us - seen.a + F.pmod(F.xxhash64(key, tie), F.lit(1000)) * (jitter_seconds * 1000)
    rows.withColumn("_b", F.floor(moved * batches / span).cast("int")).write.partitionBy("_b").parquet(f"{base}/rows")
    last = F.timestamp_micros(F.lit(seen.b + 366 * 86_400_000_000))
    end = spark.range(1).select(F.lit(None).cast(kind[key]).alias(key), last.alias(time), F.lit(0).cast(kind[tie]).alias(tie), *[F.lit(None).cast(kind[c]).alias(c) for c in more])
    dealt = spark.read.parquet(f"{base}/rows")
    buckets = max(1, seen.keys // 64)
    with with_rocksdb(spark):
        for b in range(batches + 1):  # what has arrived since the query ran last is its next micro-batch
            part = dealt.filter(F.col("_b") == b).drop("_b") if b < batches else end
            part.write.mode("append").parquet(f"{base}/arrived")
            stream = spark.readStream.schema(end.schema).parquet(f"{base}/arrived")
            out = folded(stream, key, time, tie, payload, fold, f"{delay_seconds} seconds", buckets)
            q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").filter(F.col(key).isNotNull())
