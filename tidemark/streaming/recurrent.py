"""Stateful recurrences: the same step function in batch and in Structured Streaming.

A local-level filter: prior variance grows by q; an observation moves the level
by its gain; innovations are clipped at three robust scales once `least` of the
last `window` are known. The first observation starts the level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series string, event_id long, x double, before double, level double, gain double"
STATE = "level double, variance double, started boolean, past array<double>"


@dataclass
class LocalLevel:
    q: float = 0.05
    window: int = 60
    least: int = 20
    level: float = 0.0
    variance: float = 1.0
    started: bool = False
    past: list[float] = field(default_factory=list)

    def step(self, x: float | None) -> tuple[float | None, float]:
        """(level after x, gain); a missing x only widens the variance."""
        if x is None or not math.isfinite(x):
            if self.started:
                self.variance += self.q
            return None, 0.0
        if not self.started:
            self.level, self.started = x, True
            return self.level, 1.0
        innovation = raw = x - self.level
        if len(self.past) >= self.least:
            mid = _median(self.past)
            scale = max(1.4826 * _median([abs(v - mid) for v in self.past]), 0.01)
            innovation = max(-3 * scale, min(3 * scale, raw))
        prior = self.variance + self.q
        gain = prior / (prior + 1)
        self.level += gain * innovation
        self.variance = (1 - gain) * prior
        self.past = (self.past + [raw])[-self.window :]
        return self.level, gain


def _median(values: list[float]) -> float:
    v, n = sorted(values), len(values)
    return v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2


def _rows(filter_: LocalLevel, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "event_id"])
    before, done = [], []
    for x in pdf["x"]:
        before.append(filter_.level if filter_.started else None)
        done.append(filter_.step(None if pd.isna(x) else float(x)))
    return pd.DataFrame({"series": pdf["series"], "event_id": pdf["event_id"], "x": pdf["x"], "before": before, "level": [a for a, _ in done], "gain": [b for _, b in done]})


def filtered(rows: DataFrame) -> DataFrame:
    """Batch form over (series, ts, event_id, x): one group a series, in time order.

    before is the level that was known before the row, for forecasts that must not see it.
    A series is one entity's history and has to fit a task; a longer one goes through
    filtered_stream, whose state is a few numbers."""
    return rows.groupBy("series").applyInPandas(lambda pdf: _rows(LocalLevel(), pdf), OUT)


def filtered_stream(rows: DataFrame) -> DataFrame:
    """Streaming form: the state of each series is carried between micro-batches.

    Events of a series must reach it in time order, across micro-batches too.
    """

    def run(key, frames, state: GroupState):
        f = LocalLevel()
        if state.exists:
            level, variance, started, past = state.get
            f = LocalLevel(level=level, variance=variance, started=started, past=list(past))
        pdf = pd.concat(list(frames), ignore_index=True)
        out = _rows(f, pdf)
        state.update((f.level, f.variance, f.started, f.past))
        yield out

    return rows.groupBy("series").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling window, closed by a watermark when streaming."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
