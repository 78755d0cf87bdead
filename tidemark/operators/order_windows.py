"""Order statistics of sliding frames in one sorted pass.

A frame is the `window` rows that end `shift` rows before the current one (shift 0: with it). A task
streams the rows of a series in order and keeps the frame's values as a sorted list: a row costs two
binary searches and moves of at most 8 x window bytes, and quantiles, ranks and the median distance
are read from the list by place or by a further binary search. So time is linear in the rows, and
memory is one frame and one batch. Long series are cut into segments that begin with the rows that
their first frame needs, so one hot series spreads over tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Frame:
    """The values of a frame in order."""

    def __init__(self, window: int, shift: int):
        self.window, self.shift = window, shift
        self.rows: deque[float] = deque(maxlen=window + shift)  # missing values are NaN
        self.a: list[float] = []

    def _add(self, x: float) -> None:
        if x == x:
            insort(self.a, x)

    def _drop(self, x: float) -> None:
        if x == x:
            del self.a[bisect_left(self.a, x)]

    def come_to(self, x: float) -> None:
        """Move the frame to the row of value x."""
        if self.shift == 0:
            self._add(x)
            if len(self.rows) == self.window:
                self._drop(self.rows[0])
        elif len(self.rows) >= self.shift:
            self._add(self.rows[-self.shift])
            if len(self.rows) == self.window + self.shift:
                self._drop(self.rows[0])
        self.rows.append(x)

    def linear(self, p: float) -> float:
        """The quantile between neighbouring values, as numpy's default."""
        at = (len(self.a) - 1) * p
        i = int(at)
        low = self.a[i]
        return low if i + 1 >= len(self.a) else low + (self.a[i + 1] - low) * (at - i)

    def inverted(self, p: float) -> float:
        """The least value with a share of at least p up to it."""
        return self.a[max(math.ceil(round(len(self.a) * p, 9)), 1) - 1]

    def rank(self, x: float) -> float:
        """Percentage of the values that are at most x."""
        return 100.0 * bisect_right(self.a, x) / len(self.a)

    def _distance(self, mid: float, k: int) -> float:
        """The k-th least distance from mid (from 0): the k + 1 nearest values lie side by side."""
        low, high, a = 0, len(self.a) - k - 1, self.a
        while low < high:
            m = (low + high) // 2
            if mid - a[m] > a[m + k + 1] - mid:
                low = m + 1
            else:
                high = m
        return max(mid - a[low], a[low + k] - mid)

    def median_distance(self, mid: float) -> float:
        n = len(self.a)
        up = self._distance(mid, n // 2)
        return up if n % 2 else (self._distance(mid, n // 2 - 1) + up) / 2


def _segments(rows: DataFrame, by: list[str], order: list[str], context: int, length: int) -> DataFrame:
    """rows with _first (is it the first row of its segment?) and _own (or only read ahead of the next one?), each segment in order in one partition."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = F.col("_pos").cast("long")
    own = F.floor((at - 1) / length)
    r = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    # the rows at a segment's end are also read ahead of the next one, if there is one
    follows = (at > (own + 1) * length - context) & (F.col("_last") > (own + 1) * length)
    r = r.withColumn("_seg", F.explode(F.when(follows, F.array(own, own + 1)).otherwise(F.array(own))))
    r = r.withColumn("_first", at == F.greatest(F.lit(1), F.col("_seg") * length - context + 1)).withColumn("_own", own == F.col("_seg")).drop("_last")
    r = r.repartition(*by, "_seg").sortWithinPartitions(*by, "_seg", "_pos")
    return r


def sliding(rows: DataFrame, by: list[str], order: list[str], value: str, window: int, shift: int = 1, linear: dict[str, float] | None = None, inverted: dict[str, float] | None = None, count: str | None = None, rank: str | None = None, robust_z: str | None = None, segment: int | None = None) -> DataFrame:
    """rows with columns for statistics of the frame's non-null values: `linear` and `inverted` name quantiles by
    level, `count` their number, `rank` the percentage of them up to the row's own value, `robust_z` its distance
    from their median over max(1.4826 x median distance, 1e-8). Null where the frame (or the own value) is empty.

    A row whose order is equal to another's is placed by its value; NaN counts as missing.
    segment: rows of a series that one task reads in a go; at least 16 frames by default."""
    linear, inverted = linear or {}, inverted or {}
    context = window + shift
    length = max(segment or 16 * context, context)
    names = [*linear, *inverted, *[n for n in (count, rank, robust_z) if n]]
    r = _segments(rows, by, [*order, value], context, length)
    place = {c: r.columns.index(c) for c in ("_first", "_own", value)}
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields], *[f"`{n}` double" for n in names]])

    def stats(f: Frame, x: float) -> list[float]:
        out = [math.nan] * len(names)
        n = len(f.a)
        if n:
            out[: len(linear) + len(inverted)] = [*[f.linear(p) for p in linear.values()], *[f.inverted(p) for p in inverted.values()]]
        k = len(linear) + len(inverted)
        if count:
            out[k], k = float(n), k + 1
        if rank:
            out[k], k = f.rank(x) if n and x == x else math.nan, k + 1
        if robust_z and n and x == x:
            mid = f.linear(0.5)
            out[k] = (x - mid) / max(1.4826 * f.median_distance(mid), 1e-8)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Frame(window, shift)
        for batch in batches:
            first, mine = (batch.column(place[c]).to_pylist() for c in ("_first", "_own"))
            values = batch.column(place[value]).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            out = []
            for new, keep, x in zip(first, mine, values):
                if new:
                    f = Frame(window, shift)
                f.come_to(x)
                if keep:
                    out.append(stats(f, x))
            kept = batch.filter(pa.array(mine, pa.bool_()))
            table = np.array(out, np.float64).reshape(len(out), len(names))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(table[:, j], from_pandas=True) for j in range(len(names))]], names=[*batch.schema.names, *names])

    return r.mapInArrow(run, schema).drop("_pos", "_seg", "_first", "_own")


def sliding_means(rows: DataFrame, by: list[str], order: list[str], values: list[str], window: int, shift: int = 1, segment: int | None = None) -> DataFrame:
    """rows with n_<value> (bigint) and mean_<value> of each value's frame; nulls are left out, an empty frame's mean is null.

    Each frame is added up anew, as differences of running sums lose digits and carry a NaN along; numpy adds the
    frames of a batch at once. segment: rows of a series that one task reads in a go; at least 16 frames by default."""
    context = window + shift
    r = _segments(rows, by, order, context, max(segment or 16 * context, context))
    place = {c: r.columns.index(c) for c in ("_first", "_own", *values)}
    names = [f"{a}_{v}" for v in values for a in ("n", "mean")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields], *[f"`{n}` {'bigint' if k % 2 == 0 else 'double'}" for k, n in enumerate(names)]])
    behind = window + shift - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, there = np.zeros((len(values), behind)), np.zeros((len(values), behind), np.int64)  # the rows before the batch
        for batch in batches:
            first, mine = (batch.column(place[c]).to_numpy(zero_copy_only=False) for c in ("_first", "_own"))
            cols = [batch.column(place[v]) for v in values]
            new = np.array([c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in cols])
            known = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in cols]).astype(np.int64)
            cuts = [0, *np.flatnonzero(first)[np.flatnonzero(first) > 0].tolist(), batch.num_rows]
            n, total = np.empty_like(known), np.empty_like(new)
            for a, b in zip(cuts, cuts[1:]):
                if b > a and first[a]:
                    x, there = np.zeros((len(values), behind)), np.zeros((len(values), behind), np.int64)
                x, there = np.concatenate([x, new[:, a:b]], 1), np.concatenate([there, known[:, a:b]], 1)
                count = np.concatenate([np.zeros((len(values), 1), np.int64), there.cumsum(1)], 1)
                n[:, a:b] = count[:, window : window + b - a] - count[:, : b - a]
                total[:, a:b] = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, : b - a].sum(-1)
                x, there = x[:, x.shape[1] - behind :], there[:, there.shape[1] - behind :]
            keep = mine.astype(bool)
            kept = batch.filter(pa.array(keep))
            out = []
            for k in range(len(values)):
                count = n[k][keep]
                with np.errstate(invalid="ignore"):
                    out += [pa.array(count), pa.array(total[k][keep] / np.maximum(count, 1), mask=count == 0)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *out], names=[*batch.schema.names, *names])

    return r.mapInArrow(run, schema).drop("_pos", "_seg", "_first", "_own")
