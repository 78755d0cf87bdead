"""Models of one series, fitted for all entities by a grid in one sorted pass.

Entities are dealt to blocks of about BLOCK; a block's rows come ordered by position
in the series, so that one step of a recursion advances all of its entities and all
points of the grid as arrays. A task holds the state of one block, entities x grid x
states, whatever the length of the series, which are never gathered. There is one
shuffle, by block.

The models share three calls: `start(entities)`, `step(rows, x)` for the entities that
have a row at this position (x is NaN where the value is missing), and `done(horizon)`,
which gives the best grid point of each entity (the first among equals) and its forecasts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


class _Grid:
    """Sums of losses by entity and grid point; `names` are the parameters, `points` the grid."""

    names: tuple[str, ...] = ()

    def __init__(self, **grid: tuple[float, ...]):
        self.points = np.array(list(itertools.product(*[grid[n] for n in self.names])), np.float64)

    def start(self, entities: int) -> None:
        self.n, self.seen = np.zeros(entities, np.int64), np.zeros(entities, np.int64)
        self.loss, self.used = np.zeros((entities, len(self.points))), np.zeros((entities, len(self.points)))

    def best(self) -> np.ndarray:
        low = self.loss.min(axis=1, keepdims=True)
        return np.argmax(self.loss <= low + 1e-12 * np.abs(low), axis=1)


class Smoothing(_Grid):
    """Exponential smoothing with additive trend and season, in error-correction form.

    level' = level + trend + a e, trend' = trend + b e, season' = season + g e, for the error e of
    level + trend + season; a missing value counts as no error. It starts after the first `season`
    rows, of which a missing value counts as the mean of the others: level is their mean, seasons what
    lies over it, trend 0. Without any value among them there is no forecast. Losses are squared errors.
    """

    names = ("a", "b", "g")

    def __init__(self, season: int, a=(0.1, 0.3, 0.5, 0.7, 0.9), b=(0.0, 0.05, 0.2), g=(0.0, 0.1, 0.3)):
        super().__init__(a=a, b=b, g=g)
        self.season = season

    def start(self, entities):
        super().start(entities)
        self.first = np.full((entities, self.season), np.nan)
        self.level = self.trend = None
        shape = (entities, len(self.points))
        self.level, self.trend, self.seasons = np.zeros(shape), np.zeros(shape), np.zeros((*shape, self.season))

    def step(self, rows, x):
        n, (a, b, g) = self.n[rows], self.points.T
        early = n < self.season
        self.first[rows[early], n[early]] = x[early]
        full = rows[n == self.season - 1]
        if len(full):
            first = self.first[full]
            known = (~np.isnan(first)).sum(1)
            mean = np.where(known > 0, np.nansum(first, axis=1) / np.maximum(known, 1), np.nan)
            self.level[full] = mean[:, None]
            self.seasons[full] = np.where(np.isnan(first), 0.0, first - mean[:, None])[:, None, :]
        r, x, n = rows[~early], x[~early], n[~early]
        if len(r):
            slot = n % self.season
            flat, s = self.level[r] + self.trend[r], self.seasons[r, :, slot]
            e = np.nan_to_num(x[:, None] - flat - s)
            self.level[r], self.trend[r] = flat + a * e, self.trend[r] + b * e
            self.seasons[r, :, slot] = s + g * e
            self.loss[r] += e * e
            self.seen[r] += ~np.isnan(x)
        self.n[rows] += 1

    def done(self, horizon):
        k, i = self.best(), np.arange(len(self.n))
        h = np.arange(1, horizon + 1)
        slot = (self.n[:, None] + h - 1) % self.season
        out = self.level[i, k][:, None] + h * self.trend[i, k][:, None] + self.seasons[i[:, None], k[:, None], slot]
        out[self.n < self.season] = np.nan
        return k, self.loss[i, k], out


class Theta(_Grid):
    """The theta method: simple smoothing with weight a, and half the slope of the least-squares line as drift.

    level' = level + a (x - level) from the first value on; the forecast of h steps is
    level + slope / 2 (h - 1 + (1 - (1 - a)^n) / a), with n the number of values. Positions in the line
    count values only; losses are squared errors of one step of the smoothing.
    """

    names = ("a",)

    def __init__(self, a=tuple(k / 20 for k in range(1, 20))):
        super().__init__(a=a)

    def start(self, entities):
        super().start(entities)
        self.level, self.sums = np.zeros((entities, len(self.points))), np.zeros((entities, 2))

    def step(self, rows, x):
        rows, x = rows[~np.isnan(x)], x[~np.isnan(x)]
        n = self.n[rows]
        e = np.where(n[:, None] > 0, x[:, None] - self.level[rows], 0.0)
        self.level[rows] = np.where(n[:, None] > 0, self.level[rows] + self.points[:, 0] * e, x[:, None])
        self.loss[rows] += e * e
        self.sums[rows] += np.column_stack([x, (n + 1) * x])
        self.n[rows] += 1

    def done(self, horizon):
        k, i = self.best(), np.arange(len(self.n))
        n, a = self.n.astype(np.float64), self.points[k, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(n > 1, 12 * (self.sums[:, 1] - (n + 1) / 2 * self.sums[:, 0]) / (n * (n * n - 1)), 0.0)
            drift = (slope / 2)[:, None] * (np.arange(horizon) + ((1 - (1 - a) ** n) / a)[:, None])
        out = self.level[i, k][:, None] + drift
        out[self.n == 0] = np.nan
        return k, self.loss[i, k], out


class SeasonalArima(_Grid):
    """(p <= 1, d <= 1, q <= 1) x (0, 1, Q <= 1) of a season, by the exact likelihood of the Kalman recursion.

    z is the seasonal difference, and then the first difference if `first`; z - c follows
    phi on its last value and moving averages theta, seasonal THETA and their product. A z whose
    parts are missing is a step without an observation. The variance is concentrated out, so that
    the loss is n log(sum of v^2 / F / n) + sum of log F. Forecasts come back through the last values of
    the series; a missing one of those is taken from the forecast of its own step.
    """

    names = ("phi", "theta", "seasonal", "c")

    def __init__(self, season: int, phi=(0.0,), theta=(0.0,), seasonal=(0.0,), c=(0.0,), first: bool = False):
        super().__init__(phi=phi, theta=theta, seasonal=seasonal, c=c)
        self.season, self.first = season, first
        self.r = season + 2 if max(map(abs, seasonal)) > 0 else (2 if max(map(abs, theta)) > 0 else 1)
        points, r = self.points, self.r
        self.ma = np.zeros((len(points), r))
        self.ma[:, 0] = 1
        for col, at in ((1, 1), (2, season)):
            if r > at:
                self.ma[:, at] += points[:, col]
        if r > season + 1:
            self.ma[:, season + 1] += points[:, 1] * points[:, 2]
        self.t = np.zeros((len(points), r, r))
        self.t[:, 0, 0] = points[:, 0]
        self.t[:, np.arange(r - 1), np.arange(1, r)] = 1
        self.q = self.ma[:, :, None] * self.ma[:, None, :]
        eye = np.eye(r * r)
        self.p0 = np.stack([np.linalg.solve(eye - np.kron(t, t), q.ravel()).reshape(r, r) for t, q in zip(self.t, self.q)])

    def start(self, entities):
        super().start(entities)
        self.a = np.zeros((entities, len(self.points), self.r))
        self.p = np.tile(self.p0, (entities, 1, 1, 1))
        self.back = self.season + int(self.first)
        self.last = np.full((entities, self.back), np.nan)  # the last values, oldest first
        self.square, self.logs = np.zeros(self.loss.shape), np.zeros(self.loss.shape)

    def _differences(self, last, x):
        z = x - last[:, -self.season]
        return z - (last[:, -1] - last[:, 0]) if self.first else z

    def step(self, rows, x):
        z = self._differences(self.last[rows], x)
        on = ~np.isnan(z)
        begun = self.n[rows] >= self.back
        r = rows[begun]
        if len(r):
            a, p = self.a[r], self.p[r]
            got = on[begun]
            v = np.where(got[:, None], z[begun][:, None] - self.points[:, 3] - a[:, :, 0], 0.0)
            f = p[:, :, 0, 0]
            gain = np.where(got[:, None, None], p[:, :, :, 0] / f[:, :, None], 0.0)
            a = a + gain * v[:, :, None]
            p = p - gain[:, :, :, None] * p[:, :, None, 0, :]
            self.square[r] += v * v / f
            self.logs[r] += np.where(got[:, None], np.log(f), 0.0)
            self.seen[r] += got
            self.a[r] = np.einsum("gij,egj->egi", self.t, a)
            self.p[r] = np.einsum("gij,egjk,glk->egil", self.t, p, self.t) + self.q
        self.last[rows] = np.column_stack([self.last[rows][:, 1:], x])
        self.n[rows] += 1

    def done(self, horizon):
        n = np.maximum(self.seen, 1)[:, None]
        self.loss = n * np.log(np.maximum(self.square, 1e-300) / n) + self.logs
        k, i = self.best(), np.arange(len(self.n))
        a, t, c = self.a[i, k], self.t[k], self.points[k, 3]
        last, out = self.last.copy(), np.full((len(i), horizon), np.nan)
        for h in range(horizon):
            x = c + a[:, 0] + last[:, -self.season]
            out[:, h] = x + (last[:, -1] - last[:, 0]) if self.first else x
            last = np.column_stack([last[:, 1:], out[:, h]])
            a = np.einsum("eij,ej->ei", t, a)
        out[self.seen == 0] = np.nan
        return k, np.where(self.seen > 0, self.loss[i, k], np.nan), out


def fitted_series(df: DataFrame, entity: str, order: list[str], value: str, model: _Grid, horizon: int = 4, block: int = BLOCK) -> DataFrame:
    """entity, n (rows), loss, one column for each parameter, forecast array<double> of the next `horizon` positions.

    Rows with a null or non-finite value count as positions without a value; forecasts are null where
    an entity is too short to start. Equal orders of one entity are broken by the value.
    """
    kind = dict(df.dtypes)[entity]
    x = F.col(value).cast("double")
    rows = df.select(F.col(entity).alias("_entity"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("_x"))
    blocks = max(1, -(-rows.select(F.approx_count_distinct("_entity")).first()[0] // block))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_entity"), F.lit(blocks)).cast("int")).repartition("_block")
    own = Window.partitionBy("_block", "_entity").orderBy(*[f"_o{i}" for i in range(len(order))], "_x")
    rows = rows.withColumn("_t", F.row_number().over(own)).withColumn("_e", F.dense_rank().over(Window.partitionBy("_block").orderBy("_entity")) - 1)
    rows = rows.select("_block", "_t", "_e", "_x", F.when(F.col("_t") == 1, F.col("_entity")).alias("_entity")).sortWithinPartitions("_block", "_t", "_e")
    names = [entity, "n", "loss", *model.names, "forecast"]
    schema = f"`{entity}` {kind}, n bigint, loss double, {', '.join(f'{n} double' for n in model.names)}, forecast array<double>"

    def result(entities: pa.Array, count: np.ndarray) -> pa.RecordBatch:
        k, loss, forecast = model.done(horizon)
        values = pa.array(forecast.ravel(), from_pandas=True)
        cut = pa.array(np.arange(len(k) + 1, dtype=np.int32) * horizon)
        return pa.RecordBatch.from_arrays([entities, pa.array(count), pa.array(loss, from_pandas=True), *[pa.array(model.points[k, j]) for j in range(len(model.names))], pa.ListArray.from_arrays(cut, values)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities, count, now = None, None, None
        for b, t, e, x, named in _steps(batches):
            if b != now:
                if entities is not None:
                    yield result(entities, count)
                now, entities, count = b, named, np.zeros(len(e), np.int64)
                model.start(len(e))
            model.step(e, x)
            count[e] += 1
        if entities is not None:
            yield result(entities, count)

    return rows.mapInArrow(run, schema)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, position, entities, values, names) of each run of equal block and position, which batches may cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        key = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        for end in [*(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1), len(key)] if len(key) else []:
            if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != tuple(key[at].tolist()):
                yield _step(held)
                held = []
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield _step(held)


def _step(parts: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(parts).combine_chunks()
    names = t.column(4).combine_chunks()
    names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
    return t.column(0)[0].as_py(), t.column(1)[0].as_py(), t.column(2).to_numpy().astype(np.int64), t.column(3).to_numpy(zero_copy_only=False).astype(np.float64), names
