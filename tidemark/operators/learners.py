"""Learners whose fit is an aggregation: sums in tasks, small systems solved from them."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.scratch import written


def fit_preprocessor(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (median, scale)} of a training frame; columns without any value are left out.

    scale is the population deviation after missing values take the median, 1 where that is 0."""
    medians = {}
    for c in columns:
        row = exact_quantiles(train.select(F.lit(1).alias("g"), c), ["g"], c, [0.5]).first()
        if row is not None:
            medians[c] = float(row.q[0])
    if not medians:
        return {}
    std = train.agg(*[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(m))).alias(c) for c, m in medians.items()]).first()
    return {c: (m, std[c] if std[c] and math.isfinite(std[c]) else 1.0) for c, m in medians.items()}


def preprocessed(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """df with z_<column> (missing values are 0 there) and missing_<column> for each fitted column."""
    put = {}
    for c, (m, s) in fit.items():
        put |= {f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s, f"missing_{c}": F.col(c).isNull().cast("int")}
    return df.withColumns(put)


def moments(df: DataFrame, by: list[str], features: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """by, n, m: the weighted sums of products of (1, features, y), upper triangle by rows; rows with nulls do not count."""
    w = F.lit(1.0) if weight is None else weight
    v = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    ok = df.withColumn("_w", w).dropna(subset=[*features, y, "_w"])
    sums = [F.sum(F.col("_w") * a * b) for a, b in itertools.combinations_with_replacement(v, 2)]
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("m"))


def unpacked(m, k: int) -> np.ndarray:
    """The symmetric matrix of k x k of an upper triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = m
    return out + out.T - np.diag(np.diag(out))


def ridge_of(m: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, coefficients): least squares with penalty x squares of the coefficients, not of the intercept."""
    k = len(m) - 1
    a = m[:k, :k] + penalty * np.diag([0.0] + [1.0] * (k - 1))
    return np.linalg.lstsq(a, m[:k, k], rcond=None)[0]


def elastic_net_of(m: np.ndarray, l1: float, l2: float, rounds: int = 500, least: float = 1e-10) -> np.ndarray:
    """(intercept, coefficients) by coordinate descent on centred sums: mean squares / 2 + l1 |b| + l2 b^2 / 2."""
    n, k = m[0, 0], len(m) - 1
    mean = m[0, 1:] / n
    c = m[1:, 1:] / n - np.outer(mean, mean)
    b = np.zeros(k - 1)
    for _ in range(rounds):
        before = b.copy()
        for j in range(k - 1):
            r = c[j, k - 1] - c[j, : k - 1] @ b + c[j, j] * b[j]
            b[j] = math.copysign(max(abs(r) - l1, 0.0), r) / (c[j, j] + l2) if c[j, j] + l2 > 0 else 0.0
        if np.abs(b - before).max(initial=0.0) < least:
            break
    return np.concatenate([[mean[k - 1] - mean[: k - 1] @ b], b])


def fitted(df: DataFrame, by: list[str], features: list[str], y: str, solve, weight: Column | None = None) -> DataFrame:
    """by, n, coef (intercept first): solve(matrix of sums) for each group; only the sums go to Python."""
    k = len(features) + 2
    types = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], "n long", "coef array<double>"])

    def run(frames):
        for pdf in frames:
            coef = [solve(unpacked(m, k)).tolist() for m in pdf["m"]]
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "n": pdf["n"], "coef": coef})

    return moments(df, by, features, y, weight).mapInPandas(run, schema)


def predicted(df: DataFrame, fits: DataFrame, by: list[str], features: list[str], name: str = "forecast") -> DataFrame:
    """df with the forecast of its group's fit; null without one."""
    j = df.join(fits.select(*by, "coef"), by, "left")
    terms = [F.col("coef")[i + 1] * F.col(f) for i, f in enumerate(features)]
    return j.withColumn(name, sum(terms, F.col("coef")[0])).drop("coef")


def irls(df: DataFrame, features: list[str], y: str, loss: str = "quantile", levels: tuple[float, ...] = (0.5,), rounds: int = 30, least: float = 1e-3, penalty: float = 1e-6) -> dict[float, np.ndarray]:
    """{level: (intercept, coefficients)} by reweighted least squares: one aggregation a round for all levels.

    loss: quantile (check loss), or huber with the level as its bend; residuals under
    `least` of the target's deviation count as that."""
    scale = df.agg(F.stddev_pop(y)).first()[0] or 1.0
    k = len(features) + 2
    whole = moments(df, [], features, y).first().m
    coef = {p: ridge_of(unpacked(whole, k), penalty) for p in levels}
    pairs = list(itertools.combinations_with_replacement([F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")], 2))
    for _ in range(rounds):
        sums = []
        for p in levels:
            fit = sum([F.col(f) * float(b) for f, b in zip(features, coef[p][1:])], F.lit(float(coef[p][0])))
            r = F.col(y) - fit
            if loss == "quantile":
                w = F.when(r >= 0, p).otherwise(1 - p) / F.greatest(F.abs(r), F.lit(least * scale))
            else:
                w = F.least(F.lit(1.0), p / F.greatest(F.abs(r), F.lit(1e-12)))
            sums.append(F.array(*[F.sum(w * a * b) for a, b in pairs]))
        row = df.dropna(subset=[*features, y]).agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)]).first()
        new = {p: ridge_of(unpacked(row[i], k), penalty) for i, p in enumerate(levels)}
        moved = max(float(np.abs(new[p] - coef[p]).max()) for p in levels)
        coef = new
        if moved < 1e-9 * scale:
            break
    if loss == "quantile":
        # the best intercept for given slopes is the residuals' own quantile
        for p in levels:
            r = F.col(y) - sum([F.col(f) * float(b) for f, b in zip(features, coef[p][1:])], F.lit(0.0))
            found = exact_quantiles(df.dropna(subset=[*features, y]).select(F.lit(1).alias("g"), r.alias("r")), ["g"], "r", [p]).first()
            if found is not None:
                coef[p][0] = found.q[0]
    return coef


def on_simplex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The weights w >= 0 with sum 1 that make w'aw / 2 - b'w least; at most some ten weights, as all supports are tried."""
    k, best, found = len(b), math.inf, np.full(len(b), 1 / len(b))
    size_of = np.trace(a) / k or 1.0  # the conditions' ones must not be lost beside the sums
    a, b = a / size_of, b / size_of
    for size in range(1, k + 1):
        for s in itertools.combinations(range(k), size):
            s = list(s)
            kkt = np.block([[a[np.ix_(s, s)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            w = np.linalg.lstsq(kkt, np.append(b[s], 1.0), rcond=None)[0][:size]
            if (w >= -1e-12).all() and abs(w.sum() - 1) < 1e-9:
                full = np.zeros(k)
                full[s] = np.maximum(w, 0)
                value = full @ a @ full / 2 - b @ full
                if value < best:
                    best, found = value, full / full.sum()
    return found


def convex_stack(df: DataFrame, members: list[str], y: str, rounds: int = 40, least: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, mean absolute error) of the convex combination of members with the least absolute error.

    Reweighted least squares on the simplex: a round is one aggregation of members x members sums."""
    rows = written(df.dropna(subset=[*members, y]).select(*members, y), "stack")  # once: each round reads it again
    cols = [F.col(m).cast("double") for m in members]
    scale = rows.agg(F.avg(F.abs(y))).first()[0] or 1.0
    w, best = np.full(len(members), 1 / len(members)), (math.inf, None)
    pairs = list(itertools.combinations_with_replacement(range(len(members)), 2))
    for k in range(rounds):
        r = F.abs(F.col(y) - sum([c * float(x) for c, x in zip(cols[1:], w[1:])], cols[0] * float(w[0])))
        u = 1 / F.greatest(r, F.lit(max(least, 0.1 * 0.5**k) * scale))
        row = rows.agg(F.avg(r).alias("e"), F.array(*[F.sum(u * cols[i] * cols[j]) for i, j in pairs]).alias("a"), F.array(*[F.sum(u * c * F.col(y)) for c in cols]).alias("b")).first()
        if row.e is None:
            return w, 0.0
        if row.e < best[0]:
            best = (row.e, w)
        new = on_simplex(unpacked(row.a, len(members)), np.array(row.b))
        if np.abs(new - w).max() < 1e-10 and k > 20:
            break
        w = new
    return best[1], float(best[0])


def local_trend(rows: DataFrame, by: str, order: list[str], value: str, q_level: float = 0.05, q_slope: float = 0.01, noise: float = 1.0) -> DataFrame:
    """rows (complete values) with the forecast of a local linear trend before each row: one entity's history a group."""
    keep = [by, *order, value]
    types = dict(rows.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + ["forecast double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        level = slope = 0.0
        p, out = np.diag([1e4, 1.0]), []
        for y in pdf[value].astype(float):
            level, p = level + slope, np.array([[p[0, 0] + 2 * p[0, 1] + p[1, 1] + q_level, p[0, 1] + p[1, 1]], [p[0, 1] + p[1, 1], p[1, 1] + q_slope]])
            out.append(level)
            gain = p[:, 0] / (p[0, 0] + noise)
            level, slope = level + gain[0] * (y - level), slope + gain[1] * (y - level)
            p = p - np.outer(gain, p[0])
        return pdf.assign(forecast=out)[[*keep, "forecast"]]

    return rows.select(*keep).groupBy(by).applyInPandas(run, schema)


def spline_basis(df: DataFrame, x: str, knots: list[float], degree: int = 3) -> tuple[DataFrame, list[str]]:
    """df with the truncated power basis of x at the knots, and the names of its columns."""
    put = {f"{x}_p{d}": F.pow(F.col(x), F.lit(d)) for d in range(1, degree + 1)}
    put |= {f"{x}_k{i}": F.pow(F.greatest(F.col(x) - k, F.lit(0.0)), F.lit(degree)) for i, k in enumerate(knots)}
    return df.withColumns(put), list(put)


def greedy_members(ranks: dict[str, float], families: dict[str, str], corr: dict[tuple[str, str], float], same: set[frozenset], size: int, cap, penalty: float = 0.15) -> list[str]:
    """Names chosen one by one by least rank + penalty x the largest |correlation| of errors with those chosen.

    corr: errors' correlations by sorted pair, missing ones count as 1; same: pairs of equal
    forecasts, of which one is taken; cap(family): members a family may have. A loop over
    models, not rows: there are at most some hundred."""
    chosen: list[str] = []
    while len(chosen) < size:
        options = []
        for name, rank in ranks.items():
            f = families[name]
            if name in chosen or sum(families[c] == f for c in chosen) >= cap(f) or any(frozenset((name, c)) in same for c in chosen):
                continue
            worst = max((abs(corr.get(tuple(sorted((name, c))), 1.0)) for c in chosen), default=0.0)
            options.append((rank + penalty * worst, name))
        if not options:
            break
        chosen.append(min(options)[1])
    return chosen


def replayed_weights(rows: DataFrame, year: str, d: Column, q: Column) -> DataFrame:
    """year, weight: the two-member weight sum(dq) / sum(dd), kept within 0 and 1, from the years before; 1/2 without any.

    Sums a year first, then a running sum over the years."""
    per = rows.groupBy(year).agg(F.sum(d * q).alias("_a"), F.sum(d * d).alias("_b"))
    before = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    a, b = F.sum("_a").over(before), F.sum("_b").over(before)
    return per.select(year, F.when(b > 0, F.least(F.greatest(a / b, F.lit(0.0)), F.lit(1.0))).otherwise(0.5).alias("weight"))


class Ridge:
    """The protocol that learners share: fit, predict, save, load."""

    def __init__(self, by: list[str], features: list[str], y: str, penalty: float = 1.0, coefficients: DataFrame | None = None):
        self.by, self.features, self.y, self.penalty, self.coefficients = by, features, y, penalty, coefficients

    def fit(self, train: DataFrame) -> "Ridge":
        penalty = self.penalty
        return Ridge(self.by, self.features, self.y, penalty, fitted(train, self.by, self.features, self.y, lambda m: ridge_of(m, penalty)))

    def predict(self, df: DataFrame) -> DataFrame:
        return predicted(df, self.coefficients, self.by, self.features)

    def save(self, path: str) -> None:
        meta = F.struct(F.array(*[F.lit(c) for c in self.by]).alias("by"), F.array(*[F.lit(c) for c in self.features]).alias("features"), F.lit(self.y).alias("y"), F.lit(self.penalty).alias("penalty"))
        self.coefficients.withColumn("model", meta).write.parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "Ridge":
        saved = spark.read.parquet(path)
        m = saved.select("model.*").first()
        return cls(list(m.by), list(m.features), m.y, m.penalty, saved.drop("model"))
