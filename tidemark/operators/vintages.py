"""Information vintages: what a multiple should be, learnt only from vintages that have ended."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocks(rows: DataFrame, by: str, order: list[str], key: list[str], bad: Column) -> DataFrame:
    """rows with block (number of the stretch of equal keys) and void: does any row of the series break the rules?

    Leading rows whose key is all null belong to no block."""
    w = Window.partitionBy(by).orderBy(*order)
    k = F.struct(*key)
    empty = F.coalesce(*[F.col(c).cast("string") for c in key]).isNull()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_some", F.max((~empty).cast("int")).over(upto) == 1).withColumn("_k", k)
    new = F.col("_some") & (~F.col("_k").eqNullSafe(F.lag("_k").over(w)))
    r = r.withColumn("block", F.sum(new.cast("int")).over(upto))
    void = F.max((F.coalesce(bad, F.lit(True)) & F.col("_some")).cast("int")).over(Window.partitionBy(by)) == 1
    return r.withColumn("void", void).withColumn("block", F.when(F.col("_some"), F.col("block"))).drop("_some", "_k")


def median_line(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> tuple[float, float]:
    """(intercept, slope) of the weighted least-absolute line with penalty x |slope| a unit of weight.

    The objective is piecewise linear: its optimum is a line through two points, or
    level through one, so all of these are tried; there are at most a few hundred."""
    a, b = median_lines(x[None], y[None], w[None], penalty)
    return float(a[0]), float(b[0])


def median_lines(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """median_line of each row of points."""
    i, j = np.triu_indices(x.shape[1], 1)
    apart = x[:, i] != x[:, j]
    slope = np.where(apart, y[:, j] - y[:, i], 0.0) / np.where(apart, x[:, j] - x[:, i], 1.0)
    slopes = np.concatenate([slope, np.zeros_like(x)], 1)
    starts = np.concatenate([y[:, i] - slope * x[:, i], y], 1)
    off = np.abs(y[:, None] - starts[:, :, None] - slopes[:, :, None] * x[:, None])
    loss = 0.5 * (off * w[:, None]).sum(2) / w.sum(1)[:, None] + penalty * np.abs(slopes)
    loss[:, : len(i)][~apart] = np.inf
    best = np.lexsort((np.abs(slopes), np.round(loss, 12)))[:, :1]
    return np.take_along_axis(starts, best, 1)[:, 0], np.take_along_axis(slopes, best, 1)[:, 0]


def _lines(penalty: float):
    """Column function: struct<a, b> of median_line over arrays x, y and w; arrays of one length go together, some hundred at a time."""

    @F.pandas_udf("a double, b double")
    def line(x: pd.Series, y: pd.Series, w: pd.Series) -> pd.DataFrame:
        size = np.array([0 if q is None else len(q) for q in x])
        out = np.full((len(x), 2), np.nan)
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                out[some, 0], out[some, 1] = median_lines(*(np.stack(c.to_numpy()[some]).astype(np.float64) for c in (x, y, w)), penalty)
        return pd.DataFrame(out, columns=["a", "b"])

    return line


def _percentile(values: Column, level: float) -> Column:
    """percentile() of an ascending array without nulls: between the two nearest values."""
    at = (F.size(values) - 1) * F.lit(level)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _ends(values: Column, levels: tuple[float, ...]) -> Column:
    """Percentiles of an ascending array, null if it is empty."""
    return F.when(F.size(values) > 0, F.array(*[_percentile(values, p) for p in levels]))


def _weighted_median(items: Column, value: str, weight: str) -> Column:
    """metrics.weighted_median of an array of structs in ascending order of value."""
    half = F.aggregate(items, F.lit(0.0), lambda s, p: s + p[weight]) / 2
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("found"))
    return F.aggregate(items, start, lambda s, p: F.struct((s["run"] + p[weight]).alias("run"), F.when(s["found"].isNull() & (s["run"] + p[weight] >= half), p[value]).otherwise(s["found"]).alias("found")))["found"]


def vintage_multiples(rows: DataFrame, by: str, order: list[str], key: list[str], bad: Column, log_value: str, growth: str, weight: str, most: int = 20, least: int = 4, least_growth: int = 8, penalty: float = 0.01) -> DataFrame:
    """rows with expected and way: one forecast a block, from at most `most` usable blocks that ended before it.

    A block is usable with a finite log multiple (the median of its rows) and a positive weight. With fewer than
    `least` of them there is no forecast (TOO_FEW). Else it is their weighted median (INTERCEPT) or, with
    `least_growth` finite growths, a finite own one and a rising median line on growth (scaled by the quartiles and
    held within the 5 % ends), the line's value (CONDITIONAL); either is held within the 10 % ends of what it was learnt from.

    Rows become blocks by windows (a vintage: a few a year), each block's training rows a window over the
    blocks before it, an array of at most `most` points, and the rule expressions over that array, so that nothing
    is dealt again; only the median lines are Python. A series that breaks the rules gets nothing (VOID)."""
    b = blocks(rows, by, order, key, bad)
    first = F.min_by(F.struct(F.col(growth).alias("g"), F.col(weight).alias("w")), F.struct(*order))
    per = b.filter(F.col("block").isNotNull() & ~F.col("void")).groupBy(by, "block").agg(F.percentile(log_value, F.lit(0.5)).alias("y"), first.alias("f"))
    per = per.select(by, F.col("block").cast("long").alias("block"), "y", F.col("f.g").cast("double").alias("g"), F.col("f.w").cast("double").alias("w"))
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    ended = Window.partitionBy(by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    item = F.when(finite("y") & (F.col("w") > 0), F.struct(F.when(finite("g"), F.col("g")).alias("tg"), F.col("y").alias("ty"), F.col("w").alias("tw")))
    per = per.withColumn("_h", F.collect_list(item).over(ended)).withColumn("_h", F.slice("_h", F.greatest(F.size("_h") - most, F.lit(0)) + 1, F.lit(most)))
    grown = F.filter("_h", lambda p: p["tg"].isNotNull())
    f = per.select(
        by,
        "block",
        "g",
        F.size("_h").alias("n"),
        F.array_sort(F.transform("_h", lambda p: F.struct(p["ty"].alias("ty"), p["tw"].alias("tw")))).alias("_all"),
        grown.alias("_grown"),
    )
    f = f.withColumn("n_grown", F.size("_grown"))
    # sorted once: an array that several expressions name stays a column
    sorted_of = lambda c, v: F.array_sort(F.transform(c, lambda p: p[v]))
    f = f.withColumns({"_y": F.transform("_all", lambda p: p["ty"]), "_gy": sorted_of("_grown", "ty"), "_gg": sorted_of("_grown", "tg")})
    f = f.withColumns({"all_ends": _ends(F.col("_y"), (0.1, 0.9)), "grown_ends": _ends(F.col("_gy"), (0.1, 0.9)), "q": _ends(F.col("_gg"), (0.05, 0.25, 0.5, 0.75, 0.95))})
    f = f.withColumn("weighted_median", _weighted_median(F.col("_all"), "ty", "tw"))
    q = F.col("q")
    held = lambda v: (F.least(F.greatest(v, q[0]), q[4]) - q[2]) / F.greatest(q[3] - q[1], F.lit(0.05))
    # the middle and the quartiles of growth lie within its 5 % ends, so they need no holding
    points = lambda v: F.when(F.col("n_grown") >= least_growth, F.transform("_grown", v))
    f = f.withColumn("line", _lines(penalty)(points(lambda p: held(p["tg"])), points(lambda p: p["ty"]), points(lambda p: p["tw"])))
    follows = finite("g") & (F.col("line.b") > 0)
    within = lambda v, e: F.exp(F.least(F.greatest(v, F.col(e)[0]), F.col(e)[1]))
    expected = F.when(follows, within(F.col("line.a") + F.col("line.b") * held(F.col("g")), "grown_ends")).otherwise(within(F.col("weighted_median"), "all_ends"))
    enough = F.col("n") >= least
    way = F.when(~enough, "TOO_FEW").when(F.coalesce(follows, F.lit(False)), "CONDITIONAL").otherwise("INTERCEPT")
    found = f.select(by, "block", F.when(enough, expected).alias("expected"), way.alias("way"))
    return b.join(found, [by, "block"], "left").withColumn("way", F.when(F.col("void"), "VOID").otherwise(F.coalesce("way", F.lit("NO_VINTAGE"))))
