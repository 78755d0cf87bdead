"""The report on predicted distributions: by level, interval and density, for the whole and for each part.

Rows are read once into sums by the finest combination of the parts' columns; a part's figures are sums of
those (as grouping sets would give, but over the sums), so that rows are not repeated for each part.
Histograms of the probability integral transform are counts by bin and merge the same way. Medians and
tails are exact quantiles of the parts, from a mergeable sketch and a pass over what lies near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.quantiles import exact_quantiles

#: The levels of the five quantiles, and the weights of their intervals in the interval score.
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)
_DENSITIES = {"normal": (S.normal_cdf, S.normal_crps, S.normal_nll), "laplace": (S.laplace_cdf, S.laplace_crps, S.laplace_nll)}


def _keys(parts: dict[str, list[str]]) -> Column:
    """An array of (part, key) for a row; the key holds the part's values, `all` of the whole."""
    one = lambda name, cols: F.struct(F.lit(name).alias("part"), (F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]) if cols else F.lit("all")).alias("key"))
    return F.array(*[one(n, c) for n, c in parts.items()])


def distribution_report(rows: DataFrame, y: str, quantiles: list[str], parts: dict[str, list[str]], location: str | None = None, scale: str | None = None, density: str = "normal", bins: int = 10) -> DataFrame:
    """part, key and the figures of each part of rows that have the truth and all five quantiles (which must not cross).

    parts: columns that make up each part, {"all": []} for the whole. With location and scale: density figures
    over rows with a positive scale, pit_histogram as counts of `bins` equal bins (1 counts in the last one)."""
    q, t = [F.col(c).cast("double") for c in quantiles], F.col(y).cast("double")
    names = sorted({c for cols in parts.values() for c in cols})
    ok = rows.dropna(subset=[y, *quantiles])
    w80, w50 = q[4] - q[0], q[3] - q[1]
    under = lambda low, a: (2 / a) * F.greatest(low - t, F.lit(0.0))
    over = lambda high, a: (2 / a) * F.greatest(t - high, F.lit(0.0))
    err = q[2] - t
    flag = lambda c: c.cast("double")
    sums = {f"pin{i}": S.pinball(t, c, p) for i, (c, p) in enumerate(zip(q, LEVELS))}
    sums |= {f"cal{i}": flag(t <= c) for i, c in enumerate(q)}
    sums |= {
        "dispersion": (0.1 * w80 + 0.25 * w50) / 2.5,
        "underprediction": (0.1 * under(q[0], 0.2) + 0.25 * under(q[1], 0.5)) / 2.5,
        "overprediction": (0.1 * over(q[4], 0.2) + 0.25 * over(q[3], 0.5)) / 2.5,
        "median_part": 0.5 * F.abs(err) / 2.5,
        "c80": flag((t >= q[0]) & (t <= q[4])),
        "c50": flag((t >= q[1]) & (t <= q[3])),
        "w80": w80,
        "w50": w50,
        "collapsed": flag((w80 == 0) | (w50 == 0)),
        "ae": F.abs(err),
        "se": err * err,
        "e": err,
    }
    counts: dict[str, Column] = {}
    if location and scale:
        cdf, crps, nll = _DENSITIES[density]
        m, s = F.col(location).cast("double"), F.when(F.col(scale) > 0, F.col(scale).cast("double"))
        pit = cdf(t, m, s) if density == "laplace" else cdf((t - m) / s)
        sums |= {"crps": crps(t, m, s), "nll": nll(t, m, s), "pit": pit, "pit2": pit * pit, "has": flag(pit.isNotNull())}
        place = F.when(pit.isNotNull(), F.least(F.floor(pit * bins), F.lit(bins - 1)))
        counts = {f"bin{i}": flag(place == i) for i in range(bins)}
    both = sums | counts
    fine = ok.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in both.items()])
    per = fine.select(F.inline(_keys(parts)), "n", *both).groupBy("part", "key").agg(*[F.sum(k).alias(k) for k in ("n", *both)])
    mean = lambda k: F.col(k) / F.col("n")
    calibration = [mean(f"cal{i}") - p for i, p in enumerate(LEVELS)]
    pinballs = [mean(f"pin{i}") for i in range(5)]
    wis = mean("dispersion") + mean("underprediction") + mean("overprediction") + mean("median_part")
    out = [
        *[F.col(c) for c in ("part", "key")],
        F.col("n").alias("rows"),
        (sum(pinballs[1:], pinballs[0]) / 5).alias("mean_pinball"),
        F.array(*pinballs).alias("pinball"),
        wis.alias("wis"),
        *[mean(k).alias(k) for k in ("dispersion", "underprediction", "overprediction", "median_part")],
        F.array(*calibration).alias("calibration"),
        (sum([F.abs(c) for c in calibration[1:]], F.abs(calibration[0])) / 5).alias("mean_calibration_error"),
        F.greatest(*[F.abs(c) for c in calibration]).alias("worst_calibration_error"),
        mean("c80").alias("coverage_80"),
        mean("c50").alias("coverage_50"),
        mean("w80").alias("width_80"),
        mean("w50").alias("width_50"),
        mean("collapsed").alias("collapsed"),
        mean("ae").alias("mae"),
        F.sqrt(mean("se")).alias("rmse"),
        mean("e").alias("bias"),
    ]
    if counts:
        rate = lambda k: F.when(F.col("has") > 0, F.col(k) / F.col("has"))
        out += [rate("crps").alias("crps"), rate("nll").alias("nll"), rate("pit").alias("pit_mean"), (rate("pit2") - rate("pit") * rate("pit")).alias("pit_variance"), F.array(*[F.col(k).cast("long") for k in counts]).alias("pit_histogram")]
    return per.select(*out).join(_tails(ok, parts, {"width_80": w80, "width_50": w50, "ae": F.abs(err)}), ["part", "key"])


def _tails(rows: DataFrame, parts: dict[str, list[str]], measures: dict[str, Column]) -> DataFrame:
    """part, key, then median_, p90_ and p95_ of each measure."""
    long = rows.select(F.inline(_keys(parts)), F.array(*[F.struct(F.lit(k).alias("m"), c.alias("v")) for k, c in measures.items()]).alias("a")).select("part", "key", F.inline("a"))
    q = exact_quantiles(long, ["part", "key", "m"], "v", [0.5, 0.9, 0.95])
    pick = lambda m, i: F.max(F.when(F.col("m") == m, F.col("q")[i]))
    return q.groupBy("part", "key").agg(*[pick(m, i).alias(f"{p}_{m}") for m in measures for i, p in enumerate(("median", "p90", "p95"))])
