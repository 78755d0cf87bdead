"""Registered queries of models of one series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import univariate as U
from tidemark.plans.catalog import SERIES, query, series

#: Each user's events in order, numbered from 0, with the values that are missing.
_POS = f"{SERIES}, p AS (SELECT user_id AS k, x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM s)"


def _long(fits):
    """user_id, n, loss, h, forecast: a row for each step ahead."""
    out = fits.select("user_id", "n", F.round("loss", 4).alias("loss"), F.posexplode("forecast").alias("h", "f"))
    return out.select("user_id", "n", "loss", (F.col("h") + 1).alias("h"), F.round("f", 4).alias("forecast"))


@query(
    "m11_smoothing",
    f"""WITH RECURSIVE {_POS}, i AS (SELECT k, any_value(n) AS n, avg(x) AS m, [coalesce(max(x) FILTER (pos = 0), avg(x)), coalesce(max(x) FILTER (pos = 1), avg(x)), coalesce(max(x) FILTER (pos = 2), avg(x)), coalesce(max(x) FILTER (pos = 3), avg(x))] AS v FROM p WHERE pos < 4 GROUP BY k HAVING count(*) = 4),
    f AS (SELECT k, n, 3::BIGINT AS pos, m::DOUBLE AS l, 0.0::DOUBLE AS b, v[1] - m AS s0, v[2] - m AS s1, v[3] - m AS s2, v[4] - m AS s3, 0.0::DOUBLE AS loss FROM i
      UNION ALL SELECT k, n, pos + 1, l + b + 0.3 * e, b + 0.05 * e, s1, s2, s3, s0 + 0.1 * e, loss + e * e
      FROM (SELECT f.*, coalesce(p.x - f.l - f.b - f.s0, 0) AS e FROM f JOIN p ON p.k = f.k AND p.pos = f.pos + 1)),
    z AS (SELECT * FROM f WHERE pos = n - 1)
    SELECT k AS user_id, n, round(loss, 4) AS loss, h, round(l + h * b + [s0, s1, s2, s3][h], 4) AS forecast FROM z, (SELECT unnest([1, 2, 3, 4]) AS h)
    UNION ALL SELECT k, n, 0.0, h, NULL FROM (SELECT DISTINCT k, n FROM p WHERE n < 4), (SELECT unnest([1, 2, 3, 4]) AS h)""",
)
def smoothing(spark, d):
    """Additive trend and season of four at given weights: four steps ahead of every user's events."""
    return _long(U.fitted_series(series(spark, d), "user_id", ["ts", "event_id"], "x", U.Smoothing(4, a=(0.3,), b=(0.05,), g=(0.1,))))


@query(
    "m11_theta",
    f"""WITH RECURSIVE {_POS}, v AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY pos) AS pos FROM p WHERE x IS NOT NULL),
    f AS (SELECT k, pos, x AS l, 0.0::DOUBLE AS loss FROM v WHERE pos = 1 UNION ALL SELECT f.k, v.pos, f.l + 0.4 * (v.x - f.l), f.loss + (v.x - f.l) * (v.x - f.l) FROM f JOIN v ON v.k = f.k AND v.pos = f.pos + 1),
    g AS (SELECT k, count(*) AS c, coalesce(regr_slope(x, pos), 0) AS slope FROM v GROUP BY k), a AS (SELECT k, any_value(n) AS n FROM p GROUP BY k)
    SELECT a.k AS user_id, a.n, round(coalesce(f.loss, 0), 4) AS loss, h, round(f.l + slope / 2 * (h - 1 + (1 - pow(0.6, c)) / 0.4), 4) AS forecast
    FROM a LEFT JOIN g ON g.k = a.k LEFT JOIN f ON f.k = a.k AND f.pos = g.c, (SELECT unnest([1, 2, 3, 4]) AS h)""",
)
def theta(spark, d):
    return _long(U.fitted_series(series(spark, d), "user_id", ["ts", "event_id"], "x", U.Theta(a=(0.4,))))


@query(
    "m11_seasonal_arima",
    f"""WITH RECURSIVE {_POS}, w AS (SELECT *, x - lag(x, 4) OVER (PARTITION BY k ORDER BY pos) - 0.5 AS z FROM p),
    f AS (SELECT k, n, 3::BIGINT AS pos, 0.0::DOUBLE AS a, 1 / (1 - 0.36)::DOUBLE AS q, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS lg, 0::BIGINT AS c FROM w WHERE pos = 3
      UNION ALL SELECT f.k, f.n, w.pos, 0.6 * (CASE WHEN w.z IS NULL THEN f.a ELSE w.z END), CASE WHEN w.z IS NULL THEN 0.36 * f.q + 1 ELSE 1.0 END,
        f.ss + coalesce((w.z - f.a) * (w.z - f.a) / f.q, 0), f.lg + CASE WHEN w.z IS NULL THEN 0 ELSE ln(f.q) END, f.c + (w.z IS NOT NULL)::INT FROM f JOIN w ON w.k = f.k AND w.pos = f.pos + 1),
    e AS (SELECT f.*, p1.x AS x1, p2.x AS x2, p3.x AS x3, p4.x AS x4 FROM f LEFT JOIN p p1 ON p1.k = f.k AND p1.pos = f.n - 4 LEFT JOIN p p2 ON p2.k = f.k AND p2.pos = f.n - 3 LEFT JOIN p p3 ON p3.k = f.k AND p3.pos = f.n - 2 LEFT JOIN p p4 ON p4.k = f.k AND p4.pos = f.n - 1 WHERE f.pos = f.n - 1)
    SELECT k AS user_id, n, CASE WHEN c > 0 THEN round(c * ln(ss / c) + lg, 4) END AS loss, h, CASE WHEN c > 0 THEN round(0.5 + a * pow(0.6, h - 1) + [x1, x2, x3, x4][h], 4) END AS forecast FROM e, (SELECT unnest([1, 2, 3, 4]) AS h)
    UNION ALL SELECT k, n, NULL, h, NULL FROM (SELECT DISTINCT k, n FROM p WHERE n < 4), (SELECT unnest([1, 2, 3, 4]) AS h)""",
)
def seasonal_arima(spark, d):
    """(1, 0, 0) x (0, 1, 0) of season four with a constant, at given parameters: likelihood and four steps ahead; missing values are skipped."""
    return _long(U.fitted_series(series(spark, d), "user_id", ["ts", "event_id"], "x", U.SeasonalArima(4, phi=(0.6,), c=(0.5,))))


@query("m11_grid_fits")
def grid_fits(spark, d):
    """model, entities, mean_loss: each model's best grid points over all users. No SQL: tests/test_univariate.py tries every point."""
    s, out = series(spark, d), None
    grid = {"smoothing": U.Smoothing(4), "theta": U.Theta(), "arima": U.SeasonalArima(4, phi=(0.0, 0.3, 0.6, 0.9), theta=(-0.6, 0.0), seasonal=(-0.6, 0.0))}
    for name, model in grid.items():
        row = U.fitted_series(s, "user_id", ["ts", "event_id"], "x", model).agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("loss"), 4).alias("mean_loss")).select(F.lit(name).alias("model"), "entities", "mean_loss")
        out = row if out is None else out.unionAll(row)
    return out
