import itertools
import math

import numpy as np
import pytest

from tidemark.operators import univariate as U


def series(seed, n, missing=0.1):
    rng = np.random.default_rng(seed)
    x = 20 + 0.1 * np.arange(n) + np.tile([3.0, -1, 2, -4], n // 4 + 1)[:n] + rng.normal(size=n).cumsum() * 0.3
    return np.where((rng.random(n) < missing) & (np.arange(n) > 4), np.nan, x)


def frame(spark, many):
    rows = [(f"e{k}", t, None if math.isnan(v) else float(v)) for k, x in enumerate(many) for t, v in enumerate(x)]
    np.random.default_rng(0).shuffle(rows)
    return spark.createDataFrame([(a, int(b), None if c is None else float(c)) for a, b, c in rows], "name string, at int, x double").repartition(7)


MANY = [series(k, n) for k, n in enumerate([40, 41, 3, 60, 17, 4, 1, 90])] + [np.full(12, np.nan)]


def smooth(x, m, a, b, g, horizon=4):
    if len(x) < m:
        return 0.0, [math.nan] * horizon
    level, trend = np.nanmean(x[:m]), 0.0
    season, loss = [0.0 if math.isnan(v) else v - level for v in x[:m]], 0.0
    for t in range(m, len(x)):
        e = x[t] - level - trend - season[t % m]
        e = 0.0 if math.isnan(e) else e
        level, trend, season[t % m], loss = level + trend + a * e, trend + b * e, season[t % m] + g * e, loss + e * e
    return loss, [level + h * trend + season[(len(x) + h - 1) % m] for h in range(1, horizon + 1)]


def theta(x, a, horizon=4):
    v = x[~np.isnan(x)]
    if not len(v):
        return 0.0, [math.nan] * horizon
    level, loss = v[0], 0.0
    for y in v[1:]:
        loss, level = loss + (y - level) ** 2, level + a * (y - level)
    slope = np.polyfit(np.arange(1, len(v) + 1), v, 1)[0] if len(v) > 1 else 0.0
    return loss, [level + slope / 2 * (h - 1 + (1 - (1 - a) ** len(v)) / a) for h in range(1, horizon + 1)]


def arima(x, m, phi, th, sth, c, first, horizon=4):
    """Loss by the covariance matrix of all differences, forecasts by regression on it."""
    back = m + first
    z = x[m:] - x[:-m] if len(x) > m else np.zeros(0)
    z = np.diff(z) if first else z
    psi = np.zeros(400)
    ma = np.zeros(m + 2)
    ma[0], ma[1], ma[m], ma[m + 1] = 1, th, sth, th * sth
    for j in range(400):
        psi[j] = (ma[j] if j < m + 2 else 0) + (phi * psi[j - 1] if j else 0)
    gamma = np.array([psi[: 400 - k] @ psi[k:] for k in range(len(z) + horizon)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(len(z) + horizon), np.arange(len(z) + horizon)))]
    on = np.flatnonzero(~np.isnan(z))
    if not len(on):
        return math.nan, [math.nan] * horizon
    s, v = cov[np.ix_(on, on)], z[on] - c
    w = np.linalg.solve(s, v)
    loss = len(on) * math.log(v @ w / len(on)) + np.linalg.slogdet(s)[1]
    path = list(x)
    for f in c + cov[np.ix_(np.arange(len(z), len(z) + horizon), on)] @ w:
        path.append(f + path[-m] + (path[-1] - path[-m - 1] if first else 0))
    assert back == m + first
    return loss, path[len(x) :]


def check(spark, model, one, points, tie=True):
    got = {r.name: r for r in U.fitted_series(frame(spark, MANY), "name", ["at"], "x", model, block=3).collect()}
    assert len(got) == len(MANY)
    for k, x in enumerate(MANY):
        r = got[f"e{k}"]
        tried = [(*one(x, *p), p) for p in points]
        best = min(tried, key=lambda t: t[0]) if not math.isnan(tried[0][0]) else tried[0]
        assert r.n == len(x) and (math.isnan(best[0]) if r.loss is None else abs(r.loss - best[0]) < 1e-6 * (1 + abs(best[0])))
        if r.loss:
            assert np.allclose([r[n] for n in model.names], best[2])
        assert np.allclose([math.nan if f is None else f for f in r.forecast], best[1], atol=1e-6, equal_nan=True), (k, r.forecast, best)


def test_smoothing_tries_every_point(spark):
    a, b, g = (0.1, 0.5, 0.9), (0.0, 0.1), (0.0, 0.3)
    check(spark, U.Smoothing(4, a, b, g), lambda x, *p: smooth(x, 4, *p), list(itertools.product(a, b, g)))


def test_theta_tries_every_point(spark):
    a = (0.2, 0.5, 0.8)
    check(spark, U.Theta(a), theta, [(p,) for p in a])


@pytest.mark.parametrize("first", [False, True])
def test_arima_by_the_covariance_of_all_differences(spark, first):
    phi, th, sth, c = (0.0,) if first else (0.2, 0.7), (-0.5, 0.3), (-0.4, 0.2), (0.0, 0.4)
    model = U.SeasonalArima(4, phi, th, sth, c, first=first)
    check(spark, model, lambda x, *p: arima(x, 4, *p, first), list(itertools.product(phi, th, sth, c)))


def test_equal_blocks_and_empty_tables(spark):
    df = frame(spark, MANY)
    one = sorted(map(str, U.fitted_series(df, "name", ["at"], "x", U.Theta(), block=1).collect()))
    assert one == sorted(map(str, U.fitted_series(df, "name", ["at"], "x", U.Theta()).collect()))
    assert U.fitted_series(df.limit(0), "name", ["at"], "x", U.Theta()).collect() == []
