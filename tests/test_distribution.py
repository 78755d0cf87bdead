import math

import numpy as np
import pytest

from tidemark.operators import distribution as D


@pytest.mark.parametrize("density", ["normal", "laplace"])
def test_report_equals_numpy(spark, density):
    rng = np.random.default_rng(3)
    n = 700
    seed, size = rng.integers(0, 3, n), rng.choice(["small", "large"], n)
    y, m, s = rng.normal(size=n), rng.normal(size=n) * 0.3, np.exp(rng.normal(size=n) * 0.2)
    s[::50] = 0.0
    q = m[:, None] + np.array([-1.2, -0.6, 0.0, 0.6, 1.2])
    q[::40] = q[::40, 2:3]
    rows = [(int(a), str(b), float(c), *map(float, d), float(e), float(f)) for a, b, c, d, e, f in zip(seed, size, y, q, m, s)]
    rows.append((0, "small", None, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "seed int, size string, y double, a double, b double, c double, d double, e double, m double, s double").repartition(5)
    got = {(r.part, r.key): r for r in D.distribution_report(df, "y", list("abcde"), {"all": [], "seed": ["seed"], "both": ["seed", "size"]}, "m", "s", density).collect()}
    want = {("all", "all"): np.ones(n, bool)} | {("seed", str(k)): seed == k for k in range(3)} | {("both", f"{k}|{z}"): (seed == k) & (size == z) for k in range(3) for z in ("small", "large")}
    assert set(got) == set(want)
    for key, at in want.items():
        r, t, p = got[key], y[at], q[at]
        pin = [np.maximum(v * (t - p[:, i]), (v - 1) * (t - p[:, i])).mean() for i, v in enumerate(D.LEVELS)]
        score = lambda i, j, a: (p[:, j] - p[:, i]) + 2 / a * np.maximum(p[:, i] - t, 0) + 2 / a * np.maximum(t - p[:, j], 0)
        wis = (0.5 * abs(t - p[:, 2]) + 0.1 * score(0, 4, 0.2) + 0.25 * score(1, 3, 0.5)).mean() / 2.5
        cal = [(t <= p[:, i]).mean() - v for i, v in enumerate(D.LEVELS)]
        ok = s[at] > 0
        z = (t[ok] - m[at][ok]) / s[at][ok]
        pit = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]) if density == "normal" else np.where(z < 0, np.exp(z) / 2, 1 - np.exp(-z) / 2)
        assert r.rows == at.sum() and np.allclose(r.pinball, pin) and np.allclose(r.calibration, cal)
        figures = {"wis": wis, "mean_pinball": np.mean(pin), "mean_calibration_error": np.abs(cal).mean(), "worst_calibration_error": np.abs(cal).max(), "coverage_80": ((t >= p[:, 0]) & (t <= p[:, 4])).mean(), "width_50": (p[:, 3] - p[:, 1]).mean(), "collapsed": (p[:, 4] == p[:, 0]).mean(), "mae": abs(t - p[:, 2]).mean(), "rmse": math.sqrt(((t - p[:, 2]) ** 2).mean()), "bias": (p[:, 2] - t).mean(), "pit_mean": pit.mean(), "pit_variance": pit.var(), "median_ae": np.median(abs(t - p[:, 2])), "p95_ae": np.quantile(abs(t - p[:, 2]), 0.95), "p90_width_80": np.quantile(p[:, 4] - p[:, 0], 0.9)}
        for name, v in figures.items():
            assert abs(r[name] - v) < 1e-6, (name, r[name], v)
        assert np.abs(np.array(r.pit_histogram) - np.histogram(pit, bins=np.linspace(0, 1, 11))[0]).sum() <= 2 and sum(r.pit_histogram) == ok.sum()
    assert D.distribution_report(df.limit(0), "y", list("abcde"), {"seed": ["seed"]}).collect() == []
