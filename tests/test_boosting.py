import math

import numpy as np
import pytest

from tidemark.operators import boosting as B


def data(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 30, n).astype(float), rng.normal(size=n)
    y = 0.4 * x + np.where(z > 0, 3.0, 0.0) + rng.normal(size=n) * (0.3 + 0.1 * x)
    x[::17] = np.nan
    return x, z, y


def frame(spark, x, z, y):
    rows = [(None if math.isnan(a) else float(a), float(b), float(c)) for a, b, c in zip(x, z, y)]
    return spark.createDataFrame([*rows, (1.0, 1.0, None)], "x double, z double, y double").repartition(5)


def plain_tree(bins, g, depth, least, leaf):
    """{node: ...} grown by trying every split of every node on its rows."""
    tree, parts = B.Tree.blank(depth), {1: np.arange(len(g))}
    for level in range(depth):
        for node in range(1 << level, 2 << level):
            rows, best = parts.get(node, np.zeros(0, int)), None
            for f in range(bins.shape[1]):
                for b in range(bins.max() + 1):
                    go = bins[rows, f] <= b
                    if min(go.sum(), (~go).sum()) >= least:
                        fall = g[rows][go].sum() ** 2 / go.sum() + g[rows][~go].sum() ** 2 / (~go).sum() - g[rows].sum() ** 2 / len(rows)
                        if fall > 1e-9 and (best is None or fall > best[0] * (1 + 1e-9)):
                            best = (fall, f, b)
            if best:
                tree.feature[node], tree.bin[node] = best[1:]
            go = bins[rows, best[1]] <= best[2] if best else np.ones(len(rows), bool)
            parts[2 * node], parts[2 * node + 1] = rows[go], rows[~go]
    for k in range(1 << depth):
        rows = parts[(1 << depth) + k]
        tree.leaf[k] = leaf(rows) if len(rows) else 0.0
    return tree


def plain(x, z, y, loss, start, edges, rounds, depth, rate, least):
    model = B.Boosted(["x", "z"], edges, loss.names, start)
    bins = model.bins(np.column_stack([x, z]))
    for _ in range(rounds):
        p = model.parameters(bins)
        g = loss.gradient(y, p)
        if isinstance(loss, B.CheckLoss):
            leaf = lambda j: lambda rows: rate * np.quantile(y[rows] - p[rows, j], loss.levels[j])
        else:
            leaf = lambda j: lambda rows: -rate * g[rows, j].mean()
        model.rounds.append([plain_tree(bins, g[:, j], depth, least, leaf(j)) for j in range(loss.trees)])
    return model, model.parameters(bins)


@pytest.mark.parametrize("loss", [B.NormalScore(), B.LaplaceScore(), B.CheckLoss((0.1, 0.5, 0.9))], ids=["normal", "laplace", "check"])
def test_rounds_equal_a_plain_loop(spark, loss):
    x, z, y = data()
    edges = [[4.0, 9.0, 14.0, 19.0, 24.0], [-1.0, -0.5, 0.0, 0.5, 1.0]]
    got = B.fit(frame(spark, x, z, y), ["x", "z"], "y", loss, rounds=4, depth=2, rate=0.3, least=30, edges=edges, keep=2)
    start = {"NormalScore": [y.mean(), math.log(y.std())], "LaplaceScore": [np.median(y), math.log(np.abs(y - np.median(y)).mean())], "CheckLoss": list(np.quantile(y, (0.1, 0.5, 0.9)))}[type(loss).__name__]
    assert np.allclose(got.start, start)
    want, p = plain(x, z, y, loss, start, edges, 4, 2, 0.3, 30)
    for a, b in zip(got.splits(), want.splits()):
        assert {k: v for k, v in a.items() if k != "added"} == {k: v for k, v in b.items() if k != "added"}
        assert a["added"] is None or abs(a["added"] - b["added"]) < 1e-8
    bins = got.bins(np.column_stack([x, z]))
    assert np.allclose(got.parameters(bins), p, atol=1e-7)
    again = B.Boosted.from_json(got.to_json())
    assert np.array_equal(again.parameters(bins), got.parameters(bins)) and again.names == got.names


def test_gradients_lower_their_scores():
    rng = np.random.default_rng(2)
    y, p = rng.normal(size=50) * 3, np.column_stack([rng.normal(size=50), rng.normal(size=50) * 0.3])
    root_pi, s = math.sqrt(math.pi), np.exp(p[:, 1])
    d = lambda f, j: (f(p + np.eye(2)[j] * 1e-6) - f(p - np.eye(2)[j] * 1e-6)) / 2e-6
    crps = lambda q: B.NormalScore().crps(y, q)
    g = B.NormalScore().gradient(y, p)
    assert np.allclose(g[:, 0] / (s * root_pi), d(crps, 0), atol=1e-5) and np.allclose(g[:, 1] * s / (2 * root_pi), d(crps, 1), atol=1e-5)
    lik = lambda q: q[:, 1] + np.abs(y - q[:, 0]) / np.exp(q[:, 1])
    g = B.LaplaceScore().gradient(y, p)
    assert np.allclose(g[:, 0] / s**2, d(lik, 0), atol=1e-5) and np.allclose(g[:, 1], d(lik, 1), atol=1e-5)


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 4001), [0.0, 1e-9, 100.0]])
    assert np.abs(B.erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-11


def test_held_out_scores_and_coverage(spark):
    x, z, y = data(4000, 1)
    hx, hz, hy = data(3000, 2)
    held = np.column_stack([hx, hz])
    for loss in (B.NormalScore(), B.LaplaceScore()):
        m = B.fit(frame(spark, x, z, y), ["x", "z"], "y", loss, rounds=25, rate=0.3)
        flat = np.tile(m.start, (len(hy), 1))
        assert loss.crps(hy, m.parameters(m.bins(held))).mean() < 0.75 * loss.crps(hy, flat).mean()
    m = B.fit(frame(spark, x, z, y), ["x", "z"], "y", B.CheckLoss(), rounds=12, rate=0.3)
    got = m.predict(frame(spark, hx, hz, hy)).toPandas().dropna(subset=["y"])
    q = got[list(m.names)].to_numpy()
    assert (np.diff(q, axis=1) >= 0).all()
    for j, p in enumerate((0.1, 0.25, 0.5, 0.75, 0.9)):
        for part in (got.x <= 10, got.x > 20):
            assert abs((got.y[part] <= q[part, j]).mean() - p) < 0.08


def test_no_split_and_no_rows(spark):
    one = frame(spark, np.ones(30), np.ones(30), np.arange(30.0))
    m = B.fit(one, ["x", "z"], "y", B.NormalScore(), rounds=2, least=5)
    assert all(s["feature"] is None for s in m.splits())
    with pytest.raises(ValueError):
        B.fit(one.limit(0), ["x", "z"], "y", B.NormalScore())
