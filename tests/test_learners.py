import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learners as L
from tidemark.operators import vintages
from tidemark.operators.quantiles import exact_quantiles


def frame(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x, z, e = rng.normal(size=n), rng.normal(size=n), rng.laplace(size=n)
    y = 2 + 1.5 * x - 0.7 * z + e
    return spark.createDataFrame([(i, i % 3, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "i long, g int, x double, z double, y double"), np.column_stack([np.ones(n), x, z]), y


def test_ridge_and_elastic_net_by_their_conditions(spark):
    df, x, y = frame(spark)
    (row,) = L.fitted(df.withColumn("one", F.lit(1)), ["one"], ["x", "z"], "y", lambda m: L.ridge_of(m, 5.0)).collect()
    want = np.linalg.solve(x.T @ x + 5.0 * np.diag([0, 1, 1]), x.T @ y)
    assert np.allclose(row.coef, want) and row.n == len(y)
    m = np.column_stack([x, y])
    b = L.elastic_net_of(m.T @ m, 0.3, 0.2)
    loss = lambda c: ((y - x @ c) ** 2).mean() / 2 + 0.3 * np.abs(c[1:]).sum() + 0.1 * (c[1:] ** 2).sum()
    for k in range(3):
        for step in (-1e-3, 1e-3):
            c = b.copy()
            c[k] += step
            assert loss(c) > loss(b)


def test_quantile_and_huber_lines(spark):
    df, x, y = frame(spark)
    check = lambda c, p: np.maximum(p * (y - x @ c), (p - 1) * (y - x @ c)).mean()
    for p, c in L.irls(df, ["x", "z"], "y", levels=(0.1, 0.5, 0.9), rounds=40).items():
        assert abs((y <= x @ c).mean() - p) < 0.02
        for k, step in itertools.product(range(3), (-0.1, 0.1)):
            d = c.copy()
            d[k] += step
            assert check(d, p) > check(c, p) - 1e-3
    c = L.irls(df, ["x", "z"], "y", loss="huber", levels=(1.0,), rounds=30)[1.0]
    r = y - x @ c
    assert np.abs((x * np.clip(r, -1, 1)[:, None]).mean(0)).max() < 1e-3


def test_convex_stack_against_a_grid(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=300) * 10
    m = np.column_stack([y + rng.laplace(size=300), y * 0.8 + rng.laplace(size=300), y * 1.3 + 2])
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([m, y])], "a double, b double, c double, y double")
    w, mae = L.convex_stack(df, ["a", "b", "c"], "y")
    grid = min(np.abs(m @ np.array([i, j, 100 - i - j]) / 100 - y).mean() for i in range(101) for j in range(101 - i))
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and mae <= grid * 1.002


def test_greedy_members_keep_caps_and_leave_out_copies():
    ranks = {"a1": 0.1, "a2": 0.2, "a3": 0.3, "b1": 0.4, "c1": 0.9}
    corr = {p: 0.0 for p in itertools.combinations(sorted(ranks), 2)} | {("a1", "b1"): 1.0}
    fam = {m: m[0] for m in ranks}
    assert L.greedy_members(ranks, fam, corr, set(), 4, lambda f: 2) == ["a1", "a2", "b1", "c1"]
    assert L.greedy_members(ranks, fam, corr, {frozenset(("a1", "a2"))}, 3, lambda f: 2) == ["a1", "a3", "b1"]
    assert L.greedy_members(ranks, fam, corr, set(), 5, lambda f: 1) == ["a1", "b1", "c1"]


def test_median_line_against_a_grid():
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randint(3, 12)
        x, y, w = (np.array([rng.uniform(0.5, 3) for _ in range(n)]) for _ in range(3))
        loss = lambda a, b: 0.5 * (np.abs(y - a - b * x) * w).sum() / w.sum() + 0.01 * abs(b)
        a, b = vintages.median_line(x, y, w, 0.01)
        assert loss(a, b) <= min(loss(p, q) for p in np.linspace(-4, 6, 101) for q in np.linspace(-4, 4, 81)) + 1e-9


def by_hand(past, own):
    """The rule for one vintage from (log multiple, growth, weight) of those before it."""
    if len(past) < 4:
        return None, "TOO_FEW"
    heavy = sorted(y for y, _, w in past for _ in range(int(w)))  # whole weights: rows as often as they weigh
    guess, seen, name = heavy[(len(heavy) + 1) // 2 - 1], [y for y, _, _ in past], "INTERCEPT"
    with_growth = [(g, y, w) for y, g, w in past if math.isfinite(g)]
    if len(with_growth) >= 8 and math.isfinite(own):
        g5, g25, g50, g75, g95 = np.percentile([g for g, _, _ in with_growth], [5, 25, 50, 75, 95])
        put = lambda g: (np.clip(g, g5, g95) - g50) / max(g75 - g25, 0.05)
        a, b = vintages.median_line(*(np.array(v, float) for v in zip(*[(put(g), y, w) for g, y, w in with_growth])), 0.01)
        if b > 0:
            guess, seen, name = a + b * put(own), [y for _, y, _ in with_growth], "CONDITIONAL"
    return math.exp(np.clip(guess, *np.percentile(seen, [10, 90]))), name


def test_median_lines_of_many_rows():
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 6, (40, 9)).astype(float), rng.normal(size=(40, 9)), rng.uniform(0.1, 1, (40, 9))
    x[0] = 2.0
    a, b = vintages.median_lines(x, y, w, 0.01)
    loss = lambda k, a, b: 0.5 * (np.abs(y[k] - a - b * x[k]) * w[k]).sum() / w[k].sum() + 0.01 * abs(b)
    for k in range(len(x)):
        i, j = np.triu_indices(9, 1)
        lines = [(y[k][p] - s * x[k][p], s) for p, q in zip(i, j) if x[k][p] != x[k][q] for s in [(y[k][q] - y[k][p]) / (x[k][q] - x[k][p])]] + [(v, 0.0) for v in y[k]]
        assert loss(k, a[k], b[k]) == pytest.approx(min(loss(k, *l) for l in lines), abs=1e-11)
    assert b[0] == 0


def test_vintage_rule_deals_no_training_rows(spark):
    rows = spark.range(40).selectExpr("'s' AS s", "id AS t", "id AS v", "sin(id) AS y", "cos(id) AS g", "1.0D AS w")
    plan = vintages.vintage_multiples(rows, "s", ["t"], ["v"], F.lit(False), "y", "g", "w")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Generate" not in plan


def test_vintages_never_see_themselves(spark):
    rows = [("s", t, t // 4, math.log(10 + (t * 7) % 13), 0.1 * (t // 4 % 5), 1.0) for t in range(80)]
    run = lambda r: {x.t: (x.expected, x.way) for x in vintages.vintage_multiples(spark.createDataFrame(r, "s string, t long, v long, y double, g double, w double"), "s", ["t"], ["v"], F.lit(False), "y", "g", "w").collect()}
    got = run(rows)
    done = [(float(np.median([r[3] for r in rows if r[2] == b])), 0.1 * (b % 5), 1.0) for b in range(20)]
    for b in range(20):
        want = by_hand(done[:b][-20:], done[b][1])
        assert got[4 * b][1] == want[1] and (want[0] is None or abs(got[4 * b][0] - want[0]) < 1e-9)
    # a series in which the multiple rises with growth
    rising = [("r", t, t // 4, 2 + 0.1 * (t // 4 % 5) + 0.01 * ((t * 7) % 13), 0.1 * (t // 4 % 5), float(1 + t // 4 % 3)) for t in range(80)]
    found = run(rising)
    done = [(float(np.median([r[3] for r in rising if r[2] == b])), 0.1 * (b % 5), float(1 + b % 3)) for b in range(20)]
    for b in range(20):
        want = by_hand(done[:b][-20:], done[b][1])
        assert found[4 * b][1] == want[1] and (want[0] is None or abs(found[4 * b][0] - want[0]) < 1e-9)
    assert {w for _, w in [*got.values(), *found.values()]} == {"TOO_FEW", "INTERCEPT", "CONDITIONAL"}
    later = run([r if r[1] < 60 else (*r[:3], 99.0, *r[4:]) for r in rows])
    assert all(later[t] == got[t] for t in range(60))


@pytest.mark.parametrize("n", [1, 2, 7, 300, 30_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=n), 2 if n % 2 else 9)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", None), ("c", 1.0)], "g string, v double").repartition(3)
    levels = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", levels).collect()}
    assert set(got) == {"a", "c"} and got["a"].n == n
    assert np.allclose(got["a"].q, np.quantile(v, levels), atol=1e-12)
