"""How often boosting reads its rows, and that both layouts of its table give the same trees."""

import numpy as np

from tidemark.operators import boosting as B


def rows(spark, n=3000):
    rng = np.random.default_rng(4)
    x, z = rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n).astype(float)
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, 2 * x - z + rng.normal(size=n))], "x double, z double, y double").repartition(3)


def test_a_round_reads_the_rows_once_and_for_quantiles_five_times(spark):
    df, sc, jobs = rows(spark), spark.sparkContext, {}
    for loss in (B.NormalScore(), B.CheckLoss((0.1, 0.5))):
        for n in (1, 3):
            sc.setJobGroup(f"rounds-{loss.trees}-{n}-{type(loss).__name__}", "")
            B.fit(df, ["x", "z"], "y", loss, rounds=n, depth=3, edges=[[1.0, 3.0, 6.0], [2.0]])
            jobs[type(loss).__name__, n] = len(sc.statusTracker().getJobIdsForGroup(f"rounds-{loss.trees}-{n}-{type(loss).__name__}"))
    sc.setJobGroup("", "")
    # a pass is a job for its shuffle and one for its result
    assert jobs["NormalScore", 3] - jobs["NormalScore", 1] <= 2 * 2
    assert jobs["CheckLoss", 3] - jobs["CheckLoss", 1] <= 2 * 2 * 5


def test_both_layouts_give_the_same_trees(spark):
    df = rows(spark)
    few, many = [[1.5, 3.5, 6.5], [2.5]], [[1.5, 3.5, 6.5, *np.arange(20, 220)], [2.5, *np.arange(20, 220)]]
    for loss in (B.LaplaceScore(), B.CheckLoss((0.1, 0.25, 0.9))):
        a, b = (B.fit(df, ["x", "z"], "y", loss, rounds=3, depth=2, rate=0.5, edges=[list(map(float, c)) for c in e], keep=2) for e in (few, many))
        assert a.cells() is not None and b.cells() is None
        for s, t in zip(a.splits(), b.splits(), strict=True):
            assert (s["feature"], s["threshold"]) == (t["feature"], t["threshold"])
            assert s["added"] is None or abs(s["added"] - t["added"]) < 1e-9


def test_bits_keep_order():
    x = np.array([-np.inf, -1e300, -2.0, -1.0, -1e-300, 0.0, 1e-300, 1.0, 1.5, np.inf])
    bits = B._ordered_bits(x)
    assert (bits[1:] > bits[:-1]).all() and [B._from_ordered_bits(int(b)) for b in bits] == x.tolist()
