import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.operators.order_windows import Frame, sliding, sliding_means


def series(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=n), 1)
    x[rng.random(n) < 0.15] = np.nan
    return x


def plain(x, t, window, shift):
    return x[max(0, t - shift - window + 1) : max(0, t - shift + 1)]


@pytest.mark.parametrize("window, shift", [(1, 0), (1, 1), (7, 1), (10, 4), (30, 0)])
def test_frames_equal_sorting_each(window, shift):
    x, f = series(400, window), Frame(window, shift)
    for t, v in enumerate(x.tolist()):
        f.come_to(v)
        h = plain(x, t, window, shift)
        h = np.sort(h[~np.isnan(h)])
        assert f.a == h.tolist()
        if len(h):
            mid = np.quantile(h, 0.5)
            assert math.isclose(f.linear(0.5), mid, abs_tol=1e-12) and math.isclose(f.linear(0.9), np.quantile(h, 0.9), abs_tol=1e-12)
            assert f.inverted(0.25) == np.quantile(h, 0.25, method="inverted_cdf")
            assert math.isclose(f.median_distance(mid), np.median(np.abs(h - mid)), abs_tol=1e-12)
            assert math.isclose(f.rank(0.3), 100 * (h <= 0.3).mean())


@pytest.mark.parametrize("segment", [None, 25])
def test_columns_over_cut_series(spark, segment):
    many = {"a": series(333, 1), "b": series(24, 2), "c": series(25, 3), "d": series(26, 4), "e": series(1, 5)}
    rows = [(k, t, None if math.isnan(v) else float(v)) for k, x in many.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(5).withColumn("tag", F.col("k"))
    got = sliding(df, ["k"], ["t"], "x", 20, 3, linear={"mid": 0.5}, inverted={"q10": 0.1}, count="n", rank="pct", robust_z="z", segment=segment)
    assert got.columns == ["k", "t", "x", "tag", "mid", "q10", "n", "pct", "z"]
    got = {(r.k, r.t): r for r in got.collect()}
    assert len(got) == len(rows)
    for k, x in many.items():
        for t, v in enumerate(x):
            h, r = plain(x, t, 20, 3), got[k, t]
            h = h[~np.isnan(h)]
            assert r.tag == k and r.n == len(h)
            if not len(h):
                assert r.mid is None and r.q10 is None and r.pct is None and r.z is None
                continue
            mid = np.quantile(h, 0.5)
            assert abs(r.mid - mid) < 1e-12 and r.q10 == np.quantile(h, 0.1, method="inverted_cdf")
            if math.isnan(v):
                assert r.pct is None and r.z is None
            else:
                assert abs(r.pct - 100 * (h <= v).mean()) < 1e-9
                assert abs(r.z - (v - mid) / max(1.4826 * np.median(np.abs(h - mid)), 1e-8)) < 1e-9


def test_rank_and_forward_median(spark):
    x = series(200, 8)
    df = spark.createDataFrame([(1, t, None if math.isnan(v) else float(v)) for t, v in enumerate(x)], "k int, t int, x double")
    for r in windows.causal_rank(df, ["k"], ["t"], "x", 12, 6).collect():
        h = plain(x, r.t, 12, 1)
        h = h[~np.isnan(h)]
        assert (r.pct is None) == (len(h) < 6 or math.isnan(x[r.t]))
    for r in windows.forward_median(df, ["k"], ["t"], "x", 4, "y").collect():
        h = x[r.t + 1 : r.t + 5]
        want = np.median(h) if len(h) == 4 and not np.isnan(h).any() else None
        assert r.y == want or abs(r.y - want) < 1e-12


def test_time_is_linear_in_rows_and_nearly_free_of_the_frame():
    def took(n, window):
        x, f = np.random.default_rng(1).normal(size=n).tolist(), Frame(window, 1)
        began = time.process_time()
        for v in x:
            f.come_to(v)
            if f.a:
                f.median_distance(f.linear(0.5))
        return time.process_time() - began

    took(2000, 756)
    one = min(took(20_000, 756) for _ in range(3))
    assert min(took(80_000, 756) for _ in range(2)) < 8 * one
    assert one < 6 * min(took(20_000, 20) for _ in range(3))


@pytest.mark.parametrize("segment, window, shift", [(None, 7, 3), (25, 7, 3), (40, 12, 0), (None, 1, 1)])
def test_means_over_cut_series(spark, segment, window, shift):
    x, y = series(300, 4), np.arange(300.0) ** 2
    y[50] = np.nan  # a NaN that is a value stays within its frames
    rows = [(k, i, None if np.isnan(x[i]) else float(x[i]), float(y[i])) for k in ("a", "b") for i in range(300 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double").repartition(3)
    got = {(r.k, r.i): r for r in sliding_means(df, ["k"], ["i"], ["x", "y"], window, shift, segment).collect()}
    assert len(got) == len(rows)
    for k, i, _, _ in rows:
        h, g, r = plain(x, i, window, shift), plain(y, i, window, shift), got[k, i]
        h = h[~np.isnan(h)]
        assert (r.n_x, r.n_y) == (len(h), len(g))
        assert r.mean_x is None if not len(h) else math.isclose(r.mean_x, h.mean(), abs_tol=1e-12)
        assert r.mean_y is None if not len(g) else np.isclose(r.mean_y, g.mean(), rtol=1e-12, equal_nan=True)


def test_gates_do_not_add_up_each_frame_row_by_row(spark):
    df = spark.range(9).selectExpr("1 as k", "id as i", "0.4 as p", "0.6 as q", "0.5 as u", "0.5 as v", "cast(id % 2 as int) as y")
    for out in (windows.matured_gate(df, ["k"], ["i"], ["p", "q"], ["u", "v"], "y", 2, 252, 3, 0.0, 0.1, 0.5, classwise=True), windows.paired_losses(df, ["k"], ["i"], "y", "p", "u", 252, 3)):
        assert "RowFrame, -" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 9
