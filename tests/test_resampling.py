import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import resampling as R
from tidemark.operators import selection


def test_hashes_equal_integer_arithmetic_and_sql():
    def mixed(z):
        z = (z ^ (z >> 30)) * R.MIX1 % 2**64
        z = (z ^ (z >> 27)) * R.MIX2 % 2**64
        return z ^ (z >> 31)

    keys, draws = [0, 1, 77, 2**40 + 3, -5], range(4)
    want = [[mixed((mixed(k % 2**64) + (d + 1) * R.GOLDEN) % 2**64) for d in draws] for k in keys]
    assert R.counter_hash(np.array(keys), np.arange(4)).tolist() == want
    sql = f"SELECT {R.hash_sql('k', 'd')} FROM (SELECT unnest([0, 1, 77, {2**40 + 3}]) AS k), (SELECT unnest(range(4)) AS d) ORDER BY k, d"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == sum(want[:4], [])


def test_every_one_of_many_clusters_is_drawn():
    w = R.poisson_weights(np.arange(100_000), np.arange(40))
    assert (w.sum(1) > 0).all()
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 1e-3
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.02 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.02


def test_sums_by_draw_and_interval(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], int(c), None if i % 13 == 0 else float(v)) for i, (c, v) in enumerate(zip(rng.integers(0, 300, 4000), rng.normal(size=4000)))]
    df = spark.createDataFrame(rows, "g string, c int, v double").repartition(6)
    got = {(r.g, r.draw): (r.s, r.c) for r in R.draw_sums(df, ["g"], F.col("c"), F.col("v"), 30, cells=512).collect()}
    for g in "ab":
        weights = R.poisson_weights(np.arange(300), np.arange(30))
        for d in range(30):
            s = sum(weights[c, d] * v for h, c, v in rows if h == g and v is not None)
            n = sum(weights[c, d] for h, c, v in rows if h == g and v is not None)
            assert abs(got[g, d][0] - s) < 1e-8 and got[g, d][1] == n
    for r in R.cluster_interval(df, ["g"], F.col("c"), F.col("v"), 30).collect():
        each = [got[r.g, d][0] / got[r.g, d][1] for d in range(30)]
        assert math.isclose(r.low, np.quantile(each, 0.025)) and math.isclose(r.high, np.quantile(each, 0.975)) and r.draws == 30
    one = R.cluster_interval(df, [], F.col("g"), F.col("v"), 30).first()
    assert one.low <= one.high
    assert R.cluster_interval(df.limit(0), ["g"], F.col("c"), F.col("v"), 30).collect() == []


def test_two_thousand_draws_of_a_hundred_thousand_clusters(spark):
    df = spark.range(100_000).select("id", (F.col("id") % 7).cast("double").alias("v"))
    r = R.cluster_interval(df, [], F.col("id"), F.col("v"), 2000).first()
    sd = np.std(np.arange(100_000) % 7) / math.sqrt(100_000)
    mean = (np.arange(100_000) % 7).mean()
    assert r.draws == 2000 and abs(r.low - (mean - 1.96 * sd)) < 0.3 * sd and abs(r.high - (mean + 1.96 * sd)) < 0.3 * sd


def test_resampled_rows_follow_their_weights(spark):
    df = spark.createDataFrame([(g, k, float(k)) for g in (1, 2) for k in range(5)], "g int, k int, w double")
    got = selection.resampled(df, ["g"], ["k"], F.col("w"), 4000)
    assert got.columns == ["g", "k", "w", "draw"]
    count = Counter((r.g, r.k) for r in got.collect())
    assert sum(count.values()) == 8000
    for g in (1, 2):
        assert count[g, 0] == 0 and all(abs(count[g, k] / 4000 - k / 10) < 0.03 for k in range(1, 5))
