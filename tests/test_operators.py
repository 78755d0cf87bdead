"""Properties of the point-in-time operators: the past never sees the future."""

import random

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, metrics, windows


def frame(spark, n=300, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([("ab"[i % 2], i, None if rng.random() < 0.2 else rng.uniform(1, 9)) for i in range(n)], "g string, t long, x double")


def test_future_values_do_not_change_the_past(spark):
    df = frame(spark)
    later = df.withColumn("x", F.when(F.col("t") < 200, F.col("x")).otherwise(1e9))

    def out(d):
        spec = windows.past(["g"], ["t"], 20)
        r = windows.filled(d.withColumn("pos", F.floor(F.col("t") / 2)), "x", ["g"], ["pos"], "pos", "f")
        r = r.withColumn("m", windows.rolled(F.col("x"), spec, 5))
        r = windows.causal_rank(r, ["g"], ["t"], "x", 20, 5).select("t", "f", "m", "pct")
        return sorted(map(tuple, r.filter("t < 200").collect()))

    assert out(df) == out(later)


def test_causal_fill_is_the_recurrence(spark):
    xs = [None, 2.0, None, 4.0, None, 6.0, None, 8.0, None, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "g string, pos long, x double")
    want = []
    for j, x in enumerate(xs):
        want.append(x if x is not None else want[j - 4] if j >= 4 else want[j - 1] if j else 0.0)
    got = [r.f for r in windows.filled(df, "x", ["g"], ["pos"], "pos", "f").orderBy("pos").collect()]
    assert got == want


def test_asof_backward_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 50), ("a", 2, 20), ("b", 4, 40)], "k string, rt long, v long")
    get = lambda strict: sorted((r.k, r.t, r.v) for r in asof.asof_backward(left, right, ["k"], "t", "rt", ["v"], strict).collect())
    assert get(False) == [("a", 1, None), ("a", 5, 50), ("b", 3, None)]
    assert get(True) == [("a", 1, None), ("a", 5, 20), ("b", 3, None)]


def test_newer_session_beats_newer_revision(spark):
    dec = spark.createDataFrame([("e", 10)], "e string, d long")
    hist = spark.createDataFrame([("e", 1, 9, 1, 1.0), ("e", 2, 1, 2, 2.0), ("e", 3, 1, 11, 3.0)], "e string, session long, revision long, available long, v double")
    got = asof.bitemporal_asof(dec, hist, ["e"], ["e", "d"], F.col("available") <= F.col("d"), ["session", "revision"], ["v"]).first()
    assert got.v == 2.0


def test_common_mask_and_pareto(spark):
    p = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", None)], "k long, m string, f double")
    assert {r.k for r in metrics.common_mask(p, ["k"], "m", "f").collect()} == {1}
    s = spark.createDataFrame([("x", 1.0, 5.0), ("y", 2.0, 4.0), ("z", 0.5, 1.0)], "k string, cost double, gain double")
    assert {r.k for r in metrics.pareto(s, "k", ["cost"], ["gain"]).collect()} == {"x", "z"}


def test_scalars_on_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (2.0,)], "x double")
    x = F.col("x")
    assert [r[0] for r in df.select(S.finite(x)).collect()] == [None, None, None, -1.0, 2.0]
    assert [r[0] for r in df.select(S.positive(x)).collect()] == [None, None, None, None, 2.0]
    assert [r[0] for r in df.select(S.clip(S.finite(x), 0.0, 1.0)).collect()] == [None, None, None, 0.0, 1.0]


def test_running_form_equals_the_join(spark):
    rng = random.Random(4)
    hist = spark.createDataFrame([(rng.choice("ab"), rng.randint(0, 20), rng.randint(0, 20), rng.randint(0, 20), i, float(i)) for i in range(200)], "e string, session long, observed long, available long, revision long, v double")
    dec = spark.createDataFrame([(e, d) for e in "abc" for d in range(0, 25, 3)], "e string, d long")
    seen = (F.col("observed") <= F.col("d")) & (F.col("available") <= F.col("d")) & (F.col("session") <= F.col("d"))
    a = asof.bitemporal_asof(dec, hist, ["e"], ["e", "d"], seen, ["session", "revision"], ["v"])
    t = lambda c: F.timestamp_seconds(F.col(c))
    b = asof.bitemporal_running(dec.withColumn("at", t("d")), hist, ["e"], "at", F.greatest(t("observed"), t("available"), t("session")), ["session", "revision"], ["v"])
    get = lambda df: sorted(map(str, df.select("e", "d", "v").collect()))
    assert get(a) == get(b)


def test_rescaled_price_and_expected_start(spark):
    import datetime as dt

    from tidemark.operators import fiscal

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    prices = spark.createDataFrame([("a", day(0), 10.0, 1.0), ("a", day(2), None, 2.0), ("a", day(9), None, 3.0)], "k string, at timestamp, price double, ratio double")
    left = spark.createDataFrame([("a", day(1)), ("a", day(3)), ("a", day(10)), ("b", day(1))], "k string, t timestamp")
    got = sorted((r.k, r.t, r.price and round(r.price, 6)) for r in asof.asof_rescaled(left, prices, ["k"], "t", "at", "price", "ratio", 7).collect())
    assert [x[2] for x in got] == [10.0, 20.0, None, None]
    panel = spark.createDataFrame([("a", day(40).date(), day(0).date()), ("a", day(130).date(), day(91).date()), ("a", day(50).date(), day(200).date())], "k string, asof date, stop date")
    starts = {r.stop: r.expected_start for r in fiscal.expected_start(panel, "k", "asof", "stop").collect()}
    assert starts[day(0).date()] is None and starts[day(91).date()] == day(1).date() and starts[day(200).date()] == day(1).date()
