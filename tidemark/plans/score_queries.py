"""Registered queries of metric bundles, masks and audits of predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import distribution, metrics, resampling, scoring
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.resampling import hash_sql, poisson_sql
from tidemark.plans.catalog import _PRED, _PROB, _Q5, _predictions, _probabilities, _quantiles, query, r6, table

#: Predictions of three models with everything that the metric bundle reads.
_FULL = f"{_PRED}, w AS (SELECT p.*, y * 0.85 + o_custkey % 20 * 500 AS base, CASE WHEN o_orderkey % 9 <> 0 THEN y * (1 + (o_custkey % 5 - 2) / 20.0) END AS cur, o_custkey % 50 - 1.0 AS price, f * 0.9 AS q10, f * CASE WHEN o_orderkey % 40 = 0 THEN 0.8 ELSE 1 END AS q50, f * 1.1 AS q90 FROM p)"


def _full(spark, d):
    c = F.col
    return _predictions(spark, d).select(
        "o_orderkey", "o_custkey", "m", c("y").alias("actual"), c("f").alias("forecast"), (c("y") * 0.85 + c("o_custkey") % 20 * 500).alias("baseline"), F.when(c("o_orderkey") % 9 != 0, c("y") * (1 + (c("o_custkey") % 5 - 2) / 20.0)).alias("current"),
        (c("o_custkey") % 50 - 1.0).alias("price"), (c("f") * 0.9).alias("q10"), (c("f") * F.when(c("o_orderkey") % 40 == 0, 0.8).otherwise(1)).alias("q50"), (c("f") * 1.1).alias("q90"),
    )


_ROUND = ("coverage", "mae", "rmse", "bias", "price_scaled_mae", "direction_accuracy", "baseline_mae", "interval_coverage", "interval_width", "pinball", "macro_mae", "median_ae", "p90_ae", "p95_ae", "p99_ae", "baseline_median_ae", "baseline_p99_ae", "gain")


@query(
    "a1_full_metrics",
    f"""WITH {_FULL}, e AS (SELECT *, f - y AS e, CASE WHEN f IS NOT NULL THEN abs(base - y) END AS be FROM w), mac AS (SELECT m, avg(a) AS macro_mae FROM (SELECT m, o_custkey, avg(abs(e)) AS a FROM e GROUP BY ALL) GROUP BY m)
    SELECT m, count(y) AS truth_rows, count(e) AS predicted_rows, round(count(e) / count(y), 4) AS coverage, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(avg(CASE WHEN price > 0 THEN abs(e) / price END), 4) AS price_scaled_mae,
    round(avg(CASE WHEN e IS NOT NULL AND cur IS NOT NULL THEN (sign(y - cur) = sign(f - cur))::INT END), 4) AS direction_accuracy, round(avg(be), 4) AS baseline_mae, round(avg(CASE WHEN f IS NOT NULL THEN (y BETWEEN q10 AND q90)::INT END), 4) AS interval_coverage, round(avg(q90 - q10), 4) AS interval_width,
    round(avg((greatest(0.1 * (y - q10), -0.9 * (y - q10)) + greatest(0.5 * (y - q50), -0.5 * (y - q50)) + greatest(0.9 * (y - q90), -0.1 * (y - q90))) / 3), 4) AS pinball, count(*) FILTER (q10 > q50 OR q50 > q90) AS crossing_rows, round(any_value(macro_mae), 4) AS macro_mae,
    round(quantile_cont(abs(e), 0.5), 4) AS median_ae, round(quantile_cont(abs(e), 0.9), 4) AS p90_ae, round(quantile_cont(abs(e), 0.95), 4) AS p95_ae, round(quantile_cont(abs(e), 0.99), 4) AS p99_ae, round(quantile_cont(be, 0.5), 4) AS baseline_median_ae, round(quantile_cont(be, 0.99), 4) AS baseline_p99_ae, round(1 - avg(abs(e)) / avg(be), 4) AS gain FROM e JOIN mac USING (m) GROUP BY m""",
)
def full_metrics(spark, d):
    out = scoring.full_metrics(_full(spark, d), ["m"], "o_custkey")
    return out.select(*[F.round(c, 4).alias(c) if c in _ROUND else c for c in out.columns])


_GROUPS = "list_filter([CASE WHEN y < 60000 THEN 'negative' END, CASE WHEN abs(y - 100000) <= 5000 THEN 'near_zero' END, CASE WHEN y >= 60000 THEN 'positive' END, CASE WHEN (y - cur) / greatest(abs(cur), 0.1) > 0.05 THEN 'high_growth' END, CASE WHEN (y - cur) / greatest(abs(cur), 0.1) <= 0.01 THEN 'low_growth' END, CASE WHEN cur < 60000 AND y > 60000 THEN 'loss_to_profit' END, CASE WHEN cur > 60000 AND y < 60000 THEN 'profit_to_loss' END], lambda g: g IS NOT NULL)"


@query(
    "a2_p29_subgroup_metrics",
    f"""WITH {_FULL}, g AS (SELECT m, f - y AS e, unnest({_GROUPS}) AS subgroup FROM w) SELECT m, subgroup, count(e) AS n, round(avg(abs(e)), 4) AS mae FROM g GROUP BY ALL""",
)
def subgroup_metrics(spark, d):
    y, cur = F.col("actual"), F.col("current")
    growth = (y - cur) / F.greatest(F.abs(cur), F.lit(0.1))
    names = S.codes((y < 60000, "negative"), (F.abs(y - 100000) <= 5000, "near_zero"), (y >= 60000, "positive"), (growth > 0.05, "high_growth"), (growth <= 0.01, "low_growth"), ((cur < 60000) & (y > 60000), "loss_to_profit"), ((cur > 60000) & (y < 60000), "profit_to_loss"))
    return scoring.by_subgroup(_full(spark, d), ["m"], names, F.col("forecast") - y).withColumn("mae", F.round("mae", 4))


@query("a3_independent_metrics", f"""WITH {_FULL} SELECT m, round(avg(abs(f - y)), 4) AS mae, round(sqrt(avg(power(f - y, 2))), 4) AS rmse, true AS agrees FROM w GROUP BY m""")
def independent_metrics(spark, d):
    # the same figures from SQL text, compared with the bundle's own
    p = _full(spark, d)
    sql = spark.sql("SELECT m, avg(abs(forecast - actual)) AS mae2, sqrt(avg(power(forecast - actual, 2))) AS rmse2 FROM {p} GROUP BY m", p=p)
    own = scoring.full_metrics(p, ["m"], "o_custkey").select("m", "mae", "rmse")
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.abs(F.col(a))
    return own.join(sql, "m").select("m", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), (close("mae", "mae2") & close("rmse", "rmse2")).alias("agrees"))


@query(
    "a4_log_metrics",
    f"""WITH {_PRED}, l AS (SELECT m, ln(f) - ln(y) AS e, y FROM p) SELECT m, count(y) AS truth_rows, round(count(e) / count(y), 6) AS coverage, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(abs(e), 0.5), 6) AS median_ae, round(quantile_cont(abs(e), 0.9), 6) AS p90, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(avg(e), 6) AS bias FROM l GROUP BY m""",
)
def log_metrics(spark, d):
    p = _predictions(spark, d).withColumn("e", S.safe_log(F.col("f")) - S.safe_log(F.col("y"))).withColumn("ae", F.abs("e"))
    main = p.groupBy("m").agg(F.count("y").alias("truth_rows"), r6(F.count("e") / F.count("y")).alias("coverage"), r6(F.avg("ae")).alias("mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.avg("e")).alias("bias"))
    q = exact_quantiles(p, ["m"], "ae", [0.5, 0.9, 0.95])
    return main.join(q, "m").select(*main.columns, *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("median_ae", "p90", "p95"))])


@query(
    "a6_worst_seed",
    f"""WITH {_PRED}, s AS (SELECT m, o_custkey % 5 AS seed, avg(abs(f - y)) AS mae, sum(abs(f - y)) AS t, count(f - y) AS n FROM p GROUP BY ALL)
    SELECT m, round(sum(t) / sum(n), 4) AS mae, arg_max(seed, struct_pack(a := mae, b := seed::VARCHAR)) AS worst_seed, round(max(mae), 4) AS worst_mae, round(min(mae), 4) AS best_mae FROM s GROUP BY m""",
)
def worst_seed(spark, d):
    p = _predictions(spark, d).withColumn("seed", F.col("o_custkey") % 5)
    out = scoring.per_seed(p, "m", "seed", F.col("f") - F.col("y"))
    return out.select("m", "worst_seed", *[F.round(c, 4).alias(c) for c in ("mae", "worst_mae", "best_mae")])


@query(
    "a7_a27_mask_families",
    f"""WITH {_PRED}, q AS (SELECT o_orderkey, m, y, CASE WHEN m <> 'low' OR o_orderkey % 3 <> 0 THEN f END AS f FROM p), md AS (SELECT m, count(f) >= 0.9 * count(*) AS fl FROM q GROUP BY m), t AS (SELECT count(*) AS nm, count(*) FILTER (fl) AS nf FROM md),
    k AS (SELECT o_orderkey, count(f) AS have, count(f) FILTER (fl) AS have_full FROM q JOIN md USING (m) GROUP BY 1), z AS (SELECT q.*, f IS NOT NULL AS c1, have = nm AS c2, have_full = nf AS c3 FROM q JOIN k USING (o_orderkey) CROSS JOIN t)
    SELECT m, round(avg(abs(f - y)) FILTER (c1), 4) AS complete, round(avg(abs(f - y)) FILTER (c2), 4) AS common, round(avg(abs(f - y)) FILTER (c3), 4) AS common_full, count(*) FILTER (c2) AS common_rows, count(*) FILTER (c3) AS full_rows FROM z GROUP BY m""",
)
def mask_families(spark, d):
    p = _predictions(spark, d).select("o_orderkey", "m", "y", F.when((F.col("m") != "low") | (F.col("o_orderkey") % 3 != 0), F.col("f")).alias("f"))
    z = scoring.mask_families(p, ["o_orderkey"], "m", "f", F.col("_n") >= 0.9 * F.col("_total"))
    mae = lambda mask: F.round(F.avg(F.when(F.col(mask), F.abs(F.col("f") - F.col("y")))), 4)
    return z.groupBy("m").agg(mae("mask_complete").alias("complete"), mae("mask_common").alias("common"), mae("mask_common_full").alias("common_full"), F.count_if("mask_common").alias("common_rows"), F.count_if("mask_common_full").alias("full_rows"))


@query(
    "a8_full_classification",
    f"""WITH {_PROB}, v AS (SELECT *, greatest(pa, pb, pc) AS conf, CASE WHEN pa = greatest(pa, pb, pc) THEN 0 WHEN pb = greatest(pa, pb, pc) THEN 1 ELSE 2 END AS pr FROM n WHERE pa IS NOT NULL), b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS k, abs(avg((pr = t)::INT) - avg(conf)) AS g FROM v GROUP BY 1)
    SELECT count(*) AS n, round(avg((pr = t)::INT), 6) AS accuracy, round(avg(-ln(CASE t WHEN 0 THEN pa WHEN 1 THEN pb ELSE pc END)), 6) AS log_loss, round(avg((pa - (t = 0)::INT) ^ 2 + (pb - (t = 1)::INT) ^ 2 + (pc - (t = 2)::INT) ^ 2), 6) AS brier,
    round(avg((pr = t)::INT) FILTER (t = 0), 6) AS recall_0, round(avg((pr = t)::INT) FILTER (t = 1), 6) AS recall_1, round(avg((pr = t)::INT) FILTER (t = 2), 6) AS recall_2, (SELECT round(sum(k * g) / sum(k), 6) FROM b) AS calibration_error,
    round((avg((pr = t)::INT) FILTER (t = 0) + avg((pr = t)::INT) FILTER (t = 1) + avg((pr = t)::INT) FILTER (t = 2)) / 3, 6) AS balanced_accuracy FROM v""",
)
def full_classification(spark, d):
    out = scoring.classification(_probabilities(spark, d), ["pa", "pb", "pc"], "t")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns if c != "n"])


@query("a14_a25_named_groups", "SELECT year(o_orderdate) AS year, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS final, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def named_groups(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "a17_interval_summary",
    """WITH g AS (SELECT user_id, value, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch(ts) AS s FROM events), w AS (SELECT *, CASE WHEN s IS NOT NULL THEN least(s, 3600.0) END AS w FROM g)
    SELECT user_id, round(sum(value * w) / sum(w), 5) AS mean, min(value) AS low, max(value) AS high, count(*) FILTER (s > 3600) AS long_gaps FROM w GROUP BY user_id""",
)
def interval_summary(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (F.lead(at).over(w) - at) / 1e6
    e = table(spark, d, "events").withColumn("s", gap).withColumn("w", F.when(F.col("s").isNotNull(), F.least("s", F.lit(3600.0))))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 5).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("s") > 3600).alias("long_gaps"))


@query("a18_telemetry", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, count(value) AS n FROM events GROUP BY event_type")
def telemetry(spark, d):
    e = table(spark, d, "events")
    q = exact_quantiles(e, ["event_type"], "value", [0.5, 0.95])
    return q.join(e.groupBy("event_type").agg(F.max("value").alias("top")), "event_type").select("event_type", r6(F.col("q")[0]).alias("median"), r6(F.col("q")[1]).alias("p95"), "top", "n")


@query(
    "a19_a30_maturity",
    f"""WITH {_PRED} SELECT year(o_orderdate) AS year, m, count(*) AS inferences, count(f) AS predicted, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS matured, count(f) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS scored FROM p JOIN orders USING (o_orderkey) GROUP BY ALL""",
)
def maturity(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    ripe = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")
    return _predictions(spark, d).join(o, "o_orderkey").groupBy(F.year("o_orderdate").alias("year"), "m").agg(F.count(F.lit(1)).alias("inferences"), F.count("f").alias("predicted"), F.count_if(ripe).alias("matured"), F.count(F.when(ripe, F.col("f"))).alias("scored"))


@query("a22_stratified", f"""WITH {_PRED} SELECT m, CASE o_custkey % 4 WHEN 0 THEN 'ANNUAL' WHEN 1 THEN 'FOUR_QUARTERS' WHEN 2 THEN 'BRIDGE' ELSE 'MISSING' END AS method, count(f) AS n, round(avg(abs(f - y)), 4) AS mae, round(avg(f - y), 4) AS bias FROM p GROUP BY ALL""")
def stratified(spark, d):
    method = F.get(F.array(*[F.lit(x) for x in ("ANNUAL", "FOUR_QUARTERS", "BRIDGE", "MISSING")]), (F.col("o_custkey") % 4).cast("int"))
    e = F.col("f") - F.col("y")
    return _predictions(spark, d).groupBy("m", method.alias("method")).agg(F.count("f").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.avg(e), 4).alias("bias"))


_PARTS = "(SELECT unnest([1, 2, 3]) AS set)"


@query(
    "a12_distribution_report",
    f"""WITH {_Q5}, z AS (SELECT y, q[1] AS q1, q[2] AS q2, q[3] AS q3, q[4] AS q4, q[5] AS q5, seed, flag, c AS m, CASE WHEN w > 2 THEN w * 40 END AS s, CASE WHEN w > 2 THEN CASE WHEN y < c THEN exp((y - c) / (w * 40)) / 2 ELSE 1 - exp(-(y - c) / (w * 40)) / 2 END END AS pit
      FROM (SELECT q.y, list_sort([a, b, q.c, d, e]) AS q, q.c, l.l_linenumber % 3 AS seed, l.l_returnflag AS flag, l.l_quantity AS w FROM q JOIN lineitem l USING (l_orderkey, l_partkey, l_suppkey) WHERE l.l_extendedprice = q.y)),
    p AS (SELECT CASE set WHEN 1 THEN 'all' WHEN 2 THEN 'seed' ELSE 'seed_flag' END AS part, CASE set WHEN 1 THEN 'all' WHEN 2 THEN seed::VARCHAR ELSE seed::VARCHAR || '|' || flag END AS key, z.* FROM z, {_PARTS})
    SELECT part, key, count(*) AS rows,
      round((0.1 * avg(greatest(y - q1, 0)) + 0.9 * avg(greatest(q1 - y, 0)) + 0.25 * avg(greatest(y - q2, 0)) + 0.75 * avg(greatest(q2 - y, 0)) + 0.5 * avg(abs(y - q3)) + 0.75 * avg(greatest(y - q4, 0)) + 0.25 * avg(greatest(q4 - y, 0)) + 0.9 * avg(greatest(y - q5, 0)) + 0.1 * avg(greatest(q5 - y, 0))) / 5, 4) AS mean_pinball,
      round(avg(0.5 * abs(y - q3) + 0.1 * (q5 - q1 + 10 * greatest(q1 - y, 0) + 10 * greatest(y - q5, 0)) + 0.25 * (q4 - q2 + 4 * greatest(q2 - y, 0) + 4 * greatest(y - q4, 0))) / 2.5, 4) AS wis,
      round(avg(0.1 * (q5 - q1) + 0.25 * (q4 - q2)) / 2.5, 4) AS dispersion, round(avg((y <= q1)::INT) - 0.1, 6) AS calibration_10, round(avg((y <= q5)::INT) - 0.9, 6) AS calibration_90,
      round(greatest(abs(avg((y <= q1)::INT) - 0.1), abs(avg((y <= q2)::INT) - 0.25), abs(avg((y <= q3)::INT) - 0.5), abs(avg((y <= q4)::INT) - 0.75), abs(avg((y <= q5)::INT) - 0.9)), 6) AS worst_calibration_error,
      round(avg((y BETWEEN q1 AND q5)::INT), 6) AS coverage_80, round(avg(q4 - q2), 4) AS width_50, round(avg((q1 = q5 OR q2 = q4)::INT), 6) AS collapsed, round(sqrt(avg((q3 - y) * (q3 - y))), 4) AS rmse, round(avg(q3 - y), 4) AS bias,
      round(quantile_cont(q5 - q1, 0.9), 4) AS p90_width_80, round(quantile_cont(abs(q3 - y), 0.5), 4) AS median_ae,
      round(avg(s * (abs(y - m) / s + exp(-abs(y - m) / s) - 0.75)), 4) AS crps, round(avg(ln(2 * s) + abs(y - m) / s), 6) AS nll, round(avg(pit), 6) AS pit_mean, round(var_pop(pit), 6) AS pit_variance,
      {", ".join(f"count(*) FILTER (pit IS NOT NULL AND least(floor(pit * 10), 9) = {i}) AS pit_{i}" for i in range(10))}
    FROM p GROUP BY part, key""",
)
def distribution_report(spark, d):
    """Levels, intervals, sharpness and density for the whole, by seed, and by seed and flag."""
    q = _quantiles(spark, d)
    more = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("y"), (F.col("l_linenumber") % 3).alias("seed"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 40).alias("s"))
    ordered = S.rearranged([F.col(c) for c in "abcde"])
    z = q.withColumn("q", ordered).select("l_orderkey", "l_partkey", "l_suppkey", "y", F.col("c").alias("m"), *[F.col("q")[i].alias(f"q{i + 1}") for i in range(5)]).join(more, ["l_orderkey", "l_partkey", "l_suppkey", "y"])
    r = distribution.distribution_report(z, "y", [f"q{i}" for i in range(1, 6)], {"all": [], "seed": ["seed"], "seed_flag": ["seed", "flag"]}, "m", "s", "laplace")
    four = [F.round(c, 4).alias(c) for c in ("mean_pinball", "wis", "dispersion", "width_50", "rmse", "bias", "p90_width_80", "median_ae", "crps")]
    six = [r6(F.col(c)).alias(c) for c in ("worst_calibration_error", "coverage_80", "collapsed", "nll", "pit_mean", "pit_variance")]
    return r.select("part", "key", "rows", *four, *six, r6(F.col("calibration")[0]).alias("calibration_10"), r6(F.col("calibration")[4]).alias("calibration_90"), *[F.col("pit_histogram")[i].alias(f"pit_{i}") for i in range(10)])


@query(
    "a23_cluster_interval",
    f"""WITH p AS (SELECT l_returnflag AS flag, l_orderkey * 8 + l_linenumber AS cluster, l_extendedprice / 1000 - l_quantity AS delta FROM lineitem), k AS (SELECT flag, cluster, sum(delta) AS s, count(delta) AS c FROM p GROUP BY ALL),
    h AS (SELECT flag, s, c, d, {hash_sql("cluster", "d")} AS h FROM k, (SELECT unnest(range(40)) AS d)), e AS (SELECT flag, d, sum(s * {poisson_sql("h")}) / sum(c * {poisson_sql("h")}) AS r FROM h GROUP BY ALL)
    SELECT flag, round(quantile_cont(r, 0.025), 5) AS low, round(quantile_cont(r, 0.975), 5) AS high, count(*) AS draws FROM e GROUP BY flag""",
)
def cluster_interval(spark, d):
    """Every line is a cluster, so there are more of them than 16 bits can number."""
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cluster"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("delta"))
    out = resampling.cluster_interval(p, ["flag"], F.col("cluster"), F.col("delta"), draws=40)
    return out.select("flag", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "draws")


@query(
    "a26_coverage_audit",
    """WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
    SELECT count(a.k) AS required, count(b.k) AS found, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated FROM a FULL JOIN b ON a.k = b.k""",
)
def coverage_audit(spark, d):
    a = table(spark, d, "orders").filter("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("k"))
    return scoring.coverage_audit(a, table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k")), ["k"])


@query(
    "a29_saturation",
    f"""WITH {_PRED}, g AS (SELECT m, o_custkey % 7 AS lane, 1 - avg(abs(f - y)) / avg(abs(y * 0.9 - y)) AS gain FROM p WHERE f IS NOT NULL GROUP BY ALL) SELECT m, count(*) AS lanes, bool_and(gain <= -0.1) AS saturated, arg_min(lane, struct_pack(a := round(gain, 9), b := lane)) AS worst_lane FROM g GROUP BY m""",
)
def saturation(spark, d):
    p = _predictions(spark, d).filter(F.col("f").isNotNull())
    g = p.groupBy("m", (F.col("o_custkey") % 7).alias("lane")).agg(S.relative_gain(F.avg(F.abs(F.col("f") - F.col("y"))), F.avg(F.abs(F.col("y") * 0.9 - F.col("y")))).alias("gain"))
    return g.groupBy("m").agg(F.count(F.lit(1)).alias("lanes"), F.bool_and(F.col("gain") <= -0.1).alias("saturated"), F.min_by("lane", F.struct(F.round("gain", 9), "lane")).alias("worst_lane"))


@query(
    "a31_run_lengths",
    """WITH r AS (SELECT user_id, event_type, ts, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""",
)
def run_lengths(spark, d):
    return scoring.run_lengths(table(spark, d, "events"), ["user_id"], ["ts"], "event_type")


@query(
    "a32_centred",
    """SELECT l_orderkey, l_partkey, l_suppkey, round(x - sum(x * w) OVER (PARTITION BY l_suppkey) / sum(CASE WHEN x IS NOT NULL THEN w END) OVER (PARTITION BY l_suppkey), 4) AS centred FROM (SELECT *, CASE WHEN l_partkey % 8 <> 0 THEN l_extendedprice END AS x, l_quantity AS w FROM lineitem)""",
)
def centred(spark, d):
    x = F.when(F.col("l_partkey") % 8 != 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(scoring.centred(x, F.col("l_quantity"), ["l_suppkey"]), 4).alias("centred"))


@query(
    "a34_m27_paired_ablation",
    f"""WITH {_PRED}, a AS (SELECT * FROM p WHERE m = 'close' AND f IS NOT NULL), b AS (SELECT * FROM p WHERE m = 'low' AND f IS NOT NULL)
    SELECT count(*) AS n, round(avg(abs(a.f - a.y)), 4) AS original, round(avg(abs(b.f - b.y)), 4) AS ablated, round(avg(abs(b.f - b.y) - abs(a.f - a.y)), 4) AS delta, round(avg((abs(b.f - b.y) < abs(a.f - a.y))::INT), 6) AS wins FROM a JOIN b USING (o_orderkey)""",
)
def paired_ablation(spark, d):
    p = _predictions(spark, d).filter(F.col("f").isNotNull()).withColumn("ae", F.abs(F.col("f") - F.col("y")))
    a, b = p.filter("m = 'close'").select("o_orderkey", "ae"), p.filter("m = 'low'").select("o_orderkey", F.col("ae").alias("be"))
    j = a.join(b, "o_orderkey")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ae"), 4).alias("original"), F.round(F.avg("be"), 4).alias("ablated"), F.round(F.avg(F.col("be") - F.col("ae")), 4).alias("delta"), r6(F.avg((F.col("be") < F.col("ae")).cast("int"))).alias("wins"))
