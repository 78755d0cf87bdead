"""Registered queries of further scalar operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.plans.catalog import _ORD, _Q5, SERIES, _ordered, _quantiles, query, r6, series, table


@query(
    "p4_p5_exponentials",
    f"""WITH {SERIES}, q AS (SELECT user_id, greatest(quantile_cont(abs(x), 0.5), 0.1) AS scale FROM s WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id)
    SELECT event_id, round(exp(x / 10) - 1, 5) AS em1, round(CASE WHEN x * 20 < 709.7 THEN exp(x * 20) / exp(x * 20 - 3) END, 5) AS kept, round(asinh(x / scale), 6) AS target, round(sinh(asinh(x / scale)) * scale, 4) AS back FROM s LEFT JOIN q USING (user_id)""",
)
def exponentials(spark, d):
    x, s = F.col("x"), series(spark, d)
    scale = s.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).groupBy("user_id").agg(F.greatest(F.percentile(F.abs(x), F.lit(0.5)), F.lit(0.1)).alias("scale"))
    target = F.asinh(x / F.col("scale"))
    return s.join(scale, "user_id", "left").select("event_id", F.round(S.safe_expm1(x / 10), 5).alias("em1"), F.round(S.safe_exp(x * 20) / S.safe_exp(x * 20 - 3), 5).alias("kept"), r6(target).alias("target"), F.round(F.sinh(target) * F.col("scale"), 4).alias("back"))


@query(
    "p15_p16_unit_suspicion",
    """WITH u AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice * (l_partkey % 9 - 1) AS net, l_quantity * CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 100 END AS shares, l_discount * 100 AS eps FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN shares * eps = 0 THEN NULL WHEN net / (shares * eps) < 0 THEN 'SIGN' WHEN abs(net / (shares * eps)) > 10 THEN 'HIGH' WHEN abs(net / (shares * eps)) < 0.1 THEN 'LOW' ELSE 'OK' END AS code,
    CASE WHEN shares > 0 AND shares < 1000 THEN CASE WHEN l_suppkey IN (1, 2, 3) THEN 'REVIEWED' ELSE 'SUSPECT' END END AS share_check FROM u""",
)
def unit_suspicion(spark, d):
    net, shares, eps = F.col("l_extendedprice") * (F.col("l_partkey") % 9 - 1), F.col("l_quantity") * F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(100), F.col("l_discount") * 100
    few = (shares > 0) & (shares < 1000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", S.unit_code(net, shares, eps).alias("code"), F.when(few, F.when(F.col("l_suppkey").isin(1, 2, 3), "REVIEWED").otherwise("SUSPECT")).alias("share_check"))


@query(
    "p18_p19_lag_vector_features",
    f"""WITH {_ORD}, v AS (SELECT o_orderkey, k, list(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS h FROM o)
    SELECT o_orderkey, round(h[-1] - h[-5], 4) AS growth, round(h[-1] - 2 * h[-5] + h[-9], 4) AS acceleration, round(list_aggregate(h[-8:], 'stddev_pop'), 3) AS volatility, round(greatest(list_aggregate(h, 'quantile_cont', 0.5), 0.1), 4) AS scale FROM v""",
)
def lag_vector(spark, d):
    past = Window.partitionBy("o_custkey").orderBy("k").rowsBetween(-31, 0)
    v = _ordered(spark, d).withColumn("h", F.collect_list("o_totalprice").over(past)).withColumn("scale", F.percentile(F.abs("o_totalprice"), F.lit(0.5)).over(past))
    at = lambda i: F.try_element_at("h", F.lit(-i))
    last = F.slice("h", -F.least(F.size("h"), F.lit(8)), F.lit(8))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    std = F.sqrt(mean(F.transform(last, lambda x: (x - mean(last)) * (x - mean(last)))))
    return v.select("o_orderkey", F.round(at(1) - at(5), 4).alias("growth"), F.round(at(1) - 2 * at(5) + at(9), 4).alias("acceleration"), F.round(std, 3).alias("volatility"), F.round(F.greatest("scale", F.lit(0.1)), 4).alias("scale"))


@query("p20_p42_feature_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_tax, l_quantity FROM lineitem WHERE l_orderkey IS NOT NULL")
def feature_columns(spark, d):
    from tidemark.operators.contracts import canonical, feature_names

    li = table(spark, d, "lineitem")
    names = feature_names(li.columns, prefixes=["l_disc", "l_tax"], listed=["l_quantity"], forbidden=["l_extendedprice", "l_returnflag"])
    return canonical(li, ["l_orderkey", "l_partkey", "l_suppkey"], names, width=6)


@query(
    "p21_p46_scaled_features",
    """SELECT o_orderkey, round(o_totalprice / 1e9, 12) AS billions, round(CASE WHEN o_custkey % 10 <> 0 THEN o_totalprice / (o_custkey % 10) END, 6) AS scaled,
    '{"orderkey":' || o_orderkey || ',"ratio":' || CASE WHEN o_custkey % 10 = 0 THEN 'null' ELSE (o_orderkey // (o_custkey % 10))::VARCHAR END || '}' AS line FROM orders""",
)
def scaled_features(spark, d):
    den = F.col("o_custkey") % 10
    ratio = F.when(den != 0, F.expr("o_orderkey div (o_custkey % 10)"))
    line = F.to_json(F.struct(F.col("o_orderkey").alias("orderkey"), ratio.alias("ratio")), {"ignoreNullFields": "false"})
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1e9, 12).alias("billions"), F.round(S.finite(F.col("o_totalprice") / F.nullif(den, F.lit(0))), 6).alias("scaled"), line.alias("line"))


@query(
    "p23_forward_labels",
    f"""WITH {_ORD}, l AS (SELECT o_orderkey, o_totalprice AS p, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY k) AS q FROM o)
    SELECT o_orderkey, CASE WHEN q / p - 1 <= -0.1 THEN 'DOWN' WHEN q / p - 1 >= 0.1 THEN 'UP' WHEN q IS NOT NULL THEN 'FLAT' END AS label FROM l""",
)
def forward_labels(spark, d):
    later = F.lead("o_totalprice", 2).over(Window.partitionBy("o_custkey").orderBy("k"))
    return _ordered(spark, d).withColumn("q", later).select("o_orderkey", S.forward_label(F.col("o_totalprice"), F.col("q"), -0.1, 0.1).alias("label"))


@query(
    "p24_p25_parsing",
    """WITH t AS (SELECT o_orderkey, ['true', ' Yes', 'N', '0', 'maybe', ''][(o_orderkey % 6 + 1)::INT] AS flag, ['12.345', '-3', '1e5', '99999', ' 7.5 ', 'x', '4.'][(o_orderkey % 7 + 1)::INT] AS num FROM orders)
    SELECT o_orderkey, CASE WHEN lower(trim(flag)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(flag)) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag,
    CASE WHEN regexp_full_match(trim(num), '[+-]?[0-9]+(\\.[0-9]+)?') AND num::DOUBLE BETWEEN -10 AND 1000 THEN num::DOUBLE END AS num FROM t""",
)
def parsing(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    flag, num = pick(["true", " Yes", "N", "0", "maybe", ""]), pick(["12.345", "-3", "1e5", "99999", " 7.5 ", "x", "4."])
    return table(spark, d, "orders").select("o_orderkey", S.truth_value(flag).alias("flag"), S.bounded_decimal(num, -10, 1000).alias("num"))


@query(
    "p30_vintage_weight",
    """SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN l_returnflag <> 'N' OR l_suppkey % 5 <> 0 THEN least(greatest(l_quantity * 3, 5.0), 100.0) / 100 * CASE WHEN l_returnflag = 'A' THEN 0.5 ELSE 1 END / (1 + greatest(coalesce(CASE WHEN l_partkey % 4 <> 0 THEN l_discount END, 0), 0)) END, 6) AS weight FROM lineitem""",
)
def vintage_weight(spark, d):
    approximate = F.when((F.col("l_returnflag") != "N") | (F.col("l_suppkey") % 5 != 0), F.col("l_returnflag") == "A")
    w = S.vintage_weight(F.col("l_quantity") * 3, F.when(F.col("l_partkey") % 4 != 0, F.col("l_discount")), approximate)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", r6(w).alias("weight"))


_VAL = "v AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS pct, CASE WHEN l_linenumber <> 6 THEN l_discount * 4 - 0.2 END AS gap, l_quantity / 10 - 2.5 AS z, l_returnflag = 'R' AND l_tax = 0 AS neg, l_extendedprice AS a, l_extendedprice * (1 + l_tax) AS b, l_suppkey FROM lineitem)"


def _valuation(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.when(c("l_linenumber") != 7, c("l_quantity") * 2).alias("pct"), F.when(c("l_linenumber") != 6, c("l_discount") * 4 - 0.2).alias("gap"), (c("l_quantity") / 10 - 2.5).alias("z"), ((c("l_returnflag") == "R") & (c("l_tax") == 0)).alias("neg"), c("l_extendedprice").alias("a"), (c("l_extendedprice") * (1 + c("l_tax"))).alias("b"))


@query(
    "p33_p34_valuation",
    """WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS pct, CASE WHEN l_linenumber <> 6 THEN l_discount * 4 - 0.2 END AS gap, l_quantity / 10 - 2.5 AS z, l_returnflag = 'R' AND l_tax = 0 AS neg, l_extendedprice AS a, l_extendedprice * (1 + l_tax) AS b FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey,
    CASE WHEN neg THEN 'NO_MEANING' WHEN pct >= 80 AND gap >= 0.03 THEN 'DEAR' WHEN pct <= 20 AND gap <= -0.03 THEN 'CHEAP' WHEN pct IS NOT NULL AND gap IS NOT NULL THEN 'NORMAL' ELSE 'INSUFFICIENT_DATA' END AS adaptive,
    CASE WHEN neg THEN 'NO_MEANING' WHEN pct >= 90 AND gap >= 0.05 AND z >= 1 THEN 'DEAR' WHEN pct <= 10 AND gap <= -0.05 AND z <= -1 THEN 'CHEAP' WHEN pct IS NOT NULL AND gap IS NOT NULL THEN 'NORMAL' ELSE 'INSUFFICIENT_DATA' END AS confirmed,
    round(CASE WHEN neg THEN 0 ELSE least(greatest(0.45 * coalesce(pct, 0) / 100 + 0.25 * least(l_partkey / 504.0, 1.0) + 0.15 * tanh(abs(coalesce(gap, 0)) / 0.02) + 0.15 * exp(-abs(ln(a / b))), 0), 1) END, 6) AS confidence FROM v""",
)
def valuation(spark, d):
    v, c = _valuation(spark, d), F.col
    adaptive = S.valuation_state(c("pct"), c("gap"), None, c("neg"), 20, 80, 0.03)
    confirmed = S.valuation_state(c("pct"), c("gap"), c("z"), c("neg"), 10, 90, 0.05, 1.0)
    return v.select("l_orderkey", "l_partkey", "l_suppkey", adaptive.alias("adaptive"), confirmed.alias("confirmed"), r6(S.valuation_confidence(c("pct"), c("l_partkey"), c("gap"), c("a"), c("b"), ~c("neg"))).alias("confidence"))


@query(
    "p35_fail_closed",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 7 / 7.0 ELSE 0 END AS weight, o_orderstatus <> 'P' AND o_custkey % 2 = 0 AS accepted FROM orders""",
)
def fail_closed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 7 / 7.0).alias("weight"), (F.col("o_custkey") % 2 == 0).alias("accepted"), "o_orderstatus")
    return S.masked(o, F.col("o_orderstatus") == "P", null=["price"], zero=["weight"], false=["accepted"]).drop("o_orderstatus")


_SIDES = """e AS (SELECT o_orderkey AS k, o_custkey % 40 AS ticker, o_orderdate::DATE AS asof, o_custkey % 4 AS horizon, CASE WHEN o_custkey % 11 = 0 THEN 'EUR' ELSE 'USD' END AS currency, o_orderkey % 3 AS basis, o_orderkey % 13 <> 0 AS gaap, o_orderkey % 17 <> 0 AS ttm, CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / 1000 - 20 END AS eps, o_orderkey % 23 <> 0 AS valid FROM orders),
    p AS (SELECT o_orderkey AS k, o_custkey % 40 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS ticker, o_orderdate::DATE AS asof, o_custkey % 4 AS horizon, 'USD' AS currency, o_orderkey % 3 AS basis, true AS gaap, true AS ttm, CASE WHEN o_orderkey % 31 <> 0 THEN o_custkey % 30 - 1.0 END AS pe FROM orders)"""


@query(
    "p36_contract_gate",
    f"""WITH {_SIDES}, z AS (SELECT e.k, concat_ws('|', CASE WHEN eps IS NULL OR NOT valid THEN 'INVALID_EPS' END, CASE WHEN e.ticker <> p.ticker THEN 'MISMATCH_TICKER' END, CASE WHEN e.asof <> p.asof THEN 'MISMATCH_ASOF' END, CASE WHEN e.horizon <> p.horizon THEN 'MISMATCH_HORIZON' END, CASE WHEN e.currency <> p.currency THEN 'MISMATCH_CURRENCY' END, CASE WHEN e.basis <> p.basis THEN 'MISMATCH_BASIS' END, CASE WHEN e.gaap <> p.gaap THEN 'MISMATCH_GAAP' END, CASE WHEN e.ttm <> p.ttm THEN 'MISMATCH_TTM' END,
    CASE WHEN NOT e.ttm THEN 'NOT_ANNUAL' END, CASE WHEN NOT e.gaap THEN 'WRONG_DEFINITION' END, CASE WHEN eps <= 0 THEN 'NONPOSITIVE_EPS' END, CASE WHEN pe IS NULL OR pe <= 0 THEN 'INVALID_MULTIPLE' END) AS errors, eps * pe AS price FROM e JOIN p USING (k))
    SELECT k, errors, errors = '' AS ready, round(CASE WHEN errors = '' THEN price END, 6) AS price FROM z""",
)
def contract_gate(spark, d):
    from tidemark.operators.contracts import compatible

    o, c = table(spark, d, "orders"), F.col
    key = [c("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("asof"), (c("o_custkey") % 4).alias("horizon"), (c("o_orderkey") % 3).alias("basis")]
    eps = o.select(*key, (c("o_custkey") % 40).alias("ticker"), F.when(c("o_custkey") % 11 == 0, "EUR").otherwise("USD").alias("currency"), (c("o_orderkey") % 13 != 0).alias("gaap"), (c("o_orderkey") % 17 != 0).alias("ttm"), F.when(c("o_orderkey") % 19 != 0, c("o_totalprice") / 1000 - 20).alias("eps"), (c("o_orderkey") % 23 != 0).alias("valid"))
    pe = o.select(*key, (c("o_custkey") % 40 + F.when(c("o_orderkey") % 29 == 0, 1).otherwise(0)).alias("ticker"), F.lit("USD").alias("currency"), F.lit(True).alias("gaap"), F.lit(True).alias("ttm"), F.when(c("o_orderkey") % 31 != 0, c("o_custkey") % 30 - 1.0).alias("pe"))
    out = compatible(eps, pe, "k", ["ticker", "asof", "horizon", "currency", "basis", "gaap", "ttm"])
    return out.select("k", F.concat_ws("|", "errors").alias("errors"), "ready", r6(c("price")).alias("price"))


@query(
    "p37_relative_gains",
    """WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS e, avg(l_quantity * 1000 * (l_suppkey % 5)) AS b FROM lineitem GROUP BY l_suppkey)
    SELECT l_suppkey, round(CASE WHEN b > 0 THEN 1 - e / b END, 6) AS gain, round(CASE WHEN b > 0 THEN e / b - 1 END, 6) AS degradation FROM s""",
)
def relative_gains(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("e"), F.avg(F.col("l_quantity") * 1000 * (F.col("l_suppkey") % 5)).alias("b"))
    gain = S.relative_gain(F.col("e"), F.col("b"))
    return s.select("l_suppkey", r6(gain).alias("gain"), r6(-gain).alias("degradation"))


@query(
    "p39_uncertainty",
    f"""WITH {_Q5} SELECT l_orderkey, l_partkey, l_suppkey, round(CASE WHEN ok THEN ln(d) - ln(b) END, 6) AS iqr, round(CASE WHEN ok THEN ln(e) - ln(a) END, 6) AS idr, round(CASE WHEN ok THEN (ln(d) - ln(b)) / 1.3489795003921634 END, 6) AS robust_sigma, round(CASE WHEN ok THEN e / a END, 6) AS ratio
    FROM (SELECT *, a > 0 AND a < b AND b < d AND d < e AS ok FROM q)""",
)
def uncertainty(spark, d):
    cols = S.spread_columns(*[F.col(c) for c in "abde"])
    return _quantiles(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", *cols).select("l_orderkey", "l_partkey", "l_suppkey", *[r6(F.col(c)).alias(c) for c in ("iqr", "idr", "robust_sigma", "ratio")])


_Z = "z AS (SELECT l_suppkey, (l_extendedprice / 1000 - 30) / (l_quantity / 10.0) AS z, l_quantity / 10.0 AS s FROM lineitem), f AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) AS den, 1 / (1 + 0.2316419 * abs(z)) AS t FROM z), g AS (SELECT *, den * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS up FROM f), n AS (SELECT *, CASE WHEN z >= 0 THEN 1 - up ELSE up END AS cdf FROM g)"


@query(
    "p40_distribution_scores",
    f"""WITH {_Z} SELECT l_suppkey, round(avg(s * (z * (2 * cdf - 1) + 2 * den - 1 / sqrt(pi()))), 6) AS normal_crps, round(avg(0.5 * ln(2 * pi()) + ln(s) + z * z / 2), 5) AS normal_nll, round(avg(cdf), 6) AS normal_pit, round(avg(ln(2 * s) + abs(z)), 6) AS laplace_nll, round(avg(CASE WHEN z < 0 THEN exp(z) / 2 ELSE 1 - exp(-z) / 2 END), 6) AS laplace_pit FROM n GROUP BY l_suppkey""",
)
def distribution_scores(spark, d):
    y, loc, s = F.col("l_extendedprice") / 1000, F.lit(30.0), F.col("l_quantity") / 10.0
    made = {"normal_crps": S.normal_crps(y, loc, s), "normal_nll": S.normal_nll(y, loc, s), "normal_pit": S.normal_cdf((y - loc) / s), "laplace_nll": S.laplace_nll(y, loc, s), "laplace_pit": S.laplace_cdf(y, loc, s)}
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.round(F.avg(v), 5 if k == "normal_nll" else 6).alias(k) for k, v in made.items()])


@query(
    "p43_prediction_identity",
    """SELECT o_orderkey, 'm1' AS model_id, 7 AS seed, 'f' || (o_custkey % 5) AS fold_id, count(*) OVER (PARTITION BY o_orderkey, o_custkey % 5) = 1 AS unique_identity FROM orders""",
)
def prediction_identity(spark, d):
    from tidemark.operators.contracts import with_identity

    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey") % 5).alias("fold_id"))
    return with_identity(o, {"model_id": "m1", "seed": 7}, ["o_orderkey", "fold_id"])


_NAMES = ["forest_h1", "boost_h1", "chain_observed", "ens_mean", "flat_observed", "boost_ttm", "curve", "chain_ttm", "forest_ttm", "kernel_h1"]


@query(
    "p44_p45_roles_and_families",
    f"""WITH m AS (SELECT unnest({_NAMES}) AS name, unnest(range(10)) AS i), g AS (SELECT o_custkey % 10 AS i, avg(o_totalprice) AS mae, avg(CASE WHEN o_orderkey % (o_custkey % 10 + 12) <> 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM orders GROUP BY 1), b AS (SELECT avg(o_totalprice) AS base FROM orders)
    SELECT name, CASE WHEN name LIKE 'forest%' OR name LIKE 'boost%' THEN 'TREES' WHEN name LIKE 'chain%' THEN 'STATISTICAL' WHEN name LIKE '%observed' THEN 'BASELINE' ELSE 'OTHER' END AS family,
    CASE WHEN i = 6 THEN 'INELIGIBLE' WHEN name LIKE 'ens%' THEN 'ENSEMBLE' WHEN name LIKE '%observed' THEN 'BASELINE' WHEN i = 1 THEN 'MEMBER' WHEN 1 - mae / base > 0 THEN 'LANE_SURVIVOR' WHEN coverage < 0.95 THEN 'NARROW' ELSE 'NO_GAIN' END AS role FROM m JOIN g USING (i) CROSS JOIN b""",
)
def roles(spark, d):
    o, c = table(spark, d, "orders"), F.col
    m = spark.createDataFrame(list(enumerate(_NAMES)), "i long, name string")
    g = o.groupBy((c("o_custkey") % 10).alias("i")).agg(F.avg("o_totalprice").alias("mae"), F.avg(F.when(c("o_orderkey") % (c("o_custkey") % 10 + 12) != 0, 1.0).otherwise(0.0)).alias("coverage"))
    b = o.agg(F.avg("o_totalprice").alias("base"))  # one row
    name = c("name")
    family = S.model_family(name, {"forest": "TREES", "boost": "TREES", "chain": "STATISTICAL"}, {"observed": "BASELINE"}, "OTHER")
    role = S.role(c("i") != 6, name.startswith("ens"), name.endswith("observed"), c("i") == 1, S.relative_gain(c("mae"), c("base")), c("coverage"))
    return m.join(g, "i").crossJoin(F.broadcast(b)).select("name", family.alias("family"), role.alias("role"))


@query(
    "p47_strict_json",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN (json_extract_string(props, '$.k'))::INT WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 7 END AS k FROM events""",
)
def strict_json(spark, d):
    bad = F.array(F.lit('{"k": 1, "k": 2}'), F.lit('{"k": NaN}'), F.lit('{"k": 1, "z": 2}'), F.lit('{"k": 7}'))
    e = table(spark, d, "events").withColumn("body", F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(F.get(bad, (F.col("event_id") % 5 - 1).cast("int"))))
    return e.select("event_id", S.strict_json(F.col("body"), "k int", ["k"])["k"].alias("k"))


@query(
    "u9_row_means",
    f"""WITH {_Q5} SELECT l_orderkey, l_partkey, l_suppkey, round((a + b + c + d + e) / 5, 4) AS mean, round(list_sort([a, b, c, d, e])[3], 4) AS median, round((a + b + c + d + e - least(a, b, c, d, e) - greatest(a, b, c, d, e)) / 3, 4) AS trimmed, round(0.1 * a + 0.2 * b + 0.4 * c + 0.2 * d + 0.1 * e, 4) AS weighted FROM q""",
)
def row_means(spark, d):
    q = [F.col(c) for c in "abcde"]
    made = [F.round(S.row_mean(q, how, [0.1, 0.2, 0.4, 0.2, 0.1]), 4).alias(how) for how in ("mean", "median", "trimmed", "weighted")]
    return _quantiles(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", *made)
