"""Registered queries of learners, ensembles and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import learners as L
from tidemark.operators import metrics, scoring, selection, trees, windows
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.catalog import _PRED, SERIES, _predictions, query, r6, series, table
from tidemark.sources.scratch import scratch_path

_LINES = "i AS (SELECT l_suppkey AS k, l_orderkey, l_partkey, l_quantity AS q, CASE WHEN l_linenumber <> 7 THEN l_discount * 100 END AS d, l_extendedprice / 1000 AS y, l_shipdate AS t FROM lineitem)"


def _lines(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("k"), "l_orderkey", "l_partkey", c("l_quantity").alias("q"), F.when(c("l_linenumber") != 7, c("l_discount") * 100).alias("d"), (c("l_extendedprice") / 1000).alias("y"), c("l_shipdate").alias("t"))


#: Ridge of y on two columns a and b of a table x with penalty 1, by Cramer's rule on centred sums.
_RIDGE2 = "m AS (SELECT k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1 AS saa, var_pop(b) * count(*) + 1 AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby FROM x GROUP BY k), f AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM m)"


@query("m1_m3_ridge", f"WITH {_LINES}, x AS (SELECT k, q AS a, d AS b, y FROM i WHERE d IS NOT NULL), {_RIDGE2} SELECT k, n, round(my - ba * ma - bb * mb, 4) AS b0, round(ba, 5) AS b1, round(bb, 4) AS b2, 0.0::DOUBLE AS reload_gap FROM f")
def ridge(spark, d):
    """Fitted, saved, loaded again: the loaded model forecasts the same."""
    rows = _lines(spark, d)
    model = L.Ridge(["k"], ["q", "d"], "y").fit(rows)
    path = scratch_path(spark, "ridge")
    model.save(path)
    again = L.Ridge.load(spark, path)
    a, b = model.predict(rows.select("k", "l_orderkey", "l_partkey", "q", "d")), again.predict(rows.select("k", "l_orderkey", "l_partkey", "q", "d")).withColumnRenamed("forecast", "other")
    gap = a.join(b.select("k", "l_orderkey", "l_partkey", "other"), ["k", "l_orderkey", "l_partkey"]).groupBy("k").agg(F.round(F.max(F.abs(F.col("forecast") - F.col("other"))), 9).alias("reload_gap"))
    c = F.col("coef")
    return again.coefficients.join(gap, "k").select("k", "n", F.round(c[0], 4).alias("b0"), F.round(c[1], 5).alias("b1"), F.round(c[2], 4).alias("b2"), "reload_gap")


@query(
    "m2_preprocess",
    f"""WITH {_LINES}, t AS (SELECT * FROM i WHERE t < TIMESTAMP '1998-01-01'), m AS (SELECT quantile_cont(d, 0.5) AS m FROM t), s AS (SELECT m, stddev_pop(coalesce(d, m)) AS s FROM t, m GROUP BY m) SELECT k, l_orderkey, l_partkey, round((coalesce(d, m) - m) / s, 6) AS z_d, (d IS NULL)::INT AS missing_d FROM i, s""",
)
def preprocess(spark, d):
    rows = _lines(spark, d)
    fit = L.fit_preprocessor(rows.filter(F.col("t") < F.lit("1998-01-01").cast("timestamp")), ["d"])
    return L.preprocessed(rows, fit).select("k", "l_orderkey", "l_partkey", r6(F.col("z_d")).alias("z_d"), "missing_d")


@query(
    "m3_elastic_net",
    f"""WITH {_LINES}, c AS (SELECT k, count(*) AS n, covar_pop(q, y) AS c, var_pop(q) AS v, avg(q) AS mq, avg(y) AS my FROM i GROUP BY k), b AS (SELECT *, sign(c) * greatest(abs(c) - 20.0, 0) / (v + 5.0) AS b FROM c) SELECT k, n, round(b, 6) AS slope, round(my - b * mq, 5) AS intercept FROM b""",
)
def elastic_net(spark, d):
    f = L.fitted(_lines(spark, d), ["k"], ["q"], "y", lambda m: L.elastic_net_of(m, 20.0, 5.0))
    return f.select("k", "n", r6(F.col("coef")[1]).alias("slope"), F.round(F.col("coef")[0], 5).alias("intercept"))


@query("m4_spline_ridge", f"WITH {_LINES}, x AS (SELECT k, q AS a, greatest(q - 25, 0) AS b, y FROM i), {_RIDGE2} SELECT k, n, round(my - ba * ma - bb * mb, 4) AS b0, round(ba, 5) AS b1, round(bb, 5) AS b2 FROM f")
def spline_ridge(spark, d):
    rows, names = L.spline_basis(_lines(spark, d), "q", [25.0], degree=1)
    c = F.col("coef")
    return L.fitted(rows, ["k"], names, "y", lambda m: L.ridge_of(m, 1.0)).select("k", "n", F.round(c[0], 4).alias("b0"), F.round(c[1], 5).alias("b1"), F.round(c[2], 5).alias("b2"))


@query("m5_trees", "SELECT kind, count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') AS n, true AS beats_mean FROM lineitem, (SELECT unnest(['forest', 'boosted']) AS kind) GROUP BY kind")
def tree_models(spark, d):
    rows = _lines(spark, d).select("q", (F.col("l_partkey") % 100).cast("double").alias("p"), (F.col("q") * 0.8 + F.col("l_partkey") % 100 * 0.3 + F.col("y") / 20).alias("y"), "t")
    cut = F.lit("2000-01-01").cast("timestamp")
    train, test = rows.filter(F.col("t") < cut), rows.filter(F.col("t") >= cut)
    mean = train.agg(F.avg("y")).first()[0]
    out = None
    for kind, model in (("forest", trees.forest(train, ["q", "p"], "y", trees=8)), ("boosted", trees.boosted(train, ["q", "p"], "y", rounds=4))):
        s = trees.forecasts(model, test).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.abs(F.col("forecast") - F.col("y"))) < F.avg(F.abs(F.col("y") - mean))).alias("beats_mean")).select(F.lit(kind).alias("kind"), "n", "beats_mean")
        out = s if out is None else out.unionAll(s)
    return out


@query(
    "m6_location_scale",
    f"""WITH {_LINES}, f AS (SELECT k, avg(y) AS mean, stddev_pop(y) AS std, quantile_cont(y, 0.5) AS mid FROM i WHERE t < TIMESTAMP '2000-01-01' GROUP BY k), g AS (SELECT k, any_value(mean) AS mean, any_value(std) AS std, any_value(mid) AS mid, avg(abs(y - mid)) AS b FROM i JOIN f USING (k) WHERE t < TIMESTAMP '2000-01-01' GROUP BY k)
    SELECT k, round(mid + b * ln(0.2), 4) AS laplace_q10, round(mid - b * ln(0.2), 4) AS laplace_q90, round(mean - 1.2815515655446004 * std, 4) AS normal_q10, round(mean + 1.2815515655446004 * std, 4) AS normal_q90, round(avg(b * (abs(y - mid) / b + exp(-abs(y - mid) / b) - 0.75)), 5) AS laplace_crps FROM i JOIN g USING (k) WHERE t >= TIMESTAMP '2000-01-01' GROUP BY k, mid, b, mean, std""",
)
def location_scale(spark, d):
    rows, cut = _lines(spark, d), F.lit("2000-01-01").cast("timestamp")
    train, test = rows.filter(F.col("t") < cut), rows.filter(F.col("t") >= cut)
    f = exact_quantiles(train, ["k"], "y", [0.5]).select("k", F.col("q")[0].alias("mid")).join(train.groupBy("k").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")), "k")
    f = f.join(train.join(f.select("k", "mid"), "k").groupBy("k").agg(F.avg(F.abs(F.col("y") - F.col("mid"))).alias("b")), "k")
    crps = test.join(f, "k").groupBy("k").agg(F.round(F.avg(S.laplace_crps(F.col("y"), F.col("mid"), F.col("b"))), 5).alias("laplace_crps"))
    at = lambda x: F.round(x, 4)
    mid, b, mean, std = F.col("mid"), F.col("b"), F.col("mean"), F.col("std")
    return crps.join(f, "k").select("k", at(mid + b * F.ln(F.lit(0.2))).alias("laplace_q10"), at(mid - b * F.ln(F.lit(0.2))).alias("laplace_q90"), at(mean - 1.2815515655446004 * std).alias("normal_q10"), at(mean + 1.2815515655446004 * std).alias("normal_q90"), "laplace_crps")


@query("m7_quantile_fits", "SELECT level, count(*) AS n, true AS calibrated FROM lineitem, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS level) GROUP BY level")
def quantile_fits(spark, d):
    """Linear quantile regression at five levels; about its level of the rows must lie below a fit."""
    rows = _lines(spark, d).select("q", "y")
    fits = L.irls(rows, ["q"], "y", levels=(0.1, 0.25, 0.5, 0.75, 0.9), rounds=10)
    below = lambda p, c: F.avg((F.col("y") <= F.lit(float(c[0])) + F.col("q") * float(c[1])).cast("double")) - p
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(float(p)).alias("level"), (F.abs(below(p, c)) < 0.02).alias("calibrated")) for p, c in fits.items()]).alias("a"))
    return s.select("n", F.inline("a"))


@query("m8_two_heads", "SELECT count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') AS n, true AS simplex, true AS beats_shares FROM lineitem")
def two_heads(spark, d):
    y = F.col("q") * 0.8 + F.col("l_partkey") % 100 * 0.3 + F.col("y") / 20
    rows = _lines(spark, d).select("q", (F.col("l_partkey") % 100).cast("double").alias("p"), F.when(y < 25, 0).when(y < 45, 1).otherwise(2).alias("c"), "t")
    cut = F.lit("2000-01-01").cast("timestamp")
    train, test = rows.filter(F.col("t") < cut), rows.filter(F.col("t") >= cut)
    out = trees.three_classes(trees.two_heads(train, ["q", "p"], "c", 1, 2), test)
    share = [float(x) for x in train.agg(*[F.avg((F.col("c") == k).cast("double")) for k in range(3)]).first()]
    parts = [F.col(p) for p in ("p_down", "p_sideways", "p_up")]
    flat = F.get(F.array(*[F.lit(x) for x in share]), F.col("c"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(parts[0] + parts[1] + parts[2] - 1) < 1e-9).alias("simplex"), (F.avg(S.log_loss(parts, F.col("c"))) < F.avg(-F.ln(flat))).alias("beats_shares"))


@query(
    "m9_local_trend",
    f"""WITH RECURSIVE {SERIES}, p AS (SELECT user_id, event_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM s WHERE x IS NOT NULL),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::DOUBLE AS forecast, 0.0::DOUBLE AS l, 0.0::DOUBLE AS b, 1e4::DOUBLE AS p1, 0.0::DOUBLE AS p2, 1.0::DOUBLE AS p3 FROM p
    UNION ALL SELECT user_id, pos, event_id, l, l + p1 / (p1 + 1) * (x - l), b + p2 / (p1 + 1) * (x - l), p1 - p1 / (p1 + 1) * p1, p2 - p1 / (p1 + 1) * p2, p3 - p2 / (p1 + 1) * p2
    FROM (SELECT p.user_id, p.pos, p.event_id, p.x, f.l + f.b AS l, f.b, f.p1 + 2 * f.p2 + f.p3 + 0.05 AS p1, f.p2 + f.p3 AS p2, f.p3 + 0.01 AS p3 FROM f JOIN p ON p.user_id = f.user_id AND p.pos = f.pos + 1))
    SELECT event_id, round(forecast, 5) AS forecast FROM f WHERE pos > 0""",
)
def local_trend(spark, d):
    s = series(spark, d).filter("x is not null").select("user_id", "ts", "event_id", "x")
    return L.local_trend(s, "user_id", ["ts", "event_id"], "x").select("event_id", F.round("forecast", 5).alias("forecast"))


@query(
    "m10_block_decomposition",
    f"""WITH {_LINES}, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, l_orderkey, l_partkey) AS pos FROM i WHERE d IS NOT NULL), a AS (SELECT k, covar_pop(q, y) * count(*) / (var_pop(q) * count(*) + 1) AS ba, avg(q) AS mq, avg(y) AS my FROM x GROUP BY k), r AS (SELECT x.*, ba, y - my - ba * (q - mq) AS e FROM x JOIN a USING (k)),
    b AS (SELECT k, covar_pop(d, e) * count(*) / (var_pop(d) * count(*) + 1) AS bb, avg(d) AS md, avg(e) AS me FROM r GROUP BY k), u AS (SELECT r.*, bb, e - me - bb * (d - md) AS u FROM r JOIN b USING (k)), l AS (SELECT *, lag(u) OVER (PARTITION BY k ORDER BY pos) AS pu FROM u)
    SELECT k, round(any_value(ba), 5) AS fundamental, round(any_value(bb), 5) AS market, round(least(greatest(sum(pu * u) / sum(pu * pu), -0.95), 0.95), 5) AS rho FROM l GROUP BY k""",
)
def block_decomposition(spark, d):
    w = Window.partitionBy("k").orderBy("t", "l_orderkey", "l_partkey")
    x = _lines(spark, d).filter("d is not null").withColumn("pos", F.row_number().over(w))

    def block(rows, f, y, out):
        fit = L.fitted(rows, ["k"], [f], y, lambda m: L.ridge_of(m, 1.0)).select("k", F.col("coef")[0].alias("_c"), F.col("coef")[1].alias(f"b_{f}"))
        return rows.join(fit, "k").withColumn(out, F.col(y) - F.col("_c") - F.col(f"b_{f}") * F.col(f)).drop("_c")

    u = block(block(x, "q", "y", "e"), "d", "e", "u")
    rho = windows.ar1(u, ["k"], "pos", "pos", "u", least=2).select("k", "rho")
    return u.groupBy("k").agg(F.first("b_q").alias("ba"), F.first("b_d").alias("bb")).join(rho, "k").select("k", F.round("ba", 5).alias("fundamental"), F.round("bb", 5).alias("market"), F.round("rho", 5).alias("rho"))


@query(
    "m12_annual_equation",
    f"""WITH {_LINES}, x AS (SELECT year(t) AS year, q, y FROM i), w AS (SELECT year, quantile_cont(q, 0.05) AS lo, quantile_cont(q, 0.95) AS hi, quantile_cont(y, 0.05) AS ly, quantile_cont(y, 0.95) AS hy FROM x GROUP BY year), c AS (SELECT year, least(greatest(q, lo), hi) AS q, least(greatest(y, ly), hy) AS y FROM x JOIN w USING (year))
    SELECT year, count(*) AS n, round(regr_slope(y, q), 6) AS slope, round(regr_intercept(y, q), 5) AS intercept, round((regr_intercept(y, q) + 30 * regr_slope(y, q)) / 12, 5) AS per_share FROM c GROUP BY year""",
)
def annual_equation(spark, d):
    x = _lines(spark, d).select(F.year("t").alias("year"), "q", "y")
    for c in ("q", "y"):
        cut = exact_quantiles(x, ["year"], c, [0.05, 0.95]).select("year", F.col("q").alias("_q"))
        x = x.join(F.broadcast(cut), "year").withColumn(c, F.least(F.greatest(F.col(c), F.col("_q")[0]), F.col("_q")[1])).drop("_q")
    c = F.col("coef")
    return L.fitted(x, ["year"], ["q"], "y", lambda m: L.ridge_of(m, 0.0)).select("year", "n", r6(c[1]).alias("slope"), F.round(c[0], 5).alias("intercept"), F.round((c[0] + 30 * c[1]) / 12, 5).alias("per_share"))


def _wide(spark, d):
    p = _predictions(spark, d)
    return p.groupBy("o_orderkey", "o_custkey", "y").pivot("m", ["low", "close", "highest"]).agg(F.first("f"))


@query("m13_convex_stack")
def convex_stack(spark, d):
    """No SQL: a descent; tests compare its error with a grid of all weights."""
    w, mae = L.convex_stack(_wide(spark, d), ["low", "close", "highest"], "y")
    rows = [(m, round(float(x), 4), round(mae, 4)) for m, x in zip(("low", "close", "highest"), w)]
    return spark.createDataFrame(rows, "m string, weight double, mae double")


_WIDE = f"{_PRED}, w AS (SELECT o_orderkey, o_custkey, y, max(f) FILTER (m = 'low') AS low, max(f) FILTER (m = 'close') AS close, max(f) FILTER (m = 'highest') AS highest FROM p GROUP BY ALL)"


@query(
    "m15_m19_frozen_ensemble",
    f"""WITH {_WIDE} SELECT o_orderkey, round(exp((ln(low) + ln(close) + ln(highest)) / 3), 4) AS geometric, round(0.2 * low + 0.5 * close + 0.3 * highest, 6) AS frozen, round(0.2 * low + 0.5 * close + 0.3 * highest - 1500, 6) AS q10, round(0.2 * low + 0.5 * close + 0.3 * highest + 1500, 6) AS q90 FROM w""",
)
def frozen_ensemble(spark, d):
    parts = [F.col(c) for c in ("low", "close", "highest")]
    logs = [S.safe_log(p) for p in parts]
    mix = S.row_mean(parts, "weighted", [0.2, 0.5, 0.3])
    return _wide(spark, d).select("o_orderkey", F.round(F.exp((logs[0] + logs[1] + logs[2]) / 3), 4).alias("geometric"), r6(mix).alias("frozen"), r6(mix - 1500).alias("q10"), r6(mix + 1500).alias("q90"))


@query("m16_diverse_members")
def diverse_members(spark, d):
    """No SQL: a loop over models; tests give it cases with known answers."""
    c, y = F.col, F.col("o_totalprice")
    models = [("a_0", y * 0.97 + c("o_custkey") % 10 * 100), ("a_1", y * 0.96 + c("o_custkey") % 10 * 120), ("a_2", y * 0.96 + c("o_custkey") % 10 * 120), ("b_0", y * 1.02 + c("o_orderkey") % 7 * 300), ("b_1", y * 1.05), ("c_0", y * 0.9 + c("o_orderkey") % 11 * 900)]
    p = table(spark, d, "orders").select("o_orderkey", y.alias("y"), F.inline(F.array(*[F.struct(F.lit(n).alias("m"), f.alias("f")) for n, f in models]))).withColumn("e", c("f") - c("y"))
    score = p.groupBy("m").agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(c("e") * c("e"))).alias("rmse"))
    rank = score.select("m", *[windows.mean_percent_rank(c(x), []).alias(x) for x in ("mae", "rmse")])
    ranks = {r.m: (r.mae + r.rmse) / 2 for r in rank.collect()}  # a row a model
    pairs = metrics.pairs(p, ["o_orderkey"], "m", "e").select("model_a", "model_b", "error_corr").collect()
    same = p.alias("a").join(p.alias("b"), "o_orderkey").filter("a.m < b.m").groupBy(c("a.m").alias("x"), c("b.m").alias("z")).agg(F.bool_and(c("a.f") == c("b.f")).alias("same")).filter("same").collect()
    chosen = L.greedy_members(ranks, {m: m[0] for m in ranks}, {(r.model_a, r.model_b): r.error_corr for r in pairs if r.error_corr is not None}, {frozenset((r.x, r.z)) for r in same}, 5, lambda f: 2)
    return spark.createDataFrame([(i + 1, m) for i, m in enumerate(chosen)], "place int, m string")


_SCORES = f"{_PRED}, z AS (SELECT m || '_' || o_custkey % 8 AS id, m AS family, (o_custkey % 2)::INT AS target, y, f FROM p), s AS (SELECT target, family, id, count(f) / count(y) AS coverage, avg(abs(f - y)) AS mae, quantile_cont(abs(f - y), 0.5) AS median, 1 - avg(abs(f - y)) / avg(abs(y * 0.9 - y)) AS gain, quantile_cont(abs(y * 0.9 - y), 0.5) AS base_median FROM z GROUP BY ALL)"


@query(
    "m17_representatives",
    f"""WITH {_SCORES}, c AS (SELECT *, concat_ws('|', CASE WHEN coverage < 0.9 THEN 'COVERAGE' END, CASE WHEN gain IS NULL OR gain < 0.03 THEN 'GAIN' END, CASE WHEN median > base_median THEN 'MEDIAN_HARM' END) AS codes FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY target, family ORDER BY codes = '' DESC, round(mae, 6), round(median, 6), id) AS n FROM c)
    SELECT target, family, id, codes = '' AS passed, codes FROM r WHERE n = 1""",
)
def representatives(spark, d):
    p = _predictions(spark, d).select(F.concat_ws("_", "m", F.col("o_custkey") % 8).alias("id"), F.col("m").alias("family"), (F.col("o_custkey") % 2).cast("int").alias("target"), "y", "f")
    ae, be = F.abs(F.col("f") - F.col("y")), F.abs(F.col("y") * 0.9 - F.col("y"))
    key = ["target", "family", "id"]
    s = p.groupBy(*key).agg((F.count("f") / F.count("y")).alias("coverage"), F.round(F.avg(ae), 6).alias("mae"), S.relative_gain(F.avg(ae), F.avg(be)).alias("gain"))
    s = s.join(exact_quantiles(p.withColumn("v", ae), key, "v", [0.5]).select(*key, F.round(F.col("q")[0], 6).alias("median")), key).join(exact_quantiles(p.withColumn("v", be), key, "v", [0.5]).select(*key, F.col("q")[0].alias("base_median")), key)
    gate = S.codes((F.col("coverage") < 0.9, "COVERAGE"), (F.col("gain").isNull() | (F.col("gain") < 0.03), "GAIN"), (F.col("median") > F.col("base_median"), "MEDIAN_HARM"))
    return selection.representatives(s, ["target", "family"], gate, ["mae", "median", "id"]).select("target", "family", "id", "passed", F.concat_ws("|", "codes").alias("codes"))


@query(
    "m20_nested_replay",
    f"""WITH {_WIDE}, v AS (SELECT year(o_orderdate) AS year, ln(close) - ln(low) AS d, ln(w.y) - ln(low) AS q FROM w JOIN orders USING (o_orderkey)), s AS (SELECT year, sum(d * q) AS a, sum(CASE WHEN q IS NOT NULL THEN d * d END) AS b FROM v WHERE d IS NOT NULL GROUP BY year), c AS (SELECT year, sum(a) OVER w AS a, sum(b) OVER w AS b FROM s WINDOW w AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT year, round(CASE WHEN b > 0 THEN least(greatest(a / b, 0), 1) ELSE 0.5 END, 6) AS weight FROM c""",
)
def nested_replay(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    log = lambda x: S.safe_log(F.col(x))
    v = _wide(spark, d).join(o, "o_orderkey").filter(F.col("low").isNotNull() & F.col("close").isNotNull())
    return L.replayed_weights(v, "year", log("close") - log("low"), log("y") - log("low")).select("year", r6(F.col("weight")).alias("weight"))


@query(
    "m21_shortlist_roles",
    f"""WITH {_SCORES}, n AS (SELECT target, id, count(f) FILTER (y < 60000) AS n, avg(abs(f - y)) FILTER (y < 60000) AS sub FROM z GROUP BY ALL), r AS (SELECT s.*, n.n, n.sub, (rank() OVER (PARTITION BY target ORDER BY round(mae, 6)) + rank() OVER (PARTITION BY target ORDER BY round(median, 6))) / 2.0 AS robust FROM s JOIN n USING (target, id) WHERE coverage > 0.9)
    SELECT target, arg_min(id, struct_pack(a := round(mae, 6), b := id)) AS core, arg_min(id, struct_pack(a := robust, b := id)) AS robust, arg_min(id, struct_pack(a := round(sub, 6), b := id)) FILTER (n >= 30 AND sub IS NOT NULL) AS specialist FROM r GROUP BY target""",
)
def shortlist_roles(spark, d):
    p = _predictions(spark, d).select(F.concat_ws("_", "m", F.col("o_custkey") % 8).alias("id"), (F.col("o_custkey") % 2).cast("int").alias("target"), "y", "f").withColumn("ae", F.abs(F.col("f") - F.col("y")))
    low = F.col("y") < 60000
    s = p.groupBy("target", "id").agg((F.count("f") / F.count("y")).alias("coverage"), F.round(F.avg("ae"), 6).alias("mae"), F.count(F.when(low, F.col("f"))).alias("n"), F.round(F.avg(F.when(low, F.col("ae"))), 6).alias("sub"))
    s = s.join(exact_quantiles(p, ["target", "id"], "ae", [0.5]).select("target", "id", F.round(F.col("q")[0], 6).alias("median")), ["target", "id"]).filter("coverage > 0.9")
    rank = lambda c: F.rank().over(Window.partitionBy("target").orderBy(c))
    s = s.withColumn("robust", (rank("mae") + rank("median")) / 2.0)
    best = lambda c, ok=None: F.min_by("id", F.struct(c, "id") if ok is None else F.when(ok, F.struct(c, "id")))
    return s.groupBy("target").agg(best("mae").alias("core"), best("robust").alias("robust"), best("sub", (F.col("n") >= 30) & F.col("sub").isNotNull()).alias("specialist"))


@query(
    "m22_stage_gate",
    f"""WITH {_PRED}, z AS (SELECT m || '_' || o_custkey % 4 AS id, m AS family, o_custkey % 3 AS seed, ln(f) - ln(y) AS e, ln(y * 0.93) - ln(y) AS b, f IS NOT NULL AS has FROM p), g AS (SELECT id, family, avg(has::INT) AS coverage, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(b)) FILTER (e IS NOT NULL) AS bmae, sqrt(avg(b * b) FILTER (e IS NOT NULL)) AS brmse FROM z GROUP BY ALL), w AS (SELECT id, max(a / c - 1) AS worst FROM (SELECT id, seed, avg(abs(e)) AS a, avg(abs(b)) FILTER (e IS NOT NULL) AS c FROM z GROUP BY ALL) GROUP BY id),
    q AS (SELECT *, 1 - mae / bmae AS mg, 1 - rmse / brmse AS rg FROM g JOIN w USING (id)), t AS (SELECT *, coverage > 0.9 AND worst <= 0.05 AND ((mg >= 0.02 AND rg >= -0.01) OR (rg >= 0.02 AND mg >= -0.01)) AS pass FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pass DESC, round(mae, 9), round(rmse, 9), id) AS n FROM t), h AS (SELECT *, row_number() OVER (ORDER BY (pass AND n = 1) DESC, round(mae, 9), round(rmse, 9), id) AS r FROM f)
    SELECT id, round(mg, 6) AS mae_gain, round(rg, 6) AS rmse_gain, pass, CASE WHEN NOT pass THEN 'REJECT' WHEN n = 1 AND r <= 1 THEN 'ADVANCE' ELSE 'PASS_NOT_ADVANCED' END AS decision FROM h""",
)
def stage_gate(spark, d):
    c = F.col
    e = S.safe_log(c("f")) - S.safe_log(c("y"))
    z = _predictions(spark, d).select(F.concat_ws("_", "m", c("o_custkey") % 4).alias("id"), c("m").alias("family"), (c("o_custkey") % 3).alias("seed"), e.alias("e"), F.when(e.isNotNull(), F.ln(c("y") * 0.93) - F.ln("y")).alias("b"))
    rms = lambda x: F.sqrt(F.avg(c(x) * c(x)))
    mae = lambda x: F.avg(F.abs(x))
    g = z.groupBy("id", "family").agg(F.avg(c("e").isNotNull().cast("int")).alias("coverage"), mae("e").alias("mae"), rms("e").alias("rmse"), S.relative_gain(mae("e"), mae("b")).alias("mg"), S.relative_gain(rms("e"), rms("b")).alias("rg"))
    worst = z.groupBy("id", "seed").agg((-S.relative_gain(mae("e"), mae("b"))).alias("x")).groupBy("id").agg(F.max("x").alias("worst"))
    primary = ((c("mg") >= 0.02) & (c("rg") >= -0.01)) | ((c("rg") >= 0.02) & (c("mg") >= -0.01))
    t = g.join(worst, "id").withColumn("pass", (c("coverage") > 0.9) & (c("worst") <= 0.05) & primary)
    order = [F.round("mae", 9).asc(), F.round("rmse", 9).asc(), F.asc("id")]
    advanced = selection.heads(t.filter("pass"), "family", order, 1, 1).select("id", F.lit(True).alias("adv"))
    return t.join(advanced, "id", "left").select("id", r6(c("mg")).alias("mae_gain"), r6(c("rg")).alias("rmse_gain"), "pass", F.when(~c("pass"), "REJECT").when(c("adv"), "ADVANCE").otherwise("PASS_NOT_ADVANCED").alias("decision"))


@query(
    "m23_m24_screens_and_triggers",
    f"""WITH {_PRED}, z AS (SELECT m, o_custkey % 4 AS seed, ln(f) - ln(y) AS e, CASE WHEN f IS NOT NULL THEN (y BETWEEN f * 0.9 AND f * 1.1)::INT END AS c80 FROM p), s AS (SELECT m, seed, avg(e) AS bias, avg(c80) AS cov FROM z GROUP BY ALL), g AS (SELECT m, avg(e) AS bias, avg(c80) AS cov, avg(abs(e)) AS mae FROM z GROUP BY m)
    SELECT g.m, abs(g.cov - 0.8) <= 0.1 AS coverage_guard, bool_and(abs(s.cov - 0.8) <= 0.15) AS seed_guard, CASE WHEN g.mae <= 0.05 THEN 'JOINT' WHEN g.mae <= 0.15 THEN 'DISTRIBUTION_ONLY' ELSE 'NONE' END AS path, abs(g.bias) >= 0.01 AND count(*) FILTER (sign(s.bias) = sign(g.bias)) >= 3 AS stable_bias FROM g JOIN s USING (m) GROUP BY g.m, g.cov, g.mae, g.bias""",
)
def screens(spark, d):
    c = F.col
    z = _predictions(spark, d).select("m", (c("o_custkey") % 4).alias("seed"), (S.safe_log(c("f")) - S.safe_log(c("y"))).alias("e"), F.when(c("f").isNotNull(), c("y").between(c("f") * 0.9, c("f") * 1.1).cast("int")).alias("c80"))
    g = z.groupBy("m").agg(F.avg("e").alias("bias"), F.avg("c80").alias("cov"), F.avg(F.abs("e")).alias("mae"))
    s = z.groupBy("m", "seed").agg(F.avg("e").alias("sb"), F.avg("c80").alias("sc"))
    path = S.ladder((c("mae") <= 0.05, "JOINT"), (c("mae") <= 0.15, "DISTRIBUTION_ONLY"), other="NONE")
    out = g.join(s, "m").groupBy("m", "bias", "cov", "mae").agg(F.bool_and(F.abs(c("sc") - 0.8) <= 0.15).alias("seed_guard"), F.count_if(F.signum("sb") == F.signum("bias")).alias("k"))
    return out.select("m", (F.abs(c("cov") - 0.8) <= 0.1).alias("coverage_guard"), "seed_guard", path.alias("path"), ((F.abs("bias") >= 0.01) & (c("k") >= 3)).alias("stable_bias"))


@query(
    "m27_feature_ablation",
    f"""WITH {_LINES}, x AS (SELECT k, q AS a, d AS b, y FROM i WHERE d IS NOT NULL), {_RIDGE2}, o AS (SELECT k, covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1) AS ba, avg(a) AS ma, avg(y) AS my FROM x GROUP BY k)
    SELECT x.k, count(*) AS n, round(avg(abs(f.my + f.ba * (a - f.ma) + f.bb * (b - f.mb) - y)), 5) AS original, round(avg(abs(o.my + o.ba * (a - o.ma) - y)), 5) AS ablated FROM x JOIN f USING (k) JOIN o USING (k) GROUP BY x.k""",
)
def feature_ablation(spark, d):
    rows = _lines(spark, d).filter("d is not null")
    for name, features in (("original", ["q", "d"]), ("ablated", ["q"])):
        rows = L.predicted(rows, L.fitted(rows, ["k"], features, "y", lambda m: L.ridge_of(m, 1.0)), ["k"], features, name)
    mae = lambda x: F.round(F.avg(F.abs(F.col(x) - F.col("y"))), 5).alias(x)
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), mae("original"), mae("ablated"))
