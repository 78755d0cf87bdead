"""Registered queries of gates, state machines, folds, selection and reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import contracts, folds, nested, selection, vintages, windows
from tidemark.operators.quantiles import sorted_at
from tidemark.operators.resampling import share_sql
from tidemark.plans.catalog import _ORD, _ordered, query, r6, table
from tidemark.sources.scratch import scratch_path

#: The items of a supplier in order: a series of some hundred rows, as many series as suppliers.
_ITEMS = "i AS (SELECT l_suppkey AS entity, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey) - 1 AS pos, l_shipdate, CASE WHEN l_partkey % 97 <> 0 THEN l_extendedprice / 1000 END AS x, l_quantity, l_discount, l_linenumber FROM lineitem)"


def _items(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_partkey")
    c = F.col
    return table(spark, d, "lineitem").select(c("l_suppkey").alias("entity"), "l_orderkey", "l_partkey", (F.row_number().over(w) - 1).alias("pos"), "l_shipdate", F.when(c("l_partkey") % 97 != 0, c("l_extendedprice") / 1000).alias("x"), "l_quantity", "l_discount", "l_linenumber")


@query(
    "w5_w6_forward_gate",
    f"""WITH {_ITEMS}, f AS (SELECT *, ln(x) AS l, CASE WHEN count(x) OVER a = 21 THEN quantile_cont(ln(x), 0.5) OVER a END AS t, lag(ln(x)) OVER (PARTITION BY entity ORDER BY pos) AS b, avg(ln(x)) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o FROM i WINDOW a AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
    p AS (SELECT *, CASE WHEN t IS NOT NULL AND b IS NOT NULL AND o IS NOT NULL AND l IS NOT NULL THEN 1 END AS ok FROM f), m AS (SELECT *, count(ok) OVER w AS n, avg(CASE WHEN ok = 1 THEN abs(b - t) END) OVER w AS lb, avg(CASE WHEN ok = 1 THEN abs(o - t) END) OVER w AS lo FROM p WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 273 PRECEDING AND 22 PRECEDING))
    SELECT l_orderkey, l_partkey, entity, n, round(CASE WHEN n >= 63 THEN lb - lo END, 6) AS gain, round(CASE WHEN n >= 63 AND lb - lo > 0 AND b IS NOT NULL AND o IS NOT NULL THEN 0.5 * (1 - exp(-(lb - lo) / 0.004)) ELSE 0 END, 5) AS weight FROM m""",
)
def forward_gate(spark, d):
    w = Window.partitionBy("entity").orderBy("pos")
    f = windows.forward_median(_items(spark, d).withColumn("l", S.safe_log(F.col("x"))), ["entity"], ["pos"], "l", 21, "t")
    f = f.withColumn("b", F.lag("l").over(w)).withColumn("o", F.avg("l").over(windows.past(["entity"], ["pos"], 5)))
    f = f.withColumn("t", F.when(F.col("l").isNotNull(), F.col("t")))  # the origin's own value must be there too
    f = windows.paired_losses(f, ["entity"], ["pos"], "t", "b", "o", 252, 63, 22).withColumnsRenamed({"loss_a": "lb", "loss_b": "lo"})
    present = F.col("b").isNotNull() & F.col("o").isNotNull()
    return f.select("l_orderkey", "l_partkey", "entity", "n", r6(F.col("lb") - F.col("lo")).alias("gain"), F.round(windows.gate_weight(F.col("lb"), F.col("lo"), present, 0.0, 0.004, 0.5), 5).alias("weight"))


_TWO = f"""{_ITEMS}, a AS (SELECT entity, l_orderkey, l_partkey, pos, CASE WHEN l_partkey % 23 <> 0 THEN l_quantity % 7 + 1 END AS b0, l_linenumber + 1.0 AS b1, l_discount * 30 + 1 AS b2, CASE WHEN l_orderkey % 29 <> 0 THEN l_quantity % 7 + 3 * (l_partkey % 3 = 0)::INT + 1.0 END AS s0, l_linenumber + 3 * (l_partkey % 3 = 1)::INT + 1.0 AS s1, l_discount * 30 + 3 * (l_partkey % 3 = 2)::INT + 1 AS s2, CASE WHEN l_orderkey % 10 <> 0 THEN (l_partkey % 3)::INT END AS y FROM i),
    q AS (SELECT entity, l_orderkey, l_partkey, pos, y, b0 / (b0 + b1 + b2) AS b0, b1 / (b0 + b1 + b2) AS b1, b2 / (b0 + b1 + b2) AS b2, s0 / (s0 + s1 + s2) AS s0, s1 / (s0 + s1 + s2) AS s1, s2 / (s0 + s1 + s2) AS s2 FROM a)"""


def _two(spark, d):
    c = F.col
    is_ = lambda k: 3 * (c("l_partkey") % 3 == k).cast("int")
    a = _items(spark, d).select(
        "entity", "l_orderkey", "l_partkey", "pos", F.when(c("l_partkey") % 23 != 0, c("l_quantity") % 7 + 1).alias("b0"), (c("l_linenumber") + 1.0).alias("b1"), (c("l_discount") * 30 + 1).alias("b2"),
        F.when(c("l_orderkey") % 29 != 0, c("l_quantity") % 7 + is_(0) + 1.0).alias("s0"), (c("l_linenumber") + is_(1) + 1.0).alias("s1"), (c("l_discount") * 30 + is_(2) + 1).alias("s2"), F.when(c("l_orderkey") % 10 != 0, (c("l_partkey") % 3).cast("int")).alias("y"),
    )
    share = lambda s, k: (c(f"{s}{k}") / (c(f"{s}0") + c(f"{s}1") + c(f"{s}2"))).alias(f"{s}{k}")
    return a.select("entity", "l_orderkey", "l_partkey", "pos", "y", *[share(s, k) for s in "bs" for k in range(3)])


_SOURCE = "CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL THEN 'none' WHEN b0 IS NOT NULL THEN 'incumbent_only' WHEN s0 IS NOT NULL THEN 'challenger_only' ELSE 'unavailable' END"


@query(
    "w7_log_loss_gate",
    f"""WITH {_TWO}, l AS (SELECT *, CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL AND y IS NOT NULL THEN -ln(CASE y WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END) END AS lb, CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL AND y IS NOT NULL THEN -ln(CASE y WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END) END AS ls FROM q),
    m AS (SELECT *, count(lb) OVER w AS n, CASE WHEN count(lb) OVER w >= 63 THEN avg(lb) OVER w - avg(ls) OVER w END AS g FROM l WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 272 PRECEDING AND 21 PRECEDING)), v AS (SELECT *, CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL AND g > 0.005 THEN 0.75 / (1 + exp(-least(greatest((g - 0.005) / 0.025, -40), 40))) ELSE 0 END AS w FROM m)
    SELECT l_orderkey, l_partkey, entity, n, round(g, 6) AS gain, round(w, 5) AS weight, round(CASE WHEN b0 IS NULL THEN s0 WHEN s0 IS NULL THEN b0 ELSE (1 - w) * b0 + w * s0 END, 5) AS mix_0, {_SOURCE} AS source FROM v""",
)
def log_loss_gate(spark, d):
    out = windows.matured_gate(_two(spark, d), ["entity"], ["pos"], ["b0", "b1", "b2"], ["s0", "s1", "s2"], "y", 21, 252, 63, 0.005, 0.025, 0.75)
    return out.select("l_orderkey", "l_partkey", "entity", F.col("count_0").alias("n"), r6(F.col("gain_0")).alias("gain"), F.round("weight_0", 5).alias("weight"), F.round("mix_0", 5).alias("mix_0"), "source")


@query(
    "w8_classwise_gate",
    f"""WITH {_TWO}, l AS (SELECT *, CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL AND y IS NOT NULL THEN 1 END AS ok FROM q), m AS (SELECT *, count(ok) OVER w AS n, {", ".join(f"avg(CASE WHEN ok = 1 THEN (b{k} - (y = {k})::INT) ^ 2 - (s{k} - (y = {k})::INT) ^ 2 END) OVER w AS g{k}" for k in range(3))} FROM l WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 272 PRECEDING AND 21 PRECEDING)),
    v AS (SELECT *, {", ".join(f"CASE WHEN b0 IS NOT NULL AND s0 IS NOT NULL AND n >= 63 AND g{k} > 0.002 THEN 0.6 / (1 + exp(-least(greatest((g{k} - 0.002) / 0.01, -40), 40))) ELSE 0 END AS w{k}" for k in range(3))} FROM m), x AS (SELECT *, {", ".join(f"(1 - w{k}) * b{k} + w{k} * s{k} AS r{k}" for k in range(3))} FROM v)
    SELECT l_orderkey, l_partkey, entity, {", ".join(f"round(w{k}, 5) AS weight_{k}, round(CASE WHEN b0 IS NULL THEN s{k} WHEN s0 IS NULL THEN b{k} ELSE r{k} / (r0 + r1 + r2) END, 5) AS mix_{k}" for k in range(3))} FROM x""",
)
def classwise_gate(spark, d):
    two = _two(spark, d)
    # a class of a side counts only where the whole side does
    two = two.withColumns({f"{s}{k}": F.when(F.col(f"{s}0").isNotNull(), F.col(f"{s}{k}")) for s in "bs" for k in (1, 2)})
    out = windows.matured_gate(two, ["entity"], ["pos"], ["b0", "b1", "b2"], ["s0", "s1", "s2"], "y", 21, 252, 63, 0.002, 0.01, 0.6, classwise=True)
    return out.select("l_orderkey", "l_partkey", "entity", *[F.round(f"{c}_{k}", 5).alias(f"{c}_{k}") for k in range(3) for c in ("weight", "mix")])


@query("w13_vintage_multiples")
def vintage_multiples(spark, d):
    """No SQL: a small regression a vintage; tests compare it with plain loops."""
    i = _items(spark, d)
    block = F.floor(F.col("pos") / 25)
    rows = i.select("entity", "pos", block.alias("vintage"), S.safe_log(F.col("x")).alias("y"), (F.sin(block * 1.7) / 4).alias("growth"), (F.col("l_discount") + 0.5).alias("weight"))
    out = vintages.vintage_multiples(rows, "entity", ["pos"], ["vintage"], F.col("entity") % 50 == 7, "y", "growth", "weight")
    return out.select("entity", "pos", "block", F.round("expected", 6).alias("expected"), "way")


@query(
    "w18_residual_quantiles",
    f"""WITH {_ITEMS}, r AS (SELECT *, ln(x) - ln(avg(x) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS e, ln(avg(x) OVER (PARTITION BY entity ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS point FROM i)
    SELECT l_orderkey, l_partkey, entity, round(point + quantile_disc(e, 0.1) OVER w, 5) AS q10, round(point + quantile_disc(e, 0.5) OVER w, 5) AS q50, round(point + quantile_disc(e, 0.9) OVER w, 5) AS q90 FROM r WINDOW w AS (PARTITION BY entity ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
)
def residual_quantiles(spark, d):
    point = F.ln(F.avg("x").over(windows.past(["entity"], ["pos"], 6)))
    r = _items(spark, d).withColumn("point", point).withColumn("e", S.safe_log(F.col("x")) - F.col("point"))
    r = r.withColumn("h", F.collect_list("e").over(windows.past(["entity"], ["pos"], 60)))
    return r.select("l_orderkey", "l_partkey", "entity", *[F.round(F.col("point") + sorted_at(F.col("h"), p), 5).alias(f"q{round(100 * p)}") for p in (0.1, 0.5, 0.9)])


@query(
    "w19_group_heads",
    "SELECT o_custkey, o_orderkey, n::INT AS n, share FROM (SELECT *, row_number() OVER w AS n, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) / count(*) OVER (PARTITION BY o_custkey) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE n <= 1",
)
def group_heads(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    share = F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))) / F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("n", n).withColumn("share", share).filter("n <= 1").select("o_custkey", "o_orderkey", "n", "share")


@query(
    "w22_w23_lifecycle",
    f"""WITH {_ORD}, r AS (SELECT o.o_custkey, k - 1 + CASE WHEN o.o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS rev, k, s.o_orderstatus AS st, CASE WHEN o.o_orderkey % 70 = 0 THEN 'x' ELSE 'd' END AS def, CASE WHEN k > 3 THEN 1 + (o.o_orderkey % 90 = 0)::INT END AS res FROM o JOIN orders s ON s.o_orderkey = o.o_orderkey),
    l AS (SELECT *, row_number() OVER w = 1 AS f, lag(rev) OVER w AS prev, lag(st) OVER w AS pst, lag(def) OVER w AS pdef, lag(res) OVER w AS pres FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY rev, k)),
    c AS (SELECT o_custkey, rev, unnest(list_filter([CASE WHEN f AND rev <> 0 THEN 'START' END, CASE WHEN NOT f AND rev <> prev + 1 THEN 'GAP' END, CASE WHEN NOT f AND pst || '>' || st NOT IN ('O>P', 'P>F', 'O>F', 'O>O', 'P>P') THEN 'TRANSITION' END, CASE WHEN NOT f AND def <> pdef THEN 'CHANGED_def' END, CASE WHEN pres IS NOT NULL AND res IS DISTINCT FROM pres THEN 'REVISED_res' END], lambda x: x IS NOT NULL)) AS code FROM l)
    SELECT code, count(*) AS n, count(DISTINCT o_custkey) AS histories FROM c GROUP BY code""",
)
def lifecycle(spark, d):
    s = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("st"))
    key = F.col("o_orderkey")
    r = _ordered(spark, d).join(s, "o_orderkey").select("o_custkey", "k", F.struct((F.col("k") - 1 + F.when(key % 50 == 0, 1).otherwise(0)).alias("rev"), "k").alias("order"), (F.col("k") - 1 + F.when(key % 50 == 0, 1).otherwise(0)).alias("rev"), "st", F.when(key % 70 == 0, "x").otherwise("d").alias("def"), F.when(F.col("k") > 3, 1 + (key % 90 == 0).cast("int")).alias("res"))
    out = windows.lifecycle(r, ["o_custkey"], "rev", "st", [("O", "P"), ("P", "F"), ("O", "F"), ("O", "O"), ("P", "P")], ["def"], ["res"], order=["rev", "k"])
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("histories"))


@query(
    "w25_residual_correction",
    f"""WITH {_ITEMS}, r AS (SELECT entity, pos, ln(x) - ln(31) AS e FROM i WHERE pos < 500), l AS (SELECT *, lag(e) OVER (PARTITION BY entity ORDER BY pos) AS pe FROM r), f AS (SELECT entity, CASE WHEN count(*) FILTER (pe IS NOT NULL AND e IS NOT NULL) >= 63 THEN least(greatest(sum(pe * e) / sum(CASE WHEN e IS NOT NULL THEN pe * pe END), -0.95), 0.95) ELSE 0 END AS rho, arg_max(e, pos) AS last FROM l GROUP BY entity)
    SELECT l_orderkey, l_partkey, entity, round(31 * exp(least(greatest(rho ^ (pos - 499) * last, -0.1), 0.1)), 6) AS corrected FROM i JOIN f USING (entity) WHERE pos >= 500""",
)
def residual_correction(spark, d):
    i = _items(spark, d)
    fit = windows.ar1(i.filter("pos < 500").withColumn("e", S.safe_log(F.col("x")) - F.ln(F.lit(31.0))), ["entity"], "pos", "pos", "e")
    corrected = 31 * F.exp(windows.ar_forecast(F.col("rho"), F.col("last_value"), F.col("pos") - 499, 0.1))
    return i.filter("pos >= 500").join(fit, "entity").select("l_orderkey", "l_partkey", "entity", r6(corrected).alias("corrected"))


# ---------------------------------------------------------------- order and samples

@query("t1_total_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def total_order(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return selection.numbered(o, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query(
    "t4_family_heads",
    """WITH s AS (SELECT l_suppkey % 9 AS family, l_suppkey AS k, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY m, k) AS place FROM s), f AS (SELECT family, row_number() OVER (ORDER BY m, k) AS rank FROM r WHERE place = 1)
    SELECT family, k, m, place::INT AS place, rank::INT AS rank FROM r JOIN f USING (family) WHERE place <= 2 AND rank <= 4""",
)
def family_heads(spark, d):
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 9).alias("family"), F.col("l_suppkey").alias("k")).agg(r6(F.avg("l_quantity")).alias("m"))
    return selection.heads(s, "family", [F.asc("m"), F.asc("k")], 2, 4)


@query("t5_fixed_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('1729:' || o_orderkey), o_orderkey LIMIT 100")
def fixed_sample(spark, d):
    return selection.sampled(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 1729)


@query(
    "t6_weighted_resample",
    f"""WITH {_ORD}, w AS (SELECT o_custkey, o_orderkey, k, pow(2.0, k / 4.0) AS w FROM o), c AS (SELECT *, sum(w) OVER (PARTITION BY o_custkey ORDER BY k ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY o_custkey) AS total FROM w), d AS (SELECT o_custkey, j, {share_sql('o_custkey', 'j')} AS u FROM (SELECT DISTINCT o_custkey FROM o) CROSS JOIN (SELECT unnest(range(5)) AS j))
    SELECT o_custkey, o_orderkey, j::INT AS draw FROM d JOIN c USING (o_custkey) WHERE u * total > hi - w AND u * total <= hi""",
)
def weighted_resample(spark, d):
    o = _ordered(spark, d).select("o_custkey", "o_orderkey", "k")
    return selection.resampled(o, ["o_custkey"], ["k"], F.pow(F.lit(2.0), F.col("k") / 4.0), 5).select("o_custkey", "o_orderkey", "draw")


@query("t8_recent_years", "SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' - INTERVAL 5 YEAR AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1")
def recent_years(spark, d):
    cut = F.lit("2001-01-01").cast("timestamp")
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= cut - F.expr("interval 5 years")) & (F.col("o_orderdate") < cut))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query(
    "u7_u10_appended_columns",
    """SELECT event_id, event_type, user_id, (json_extract_string(props, '$.k'))::INT AS k, value > 50 AS high FROM events""",
)
def appended_columns(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.struct("user_id", F.from_json("props", "k int").alias("p")).alias("n"), "value")
    flat = e.select("event_id", "event_type", "n.user_id", "n.p.*", "value")
    return contracts.appended(flat, {"high": F.col("value") > 50}).drop("value")


# ---------------------------------------------------------------- folds

@query(
    "f3_surfaces",
    f"""WITH {_ORD}, l AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY k) AS a FROM o) SELECT surface, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' AND a < TIMESTAMP '1998-01-01' THEN 'development' WHEN o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' AND a < TIMESTAMP '2000-06-01' THEN 'confirmation' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'monitor' END AS surface FROM l) WHERE surface IS NOT NULL GROUP BY surface""",
)
def surfaces(spark, d):
    a = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("k"))
    at = lambda x: F.lit(x).cast("timestamp")
    day = F.col("o_orderdate")
    name = S.ladder(((day < at("1998-01-01")) & (F.col("a") < at("1998-01-01")), "development"), ((day >= at("1998-01-01")) & (day < at("2000-01-01")) & (F.col("a") < at("2000-06-01")), "confirmation"), (day >= at("2000-01-01"), "monitor"), other=None)
    return _ordered(spark, d).withColumn("a", a).withColumn("surface", name).filter("surface is not null").groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_ROWS = "r AS (SELECT o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 5)::INT) AS a FROM orders), i AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT s FROM r)), m AS (SELECT max(i) AS m FROM i)"
_OUTER = f"""{_ROWS}, g AS (SELECT unnest(range(252, m + 1, 210)) AS first, m FROM m), n AS (SELECT first, f.s AS from_s, t.s AS train_end, b.s AS test_start, e.s AS test_end FROM g JOIN i f ON f.i = greatest(first - 1008, 0) JOIN i t ON t.i = first - 1 JOIN i b ON b.i = first JOIN i e ON e.i = least(first + 20, m)),
    tr AS (SELECT first, train_end, test_start, test_end, count(*) AS train_rows, min(s) AS train_start FROM n JOIN r ON r.s >= from_s AND r.s <= train_end AND r.a <= train_end GROUP BY ALL HAVING count(DISTINCT s) >= 252), te AS (SELECT first, count(*) AS test_rows FROM n JOIN r ON r.s BETWEEN test_start AND test_end GROUP BY first),
    o AS (SELECT row_number() OVER (ORDER BY first) AS fold_id, train_start, train_end, test_start, test_end, train_rows, test_rows FROM tr JOIN te USING (first))"""


def _fold_rows(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("a"))


@query("f6_f9_outer_folds", f"WITH {_OUTER} SELECT * FROM o")
def outer_folds(spark, d):
    return folds.session_folds(_fold_rows(spark, d), "s", "a", min_train=252, max_train=1008, test=21, step=210, embargo=0, partial=True)


@query(
    "f6_f7_inner_folds",
    f"""WITH {_OUTER}, z AS (SELECT DISTINCT fold_id, r.s FROM o JOIN r ON r.s >= train_start AND greatest(r.s, r.a) <= train_end), k AS (SELECT fold_id, s, row_number() OVER (PARTITION BY fold_id ORDER BY s) - 1 AS i FROM z), t AS (SELECT fold_id, max(i) AS m FROM k GROUP BY 1 HAVING max(i) >= 272), h AS (SELECT fold_id, unnest(range(252, m - 20 + 1, 210)) AS first FROM t)
    SELECT fold_id AS outer_id, row_number() OVER (PARTITION BY fold_id ORDER BY first)::INT AS "inner", a.s AS train_end, b.s AS test_start, c.s AS test_end FROM h JOIN k a USING (fold_id) JOIN k b USING (fold_id) JOIN k c USING (fold_id) WHERE a.i = first - 1 AND b.i = first AND c.i = first + 20""",
)
def inner_folds(spark, d):
    rows = _fold_rows(spark, d)
    outer = folds.session_folds(rows, "s", "a", min_train=252, max_train=1008, test=21, step=210, embargo=0, partial=True)
    return folds.inner_folds(rows, outer, "s", "a", 252, 21, 210)


_INNER = """z AS (SELECT DISTINCT fold_id, r.s FROM o JOIN r ON r.s >= train_start AND greatest(r.s, r.a) <= train_end), k AS (SELECT fold_id, s, row_number() OVER (PARTITION BY fold_id ORDER BY s) - 1 AS i FROM z), t AS (SELECT fold_id, max(i) AS m FROM k GROUP BY 1 HAVING max(i) >= 272), h AS (SELECT fold_id, unnest(range(252, m - 20 + 1, 210)) AS first FROM t),
    inn AS (SELECT fold_id, row_number() OVER (PARTITION BY fold_id ORDER BY first)::INT AS k, a.s AS train_end, b.s AS test_start, c.s AS test_end FROM h JOIN k a USING (fold_id) JOIN k b USING (fold_id) JOIN k c USING (fold_id) WHERE a.i = first - 1 AND b.i = first AND c.i = first + 20)"""


@query(
    "f7_nested_forecasts",
    f"""WITH {_OUTER}, {_INNER}, q AS (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 5)::INT) AS a, (o_custkey % 50) / 10 AS x, o_totalprice / 100000 + (o_custkey % 50) / 20 AS y FROM orders),
    tk AS (SELECT fold_id AS outer_id, 0 AS n, train_start, train_end, test_start, test_end, NULL::DATE AS seen FROM o UNION ALL SELECT fold_id, inn.k, train_start, inn.train_end, inn.test_start, inn.test_end, o.train_end FROM inn JOIN o USING (fold_id)),
    f AS (SELECT outer_id, n, count(*) AS c, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5) AS b FROM tk JOIN q ON s >= train_start AND greatest(s, a) <= train_end GROUP BY ALL),
    e AS (SELECT outer_id, n, c, y, learner, CASE learner WHEN 'mean' THEN my ELSE my + b * (x - mx) END AS p FROM tk JOIN f USING (outer_id, n) JOIN q ON s BETWEEN test_start AND test_end AND (seen IS NULL OR greatest(s, a) <= seen), (SELECT unnest(['mean', 'ridge']) AS learner))
    SELECT outer_id, n AS "inner", learner, c AS train_rows, count(*) AS n, round(avg(p), 6) AS mean_forecast, round(avg(abs(p - y)), 6) AS mae FROM e GROUP BY ALL""",
)
def nested_forecasts(spark, d):
    """Inner and outer tests of two learners; fits are read from the cache where it has them."""
    day, x = F.to_date("o_orderdate"), (F.col("o_custkey") % 50) / 10
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("a"), x.alias("x"), (F.col("o_totalprice") / 100000 + x / 2).alias("y"))
    outer = folds.session_folds(rows, "s", "a", min_train=252, max_train=1008, test=21, step=210, embargo=0, partial=True)
    inner = folds.inner_folds(rows, outer, "s", "a", 252, 21, 210)
    learners = {"mean": nested.Learner((), options={"penalty": 0.0}), "ridge": nested.Learner(("x",), options={"penalty": 5.0})}
    f, _ = nested.nested_forecasts(rows, outer, inner, learners, "s", "a", "y", scratch_path(spark, "fits"))
    return f.groupBy("outer_id", "inner", "learner").agg(F.first("train_rows").alias("train_rows"), F.count(F.lit(1)).alias("n"), r6(F.avg("forecast")).alias("mean_forecast"), r6(F.avg(F.abs(F.col("forecast") - F.col("y")))).alias("mae"))


@query(
    "f8_f12_refit_schedule",
    f"""WITH {_ITEMS}, p AS (SELECT *, CASE WHEN pos >= 126 THEN 126 + (pos - 126) // 63 * 63 END AS refit FROM i), t AS (SELECT DISTINCT entity, refit FROM p WHERE refit IS NOT NULL), f AS (SELECT t.entity, t.refit, avg(x) AS forecast FROM t JOIN i ON i.entity = t.entity AND i.pos >= t.refit - 252 AND i.pos < t.refit GROUP BY ALL)
    SELECT l_orderkey, l_partkey, entity, p.refit::INT AS refit, round(forecast, 6) AS forecast FROM p JOIN f USING (entity, refit)""",
)
def refit_schedule(spark, d):
    p = folds.refits(_items(spark, d).drop("pos"), "entity", ["l_shipdate", "l_orderkey", "l_partkey"], 252, 126, 63)
    # the fit of a refit is a window up to its first row: one sorted pass in place of a join of rows with fits
    fit = F.avg("x").over(windows.past(["entity"], ["position"], 252))
    f = p.withColumn("fit", fit).filter("position = refit").select("entity", "refit", F.col("fit").alias("forecast"))
    return p.filter("refit is not null").join(f, ["entity", "refit"]).select("l_orderkey", "l_partkey", "entity", "refit", r6(F.col("forecast")).alias("forecast"))


@query(
    "f10_row_set_hash",
    """WITH k AS (SELECT o_custkey % 100 AS fold, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1) // 60 AS part FROM orders), p AS (SELECT fold, part, count(*) AS n, sha256(string_agg(k::VARCHAR, ',' ORDER BY k)) AS d FROM k GROUP BY ALL)
    SELECT fold, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY part)) AS digest FROM p GROUP BY fold""",
)
def row_set_hash(spark, d):
    return folds.row_set_hash(table(spark, d, "orders").withColumn("fold", F.col("o_custkey") % 100), ["fold"], "o_orderkey", chunk=60)


@query(
    "f13_m28_fold_assembly",
    f"""WITH {_ITEMS}, f AS (SELECT entity, pos, pos // 100 AS fold, x, x * 0.9 AS q10, x * CASE WHEN l_orderkey % 30 = 0 THEN 0.8 ELSE 1.0 END AS q50, x * 1.1 AS q90 FROM i)
    SELECT fold, 'ref' AS model_id, count(*) AS n, count(DISTINCT entity) AS entities, count(*) FILTER (q10 > q50 OR q50 > q90) AS crossing, round(max(greatest(q10 - q50, q50 - q90)), 6) AS worst, count(*) = count(DISTINCT entity * 100000 + pos) AS exactly_once FROM f WHERE x IS NOT NULL GROUP BY fold""",
)
def fold_assembly(spark, d):
    x = F.col("x")
    f = _items(spark, d).filter(x.isNotNull()).select("entity", "pos", F.floor(F.col("pos") / 100).alias("fold"), (x * 0.9).alias("q10"), (x * F.when(F.col("l_orderkey") % 30 == 0, 0.8).otherwise(1.0)).alias("q50"), (x * 1.1).alias("q90"))
    q = [F.col(c) for c in ("q10", "q50", "q90")]
    worst = F.greatest(q[0] - q[1], q[1] - q[2])
    return f.groupBy("fold").agg(F.first(F.lit("ref")).alias("model_id"), F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.count_if(S.crossings(q) > 0).alias("crossing"), r6(F.max(worst)).alias("worst"), (F.count(F.lit(1)) == F.count_distinct("entity", "pos")).alias("exactly_once"))
