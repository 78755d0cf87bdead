"""Registered queries of fiscal construction and of further joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import asof, contracts, fiscal
from tidemark.plans.catalog import _ORD, SERIES, _ordered, query, r6, series, table

_FACTS = "f AS (SELECT l_orderkey AS accn, l_shipdate::DATE - (l_quantity * 8)::INT AS start, l_shipdate::DATE AS stop, (l_quantity * 8)::INT AS days, l_linestatus = 'F' AS annual, l_linenumber AS val FROM lineitem)"


def _facts(spark, d):
    days = (F.col("l_quantity") * 8).cast("int")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("accn"), F.date_sub(F.to_date("l_shipdate"), days).alias("start"), F.to_date("l_shipdate").alias("stop"), (F.col("l_linestatus") == "F").alias("annual"), F.col("l_linenumber").alias("val"))


@query(
    "c1_native_period",
    f"""WITH {_FACTS}, c AS (SELECT *, CASE WHEN days BETWEEN 65 AND 110 THEN 1 WHEN days BETWEEN 150 AND 215 THEN 2 WHEN days BETWEEN 235 AND 305 THEN 3 WHEN days BETWEEN 330 AND 390 THEN 4 END AS quarter FROM f), m AS (SELECT *, max(quarter) OVER (PARTITION BY accn) AS top FROM c WHERE quarter IS NOT NULL AND (quarter = 4) = annual)
    SELECT accn, quarter, min(start) AS start, CASE WHEN count(DISTINCT val) = 1 THEN min(val) END AS val FROM m WHERE quarter = top GROUP BY accn, quarter HAVING count(DISTINCT start) = 1""",
)
def native_period(spark, d):
    return fiscal.period_context(_facts(spark, d), ["accn"], "start", "stop", "annual", "val")


@query(
    "c2_c3_fiscal_index",
    """WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS start, o_orderkey % 4 + 1 AS quarter, first_value(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS anchor FROM orders), c AS (SELECT *, start - anchor AS since, round_even((start - anchor) / 365.2425, 0) AS cycle FROM p)
    SELECT o_orderkey, CASE WHEN abs(since - cycle * 365.2425) <= 21 THEN ((year(anchor) + cycle) * 4 + quarter - 1)::INT END AS fiscal_index FROM c""",
)
def fiscal_index(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start"), (F.col("o_orderkey") % 4 + 1).alias("quarter"), "o_orderdate")
    return fiscal.fiscal_index(p, "o_custkey", "start", "quarter", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "fiscal_index")


@query(
    "c4_expected_start",
    """WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS stop, o_orderdate::DATE + (o_orderkey % 400)::INT AS asof FROM orders)
    SELECT o_orderkey, (SELECT max(q.stop) + 1 FROM p q WHERE q.o_custkey = p.o_custkey AND q.asof < p.asof AND q.stop < p.stop) AS expected_start FROM p""",
)
def expected_start(spark, d):
    day = F.to_date("o_orderdate")
    p = table(spark, d, "orders").select("o_orderkey", "o_custkey", day.alias("stop"), F.date_add(day, (F.col("o_orderkey") % 400).cast("int")).alias("asof"))
    return fiscal.expected_start(p, "o_custkey", "asof", "stop").select("o_orderkey", "expected_start")


_PANEL = f"{_ORD}, p AS (SELECT o_orderkey, o_custkey, k, o_orderdate + to_days((o_orderkey % 500)::INT) AS asof, CASE WHEN o_orderkey % 8 <> 0 THEN round(o_totalprice / 1000) END AS v, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice / 100) END AS y FROM o WHERE o_orderkey % 11 <> 0)"


def _panel(spark, d):
    o = _ordered(spark, d).filter("o_orderkey % 11 != 0")
    key = F.col("o_orderkey")
    return o.select("o_orderkey", "o_custkey", "k", (F.col("o_orderdate") + F.make_dt_interval((key % 500).cast("int"))).alias("asof"), F.when(key % 8 != 0, F.round(F.col("o_totalprice") / 1000)).alias("v"), F.when(key % 5 != 0, F.round(F.col("o_totalprice") / 100)).alias("y"))


@query(
    "c6_trailing_year",
    f"""WITH {_PANEL}, j AS (SELECT p.*, b.v AS v1, c.v AS v2, e.v AS v3, f.y AS y4, g.y AS ya FROM p
    LEFT JOIN p b ON b.o_custkey = p.o_custkey AND b.k = p.k - 1 AND b.asof <= p.asof LEFT JOIN p c ON c.o_custkey = p.o_custkey AND c.k = p.k - 2 AND c.asof <= p.asof
    LEFT JOIN p e ON e.o_custkey = p.o_custkey AND e.k = p.k - 3 AND e.asof <= p.asof LEFT JOIN p f ON f.o_custkey = p.o_custkey AND f.k = p.k - 4 AND f.asof <= p.asof LEFT JOIN p g ON g.o_custkey = p.o_custkey AND g.k = p.k // 4 * 4 - 1 AND g.asof <= p.asof),
    w AS (SELECT o_orderkey, CASE WHEN k % 4 = 3 THEN y END AS a, v + v1 + v2 + v3 AS q, CASE WHEN k % 4 <> 3 THEN ya + y - y4 END AS b FROM j)
    SELECT o_orderkey, coalesce(a, q, b) AS ttm, CASE WHEN a IS NOT NULL THEN 'ANNUAL' WHEN q IS NOT NULL THEN 'FOUR_QUARTERS' WHEN b IS NOT NULL THEN 'BRIDGE' ELSE 'MISSING' END AS method, a IS NULL AND q IS NULL AND b IS NOT NULL AS approximate FROM w""",
)
def trailing_year(spark, d):
    return fiscal.trailing_year(_panel(spark, d), "o_custkey", "k", "asof", "v", "y").select("o_orderkey", "ttm", "method", "approximate")


_HIST8 = f"{_ORD}, h AS (SELECT o_orderkey, k, list(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS h FROM o)"


def _histories(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("k").rowsBetween(-7, 0)
    # collect_list skips nulls: each value travels in a struct
    h = F.transform(F.collect_list(F.struct(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("x"))).over(w), lambda s: s["x"])
    return _ordered(spark, d).select("o_orderkey", h.alias("h"))


@query("c8_lag_columns", f"""WITH {_HIST8} SELECT o_orderkey, {", ".join(f"h[-{i + 1}] AS lag_{i}" for i in range(8))}, {", ".join(f"(h[-{i + 1}] IS NOT NULL)::INT AS observed_{i}" for i in range(8))} FROM h""")
def lag_columns(spark, d):
    return fiscal.lag_columns(_histories(spark, d), "h", 8)


@query("c12_u5_lags_long", f"WITH {_HIST8} SELECT o_orderkey, (unnest(range(len(h))))::INT AS position, unnest(h) AS value, (unnest(h) IS NOT NULL)::INT AS mask FROM h")
def lags_long(spark, d):
    return fiscal.lags_long(_histories(spark, d), ["o_orderkey"], "h")


@query("c9_staleness", f"WITH {_HIST8} SELECT o_orderkey, greatest(coalesce(list_position(list_transform(list_reverse(h), lambda x: x IS NOT NULL), true), 0) - 1, 0) AS staleness FROM h")
def staleness(spark, d):
    return _histories(spark, d).select("o_orderkey", fiscal.staleness("h").alias("staleness"))


@query(
    "c13_all_lags",
    f"""WITH {_ORD} SELECT o_orderkey, {", ".join(f"lag(o_totalprice, {n}) OVER w AS lag_{n}" for n in (1, 2, 3, 4, 5, 8, 12, 16))}, round((lag(o_totalprice, 4) OVER w + lag(o_totalprice, 8) OVER w) / 2, 3) AS seasonal_mean FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY k)""",
)
def all_lags(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("k")
    lag = lambda n: F.lag("o_totalprice", n).over(w)
    return _ordered(spark, d).select("o_orderkey", *[lag(n).alias(f"lag_{n}") for n in (1, 2, 3, 4, 5, 8, 12, 16)], F.round((lag(4) + lag(8)) / 2, 3).alias("seasonal_mean"))


@query(
    "c14_authority",
    """WITH e AS (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 <> 0 THEN coalesce(e.v, r.v) END AS v, CASE WHEN o_orderkey % 13 = 0 THEN 'QUARANTINE' WHEN e.v IS NOT NULL THEN 'EXACT' WHEN r.v IS NOT NULL THEN 'OVERRIDE' ELSE 'MISSING' END AS tier FROM orders LEFT JOIN e ON e.k = o_orderkey LEFT JOIN r ON r.k = o_orderkey""",
)
def authority(spark, d):
    best = lambda flag: table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return fiscal.authority(base, ["k"], "v", [("EXACT", best("A")), ("OVERRIDE", best("R"))], base.filter("k % 13 = 0"))


@query(
    "c15_prefix_view",
    "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY l_suppkey",
)
def prefix_view(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = fiscal.known_before(li, "1998-01-01", "l_shipdate").join(fiscal.known_before(o, "1998-01-01", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "c17_c18_event_rows",
    """SELECT event_id, 'EPS' AS factor, user_id AS entity, ts AS observed_at, sha256('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') AS id, CASE WHEN event_id % 3 = 0 THEN 'price' ELSE '' END AS forbidden FROM events""",
)
def event_rows(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.lit('{"a": {"Price": 1}, "note": "target: 3"}')).otherwise(F.col("props"))
    e = table(spark, d, "events")
    return e.select("event_id", F.lit("EPS").alias("factor"), F.col("user_id").alias("entity"), F.col("ts").alias("observed_at"), fiscal.event_id("event_id", "user_id", "event_type").alias("id"), F.concat_ws(",", fiscal.forbidden_keys(body, ["price", "target", "label"])).alias("forbidden"))


@query(
    "c19_forecast_year",
    f"""WITH {_ORD} SELECT o_orderkey, round(CASE WHEN count(o_totalprice) OVER w = 4 THEN sum(o_totalprice) OVER w END, 2) AS ttm, true AS approximate FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""",
)
def forecast_year(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("k").rowsBetween(0, 3)
    return _ordered(spark, d).select("o_orderkey", F.round(F.when(F.count("o_totalprice").over(w) == 4, F.sum("o_totalprice").over(w)), 2).alias("ttm"), F.lit(True).alias("approximate"))


@query(
    "c20_w26_trimmed_series",
    f"""WITH {SERIES}, l AS (SELECT user_id, list(CASE WHEN user_id % 3 <> 0 OR ts < TIMESTAMP '2024-01-09' THEN x END ORDER BY ts) AS v FROM s GROUP BY user_id), t AS (SELECT user_id, v[:len(v) - coalesce(nullif(list_position(list_transform(list_reverse(v), lambda x: x IS NOT NULL), true), 0) - 1, len(v))] AS t FROM l)
    SELECT user_id, CASE WHEN len(t) >= 12 AND len(list_filter(t, lambda x: x IS NOT NULL)) >= 8 THEN len(t) END::INT AS n, CASE WHEN len(t) >= 12 AND len(list_filter(t, lambda x: x IS NOT NULL)) >= 8 THEN t[-1] END AS last FROM t""",
)
def trimmed_series(spark, d):
    x = F.when((F.col("user_id") % 3 != 0) | (F.col("ts") < F.lit("2024-01-09").cast("timestamp")), F.col("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", x.alias("x")))), lambda s: s["x"])
    t = series(spark, d).groupBy("user_id").agg(v.alias("v")).withColumn("t", fiscal.trimmed("v"))
    return t.select("user_id", F.when(F.col("t").isNotNull(), F.size("t")).alias("n"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query(
    "s19_quarter_timeline",
    """SELECT c_custkey, (DATE '2010-01-01' + INTERVAL 1 MONTH * (3 * i))::DATE AS quarter FROM customer, LATERAL (SELECT unnest(range(c_custkey % 5 + 1)) AS i)""",
)
def quarter_timeline(spark, d):
    starts = fiscal.quarter_starts(F.lit("2010-01-01").cast("date"), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.explode(starts).alias("quarter"))


# ---------------------------------------------------------------- joins

@query(
    "j4_rescaled_price",
    """WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS price, CASE WHEN event_id % 17 = 0 THEN 2.0 ELSE 1.0 END AS ratio FROM events),
    c AS (SELECT *, sum(ln(ratio)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c, last_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pt FROM e)
    SELECT a.event_id, round(CASE WHEN a.ts::DATE - b.ts::DATE <= 2 THEN b.price * exp(a.c - b.c) END, 4) AS price FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND a.pt = b.ts WHERE a.event_type = 'purchase'""",
)
def rescaled_price(spark, d):
    e = table(spark, d, "events")
    prices = e.select("user_id", F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("price"), F.when(F.col("event_id") % 17 == 0, 2.0).otherwise(1.0).alias("ratio"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof.asof_rescaled(left, prices, ["user_id"], "ts", "at", "price", "ratio", 2).select("event_id", F.round("price", 4).alias("price"))


@query(
    "j6_earliest_context",
    """WITH f AS (SELECT l_suppkey AS cell, l_partkey % 40 AS part, l_linenumber AS tag, l_shipdate::DATE AS start, CASE WHEN l_linenumber % 3 <> 1 OR l_quantity > 25 THEN round(l_quantity / 20) END AS v FROM lineitem),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY cell, part ORDER BY tag, start) AS k FROM f) SELECT cell, part, min(tag) AS tag, min(start) AS start, CASE WHEN count(DISTINCT v) = 1 AND count(v) = count(*) THEN min(v) END AS v FROM r WHERE k = 1 GROUP BY cell, part""",
)
def earliest_context(spark, d):
    v = F.when((F.col("l_linenumber") % 3 != 1) | (F.col("l_quantity") > 25), F.round(F.col("l_quantity") / 20))
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 40).alias("part"), F.col("l_linenumber").alias("tag"), F.to_date("l_shipdate").alias("start"), v.alias("v"))
    return asof.earliest_context(f, ["cell", "part"], "tag", "start", "v")


@query(
    "j8_observable_session",
    """WITH s AS (SELECT DISTINCT ts::DATE AS session FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5)
    SELECT event_id, (SELECT min(session) FROM s WHERE session >= ts::DATE + CASE WHEN strftime(ts, '%H:%M:%S') > '16:15:00' THEN 1 ELSE 0 END) AS session FROM events""",
)
def observable_session(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    s = e.select(F.to_date("ts").alias("session")).distinct().filter(F.weekday("session") < 5)
    return asof.first_observable_session(e, s, "ts").select("event_id", "session")


@query(
    "j9_j16_j19_matched_once",
    """WITH r AS (SELECT l_orderkey, count(*) AS n, min(l_extendedprice) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN n = 1 THEN v END AS v, CASE WHEN n IS NULL THEN 'NONE' WHEN n > 1 THEN 'MANY' ELSE 'ONE' END AS match FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""",
)
def matched_once(spark, d):
    r = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("v"))
    return contracts.matched_once(table(spark, d, "orders").select("o_orderkey"), r, ["o_orderkey"], ["v"])


@query(
    "j10_report_alignment",
    """WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders), b AS (SELECT o_orderkey, o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 1e-4 ELSE 1e-12 END) AS w FROM orders WHERE o_orderkey % 20 <> 1)
    SELECT count(*) AS n, count(w) AS matched, count(*) FILTER (abs(v - w) > 1e-9 * abs(v)) AS differing, round(max(abs(v - w) / abs(v)), 9) AS worst FROM a LEFT JOIN b USING (o_orderkey)""",
)
def report_alignment(spark, d):
    o = table(spark, d, "orders")
    b = o.filter("o_orderkey % 20 != 1").select("o_orderkey", (F.col("o_totalprice") * (1 + F.when(F.col("o_orderkey") % 50 == 0, 1e-4).otherwise(1e-12))).alias("w"))
    off = F.abs(F.col("v") - F.col("w")) / F.abs("v")
    j = o.select("o_orderkey", F.col("o_totalprice").alias("v")).join(b, "o_orderkey", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("w").alias("matched"), F.count_if(off > 1e-9).alias("differing"), F.round(F.max(off), 9).alias("worst"))


@query(
    "j14_j18_aligned_baseline",
    """WITH m AS (SELECT unnest(range(5)) AS g, unnest(['a', 'b', 'c', 'd', 'e']) AS kind), b AS (SELECT o_orderkey, o_totalprice * 0.9 AS base FROM orders WHERE o_orderkey % 6 <> 0)
    SELECT kind, count(*) AS n, round(avg(abs(o_totalprice * 1.01 - o_totalprice) - abs(base - o_totalprice)), 4) AS delta FROM orders JOIN b USING (o_orderkey) JOIN m ON o_custkey % 5 = g WHERE o_orderkey % 4 <> 0 GROUP BY kind""",
)
def aligned_baseline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("y"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") * 1.01).alias("f"))
    base = table(spark, d, "orders").filter("o_orderkey % 6 != 0").select("o_orderkey", (F.col("o_totalprice") * 0.9).alias("base"))
    kinds = spark.createDataFrame(list(enumerate("abcde")), "g long, kind string")  # five rows of metadata
    j = o.join(base, "o_orderkey", "left").filter(F.col("f").isNotNull() & F.col("base").isNotNull()).join(F.broadcast(kinds), F.col("o_custkey") % 5 == F.col("g"))
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("f") - F.col("y")) - F.abs(F.col("base") - F.col("y"))), 4).alias("delta"))


@query(
    "j20_j21_attached_history",
    """WITH p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'), e AS (SELECT user_id, ts, max(value) AS eps FROM events WHERE event_type = 'purchase' GROUP BY ALL), b AS (SELECT ts::DATE AS day, avg(value) AS market FROM events GROUP BY 1)
    SELECT p.event_id, round(p.value / e.eps, 7) AS multiple, round(b.market, 4) AS market FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts > e.ts LEFT JOIN b ON p.ts::DATE = b.day""",
)
def attached_history(spark, d):
    e = table(spark, d, "events")
    eps = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("eps"))
    p = asof.asof_backward(e.filter("event_type = 'view'").select("event_id", "user_id", "ts", "value"), eps, ["user_id"], "ts", "seen", ["eps"], strict=True)
    market = e.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("market"))
    return p.join(market, F.to_date("ts") == F.col("day"), "left").select("event_id", F.round(S.ieee_ratio(F.col("value"), F.col("eps")), 7).alias("multiple"), F.round("market", 4).alias("market"))


@query(
    "j22_u8_q15_identity_equality",
    """SELECT 'orders' AS side, count(*) AS only_here FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lineitem', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)""",
)
def identity_equality(spark, d):
    a, b = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")
    side = lambda x, y, name: x.exceptAll(y).agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("only_here"))
    return side(a, b, "orders").unionAll(side(b, a, "lineitem"))
