"""Further registered queries: selection, reshaping, audits, sampling and state machines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import fiscal, windows
from tidemark.operators.order_windows import sliding
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.catalog import _ORD, _PRED, SERIES, _ordered, _predictions, query, r6, series, table
from tidemark.sources.scratch import written
from tidemark.streaming import ordered, recurrent


@query(
    "p17_p28_p31_p32_scalars",
    """SELECT o_orderkey, round(sin((o_orderkey % 4) * pi() / 2), 6) + 0.0 AS q_sin, round(cos((o_orderkey % 4) * pi() / 2), 6) + 0.0 AS q_cos, sign(o_totalprice - 90000) = sign(o_totalprice * 0.9 - 90000) AS hit,
    round(pow(2.0, -((DATE '2002-01-01' - o_orderdate::DATE) / 730.485)), 9) AS recency, CASE WHEN o_custkey % 6 = 0 THEN 0.5 ELSE least(greatest((o_custkey % 120)::DOUBLE, 5.0), 100.0) / 100 END AS sample_weight FROM orders""",
)
def more_scalars(spark, d):
    o = table(spark, d, "orders")
    quarter = F.col("o_orderkey") % 4 * F.pi() / 2
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate"))
    weight = F.when(F.col("o_custkey") % 6 == 0, 0.5).otherwise(S.clip((F.col("o_custkey") % 120).cast("double"), 5.0, 100.0) / 100)
    return o.select("o_orderkey", (r6(F.sin(quarter)) + 0.0).alias("q_sin"), (r6(F.cos(quarter)) + 0.0).alias("q_cos"), S.direction_hit(F.col("o_totalprice"), F.col("o_totalprice") * 0.9, F.lit(90000.0)).alias("hit"), F.round(S.recency_weight(age, 730.485), 9).alias("recency"), weight.alias("sample_weight"))


@query(
    "p26_p27_lexical_checks",
    """SELECT p_partkey, lpad(p_partkey::VARCHAR, 10, '0') AS cik, regexp_matches(p_brand, '^Brand#[0-9]+$') AS brand_ok, lower(trim(p_type)) AS kind, TRY_CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) * pow(10, p_size % 3)::BIGINT AS scaled FROM part""",
)
def lexical(spark, d):
    p = table(spark, d, "part")
    digits = F.expr("try_cast(regexp_replace(p_brand, '[^0-9]', '') as bigint)")
    return p.select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("cik"), F.col("p_brand").rlike("^Brand#[0-9]+$").alias("brand_ok"), F.lower(F.trim("p_type")).alias("kind"), (digits * F.pow(F.lit(10), F.col("p_size") % 3).cast("bigint")).alias("scaled"))


@query(
    "p33_valuation_state",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'INVALID' WHEN g > 0.3 AND o_orderstatus = 'F' THEN 'RICH_CONFIRMED' WHEN g > 0.3 THEN 'RICH' WHEN g < -0.3 THEN 'CHEAP' ELSE 'FAIR' END AS state FROM (SELECT *, CASE WHEN o_totalprice > 0 THEN ln(o_totalprice / 90000) END AS g FROM orders)""",
)
def valuation_state(spark, d):
    g = S.safe_log(F.col("o_totalprice") / 90000)
    state = F.when(F.col("o_totalprice") < 5000, "INVALID").when((g > 0.3) & (F.col("o_orderstatus") == "F"), "RICH_CONFIRMED").when(g > 0.3, "RICH").when(g < -0.3, "CHEAP").otherwise("FAIR")
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"))


@query(
    "j12_key_universe",
    """SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) b ON a.k = b.k GROUP BY side""",
)
def key_universe(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("l")).distinct()
    b = table(spark, d, "customer").filter("c_custkey % 5 != 0").select(F.col("c_custkey").alias("k"), F.lit(1).alias("r"))
    side = F.when(F.col("l").isNull(), "extra").when(F.col("r").isNull(), "missing").otherwise("both")
    return a.join(b, "k", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "j15_shifted_year_join",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL) SELECT a.o_custkey, a.yr, a.v, b.v AS next_v FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND b.yr = a.yr + 1""",
)
def shifted_year(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    w = Window.partitionBy("o_custkey").orderBy("yr")
    return y.select("o_custkey", "yr", "v", F.when(F.lead("yr").over(w) == F.col("yr") + 1, F.lead("v").over(w)).alias("next_v"))


@query(
    "c8_c12_lag_vectors",
    f"""WITH {_ORD}, v AS (SELECT o_custkey, list(o_totalprice ORDER BY k) AS xs FROM o GROUP BY o_custkey) SELECT o_custkey, len(xs) AS n, xs[len(xs)] AS last_value, xs[1] AS first_value, round(list_avg(xs[greatest(len(xs) - 7, 1):]), 7) AS mean_8 FROM v""",
)
def lag_vectors(spark, d):
    # newest eight values only: an array of bounded size, not the whole history
    o = _ordered(spark, d)
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("k")))
    return o.withColumn("back", back).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_totalprice", "k").alias("last_value"), F.min_by("o_totalprice", "k").alias("first_value"), F.round(F.avg(F.when(F.col("back") <= 8, F.col("o_totalprice"))), 7).alias("mean_8"))


@query(
    "a13_a15_counts",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(DISTINCT year(l_shipdate)) AS years FROM lineitem GROUP BY ALL""",
)
def counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.year("l_shipdate")).alias("years"))


@query(
    "a20_path_diagnostics",
    f"""WITH {_ORD}, e AS (SELECT o_custkey, (k - 1) // 4 AS path, o_totalprice - 90000 AS e FROM o), p AS (SELECT o_custkey, path, avg(abs(e)) AS mae, abs(sum(e)) AS total FROM e GROUP BY ALL HAVING count(*) = 4) SELECT count(*) AS paths, round(avg(mae), 4) AS path_mae, round(avg(total), 4) AS sum_mae FROM p""",
)
def paths(spark, d):
    e = _ordered(spark, d).select("o_custkey", F.floor((F.col("k") - 1) / 4).alias("path"), (F.col("o_totalprice") - 90000).alias("e"))
    p = e.groupBy("o_custkey", "path").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"), F.abs(F.sum("e")).alias("total")).filter("n = 4")
    return p.agg(F.count(F.lit(1)).alias("paths"), F.round(F.avg("mae"), 4).alias("path_mae"), F.round(F.avg("total"), 4).alias("sum_mae"))


@query(
    "a21_seed_stability",
    f"""WITH {_PRED}, s AS (SELECT o_orderkey, stddev_samp(f) AS sd, count(DISTINCT sign(f - y)) AS signs FROM p GROUP BY o_orderkey) SELECT round(quantile_cont(sd, 0.5), 4) AS median_sd, round(quantile_cont(sd, 0.95), 4) AS p95_sd, round(avg(CASE WHEN signs > 1 THEN 1.0 ELSE 0.0 END), 6) AS disagree FROM s""",
)
def seed_stability(spark, d):
    side = F.signum(F.col("f") - F.col("y"))
    s = _predictions(spark, d).groupBy("o_orderkey").agg(F.stddev_samp("f").alias("sd"), F.coalesce(F.min(side) != F.max(side), F.lit(False)).alias("apart"))
    # written once, as the quantiles read it three times; no task sorts all orders
    s = written(s.select(F.lit(0).alias("all"), "sd", "apart"), "stability")
    q = exact_quantiles(s, ["all"], "sd", [0.5, 0.95]).select(F.col("q")[0].alias("mid"), F.col("q")[1].alias("high"))
    share = s.agg(r6(F.avg(F.col("apart").cast("double"))).alias("disagree"))
    return share.join(q, F.lit(True), "left").select(F.round("mid", 4).alias("median_sd"), F.round("high", 4).alias("p95_sd"), "disagree")


@query(
    "a28_a32_means",
    """SELECT l_suppkey, round(exp(avg(ln(l_extendedprice))), 4) AS geometric, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY l_suppkey""",
)
def means(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.exp(F.avg(S.safe_log(F.col("l_extendedprice")))), 4).alias("geometric"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 4).alias("weighted"))


@query(
    "w16_baselines",
    f"""WITH {_ORD} SELECT o_orderkey, lag(o_totalprice) OVER w AS persistence, coalesce(lag(o_totalprice, 4) OVER w, lag(o_totalprice) OVER w) AS seasonal, round(lag(o_totalprice) OVER w + (lag(o_totalprice) OVER w - first_value(o_totalprice) OVER w) / nullif(k - 2, 0), 7) AS drift, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 7) AS mean FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY k)""",
)
def baselines(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("k")
    before = F.lag("o_totalprice").over(w)
    drift = before + F.try_divide(before - F.first("o_totalprice").over(w), F.col("k") - 2)
    return _ordered(spark, d).select("o_orderkey", before.alias("persistence"), F.coalesce(F.lag("o_totalprice", 4).over(w), before).alias("seasonal"), F.round(drift, 7).alias("drift"), F.round(F.avg("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1)), 7).alias("mean"))


@query(
    "w17_rolling_reference_quantiles",
    f"""WITH {SERIES} SELECT event_id, quantile_disc(x, 0.1) OVER w AS q10, quantile_disc(x, 0.25) OVER w AS q25, quantile_disc(x, 0.5) OVER w AS q50, quantile_disc(x, 0.75) OVER w AS q75, quantile_disc(x, 0.9) OVER w AS q90 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""",
)
def reference_quantiles(spark, d):
    levels = {f"q{round(100 * p)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    return sliding(series(spark, d), ["user_id"], ["ts"], "x", 40, inverted=levels).select("event_id", *levels)


_LEVEL = f"""{SERIES}, p AS (SELECT user_id, event_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM s),
    f AS (SELECT user_id, 0::BIGINT AS pos, NULL::BIGINT AS event_id, NULL::DOUBLE AS x, NULL::DOUBLE AS before, NULL::DOUBLE AS level, 0.0::DOUBLE AS gain, NULL::DOUBLE AS state, 1.0::DOUBLE AS var, []::DOUBLE[] AS past FROM (SELECT DISTINCT user_id FROM p)
    UNION ALL SELECT user_id, pos, event_id, x, state, CASE WHEN x IS NULL THEN NULL WHEN state IS NULL THEN x ELSE state + (var + 0.05) / (var + 1.05) * innovation END, CASE WHEN x IS NULL THEN 0.0 WHEN state IS NULL THEN 1.0 ELSE (var + 0.05) / (var + 1.05) END,
    CASE WHEN x IS NULL THEN state WHEN state IS NULL THEN x ELSE state + (var + 0.05) / (var + 1.05) * innovation END, CASE WHEN state IS NULL THEN var WHEN x IS NULL THEN var + 0.05 ELSE (1 - (var + 0.05) / (var + 1.05)) * (var + 0.05) END, CASE WHEN x IS NULL OR state IS NULL THEN past ELSE list_append(past, x - state)[-60:] END
    FROM (SELECT *, CASE WHEN len(past) >= 20 THEN greatest(-3 * scale, least(3 * scale, x - state)) ELSE x - state END AS innovation FROM (SELECT *, greatest(1.4826 * list_aggregate(list_transform(past, lambda v: abs(v - mid)), 'quantile_cont', 0.5), 0.01) AS scale FROM (SELECT f.state, f.var, f.past, p.user_id, p.pos, p.event_id, p.x, list_aggregate(f.past, 'quantile_cont', 0.5) AS mid FROM f JOIN p ON p.user_id = f.user_id AND p.pos = f.pos + 1))))"""


@query("w10_w11_local_level_filter", f"""WITH RECURSIVE {_LEVEL} SELECT event_id, round(before, 5) AS before, round(level, 5) AS level, round(gain, 6) AS gain FROM f WHERE pos > 0""")
def local_level(spark, d):
    """level after the row and before it: the second is the forecast that has not seen the row."""
    s = series(spark, d).select(F.col("user_id").cast("string").alias("series"), "ts", "event_id", "x")
    return recurrent.filtered(s).select("event_id", F.round("before", 5).alias("before"), F.round("level", 5).alias("level"), r6(F.col("gain")).alias("gain"))


@query("stream_local_level", f"""WITH RECURSIVE {_LEVEL} SELECT event_id, round(before, 5) AS before, round(level, 5) AS level, round(gain, 6) AS gain FROM f WHERE pos > 0""")
def stream_local_level(spark, d):
    """The events replayed in four micro-batches that overlap by up to six hours: equal to the batch form."""
    out = ordered.replayed(series(spark, d), "user_id", "ts", "event_id", ["event_id", "x"], ordered.LevelFold(), 4, 8 * 3600, 6 * 3600)
    return out.select("event_id", F.round("before", 5).alias("before"), F.round("level", 5).alias("level"), r6(F.col("gain")).alias("gain"))


@query(
    "stream_asof",
    """WITH e AS (SELECT user_id, event_id, ts, event_id % 3 = 0 AS asks, event_id % 50 AS session, event_id % 7 AS revision, value FROM events), m AS (SELECT a.event_id AS decision, b.session, b.revision, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.session DESC, b.revision DESC, b.ts, b.event_id) AS n FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND NOT b.asks AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) WHERE a.asks)
    SELECT decision, session, revision, value FROM m WHERE n = 1""",
)
def stream_asof(spark, d):
    """Every third event asks for the value of the latest session, highest revision, that was there before it; both sides are streams."""
    asks, own = F.col("event_id") % 3 == 0, lambda c: F.when(F.col("event_id") % 3 != 0, c)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(asks, F.col("event_id")).alias("decision"), own(F.col("event_id") % 50).alias("session"), own(F.col("event_id") % 7).alias("revision"), own(F.col("value")).alias("value"))
    return ordered.replayed(e, "user_id", "ts", "event_id", ["decision", "session", "revision", "value"], ordered.AsofFold(), 4, 8 * 3600, 6 * 3600).select("decision", "session", "revision", "value")


@query(
    "stream_transitions",
    """WITH r AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER w AS before, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM r), n AS (SELECT user_id, run, count(*) AS n FROM g GROUP BY ALL)
    SELECT event_id, before AS from_label, event_type AS to_label, coalesce(n.n, 0) AS run FROM g LEFT JOIN n ON n.user_id = g.user_id AND n.run = g.run - 1 WHERE new = 1""",
)
def stream_transitions(spark, d):
    """Changes of a user's event type, with how many events the type before had lasted."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.replayed(e, "user_id", "ts", "event_id", ["event_id", "event_type"], ordered.TransitionFold(), 4, 8 * 3600, 6 * 3600).select("event_id", "from_label", "to_label", "run")


@query(
    "stream_windowed_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def windowed(spark, d):
    out = recurrent.windowed_counts(table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "t2_t3_top_and_argmin",
    """WITH r AS (SELECT l_suppkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS n FROM lineitem) SELECT l_suppkey, n::INT AS n, l_partkey, l_extendedprice FROM r WHERE n <= 3""",
)
def top_rows(spark, d):
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_orderkey"))
    return table(spark, d, "lineitem").withColumn("n", n).filter("n <= 3").select("l_suppkey", "n", "l_partkey", "l_extendedprice")


@query(
    "t9_m17_lexicographic_selection",
    """WITH m AS (SELECT p_brand, p_partkey, p_retailprice, p_size, p_size > 10 AS pass FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pass DESC, p_retailprice, p_size, p_partkey) AS n FROM m) SELECT p_brand, p_partkey, pass FROM r WHERE n = 1""",
)
def lexicographic(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size", (F.col("p_size") > 10).alias("pass"))
    best = F.min_by(F.struct("p_partkey", "pass"), F.struct(~F.col("pass"), "p_retailprice", "p_size", "p_partkey"))
    return p.groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.p_partkey", "b.pass")


@query(
    "u1_u3_set_operations",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.08 AND l_tax > 0.06) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_quantity > 45").select(F.col("l_suppkey").alias("k")).distinct()
    b = li.filter("l_discount > 0.08 and l_tax > 0.06").select(F.col("l_suppkey").alias("k")).distinct()
    both = a.withColumn("x", F.lit(1)).unionByName(b.withColumn("y", F.lit(1)), allowMissingColumns=True).groupBy("k").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    ops = S.codes((F.lit(True), "union"), (F.col("x").isNotNull() & F.col("y").isNotNull(), "intersect"), (F.col("x").isNotNull() & F.col("y").isNull(), "except"))
    return both.select(F.explode(ops).alias("op"), "k")


@query(
    "f11_cell_purge",
    f"""WITH {_ORD}, c AS (SELECT o_orderkey, h, lead(o_orderdate, 1) OVER w AS a1, lead(o_orderdate, 2) OVER w AS a2, lead(o_totalprice, 1) OVER w AS y1, lead(o_totalprice, 2) OVER w AS y2 FROM o, (SELECT 1 AS h UNION ALL SELECT 2) WINDOW w AS (PARTITION BY h, o_custkey ORDER BY k))
    SELECT h, count(*) AS cells, count(*) FILTER ((CASE h WHEN 1 THEN a1 ELSE a2 END) < TIMESTAMP '1999-01-01') AS visible FROM c GROUP BY h""",
)
def cell_purge(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("k")
    wide = _ordered(spark, d).select(F.lead("o_orderdate", 1).over(w).alias("a1"), F.lead("o_orderdate", 2).over(w).alias("a2"))
    cells = wide.select(F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"a{h}").alias("a")) for h in (1, 2)])))
    return cells.groupBy("h").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("a") < F.lit("1999-01-01").cast("timestamp")).alias("visible"))


@query(
    "q1_prefix_invariance",
    """WITH a AS (SELECT o_orderkey, avg(o_totalprice) OVER w AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT o_orderkey, o_orderdate, avg(o_totalprice) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
    SELECT count(*) AS n, count(a.m) AS with_history, count(*) FILTER (a.m IS DISTINCT FROM b.m) AS changed FROM a JOIN b USING (o_orderkey)""",
)
def prefix_invariance(spark, d):
    """Lag features built from orders before a cutoff equal those built from all orders."""
    past4 = windows.past(["o_custkey"], ["o_orderdate", "o_orderkey"], 4)
    build = lambda o: o.select("o_orderkey", F.avg("o_totalprice").over(past4).alias("m"))
    o = table(spark, d, "orders")
    early = build(fiscal.known_before(o, "1998-01-01", "o_orderdate")).withColumnRenamed("m", "early")
    j = early.join(build(o), "o_orderkey")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("early").alias("with_history"), F.count_if(~F.col("early").eqNullSafe(F.col("m"))).alias("changed"))


@query(
    "q17_positions",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) SELECT conv_id, count(*) AS n, bool_and(turn = pos) AS contiguous FROM t GROUP BY conv_id""",
)
def positions(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), ((F.min("turn") == 0) & (F.max("turn") == F.count(F.lit(1)) - 1) & (F.count_distinct("turn") == F.count(F.lit(1)))).alias("contiguous"))


@query(
    "s18_business_days",
    """WITH d AS (SELECT unnest(range(min(o_orderdate)::DATE, max(o_orderdate)::DATE + 1, INTERVAL 1 DAY))::DATE AS day FROM orders) SELECT day FROM d WHERE isodow(day) <= 5""",
)
def business_days(spark, d):
    """The weekdays from the first to the last order."""
    span = table(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.filter(F.weekday("day") < 5)
