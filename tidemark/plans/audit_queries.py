"""Registered queries of audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audits, contracts, windows
from tidemark.plans.catalog import _PRED, _predictions, query, table
from tidemark.sources import sinks
from tidemark.sources.scratch import scratch_path


def _features(o):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select("o_orderkey", "o_orderdate", F.lag("o_totalprice").over(w).alias("lag_1"), F.max("o_totalprice").over(windows.past(["o_custkey"], ["o_orderdate", "o_orderkey"], 4)).alias("max_4"))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


_FEATURES = "SELECT o_orderkey, o_orderdate, lag(v) OVER w AS lag_1, max(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS max_4 FROM {t} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(
    "q2_future_mutation",
    f"""WITH s AS (SELECT *, o_totalprice AS v FROM orders), t AS (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 1e12 ELSE o_totalprice END AS v FROM orders), a AS ({_FEATURES.format(t="s")}), b AS ({_FEATURES.format(t="t")})
    SELECT count(*) AS n, count(*) FILTER (a.lag_1 IS DISTINCT FROM b.lag_1 OR a.max_4 IS DISTINCT FROM b.max_4) AS changed FROM a JOIN b USING (o_orderkey) WHERE a.o_orderdate < TIMESTAMP '1999-01-01'""",
)
def future_mutation(spark, d):
    cut = F.lit("1999-01-01").cast("timestamp")
    return audits.future_mutation(_features, _orders(spark, d), ["o_orderkey"], "o_totalprice", F.col("o_orderdate") >= cut, F.col("o_orderdate") < cut)


@query("q3_order_independence", "SELECT count(*) AS n, 0::BIGINT AS changed FROM orders")
def order_independence(spark, d):
    return audits.order_independence(_features, _orders(spark, d), ["o_orderkey"])


@query(
    "q4_lag_intervention",
    f"""WITH s AS (SELECT *, o_totalprice AS v FROM orders), t AS (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders), a AS ({_FEATURES.format(t="s")}), b AS ({_FEATURES.format(t="t")}), p AS (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 10 = 0 AS hit FROM orders)
    SELECT count(*) AS n, count(*) FILTER (b.lag_1 = a.lag_1 + 1) AS moved, bool_and(coalesce(hit, false) = coalesce(b.lag_1 IS DISTINCT FROM a.lag_1, false)) AS only_where_it_should FROM a JOIN b USING (o_orderkey) JOIN p USING (o_orderkey)""",
)
def lag_intervention(spark, d):
    """A change of one row moves the lag of the next row of its entity, by as much, and nothing else."""
    o = _orders(spark, d)
    b = _features(o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))).select("o_orderkey", F.col("lag_1").alias("new"))
    hit = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) % 10 == 0
    j = _features(o).join(b, "o_orderkey").join(o.select("o_orderkey", hit.alias("hit")), "o_orderkey")
    differs = ~F.col("new").eqNullSafe(F.col("lag_1"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new") == F.col("lag_1") + 1).alias("moved"), F.bool_and(F.coalesce("hit", F.lit(False)) == differs).alias("only_where_it_should"))


@query(
    "q6_prediction_issues",
    f"""WITH {_PRED}, x AS (SELECT o_orderkey, m, y + CASE WHEN o_orderkey % 1000 = 1 THEN 1 ELSE 0 END AS y, f FROM p WHERE o_orderkey % 500 <> 3 UNION ALL SELECT o_orderkey, m, y, f FROM p WHERE o_orderkey % 700 = 5), k AS (SELECT o_orderkey, m, count(*) AS c FROM x GROUP BY ALL), t AS (SELECT o_orderkey, o_totalprice AS y FROM orders WHERE o_orderkey % 300 <> 7), md AS (SELECT DISTINCT m FROM x),
    f AS (SELECT o_orderkey, m, any_value(y) AS y, any_value(f) AS f FROM x GROUP BY ALL), n AS (SELECT t.*, m FROM t CROSS JOIN md)
    SELECT 'REPEATED' AS issue, count(*) AS n FROM k WHERE c > 1 UNION ALL SELECT 'NO_TRUTH', count(*) FROM k ANTI JOIN n USING (o_orderkey, m) UNION ALL SELECT 'TRUTH_DIFFERS', count(*) FROM n JOIN f USING (o_orderkey, m) WHERE n.y <> f.y UNION ALL SELECT 'NOT_FINITE', count(*) FROM f WHERE f IS NULL UNION ALL SELECT 'MISSING', count(*) FROM n ANTI JOIN k USING (o_orderkey, m)""",
)
def prediction_issues(spark, d):
    p = _predictions(spark, d).select("o_orderkey", "m", "y", "f")
    shifted = p.filter("o_orderkey % 500 != 3").withColumn("y", F.col("y") + F.when(F.col("o_orderkey") % 1000 == 1, 1).otherwise(0))
    x = shifted.unionByName(p.filter("o_orderkey % 700 = 5"))
    truth = table(spark, d, "orders").filter("o_orderkey % 300 != 7").select("o_orderkey", F.col("o_totalprice").alias("y"))
    return audits.prediction_issues(x, truth, ["o_orderkey"], "m", "f", "y")


@query(
    "q7_duration_gaps",
    """WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS start, o_orderdate::DATE + (o_orderkey % 300)::INT AS stop FROM orders), l AS (SELECT *, start - lag(stop) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey) AS g FROM p)
    SELECT o_custkey, count(*) AS periods, count(*) FILTER (g > 1) AS gaps, count(*) FILTER (g < 1) AS overlaps FROM l GROUP BY o_custkey""",
)
def duration_gaps(spark, d):
    day = F.to_date("o_orderdate")
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", day.alias("start"), F.date_add(day, (F.col("o_orderkey") % 300).cast("int")).alias("stop"))
    return audits.gap_counts(p, ["o_custkey"], ["start", "o_orderkey"], "start", "stop")


@query("q8_frame_hash", "SELECT o_orderstatus, count(*) AS n, sum(('0x' || substr(md5(o_orderkey || ':' || o_custkey), 1, 12))::BIGINT)::BIGINT AS digest FROM orders GROUP BY 1")
def frame_hash(spark, d):
    # a sum of digests: the same for any order, and partial sums add up. 48 bits a row pass 63 after some 65,000 rows,
    # where the SQL's cast ends with an error: the exact sum then goes on modulo 2^64
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "o_orderkey", "o_custkey")), 1, 12), 16, 10).cast("decimal(16,0)")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), S.wrapped(F.sum(h)).alias("digest"))


@query(
    "q9_hash_chain",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), h AS (SELECT conv_id, 0::BIGINT AS k, '' AS head FROM (SELECT DISTINCT conv_id FROM c) UNION ALL SELECT c.conv_id, c.k, sha256(h.head || '|' || c.role) FROM h JOIN c ON c.conv_id = h.conv_id AND c.k = h.k + 1)
    SELECT conv_id, max(k) AS n, arg_max(head, k) AS head FROM h GROUP BY conv_id""",
)
def hash_chain(spark, d):
    return sinks.chained(table(spark, d, "conversations"), ["conv_id"], ["turn"], "role")


@query(
    "q13_prefix_checkpoints",
    """WITH k AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT (unnest([1, 2, 5, 9]))::INT AS checkpoint, unnest([count(*) FILTER (k <= 1), count(*) FILTER (k <= 2), count(*) FILTER (k <= 5), count(*) FILTER (k <= 9)]) AS n, 0::BIGINT AS changed FROM k""",
)
def prefix_checkpoints(spark, d):
    return audits.prefix_checkpoints(_features, _orders(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], [1, 2, 5, 9], ["o_orderkey"])


@query(
    "q15_quantile_issues",
    """WITH q AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice - 1500 END AS a, l_extendedprice + 100 AS b, l_extendedprice + CASE WHEN l_suppkey % 20 = 0 THEN 50 ELSE 200 END AS c, l_linenumber = 7 AS off FROM lineitem)
    SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN a IS NULL THEN 'NOT_FINITE' END, CASE WHEN a <= 0 THEN 'NOT_POSITIVE' END, CASE WHEN a >= b OR b >= c THEN 'NOT_RISING' END, CASE WHEN off THEN 'EXPECTED_IS_NOT_MEDIAN' END], lambda x: x IS NOT NULL)) AS code FROM q) GROUP BY code""",
)
def quantile_issues(spark, d):
    p = F.col("l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 50 != 0, p - 1500).alias("a"), (p + 100).alias("b"), (p + F.when(F.col("l_suppkey") % 20 == 0, 50).otherwise(200)).alias("c"), F.when(F.col("l_linenumber") == 7, p).otherwise(p + 100).alias("e"))
    codes = audits.quantile_issues(rows, ["a", "b", "c"], "e")
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q16_oof_issues",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, l_shipdate::DATE - (l_partkey % 30)::INT AS trained, l_suppkey / 2.0 AS pos, CASE WHEN l_returnflag = 'N' THEN 'OUTER' ELSE 'INNER' END AS role, CASE WHEN l_returnflag = 'N' AND l_suppkey % 9 <> 0 THEN -1 ELSE l_suppkey END AS fold FROM lineitem), c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM r)
    SELECT 'TRAINED_TOO_LATE' AS code, count(*) AS n FROM c WHERE trained >= day UNION ALL SELECT 'REPEATED', count(*) FROM c WHERE n > 1 UNION ALL SELECT 'POSITION', count(*) FROM c WHERE pos <> floor(pos) UNION ALL SELECT 'FOLD_ROLE', count(*) FROM c WHERE (role = 'OUTER') <> (fold = -1)""",
)
def oof_issues(spark, d):
    c, day = F.col, F.to_date("l_shipdate")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", day.alias("day"), F.date_sub(day, (c("l_partkey") % 30).cast("int")).alias("trained"), (c("l_suppkey") / 2.0).alias("pos"), F.when(c("l_returnflag") == "N", "OUTER").otherwise("INNER").alias("role"), F.when((c("l_returnflag") == "N") & (c("l_suppkey") % 9 != 0), -1).otherwise(c("l_suppkey")).alias("fold"))
    return audits.oof_issues(r, ["l_orderkey", "l_linenumber"], "trained", "day", "pos", "role", "fold")


@query("q18_replay_equality", "SELECT count(*) AS n, 0::BIGINT AS changed FROM orders")
def replay_equality(spark, d):
    """What was written once is made again from the sources and compared."""
    stored = sinks.write_verified(_features(_orders(spark, d)), scratch_path(spark, "stored"))
    return audits.changed_rows(stored, _features(_orders(spark, d)), ["o_orderkey"])


@query(
    "p41_feature_contract",
    """WITH r AS (SELECT p_partkey AS k, p_size % 2 = 0 AS fit, p_size % 5 = 0 AS evaluation, p_size % 7 = 0 AS ahead, p_size % 11 = 0 AS revised FROM part WHERE p_partkey % 9 <> 0), q AS (SELECT DISTINCT l_partkey AS k FROM lineitem)
    SELECT 'part_' || q.k AS feature, unnest(list_filter([CASE WHEN r.k IS NULL THEN 'UNREGISTERED' END, CASE WHEN NOT fit THEN 'NOT_FOR_FIT' END, CASE WHEN evaluation THEN 'EVALUATION_ONLY' END, CASE WHEN ahead THEN 'LOOK_AHEAD' END, CASE WHEN revised THEN 'REVISED_DATA' END], lambda x: x IS NOT NULL)) AS code FROM q LEFT JOIN r USING (k)""",
)
def feature_contract(spark, d):
    """Parts as features: registered ones with what they are allowed for, and those that lines ask for."""
    name, size = lambda k: F.concat(F.lit("part_"), F.col(k)), F.col("p_size")
    flags = {"fit_allowed": size % 2 == 0, "predict_allowed": F.lit(True), "evaluation_only": size % 5 == 0, "look_ahead": size % 7 == 0, "revised": size % 11 == 0}
    registry = table(spark, d, "part").filter("p_partkey % 9 != 0").select(name("p_partkey").alias("feature"), *[c.alias(k) for k, c in flags.items()])
    requested = table(spark, d, "lineitem").select(name("l_partkey").alias("feature")).distinct()
    return contracts.feature_violations(registry, requested, "fit")
