"""Registered queries of boosted distributions and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import boosting
from tidemark.plans.catalog import query, r6
from tidemark.plans.learner_queries import _LINES, _lines

#: Edges of the bins of q and d, so that SQL can state the same bins.
EDGES = {"q": [10.0, 20.0, 30.0, 40.0], "d": [2.5, 5.5, 7.5]}
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Lines whose target has both its location and its scale from q.
_TARGET = f"{_LINES}, z AS (SELECT q, d, q * 0.8 + y * q / 400 AS y, t FROM i)"
_BINS = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 + {' + '.join(f'({c} > {e})::INT' for e in edges)} END AS b{i}" for i, (c, edges) in enumerate(EDGES.items()))
_EDGE = f"CASE f WHEN 0 THEN {list(EDGES['q'])}[bin] ELSE {list(EDGES['d'])}[bin] END"


def _tree_sql(least: int) -> str:
    """CTEs r1 and r2 (best split of the root and of its children, by tree) and placed (rows with their leaf 4 to 7), of a table long (tree, g, b0, b1, ...)."""
    sums = "SELECT tree, node, f, bin, count(*) AS n, sum(g) AS s FROM (SELECT tree, node, g, 0 AS f, b0 AS bin FROM {x} UNION ALL SELECT tree, node, g, 1 AS f, b1 AS bin FROM {x}) GROUP BY ALL"
    run = "SELECT *, sum(n) OVER l AS nl, sum(s) OVER l AS sl, sum(n) OVER a AS na, sum(s) OVER a AS sa FROM {h} WINDOW l AS (PARTITION BY tree, node, f ORDER BY bin), a AS (PARTITION BY tree, node, f)"
    best = f"SELECT tree, node, f, bin FROM (SELECT *, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na AS gain FROM {{c}} WHERE nl >= {least} AND na - nl >= {least}) WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f, bin) = 1"
    out = []
    for level, x in ((1, "long1"), (2, "long2")):
        out += [f"h{level} AS ({sums.format(x=x)})", f"c{level} AS ({run.format(h=f'h{level}')})", f"r{level} AS ({best.format(c=f'c{level}')})"]
        node = f"2 * x.node + (r.bin IS NOT NULL AND CASE r.f WHEN 0 THEN b0 ELSE b1 END > r.bin)::INT AS node"
        out.append(f"{'long2' if level == 1 else 'placed'} AS (SELECT x.* EXCLUDE (node), {node} FROM {x} x LEFT JOIN r{level} r ON r.tree = x.tree AND r.node = x.node)")
    return "long1 AS (SELECT *, 1 AS node FROM long), " + ", ".join(out)


def _split(spark, d):
    rows, cut = _lines(spark, d).select("q", "d", (F.col("q") * 0.8 + F.col("y") * F.col("q") / 400).alias("y"), "t"), F.lit("2000-01-01").cast("timestamp")
    return rows.filter(F.col("t") < cut), rows.filter(F.col("t") >= cut)


@query(
    "m6_natural_boosting",
    f"""WITH {_TARGET}, tr AS (SELECT y, {_BINS} FROM z WHERE t < TIMESTAMP '2000-01-01'), s0 AS (SELECT quantile_cont(y, 0.5) AS mid FROM tr), s AS (SELECT any_value(mid) AS mid, avg(abs(y - mid)) AS b FROM tr, s0),
    long AS (SELECT 'location' AS tree, -b * sign(y - mid) AS g, b0, b1 FROM tr, s UNION ALL SELECT 'log_scale', 1 - abs(y - mid) / b, b0, b1 FROM tr, s), {_tree_sql(20)},
    leaves AS (SELECT tree, node, -0.3 * avg(g) AS added FROM placed GROUP BY tree, node)
    SELECT tree AS parameter, node, CASE f WHEN 0 THEN 'q' WHEN 1 THEN 'd' END AS feature, {_EDGE} AS threshold, NULL::DOUBLE AS added FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2)
    UNION ALL SELECT tree, node, NULL, NULL, round(added, 6) FROM leaves""",
)
def natural_boosting(spark, d):
    """One round of natural-gradient boosting of a Laplace distribution: its splits and leaves."""
    train, _ = _split(spark, d)
    model = boosting.fit(train, ["q", "d"], "y", boosting.LaplaceScore(), rounds=1, depth=2, rate=0.3, least=20, edges=list(EDGES.values()))
    rows = [(r["parameter"], r["node"], r["feature"], r["threshold"], r["added"]) for r in model.splits() if r["feature"] or r["added"]]
    return spark.createDataFrame(rows, "parameter string, node int, feature string, threshold double, added double").withColumn("added", r6(F.col("added")))


@query("m6_boosted_crps")
def boosted_crps(spark, d):
    """distribution, n, boosted, flat: mean CRPS on later rows of twelve rounds, and of one location and scale for all rows.

    No SQL: a round depends on the one before. tests/test_boosting.py holds rounds to a plain loop."""
    train, test = _split(spark, d)
    out = None
    for name, loss, crps in (("normal", boosting.NormalScore(), S.normal_crps), ("laplace", boosting.LaplaceScore(), S.laplace_crps)):
        model = boosting.fit(train, ["q", "d"], "y", loss, rounds=12, depth=2, rate=0.3, keep=6)
        at, spread = model.start
        score = lambda m, s: F.round(F.avg(crps(F.col("y"), m, s)), 5)  # noqa: B023, E731
        row = model.predict(test.select("q", "d", "y")).agg(F.count(F.lit(1)).alias("n"), score(F.col("location"), F.exp("log_scale")).alias("boosted"), score(F.lit(at), F.exp(F.lit(spread))).alias("flat"))
        row = row.select(F.lit(name).alias("distribution"), "n", "boosted", "flat")
        out = row if out is None else out.unionAll(row)
    return out


@query(
    "m7_quantile_trees",
    f"""WITH {_TARGET}, w AS (SELECT *, row_number() OVER () AS id, {_BINS} FROM z), s AS (SELECT unnest({list(LEVELS)})::DOUBLE AS level, unnest(quantile_cont(y, {list(LEVELS)})) AS q0 FROM w WHERE t < TIMESTAMP '2000-01-01'),
    long AS (SELECT level AS tree, y - q0 AS r, CASE WHEN y > q0 THEN -level ELSE 1 - level END AS g, b0, b1 FROM w, s WHERE t < TIMESTAMP '2000-01-01'), {_tree_sql(20)},
    leaves AS (SELECT tree, node, quantile_cont(r, {list(LEVELS)})[list_position({list(LEVELS)}, tree)] AS added FROM placed GROUP BY tree, node),
    held AS (SELECT id, q, y, level AS tree, q0, b0, b1, 1 AS node FROM w, s WHERE t >= TIMESTAMP '2000-01-01'),
    d2 AS (SELECT x.* EXCLUDE (node), 2 + (r.bin IS NOT NULL AND CASE r.f WHEN 0 THEN b0 ELSE b1 END > r.bin)::INT AS node FROM held x LEFT JOIN r1 r ON r.tree = x.tree),
    d3 AS (SELECT x.* EXCLUDE (node), 2 * x.node + (r.bin IS NOT NULL AND CASE r.f WHEN 0 THEN b0 ELSE b1 END > r.bin)::INT AS node FROM d2 x LEFT JOIN r2 r ON r.tree = x.tree AND r.node = x.node),
    p AS (SELECT id, any_value(q) AS q, any_value(y) AS y, list_sort(list(q0 + added)) AS f FROM d3 JOIN leaves USING (tree, node) GROUP BY id),
    e AS (SELECT floor(q / 10)::INT AS bucket, y, unnest({list(LEVELS)})::DOUBLE AS level, unnest(f) AS f FROM p)
    SELECT level, bucket, count(*) AS n, round(avg((y <= f + 1e-6)::INT), 6) AS share_below, round(avg(f), 4) AS mean_forecast FROM e GROUP BY level, bucket""",
)
def quantile_trees(spark, d):
    """level, bucket of q, n, share_below, mean_forecast: coverage of trees for five levels on later rows."""
    train, test = _split(spark, d)
    model = boosting.fit(train, ["q", "d"], "y", boosting.CheckLoss(LEVELS), rounds=1, depth=2, rate=1.0, least=20, edges=list(EDGES.values()))
    p = model.predict(test.select("q", "d", "y"))
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.col(n).alias("f")) for level, n in zip(LEVELS, model.names)])
    e = p.select(F.floor(F.col("q") / 10).cast("int").alias("bucket"), "y", F.inline(pairs))
    return e.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("y") <= F.col("f") + 1e-6).cast("int"))).alias("share_below"), F.round(F.avg("f"), 4).alias("mean_forecast"))


@query("m7_boosted_coverage")
def boosted_coverage(spark, d):
    """level, bucket of q, n, share_below, loss, flat_loss on later rows after eight rounds: coverage, and the check loss beside that of one quantile for all rows.

    No SQL: a round depends on the one before. tests/test_boosting.py holds rounds to a plain loop."""
    train, test = _split(spark, d)
    model = boosting.fit(train, ["q", "d"], "y", boosting.CheckLoss(LEVELS), rounds=8, depth=2, rate=0.5, keep=4)
    p = model.predict(test.select("q", "d", "y"))
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.col(n).alias("f"), F.lit(s).alias("flat")) for level, n, s in zip(LEVELS, model.names, model.start)])
    e = p.select(F.floor(F.col("q") / 10).cast("int").alias("bucket"), "y", F.inline(pairs))
    loss = lambda c: F.round(F.avg(F.greatest(F.col("level") * (F.col("y") - F.col(c)), (F.col("level") - 1) * (F.col("y") - F.col(c)))), 5)
    return e.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("y") <= F.col("f")).cast("int"))).alias("share_below"), loss("f").alias("loss"), loss("flat").alias("flat_loss"))
