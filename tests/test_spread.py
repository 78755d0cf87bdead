"""Tasks whose share of a table is bounded."""

from pyspark.sql import functions as F

from tidemark.operators import asof, spread, trees
from tidemark.plans import catalog
from tidemark.sources import sinks


def test_spread_makes_more_tasks_for_more_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 300)
    assert spread.spread(df, ["k"], 100).rdd.getNumPartitions() == 10
    assert spread.spread(df, ["k"], 1000) is df


def test_earliest_context_groups_in_bounded_tasks(spark, monkeypatch):
    facts = spark.range(600).selectExpr("id % 97 AS c", "CAST(id % 5 AS int) AS r", "CAST(id % 7 AS int) AS s", "IF(id % 11 = 0, NULL, CAST(id % 3 AS double)) AS v")
    run = lambda: asof.earliest_context(facts, ["c"], "r", "s", "v")
    want = sorted(run().collect(), key=str)
    monkeypatch.setattr(spread.spread, "__defaults__", (60,))
    assert sorted(run().collect(), key=str) == want
    assert "hashpartitioning(c#" in (plan := run()._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" in plan


def test_audit_groups_and_joins_in_bounded_tasks(spark, monkeypatch):
    run = lambda: catalog.QUERIES["q5_q14_audit_issues"](spark, "/root/testdata/sf0.001")
    want = sorted(run().collect())
    monkeypatch.setattr(spread.spread, "__defaults__", (500,))
    assert sorted(run().collect()) == want
    assert "REPARTITION_BY_NUM" in run()._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_compared_in_one_exchange(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, float("nan")), (None, None)], "k int, v double")
    assert not sinks.differ(a, a.orderBy("k"))
    assert sinks.differ(a, a.distinct()) and sinks.differ(a.distinct(), a) and sinks.differ(a, a.filter("k = 1"))


def test_training_rows_are_dealt_in_bounded_parts(spark, monkeypatch):
    rows = spark.range(0, 900, 1, 1).selectExpr("CAST(id % 30 AS double) AS a", "IF(id % 10 = 0, NULL, CAST(id % 30 AS double) + id % 3) AS y", "CAST(id % 3 AS int) AS c", "named_struct('x', id) AS other")
    seen = []
    monkeypatch.setattr(spread.dealt, "__defaults__", (100,))
    monkeypatch.setattr(trees.Pipeline, "fit", lambda self, df, fit=trees.Pipeline.fit: (seen.append(df.rdd.glom().map(len).collect()), fit(self, df))[1])
    fits = [f(rows, ["a"], "y", 2) for f in (trees.forest, trees.boosted)]
    trees.two_heads(rows, ["a"], "c", 1, 2)
    assert [sum(x) for x in seen] == [810, 810, 900, 600]
    assert all(max(x) < 150 for x in seen)
    again = trees.forest(rows, ["a"], "y", 2)
    shape = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]  # noqa: E731 - the first line has the model's random name
    assert shape(again) == shape(fits[0])
    gap = [trees.forecasts(m, rows.dropna()).selectExpr("avg(abs(forecast - y))").first()[0] for m in fits]
    assert max(gap) < 7


def test_few_rows_are_not_dealt(spark):
    df = spark.range(0, 50, 1, 2)
    assert spread.dealt(df) is df
