"""Few large groups stay in many tasks: their rows are not shuffled by group."""

from tidemark.operators import learners
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import catalog_more, learner_queries  # noqa: F401 - these register their queries
from tidemark.plans.catalog import QUERIES


def broadcasts(spark, threshold: str, make) -> int:
    """Broadcast joins in the plan of a frame as made under a threshold, before any of its stages has run."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        return make()._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")
    finally:
        spark.conf.set(key, old)


def test_quantiles_of_few_groups_broadcast_their_brackets(spark):
    rows = spark.range(200_000).selectExpr("id % 2 AS g", "id * 1.0 AS v")
    quantiles = lambda: exact_quantiles(rows, ["g"], "v", [0.5])
    # both passes over the rows meet the brackets
    assert broadcasts(spark, "60k", quantiles) >= 2
    assert {r.g: r.q[0] for r in quantiles().collect()} == {0: 99999.0, 1: 100000.0}


def test_annual_equation_broadcasts_its_cuts(spark):
    assert broadcasts(spark, "-1", lambda: QUERIES["m12_annual_equation"](spark, "/root/testdata/sf0.001")) >= 2


def test_stacking_computes_its_rows_once(spark, monkeypatch):
    names, write = [], learners.written
    monkeypatch.setattr(learners, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.range(50).selectExpr("id * 1D AS a", "id * 2D AS b", "id * 1.4D AS y")
    w, mae = learners.convex_stack(df, ["a", "b"], "y")
    assert names == ["stack"] and abs(w[0] - 0.6) < 1e-3 and mae < 0.05


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()


def test_stability_sorts_no_column_in_one_task(spark):
    text = plan(spark, "a21_seed_stability")
    assert "percentile(" not in text
    r = QUERIES["a21_seed_stability"](spark, "/root/testdata/sf0.001").collect()
    assert len(r) == 1 and 0 < r[0].median_sd < r[0].p95_sd and 0 <= r[0].disagree <= 1
