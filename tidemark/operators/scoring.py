"""Metric bundles, masks, audits of coverage, and resampling of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.quantiles import exact_quantiles


def full_metrics(p: DataFrame, by: list[str], entity: str) -> DataFrame:
    """One row a group of predictions (actual, forecast, baseline, current, price, q10, q50, q90):
    coverage over rows with truth, errors over rows with both; tails by exact quantiles."""
    e = F.col("forecast") - F.col("actual")
    ok = F.col("actual").isNotNull() & F.col("forecast").isNotNull()
    r = p.withColumn("e", F.when(ok, e)).withColumn("ae", F.when(ok, F.abs(e))).withColumn("be", F.when(ok, F.abs(F.col("baseline") - F.col("actual"))))
    hit = F.when(ok & F.col("current").isNotNull(), S.direction_hit(F.col("actual"), F.col("forecast"), F.col("current")).cast("double"))
    qok = ok & F.col("q10").isNotNull() & F.col("q50").isNotNull() & F.col("q90").isNotNull()
    pin = sum([S.pinball(F.col("actual"), F.col(c), t) for c, t in (("q50", 0.5), ("q90", 0.9))], S.pinball(F.col("actual"), F.col("q10"), 0.1)) / 3
    main = r.groupBy(*by).agg(
        F.count("actual").alias("truth_rows"),
        F.count("e").alias("predicted_rows"),
        (F.count("e") / F.nullif(F.count("actual"), F.lit(0))).alias("coverage"),
        F.avg("ae").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg("e").alias("bias"),
        F.avg(F.when(F.col("price") > 0, F.col("ae") / F.col("price"))).alias("price_scaled_mae"),
        F.avg(hit).alias("direction_accuracy"),
        F.avg("be").alias("baseline_mae"),
        F.avg(F.when(qok, F.col("actual").between(F.col("q10"), F.col("q90")).cast("double"))).alias("interval_coverage"),
        F.avg(F.when(qok, F.col("q90") - F.col("q10"))).alias("interval_width"),
        F.avg(F.when(qok, pin)).alias("pinball"),
        F.count_if(qok & ((F.col("q10") > F.col("q50")) | (F.col("q50") > F.col("q90")))).alias("crossing_rows"),
    )
    macro = r.groupBy(*by, entity).agg(F.avg("ae").alias("_m")).groupBy(*by).agg(F.avg("_m").alias("macro_mae"))
    tails = exact_quantiles(r, by, "ae", [0.5, 0.9, 0.95, 0.99]).select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("median_ae", "p90_ae", "p95_ae", "p99_ae"))])
    base = exact_quantiles(r, by, "be", [0.5, 0.99]).select(*by, F.col("q")[0].alias("baseline_median_ae"), F.col("q")[1].alias("baseline_p99_ae"))
    out = main.join(macro, by).join(tails, by, "left").join(base, by, "left")
    return out.withColumn("gain", S.relative_gain(F.col("mae"), F.col("baseline_mae")))


def by_subgroup(p: DataFrame, by: list[str], names: Column, error: Column) -> DataFrame:
    """by, subgroup, n, mae: a row counts in each of its subgroups (an array of names)."""
    return p.select(*by, F.explode(names).alias("subgroup"), error.alias("_e")).groupBy(*by, "subgroup").agg(F.count("_e").alias("n"), F.avg(F.abs("_e")).alias("mae"))


def per_seed(p: DataFrame, model: str, seed: str, error: Column) -> DataFrame:
    """model, mae, worst_seed, worst_mae, best_mae: the worst seed is the last one by text among equals."""
    s = p.groupBy(model, seed).agg(F.avg(F.abs(error)).alias("_a"), F.sum(F.abs(error)).alias("_t"), F.count(error).alias("_n"))
    worst = F.max_by(seed, F.struct("_a", F.col(seed).cast("string")))
    return s.groupBy(model).agg((F.sum("_t") / F.sum("_n")).alias("mae"), worst.alias("worst_seed"), F.max("_a").alias("worst_mae"), F.min("_a").alias("best_mae"))


def mask_families(p: DataFrame, key: list[str], model: str, value: str, full: Column) -> DataFrame:
    """p with mask_complete, mask_common (all models have a value) and mask_common_full (all models of full coverage have one).

    `full`: does a model, by its count _n of values and the number _total of identities, count as full?"""
    models = p.groupBy(model).agg(F.count(value).alias("_n"), F.count(F.lit(1)).alias("_total"))
    models = models.select(model, full.alias("_full"))
    total = models.agg(F.count(F.lit(1)).alias("_m"), F.count_if("_full").alias("_f"))  # one row
    r = p.join(models, model)
    per = r.groupBy(*key).agg(F.count(value).alias("_have"), F.count(F.when(F.col("_full"), F.col(value))).alias("_have_full"))
    per = per.join(F.broadcast(total), F.lit(True)).select(*key, (F.col("_have") == F.col("_m")).alias("mask_common"), (F.col("_have_full") == F.col("_f")).alias("mask_common_full"))
    return p.join(per, key).withColumn("mask_complete", F.col(value).isNotNull())


def classification(p: DataFrame, parts: list[str], truth: str, bins: int = 10) -> DataFrame:
    """One row: accuracy, balanced accuracy, log loss, Brier score, expected calibration error and recall of each class."""
    cols = [F.col(c) for c in parts]
    k = len(parts)
    top = F.greatest(*cols)
    pred = F.array_position(F.array(*cols), top).cast("int") - 1
    r = p.filter(F.col(truth).isNotNull() & top.isNotNull()).select(pred.alias("_p"), F.col(truth).alias("_t"), top.alias("_c"), S.log_loss(cols, F.col(truth)).alias("_l"), S.brier(cols, F.col(truth)).alias("_b"))
    r = r.withColumn("_bin", F.least(F.floor(F.col("_c") * bins), F.lit(bins - 1)))
    hit = (F.col("_p") == F.col("_t")).cast("double")
    recall = [F.avg(F.when(F.col("_t") == i, hit)).alias(f"recall_{i}") for i in range(k)]
    main = r.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.avg("_l").alias("log_loss"), F.avg("_b").alias("brier"), *recall)
    known = sum([F.col(f"recall_{i}").isNotNull().cast("int") for i in range(1, k)], F.col("recall_0").isNotNull().cast("int"))
    balanced = sum([F.coalesce(f"recall_{i}", F.lit(0.0)) for i in range(1, k)], F.coalesce("recall_0", F.lit(0.0))) / known
    gap = r.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), F.abs(F.avg(hit) - F.avg("_c")).alias("_g")).agg((F.sum(F.col("_n") * F.col("_g")) / F.sum("_n")).alias("calibration_error"))
    return main.join(gap, F.lit(True)).withColumn("balanced_accuracy", balanced)


def coverage_audit(required: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """One row: required, found, missing, extra and repeated identities."""
    a = required.select(*key).distinct().withColumn("_a", F.lit(1))
    b = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_b"))
    j = a.join(b, key, "full_outer")
    count = F.count_if
    return j.agg(F.count("_a").alias("required"), F.count("_b").alias("found"), count(F.col("_b").isNull()).alias("missing"), count(F.col("_a").isNull()).alias("extra"), count(F.col("_b") > 1).alias("repeated"))


def run_lengths(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, run, value, n: stretches of equal values in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    r = rows.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def centred(x: Column, weight: Column, by: list[str]) -> Column:
    """x less the weighted mean of its group."""
    w = Window.partitionBy(*by)
    return x - F.sum(x * weight).over(w) / F.sum(F.when(x.isNotNull(), weight)).over(w)
