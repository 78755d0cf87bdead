"""Forecast metrics and comparisons on identical masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.scratch import written


def point_metrics(rows: DataFrame, by: list[str], actual: str, forecast: str) -> DataFrame:
    """by, rows, coverage, MAE, RMSE, median, p90, bias of each group; errors over rows with both values.

    Median and p90 are exact and need no task to hold a group."""
    e = F.col(forecast) - F.col(actual)
    main = rows.groupBy(*by).agg(
        F.count(actual).alias("truth_rows"),
        (F.count(e) / F.count(actual)).alias("coverage"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    )
    tails = exact_quantiles(rows.select(*by, F.abs(e).alias("_ae")), by, "_ae", [0.5, 0.9])
    return main.join(tails.select(*by, F.col("q")[0].alias("median_ae"), F.col("q")[1].alias("p90_ae")), by, "left")


def common_mask(predictions: DataFrame, key: list[str], model: str, value: str) -> DataFrame:
    """Predictions of the identities for which every model has a value: omission is not rewarded."""
    models = predictions.agg(F.count_distinct(model).alias("_m"))
    ok = predictions.filter(F.col(value).isNotNull()).groupBy(*key).agg(F.count_distinct(model).alias("_n"))
    ok = ok.join(F.broadcast(models), F.col("_n") == F.col("_m"), "left_semi")
    return predictions.join(ok.select(*key), key, "left_semi")


def pairs(predictions: DataFrame, key: list[str], model: str, error: str) -> DataFrame:
    """For each pair of models: rows, error correlation, MAE of the better one per row and of the mean, win share."""
    a = predictions.select(*key, F.col(model).alias("model_a"), F.col(error).alias("ea"))
    b = predictions.select(*key, F.col(model).alias("model_b"), F.col(error).alias("eb"))
    both = a.join(b, key).filter((F.col("model_a") < F.col("model_b")) & F.col("ea").isNotNull() & F.col("eb").isNotNull())
    var = (F.stddev_pop("ea") > 0) & (F.stddev_pop("eb") > 0)
    return both.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(var, F.corr("ea", "eb")).alias("error_corr"),
        F.avg(F.least(F.abs("ea"), F.abs("eb"))).alias("oracle_mae"),
        F.avg(F.abs((F.col("ea") + F.col("eb")) / 2)).alias("equal_mae"),
        F.avg(F.when(F.abs("ea") < F.abs("eb"), 1.0).otherwise(0.0)).alias("win_a"),
    )


def pair_correlations(predictions: DataFrame, key: list[str], model: str, actual: str, forecast: str) -> DataFrame:
    """For each pair of models over rows that both predict and whose truth is known: n, and the correlations of forecasts, errors and absolute errors.

    Null where a side does not vary."""
    p = predictions.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    side = lambda s: p.select(*key, F.col(model).alias(f"model_{s}"), F.col(forecast).alias(f"f{s}"), (F.col(forecast) - F.col(actual)).alias(f"e{s}"))
    both = side("a").join(side("b"), key).filter(F.col("model_a") < F.col("model_b"))
    corr = lambda x, y: F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))
    return both.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n"),
        corr(F.col("fa"), F.col("fb")).alias("forecast_corr"),
        corr(F.col("ea"), F.col("eb")).alias("error_corr"),
        corr(F.abs("ea"), F.abs("eb")).alias("absolute_error_corr"),
    )


def bound_leaderboard(predictions: DataFrame, key: list[str], model: str, forecast: str, error: Column) -> DataFrame:
    """rank, model, identity_bound, mask_bound, coverage, score (mean error) of each model; the rank is null for a model that is not bound.

    identity_bound: it has exactly one row for each identity that any model has; mask_bound: it forecasts
    exactly those that all models forecast. Scores are over its own forecasts, so only bound ones compare."""
    ids = predictions.groupBy(*key).agg(F.count_distinct(F.when(F.col(forecast).isNotNull(), F.col(model))).alias("_have"))
    models = predictions.select(F.count_distinct(model).alias("_models"))
    total = ids.join(F.broadcast(models), F.lit(True)).agg(F.count(F.lit(1)).alias("_ids"), F.count_if(F.col("_have") == F.col("_models")).alias("_common"))  # one row
    per = predictions.groupBy(model, *key).agg(F.count(F.lit(1)).alias("_rows"), F.count(forecast).alias("_f"), F.sum(error).alias("_e"), F.count(error).alias("_n"))
    per = per.groupBy(model).agg(F.count(F.lit(1)).alias("_own"), F.max("_rows").alias("_most"), F.count_if(F.col("_f") > 0).alias("_mask"), F.sum("_e").alias("_e"), F.sum("_n").alias("_n"))
    out = per.join(F.broadcast(total), F.lit(True)).select(
        model,
        ((F.col("_own") == F.col("_ids")) & (F.col("_most") == 1)).alias("identity_bound"),
        (F.col("_mask") == F.col("_common")).alias("mask_bound"),
        (F.col("_mask") / F.col("_ids")).alias("coverage"),
        F.try_divide("_e", "_n").alias("score"),
    )
    bound = F.col("identity_bound") & F.col("mask_bound")
    place = F.row_number().over(Window.orderBy(F.when(bound, 0).otherwise(1), F.col("score").asc_nulls_last(), model))  # one row a model
    return out.select(F.when(bound, place).alias("rank"), model, "identity_bound", "mask_bound", "coverage", "score")


def pareto(rows: DataFrame, key: str, low: list[str], high: list[str], most: int = 20_000) -> DataFrame:
    """Rows that no other row beats: as good in every objective and better in one. A missing objective neither beats nor is beaten.

    Compared are distinct vectors. The thousand with the best sums of scaled objectives
    drop most of the others; those left are compared with each other, in blocks of
    `most` that meet every vector in a join, so that no task holds more than a block."""
    cols = [*low, *high]
    *same, last = cols
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    # of vectors that agree in all but the last objective only the best can stay
    best = written(rows.filter(whole).groupBy(*same).agg((F.min if last in low else F.max)(last).alias(last)), "pareto")
    ends = best.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))]).first()
    place = F.lit(0.0)
    for c in cols:
        span = (ends[f"max_{c}"] or 0.0) - (ends[f"min_{c}"] or 0.0)
        place = place + F.col(c).cast("double") * ((1 if c in low else -1) / span if span > 0 else 0.0)
    as_good, better = F.lit(True), F.lit(False)
    for c in cols:
        a, b = (F.col(f"o_{c}"), F.col(c)) if c in low else (F.col(c), F.col(f"o_{c}"))
        as_good, better = as_good & (a <= b), better | (a < b)
    other = lambda x: x.select(*[F.col(c).alias(f"o_{c}") for c in cols])
    left = written(best.join(F.broadcast(other(best.orderBy(place).limit(1000))), as_good & better, "left_anti"), "pareto")
    blocks = -(-left.count() // most)
    if blocks <= 1:
        front = left.join(F.broadcast(other(left)), as_good & better, "left_anti")
    else:
        block = F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")
        against = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        o = left.withColumn("_ob", block).select("_ob", *[F.col(c).alias(f"o_{c}") for c in cols])
        beaten = against.join(o.hint("merge"), (F.col("_b") == F.col("_ob")) & as_good & better, "left_semi").select(*cols).distinct()
        front = left.join(beaten, cols, "left_anti")
    return rows.join(front.withColumn("_front", F.lit(True)), cols, "left").filter(~whole | F.col("_front")).select(*rows.columns)


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of the total."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_run", run).withColumn("_half", F.sum(weight).over(w) / 2)
    return r.filter(F.col("_run") >= F.col("_half")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def frame_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows by status: added, removed, changed (null-safe) or same."""
    a = old.select(*key, F.struct(*columns).alias("_a"))
    b = new.select(*key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.select(*key, status.alias("status"))


def conformal_expansion(rows: DataFrame, by: list[str], score: str, level: float = 0.8) -> DataFrame:
    """Split-conformal correction: the order statistic ceil((n + 1) level) of the scores, at least 0."""
    w = Window.partitionBy(*by)
    r = rows.withColumn("_n", F.count(score).over(w)).withColumn("_k", F.row_number().over(w.orderBy(score)))
    at = F.least(F.ceil(F.least(F.ceil((F.col("_n") + 1) * level) / F.col("_n"), F.lit(1.0)) * (F.col("_n") - 1)) + 1, F.col("_n"))
    return r.filter(F.col("_k") == at).groupBy(*by).agg(F.greatest(F.max(score), F.lit(0.0)).alias("correction"), F.max("_n").alias("n"))
