"""Audits: what a build must not depend on, and violations as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def changed_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows of a, and how many of them differ (null-safe) or are missing in b."""
    cols = [c for c in a.columns if c not in key]
    j = a.select(*key, F.struct(*cols).alias("_a")).join(b.select(*key, F.struct(*cols).alias("_b")), key, "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))


def future_mutation(build: Callable[[DataFrame], DataFrame], source: DataFrame, key: list[str], value: str, later: Column, check: Column, huge: float = 1e12) -> DataFrame:
    """Do the features of rows before a cutoff (check) stay when later values become huge?"""
    mutated = source.withColumn(value, F.when(later, F.lit(huge)).otherwise(F.col(value)))
    return changed_rows(build(source).filter(check), build(mutated), key)


def order_independence(build: Callable[[DataFrame], DataFrame], source: DataFrame, key: list[str], parts: int = 7) -> DataFrame:
    """Are the features the same for rows that come in another order and other partitions?"""
    shuffled = source.withColumn("_o", F.xxhash64(*source.columns)).repartition(parts, "_o").sortWithinPartitions("_o").drop("_o")
    return changed_rows(build(source), build(shuffled), key)


def prefix_checkpoints(build: Callable[[DataFrame], DataFrame], source: DataFrame, entity: str, order: list[str], points: list[int], key: list[str]) -> DataFrame:
    """checkpoint, n, changed: features rebuilt from the first `point` rows of each entity against those from all rows."""
    pos = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    numbered = source.withColumn("_pos", pos)
    whole, out = build(source), None
    for p in points:
        part = changed_rows(build(numbered.filter(F.col("_pos") <= p).drop("_pos")), whole, key).select(F.lit(p).alias("checkpoint"), "n", "changed")
        out = part if out is None else out.unionAll(part)
    return out


def prediction_issues(p: DataFrame, truth: DataFrame, key: list[str], model: str, forecast: str, actual: str) -> DataFrame:
    """issue, n: forecasts that repeat an identity, lack a truth, disagree with it, are not finite, or are missing for one."""
    pk = p.groupBy(*key, model).agg(F.count(F.lit(1)).alias("_c"), F.first(actual).alias(actual), F.first(forecast).alias(forecast))
    models = p.select(model).distinct()
    need = truth.select(*key, F.col(actual).alias("_y"), F.lit(True).alias("_has")).join(models, F.lit(True))  # models are few
    j = need.join(pk, [*key, model], "full_outer")
    rules = S.codes(
        (F.col("_c") > 1, "REPEATED"),
        (F.col("_has").isNull(), "NO_TRUTH"),
        (F.col("_has") & F.col("_c").isNotNull() & ~F.col("_y").eqNullSafe(F.col(actual)), "TRUTH_DIFFERS"),
        (F.col("_c").isNotNull() & S.finite(F.col(forecast)).isNull(), "NOT_FINITE"),
        (F.col("_c").isNull(), "MISSING"),
    )
    return j.select(F.explode(rules).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def quantile_issues(p: DataFrame, quantiles: list[str], expected: str) -> Column:
    """Codes of a quantile forecast: all finite, positive, strictly rising, the expected value being the middle one."""
    q = [F.col(c) for c in quantiles]
    bad = [S.finite(c).isNull() for c in q]
    missing = bad[0]
    for b in bad[1:]:
        missing = missing | b
    falls = q[0] >= q[1]
    for a, b in zip(q[1:], q[2:]):
        falls = falls | (a >= b)
    return S.codes((missing, "NOT_FINITE"), (q[0] <= 0, "NOT_POSITIVE"), (falls, "NOT_RISING"), (~F.col(expected).eqNullSafe(q[len(q) // 2]), "EXPECTED_IS_NOT_MEDIAN"))


def oof_issues(rows: DataFrame, key: list[str], trained_to: str, date: str, position: str, role: str, fold: str) -> DataFrame:
    """code, n of out-of-fold rows: trained on their own day or later, identities twice, bad positions, folds that do not fit the role."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    rules = S.codes(
        (F.col(trained_to) >= F.col(date), "TRAINED_TOO_LATE"),
        (n > 1, "REPEATED"),
        (F.col(position).isNull() | (F.col(position) < 0) | (F.col(position) != F.floor(position)), "POSITION"),
        ((F.col(role) == "OUTER") != (F.col(fold) == -1), "FOLD_ROLE"),
    )
    return rows.withColumn("_codes", rules).select(F.explode("_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def gap_counts(rows: DataFrame, by: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """by, periods, gaps, overlaps: periods that do not begin on the day after the last one's end."""
    before = F.lag(end).over(Window.partitionBy(*by).orderBy(*order))
    r = rows.withColumn("_d", F.datediff(start, before))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.col("_d") > 1).alias("gaps"), F.count_if(F.col("_d") < 1).alias("overlaps"))
