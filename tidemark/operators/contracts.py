"""Checks of columns and identities before rows are used: they fail early or name the violation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


class ContractError(ValueError):
    """A frame does not keep its contract."""


def feature_names(columns: list[str], prefixes: list[str], listed: list[str], forbidden: list[str]) -> list[str]:
    """Columns with an allowed prefix, then listed ones, each once; a forbidden one among them is an error."""
    out = [c for c in columns if any(c.startswith(p) for p in prefixes)]
    out += [c for c in listed if c not in out]
    if missing := [c for c in out if c not in columns]:
        raise ContractError(f"missing features: {missing}")
    if bad := sorted(set(out) & set(forbidden)):
        raise ContractError(f"forbidden features: {bad}")
    return out


def feature_violations(registry: DataFrame, requested: DataFrame, use: str) -> DataFrame:
    """(feature, code) for requested features that a registry (feature, fit_allowed, predict_allowed,
    evaluation_only, look_ahead, revised) does not let be used for `use` (fit or predict)."""
    j = requested.select("feature").join(registry.withColumn("_known", F.lit(True)), "feature", "left")
    rules = S.codes(
        (F.col("_known").isNull(), "UNREGISTERED"),
        (~F.col(f"{use}_allowed"), f"NOT_FOR_{use.upper()}"),
        (F.col("evaluation_only"), "EVALUATION_ONLY"),
        (F.col("look_ahead"), "LOOK_AHEAD"),
        (F.col("revised"), "REVISED_DATA"),
    )
    return j.select("feature", F.explode(rules).alias("code"))


def canonical(df: DataFrame, identity: list[str], features: list[str], width: int) -> DataFrame:
    """identity and features in this order, rows with a null identity left out; another width is an error."""
    if len(identity) + len(features) != width:
        raise ContractError(f"expected {width} columns, got {len(identity) + len(features)}")
    return df.select(*identity, *features).dropna(subset=identity)


def with_identity(df: DataFrame, literals: dict, key: list[str]) -> DataFrame:
    """df with literal identity columns and unique_identity: is the row the only one with its key and literals?"""
    out = df.withColumns({k: F.lit(v) for k, v in literals.items()})
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return out.withColumn("unique_identity", n == 1)


def compatible(eps: DataFrame, pe: DataFrame, key: str, same: list[str]) -> DataFrame:
    """key, errors (codes in order), ready, price: can an earnings forecast and a multiple be combined?

    eps has eps, valid, ttm and gaap; pe has pe; all of `same` must agree."""
    l, r = eps.alias("l"), pe.select(key, "pe", *[F.col(c).alias(f"_{c}") for c in same])
    j = l.join(r, key)
    rules = [(S.finite(F.col("eps")).isNull() | ~F.col("valid"), "INVALID_EPS")]
    rules += [(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"MISMATCH_{c.upper()}") for c in same]
    rules += [(~F.col("ttm"), "NOT_ANNUAL"), (~F.col("gaap"), "WRONG_DEFINITION"), (F.col("eps") <= 0, "NONPOSITIVE_EPS"), (S.positive(F.col("pe")).isNull(), "INVALID_MULTIPLE")]
    j = j.select(key, S.codes(*rules).alias("errors"), (F.col("eps") * F.col("pe")).alias("price"))
    ready = F.size("errors") == 0
    return j.select(key, "errors", ready.alias("ready"), F.when(ready, F.col("price")).alias("price"))


def matched_once(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """left with columns of right, many to one, and match: ONE, NONE or MANY (columns are null but for ONE)."""
    per = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    j = left.join(per, key, "left")
    match = F.when(F.col("_n").isNull(), "NONE").when(F.col("_n") > 1, "MANY").otherwise("ONE")
    return j.select(*left.columns, *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in columns], match.alias("match"))


def require(violations: DataFrame, what: str) -> None:
    """Raise with one example if there are any violations."""
    if row := violations.first():
        raise ContractError(f"{what}: {row.asDict()}")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do both frames hold the same rows, repeats counted, in any order?"""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def appended(df: DataFrame, columns: dict) -> DataFrame:
    """df with further columns behind its own, which stay as they are; taking one of their names is an error."""
    if taken := set(columns) & set(df.columns):
        raise ContractError(f"columns of the input would change: {sorted(taken)}")
    return df.select(*df.columns, *[v.alias(k) for k, v in columns.items()])
