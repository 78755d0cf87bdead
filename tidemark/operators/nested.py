"""Nested out-of-fold forecasts: every (outer fold, inner fold, learner) as a row of a task table.

Fits come from sums of products by day. A row counts for a fold if its session is in the
training window and its label was available by the window's end; with e the later of
session and availability, the sums of a window from S to E are

    sums with e <= E   less   sums with session < S   plus   sums with session < S and e > E,

so running sums over the calendar give all folds at once, and only pairs of days further apart
than the shortest window meet the windows. Rows are read once for the fits, however many folds
there are. What is summed also holds a count and an order-free hash of the rows, so that each fit
has a key of its data, window, learner and options; fits that are in the cache are not made again.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.learners import ridge_of, unpacked
from tidemark.sources.scratch import written

_FITS = "fit_key string, n bigint, coef array<double>"


@dataclass(frozen=True)
class Learner:
    """A fit from the matrix of sums of products of (1, features, y): solve(matrix, **options) gives (intercept, coefficients)."""

    features: tuple[str, ...]
    solve: Callable[..., np.ndarray] = ridge_of
    options: dict = field(default_factory=lambda: {"penalty": 1.0})

    def described(self) -> str:
        return json.dumps([self.solve.__module__, self.solve.__name__, list(self.features), self.options], sort_keys=True)


def task_table(outer: DataFrame, inner: DataFrame, learners: dict[str, Learner]) -> DataFrame:
    """outer_id, inner (0: the outer test), learner, train_start, train_end, test_start, test_end, seen_by (the last day that an inner test's labels may need)."""
    o = outer.select(F.col("fold_id").alias("outer_id"), F.lit(0).alias("inner"), "train_start", "train_end", "test_start", "test_end", F.lit(None).cast("date").alias("seen_by"))
    i = inner.join(outer.select(F.col("fold_id").alias("outer_id"), "train_start", F.col("train_end").alias("seen_by")), "outer_id")
    both = o.unionByName(i.select("outer_id", F.col("inner").cast("int").alias("inner"), "train_start", "train_end", "test_start", "test_end", F.col("seen_by").cast("date").alias("seen_by")))
    return both.withColumn("learner", F.explode(F.array(*[F.lit(n) for n in sorted(learners)])))


def window_sums(rows: DataFrame, windows: DataFrame, session: str, available: str, features: list[str], y: str) -> DataFrame:
    """train_start, train_end, n, lo, hi (hash sums), m (sums of products, upper triangle by rows): one row a window."""
    v = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    ok = rows.dropna(subset=[session, available, y, *features])
    h = F.xxhash64(session, available, *features, y)
    products = [a * b for a, b in itertools.combinations_with_replacement(v, 2)]
    sums = {"n": F.count(F.lit(1)), "lo": F.sum((h.bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(38,0)")), "hi": F.sum(F.shiftrightunsigned(h, 32).cast("decimal(38,0)"))}
    sums |= {f"m{i}": F.sum(p) for i, p in enumerate(products)}
    pairs = written(ok.groupBy(F.col(session).alias("s"), F.greatest(session, available).alias("e")).agg(*[x.alias(k) for k, x in sums.items()]), "pairs")
    days = pairs.select(F.col("s").alias("d")).union(pairs.select(F.col("e").alias("d"))).union(windows.select("train_start")).union(windows.select("train_end")).distinct()
    upto = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row a day of the calendar

    def running(by: str, strict: bool) -> DataFrame:
        per = pairs.groupBy(F.col(by).alias("d")).agg(*[F.sum(k).alias(k) for k in sums])
        all_ = days.join(per, "d", "left")
        cum = lambda k: F.coalesce(F.sum(k).over(upto), F.lit(0)) - (F.coalesce(k, F.lit(0)) if strict else F.lit(0))
        return all_.select("d", *[cum(k).alias(f"{by}_{k}") for k in sums])

    w = windows.select("train_start", "train_end").distinct()
    shortest = w.agg(F.min(F.datediff("train_end", "train_start"))).first()[0] or 0
    late = pairs.filter(F.datediff("e", "s") > shortest).join(w, (F.col("s") < F.col("train_start")) & (F.col("e") > F.col("train_end")))
    late = late.groupBy("train_start", "train_end").agg(*[F.sum(k).alias(f"late_{k}") for k in sums])
    out = w.join(running("e", False), F.col("train_end") == F.col("d")).drop("d").join(running("s", True), F.col("train_start") == F.col("d")).drop("d")
    out = out.join(late, ["train_start", "train_end"], "left")
    value = lambda k: F.col(f"e_{k}") - F.col(f"s_{k}") + F.coalesce(f"late_{k}", F.lit(0))
    return out.select("train_start", "train_end", value("n").cast("long").alias("n"), value("lo").alias("lo"), value("hi").alias("hi"), F.array(*[value(f"m{i}").cast("double") for i in range(len(products))]).alias("m"))


def keyed(tasks: DataFrame, sums: DataFrame, learners: dict[str, Learner]) -> DataFrame:
    """tasks with n, m and fit_key: the digest of data, window, learner and options. Tasks that train alike share a key."""
    options = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(x.described())) for k, x in learners.items()))
    key = F.sha2(F.concat_ws("|", "learner", options[F.col("learner")], "train_start", "train_end", "n", "lo", "hi"), 256)
    return tasks.join(sums, ["train_start", "train_end"]).withColumn("fit_key", key).drop("lo", "hi")


def _stored(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(_FITS).option("recursiveFileLookup", True).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FITS)


def fit_tasks(tasks: DataFrame, learners: dict[str, Learner], features: list[str], cache: str) -> tuple[DataFrame, int]:
    """(fit_key, n, coef by all features; how many fits were made): those that the cache lacks are solved in tasks and appended to it.

    Each run writes a folder of its own, so runs may overlap; of fits with one key any serves."""
    spark = tasks.sparkSession
    missing = tasks.select("fit_key", "learner", "n", "m").dropDuplicates(["fit_key"]).join(_stored(spark, cache), "fit_key", "left_anti")
    place, k = {f: i + 1 for i, f in enumerate(features)}, len(features) + 2

    def run(frames):
        for pdf in frames:
            coef = []
            for name, n, m in zip(pdf["learner"], pdf["n"], pdf["m"]):
                x, out = learners[name], np.zeros(k - 1)
                at = [0, *[place[f] for f in x.features]]
                if n:
                    out[at] = x.solve(unpacked(m, k)[np.ix_([*at, k - 1], [*at, k - 1])], **x.options)
                coef.append(out.tolist() if n else None)
            yield pd.DataFrame({"fit_key": pdf["fit_key"], "n": pdf["n"], "coef": coef}).dropna(subset=["coef"])

    path = f"{cache.rstrip('/')}/fits-{uuid.uuid4().hex}"
    missing = written(missing, "missing")
    made = missing.count()
    if made:
        missing.mapInPandas(run, _FITS).write.parquet(path)
    return _stored(spark, cache).dropDuplicates(["fit_key"]), made


def forecasts(rows: DataFrame, tasks: DataFrame, fits: DataFrame, session: str, available: str, features: list[str]) -> DataFrame:
    """rows with outer_id, inner, learner, train_rows and forecast: once for each task that tests their session.

    An inner test has only rows whose labels the outer training could see. Raises if a task has no fit."""
    ready = written(tasks.select("outer_id", "inner", "learner", "test_start", "test_end", "seen_by", "fit_key").join(fits, "fit_key", "left"), "ready")
    lacking = ready.filter("coef is null").select("outer_id", "inner", "learner").take(5)
    if lacking:
        raise ValueError(f"tasks without a fit: {[tuple(r) for r in lacking]}")
    by_day = ready.withColumn("_day", F.explode(F.sequence("test_start", "test_end"))).drop("test_start", "test_end", "fit_key")
    j = rows.join(by_day, F.col(session) == F.col("_day"))
    # greatest() alone would pass over a missing availability
    j = j.filter(F.col("seen_by").isNull() | (F.col(available).isNotNull() & (F.greatest(session, available) <= F.col("seen_by"))))
    value = sum([F.col("coef")[i + 1] * F.col(f) for i, f in enumerate(features)], F.col("coef")[0])
    return j.withColumn("forecast", value).withColumnRenamed("n", "train_rows").drop("_day", "seen_by", "coef")


def nested_forecasts(rows: DataFrame, outer: DataFrame, inner: DataFrame, learners: dict[str, Learner], session: str, available: str, y: str, cache: str) -> tuple[DataFrame, int]:
    """(forecasts of all tasks, number of fits made); session and available are dates.

    Training rows need all features of all learners; outer and inner come from session_folds and inner_folds."""
    features = sorted({f for x in learners.values() for f in x.features})
    tasks = written(task_table(outer, inner, learners), "plan")
    tasks = written(keyed(tasks, window_sums(rows, tasks, session, available, features, y), learners), "tasks")
    fits, made = fit_tasks(tasks, learners, features, cache)
    return forecasts(rows, tasks, fits, session, available, features), made
