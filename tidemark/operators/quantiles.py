"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def exact_quantiles(df: DataFrame, by: list[str], value: str, levels: list[float], accuracy: int = 10_000) -> DataFrame:
    """by, q (array, linear interpolation, as numpy does it by default), n. Nulls are left out.

    A mergeable sketch first brackets each level; one more pass counts what lies
    below each bracket and keeps only the values in it, about 6 / accuracy of a
    group, and only those are sorted. No task holds a group's values.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # a bracket must reach a few ranks beyond its level: wide ones for groups of a few thousand, all values for small ones
    wide, narrow = 0.02, 3.0 / accuracy
    ends = [min(max(p + side * eps, 0.0), 1.0) for p in levels for eps in (narrow, wide) for side in (-1, 1)]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_v", ends, accuracy).alias("_b"), F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def end(i: int, high: int) -> Column:
        edge = F.col("_hi" if high else "_lo")
        at = lambda k: edge if ends[4 * i + k + high] == float(high) else F.col("_b")[4 * i + k + high]
        return F.when(F.col("_n") * narrow >= 6, at(0)).when(F.col("_n") * wide >= 4, at(2)).otherwise(edge)

    low, high = ([end(i, h) for i in range(len(levels))] for h in (0, 1))
    # written once: the two passes that follow do not sketch again, and its size is known, so that few groups are broadcast and large ones stay in many tasks
    sketch = written(sketch.select(*by, "_n", F.array(*low).alias("_l"), F.array(*high).alias("_h")), "quantiles")
    j = rows.join(sketch, by)
    below = j.groupBy(*by).agg(F.array(*[F.count_if(F.col("_v") < F.col("_l")[i]) for i in range(len(levels))]).alias("_c"))
    inside = j.select(*by, "_v", "_n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda i: (F.col("_v") >= F.get("_l", i)) & (F.col("_v") <= F.get("_h", i)))).alias("_i"))
    inside = inside.groupBy(*by, "_i", "_v", "_n").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by, "_i").orderBy("_v"))
    ranked = inside.withColumn("_to", upto).join(below, by).withColumn("_to", F.col("_to") + F.get("_c", F.col("_i")))
    at = (F.col("_n") - 1) * F.get(F.array(*[F.lit(p) for p in levels]), F.col("_i"))
    has = lambda r: (F.col("_to") - F.col("_m") <= r) & (r < F.col("_to"))  # noqa: E731 - rank r, from 0
    f = F.floor(at)
    picked = ranked.groupBy(*by, "_i", "_n").agg(F.max(F.when(has(f), F.col("_v"))).alias("_x"), F.max(F.when(has(F.least(f + 1, F.col("_n") - 1)), F.col("_v"))).alias("_y"))
    q = F.col("_x") + (F.col("_y") - F.col("_x")) * (at - f)
    out = picked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", q.alias("q")))).alias("_q"), F.first("_n").alias("n"))
    return out.select(*by, F.transform("_q", lambda s: s["q"]).alias("q"), "n")


def sorted_at(values: Column, level: float) -> Column:
    """The inverted distribution function of an array's values: the least with a share of at least `level` up to it."""
    a = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(a, F.greatest(F.ceil(F.size(a) * level).cast("int") - 1, F.lit(0)))
