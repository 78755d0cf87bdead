"""Orders, samples and choices that come out the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resampling import share
from tidemark.sources.scratch import written


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in a total order, from 1, without sorting in one task.

    Rows are dealt by range and sorted within partitions; counts by partition give
    each its first number. The dealt rows are written, as ranges come from a sample
    and must not change between the two uses."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    # one row a partition
    first = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn(name, within).join(F.broadcast(first), "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the least digest of seed and key: the same ones wherever and however often it runs."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def resampled(rows: DataFrame, by: list[str], order: list[str], weight: Column, draws: int) -> DataFrame:
    """draws rows of each group, with replacement, each in proportion to its weight: the one whose running weight first reaches a drawn share.

    Drawn places are sorted in among the running weights, so that a row takes those that lie
    before its own end and after the one before: one sort of rows + draws a group, no pairs."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = rows.withColumn("_w", weight).filter(F.col("_w") > 0)
    r = r.withColumn("_to", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    drawn = r.groupBy(*by).agg(F.max("_to").alias("_all")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.select(*by, (share(key, F.col("draw")) * F.col("_all")).alias("_to"), "draw")
    here = r.select(*by, "_to", F.struct(*rows.columns).alias("_row"), F.lit(None).cast("int").alias("draw"))
    both = here.unionByName(drawn.withColumn("_row", F.lit(None).cast(here.schema["_row"].dataType)))
    # at equal places the row comes first when read backwards, so the draw still finds it
    back = Window.partitionBy(*by).orderBy(F.desc("_to"), F.col("draw").asc_nulls_first())
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter("draw is not null").select("_row.*", "draw")


def heads(rows: DataFrame, family: str, order: list[Column], per_family: int, families: int) -> DataFrame:
    """The first per_family rows of each family, of the `families` families with the best first row; rank is the family's."""
    r = rows.withColumn("_n", F.row_number().over(Window.partitionBy(family).orderBy(*order))).filter(F.col("_n") <= per_family)
    # one row a family
    lead = r.filter("_n = 1").withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") <= families).select(family, "rank")
    return r.join(F.broadcast(lead), family).withColumnRenamed("_n", "place")


def representatives(scores: DataFrame, by: list[str], gate: Column, order: list[str]) -> DataFrame:
    """by, the first row in order among those without gate codes, else the best failing one; passed and its codes."""
    r = scores.withColumn("codes", gate).withColumn("passed", F.size("codes") == 0)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("passed"), *order))
    return r.withColumn("_n", n).filter("_n = 1").drop("_n")
