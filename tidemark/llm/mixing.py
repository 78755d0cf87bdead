"""Mixing sources to target weights by hash-threshold histograms, in DataFrame
functions only.

Each source's budget is a number of whole passes over its documents and a
remainder. The remainder is the set of documents whose hash lies at or below a
threshold: sizes are summed by source and hash bucket, the bucket in which the
running sum crosses the remainder is found, and only the documents of that
bucket go on to the next, finer histogram. After the last level the threshold
is exact, and one filter takes the documents; nothing is sorted.

Sources are names of collections, some thousand at most: a row for each of them
goes through windows over all sources in one task. A source may hold any share of
the documents, as these are summed by bucket first.

Defined results: a null text has size 0; texts of any length are counted whole; the null source comes last; sources
without any words get target 0; equal rows share a hash and are taken together;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: Hash bits per level: 4 levels of 12 bits order 48 bits of the hash.
LEVELS, BITS = 4, 12


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources share the total by weight; none gets more than `most` times its size
    and what is cut off is shared again by weight. With the sources ordered by
    size / weight the capped ones come first, so running sums give the rate at
    which the others are filled.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    ratio = F.col("cap").cast("double") / F.col("weight")
    before = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    w = w.withColumn("ratio", ratio)
    w = w.withColumns(
        {
            "cut": F.sum("cap").over(before),
            "cut_w": F.sum("weight").over(before),
            "total": F.sum("source_size").over(whole),
            "total_w": F.sum("weight").over(whole),
        }
    )
    # rates only fall after the first source that is not capped, whose rate is the one that holds;
    # sources up to a ratio are capped while their cap is below the rate that the ones before it leave
    w = w.withColumn("prev_cut", F.col("cut") - F.sum("cap").over(Window.partitionBy("ratio")))
    w = w.withColumn("prev_w", F.col("cut_w") - F.sum("weight").over(Window.partitionBy("ratio")))
    rate_here = (F.col("total") - F.col("prev_cut")).cast("double") / (F.col("total_w") - F.col("prev_w"))
    w = w.withColumn("rate_here", rate_here).withColumn("capped", F.col("ratio") <= F.col("rate_here"))
    w = w.withColumn("rate", F.max(F.when(~F.col("capped"), F.col("rate_here"))).over(whole))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rate"))
    return w.select("source", "source_size", target.alias("target"))


def _hash():
    """48 bits of a hash of id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): h is 48 bits of a hash of id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash().alias("h"))


def plan(rows: DataFrame) -> DataFrame:
    """Per source: source_size, target, passes and threshold (at or below: one more).

    A few columns per source; each level's histogram holds at most
    sources x 2**BITS rows, summed on the map side first.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = targets(sizes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("passes", passes)
    state = state.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    # low: start of the crossing bucket; done: sizes taken below it
    state = written(state.withColumn("low", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long")), "mix")
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        span = width << BITS
        here = small(state.select(F.col("source").alias("s"), "low", "done", "left"))
        inside = rows.join(here, F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + span))
        hist = inside.groupBy("s", "low", "done", "left", ((F.col("h") - F.col("low")) / width).cast("long").alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("s").orderBy("b")
        hist = hist.withColumn("upto", F.col("done") + F.sum("n").over(run))
        # the first bucket whose running sum passes what is left; none if all of it fits
        crossing = hist.filter(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("b", "upto", "n")).alias("x"))
        found = crossing.select(F.col("s").alias("s2"), F.col("x.b").alias("b"), (F.col("x.upto") - F.col("x.n")).alias("below"), F.col("x.n").alias("n"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("s2")), "left")
        if level < LEVELS:
            nxt = joined.withColumn("low", F.when(F.col("b").isNotNull(), F.col("low") + F.col("b") * width).otherwise(F.col("low") + span)).withColumn("done", F.coalesce("below", "done"))
            state = written(nxt.drop("s2", "b", "below", "n"), "mix")
        else:
            near = (F.col("below") + F.col("n") - F.col("left")) < (F.col("left") - F.col("below"))
            top = F.when(F.col("b").isNull(), F.col("low") + span - 1).otherwise(F.col("low") + F.col("b") - F.when(near, 0).otherwise(1))
            state = written(joined.withColumn("threshold", top).select("source", "source_size", "target", "passes", "threshold"), "mix")
    return state


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    rows = written(sized(docs), "sized")
    p = small(plan(rows).withColumnRenamed("source", "s"))
    out = rows.join(p, F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("passes") + (F.col("h") <= F.col("threshold")).cast("long")
    copies = F.when(F.col("passes") >= MOST_TIMES, F.lit(MOST_TIMES).cast("long")).otherwise(copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    p = plan(written(sized(docs), "sized"))
    p = small(p.select(F.col("source").alias("_s"), F.col("passes").alias("_passes"), F.col("threshold").alias("_threshold")))
    out = docs.join(p, F.col("source").cast("string").eqNullSafe(F.col("_s")))
    copies = F.when(F.col("_passes") >= MOST_TIMES, F.lit(MOST_TIMES).cast("long")).otherwise(F.col("_passes") + (_hash() <= F.col("_threshold")).cast("long"))
    out = out.withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def op5_query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("copies")


_TARGETS_SQL = r"""
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w0 AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY (source IS NULL), encode(coalesce(source, ''))) - 1) % 3 + 1)::BIGINT]::BIGINT AS weight, source_size * 3 AS cap FROM s),
w1 AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio FROM w0),
w2 AS (SELECT *, sum(cap) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - sum(cap) OVER (PARTITION BY ratio)::BIGINT AS prev_cut,
         sum(weight) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - sum(weight) OVER (PARTITION BY ratio)::BIGINT AS prev_w,
         sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS total_w FROM w1),
w3 AS (SELECT *, (total - prev_cut)::DOUBLE / (total_w - prev_w)::DOUBLE AS rate_here FROM w2),
w4 AS (SELECT *, max(CASE WHEN ratio > rate_here THEN rate_here END) OVER () AS rate FROM w3),
t AS (SELECT source, source_size, CASE WHEN ratio <= rate_here THEN cap::DOUBLE ELSE weight::DOUBLE * rate END AS target FROM w4),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT *, greatest(0.0::DOUBLE, target - (passes * source_size)::DOUBLE) AS rest FROM p),
hs AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT hs.source, h, n, sum(n) OVER (PARTITION BY hs.source ORDER BY h)::BIGINT AS upto FROM hs),
th AS (SELECT r.source, min(CASE WHEN c.upto > r.rest THEN c.h END) AS hx FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source GROUP BY r.source),
x AS (SELECT r.source, r.source_size, r.target, r.passes,
        CASE WHEN th.hx IS NULL THEN 281474976710655 WHEN (c.upto - r.rest) < (r.rest - (c.upto - c.n)) THEN th.hx ELSE th.hx - 1 END AS threshold
      FROM r JOIN th ON r.source IS NOT DISTINCT FROM th.source LEFT JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.h = th.hx)
"""

MIX_SQL = (
    r"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 12))::BIGINT AS h
  FROM documents
), """
    + _TARGETS_SQL
    + r""" SELECT d.doc_id, d.size, x.source_size, x.target,
  d.size * (CASE WHEN x.passes >= 3 THEN 3 ELSE x.passes + (d.h <= x.threshold)::BIGINT END) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
)
