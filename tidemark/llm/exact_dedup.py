"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

A frequent-items summary (the Misra-Gries family behind ``approx_top_k``: it
keeps a fixed number of counters, merges across partitions and never misses an
item above rows / counters) proposes frequent digests. An exact count verifies
them, and their winners, at most ``max_heavy`` rows, are broadcast so that the
copies of hot texts are settled on the map side. All other digests take one
ordinary shuffle of (digest, id) rows; the texts themselves never move.

Defined results: a null text is an empty text; texts of any length are digested
whole, row by row; a null doc_id sorts after all
others; of rows that tie on doc_id exactly one stays; an empty table gives an
empty result; further input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Runs of these characters count as one space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest_table(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, digest): one row per document, written once."""
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("rid"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
    )
    return written(out, "digests")


def heavy_winners(rows: DataFrame, counters: int = 8192, max_heavy: int = 4096, least: int = 16) -> DataFrame:
    """Digests of at least `least` rows among the summary's frequent items, with
    their exact group size and winner: never more than max_heavy rows."""
    summary = rows.agg(F.expr(f"approx_top_k(hex(digest), {max_heavy}, {counters})").alias("top"))
    proposed = summary.select(F.explode("top").alias("t")).filter(F.col("t.count") >= least)
    proposed = written(proposed.select(F.unhex("t.item").alias("digest")), "heavy")
    found = rows.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("first")
    )
    found = found.select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    return found.filter(F.col("group_size") >= least)


def _order() -> Column:
    """Smallest doc_id first, null last, ties by row number."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")


def exact_dedup(docs: DataFrame, counters: int = 8192, max_heavy: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, rid."""
    rows = digest_table(docs)
    heavy = written(heavy_winners(rows, counters, max_heavy), "winners")
    hot = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    by = Window.partitionBy("digest")
    cold = rest.withColumn("group_size", F.count(F.lit(1)).over(by)).withColumn("first", F.min(_order()).over(by))
    cold = cold.select("digest", "doc_id", "rid", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    return hot.select(*cold.columns).unionAll(cold).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact deduplication keeps, in their own columns.

    Copies of heavy texts are removed on the map side, before the texts are
    shuffled to meet the ids that stay. Rows that repeat both doc_id and text
    come out once.
    """
    rows = digest_table(docs)
    heavy = written(heavy_winners(rows), "winners").select(F.col("digest").alias("_hd"), F.col("keep_id").alias("_hk"))
    mark = F.unhex(F.sha2(normalised(F.col("text")), 256))
    taken = docs.withColumn("_digest", mark).join(F.broadcast(heavy), F.col("_digest") == F.col("_hd"), "left")
    taken = taken.filter(F.col("_hd").isNull() | F.col("_hk").eqNullSafe(F.col("doc_id"))).drop("_hd", "_hk")
    rest = rows.join(F.broadcast(heavy), F.col("digest") == F.col("_hd"), "left_anti")
    winners = rest.groupBy("digest").agg(F.min(_order()).alias("first")).select(F.col("digest").alias("_wd"), F.col("first.doc_id").alias("_wk"))
    winners = winners.unionAll(heavy.select("_hd", "_hk"))
    out = taken.join(winners.hint("shuffle_hash"), (F.col("_digest") == F.col("_wd")) & F.col("doc_id").eqNullSafe(F.col("_wk")), "left_semi")
    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        out = out.withColumn("_copy", F.row_number().over(Window.partitionBy("_digest", "doc_id").orderBy("doc_id"))).filter("_copy = 1").drop("_copy")
    return out.select(*docs.columns)


def op2_query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, sha256(t) AS text_sha256,
         min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS n
  FROM d
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM g
"""
