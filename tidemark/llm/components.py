"""Connected components of an edge table, without collecting nodes or edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _meet(rows: DataFrame, per: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """rows joined with the one row that per has for each a. The few nodes in hubs meet
    by broadcast, where their rows are, so that no task gets all edges of a node."""
    if hubs is None:
        return rows.join(per, "a")
    few = F.broadcast(per.join(F.broadcast(hubs), "a", "left_semi"))
    return rows.join(F.broadcast(hubs), "a", "left_anti").join(per, "a").unionByName(rows.join(few, "a"))


def connected_components(edges: DataFrame, rounds: int = 100, hub: int = 1000, most_hubs: int = 5000) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each links neighbours to the smallest one known, so edges never grow in
    number and the rounds needed grow with the logarithm of the longest path.
    Each round's edges are written, which ends the lineage. It ends when every
    edge leads to the root of a star, which is checked on all edges, and raises
    an error if that takes more than `rounds`.

    A node with very many edges counts as a hub: one with at least `hub` of them,
    or so many that no more than `most_hubs` nodes can have them.
    """
    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b")).alias("below"), F.least(F.min("b"), F.col("a")).alias("m"))
        degree = written(degree, "degrees")
        # in stars a node has one smaller neighbour, or only larger ones
        state = degree.agg(F.max(F.when(F.col("below") > 0, F.col("n"))).alias("worst"), F.sum("n").alias("ends")).first()
        if (state.worst or 1) == 1:
            found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return found.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        least = degree.select("a", "m")
        top = degree.filter(F.col("n") >= max(hub, -(-state.ends // most_hubs))).select("a")
        hubs = top if top.limit(1).count() else None
        # large star: larger neighbours go to the smallest of the neighbourhood
        large = _meet(both.filter("b > a"), least, hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, low, hubs).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        e = written(small.filter("a != b").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
