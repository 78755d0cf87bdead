"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The trees' splits are fitted on a bounded sample (`sample`, taken by hash of the
id); every row is put into a leaf of every tree. Inner product becomes nearness
by one more coordinate that gives all rows the same length. A query walks all
trees through one priority queue, always opening the branch with the best margin
anywhere in the forest, until it has `leaves` leaves; the rows of these leaves
are ranked by their exact inner products in double precision.

`leaves` is measured, not set: the k nearest of `probes` queries, taken by hash,
are found by comparing them with all rows, and `leaves` is the least number that
finds the share `recall` of them. If that is more than `most_leaves`, the trees
are grown again with larger leaves, so that a query stays in few places however
many rows it must be compared with. The recall holds at every size of table; the
rows opened follow from it, and are a fixed share of a table without structure.

Of rows with equal vectors only the first `k` + 1 by id can be among anybody's k
nearest, so only these are indexed, and equal queries are searched once: a
vector that a third of the rows share costs no more than another one. Leaves
that are still large are cut into shards of at most `shard` rows; each shard
sends its own k nearest.

Defined results: vectors that are null, empty, zero, of another length than most
or hold null or non-finite components take no part, neither as queries nor as
candidates; repeated rows count once, other rows that repeat an id are rows of
their own, but a query finds an id once and never its own; ties go to the smaller id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, small, written


class Tree:
    """Splits as arrays: node i sends x left if x . normal[i] < cut[i]; children below zero are leaves -1 - leaf."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.cuts, self.children, self.leaves = [], [], [], 0
        self._grow(x, np.arange(len(x)), leaf, rng, 0)
        self.normals, self.cuts, self.children = np.array(self.normals).reshape(-1, x.shape[1]), np.array(self.cuts), np.array(self.children).reshape(-1, 2)

    def _grow(self, x, rows, leaf, rng, depth) -> int:
        if len(rows) > leaf and depth < 40:
            a, b = x[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if not normal.any():
                normal = rng.standard_normal(x.shape[1])
            normal /= np.linalg.norm(normal)
            at = x[rows] @ normal
            cut = float(np.median(at))
            left = at < cut
            if 0 < left.sum() < len(rows):
                node = len(self.cuts)
                self.normals.append(normal)
                self.cuts.append(cut)
                self.children.append([0, 0])
                self.children[node] = [self._grow(x, rows[left], leaf, rng, depth + 1), self._grow(x, rows[~left], leaf, rng, depth + 1)]
                return node
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.full(len(x), 0 if len(self.cuts) else -1)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            node = at[open_]
            right = (np.einsum("ij,ij->i", x[open_], self.normals[node]) >= self.cuts[node]).astype(int)
            at[open_] = self.children[node, right]
            open_ = open_[at[open_] >= 0]
        return -1 - at


def search(forest: list[Tree], x: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """The `leaves` leaves (tree, leaf) with the best margins, by one queue over all trees."""
    margins = [t.normals @ x - t.cuts if len(t.cuts) else None for t in forest]
    queue = [(-math.inf, k, 0 if len(t.cuts) else -1) for k, t in enumerate(forest)]
    found = []
    while queue and len(found) < leaves:
        worst, k, node = heapq.heappop(queue)
        if node < 0:
            found.append((k, -1 - node))
            continue
        m, (left, right) = margins[k][node], forest[k].children[node]
        heapq.heappush(queue, (max(worst, m), k, int(left)))
        heapq.heappush(queue, (max(worst, -m), k, int(right)))
    return found


def leaves_for(forest: list[Tree], probes: list[tuple[np.ndarray, np.ndarray]], recall: float, most: int) -> int | None:
    """The least number of leaves that finds the share `recall` of the probes' neighbours; None if it is over `most`.

    A probe: its vector and its neighbours'."""
    needed = [np.zeros(0)]
    for x, near in probes:
        place = [np.full(t.leaves, math.inf) for t in forest]
        for n, (k, leaf) in enumerate(search(forest, x, most)):
            place[k][leaf] = n + 1
        needed.append(np.min([p[t.place(near)] for p, t in zip(place, forest)], axis=0))
    needed = np.sort(np.concatenate(needed))
    least = needed[math.ceil(recall * len(needed)) - 1] if len(needed) else 1
    return int(least) if least < math.inf else None


def usable(vectors: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    return rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0.0))


_ROW = "leaf bigint, id bigint, v binary"


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _truth(queries: DataFrame, index: DataFrame, probes: int, k: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vector, its k nearest) of at most `probes` of the queries, by comparing them with every indexed row."""
    taken = queries.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(probes).toArrow()
    if not taken.num_rows:
        return []
    own, asked = taken["id"].to_numpy(), _matrix(taken["v"].combine_chunks())
    value = queries.sparkSession.sparkContext.broadcast((own, asked))

    def compare(batches):
        own, asked = value.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, asked.shape[1])))] * len(own)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m = batch.column(0).to_numpy(), _matrix(batch.column(1))
            scores = asked @ m.T
            for i, (s, j, v) in enumerate(best):
                near = np.flatnonzero(ids != own[i])
                if len(near) > k:  # ties at the border stay in
                    near = near[scores[i, near] >= np.partition(scores[i, near], len(near) - k)[len(near) - k]]
                s, j, v = np.concatenate([s, scores[i, near]]), np.concatenate([j, ids[near]]), np.concatenate([v, m[near]])
                first = np.lexsort((j, -s))[:k]
                best[i] = (s[first], j[first], v[first])
        for i, (s, j, v) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(j), pa.array(s), pa.array([r.tobytes() for r in v], pa.binary())], names=["q", "id", "score", "v"])

    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = index.mapInArrow(compare, "q bigint, id bigint, score double, v binary").withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).select("q", "v").toArrow()
    q = found["q"].to_numpy()
    near = np.frombuffer(b"".join(found["v"].to_pylist()), np.float64).reshape(len(q), asked.shape[1])
    return [(asked[i], near[q == i]) for i in range(len(asked))]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = 8, leaves: int | None = None, leaf_rows: int = 512, sample: int = 20_000, shard: int = 4096, seed: int = 11, recall: float = 0.95, probes: int = 256, most_leaves: int = 48, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    A number given as leaves is used as it is, and nothing is measured."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    result = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, vec, key)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    dim, total, longest = lengths.d, lengths.n, lengths.top * (1 + 1e-9)
    rows = written(rows.filter(F.size("v") == dim), "vectors")
    # repeated rows would fill the places of other ids with the same vector; ids alone tell whether there are any
    again = rows.groupBy("id").count().filter("count > 1").limit(1).count()
    by = Window.partitionBy("v").orderBy("id")
    index = written((rows.dropDuplicates(["id", "v"]) if again else rows).withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).select("id", "v"), "index")

    share = min(1.0, sample / total)
    picked = index.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample).toArrow()
    if picked.num_rows < 2:
        picked = index.limit(2).toArrow()
    order = np.argsort(picked["id"].to_numpy(), kind="stable")
    x = _matrix(picked["v"].combine_chunks())[order]

    def lifted(m: np.ndarray) -> np.ndarray:
        return np.column_stack([m, np.sqrt(np.maximum(longest - (m * m).sum(1), 0))])

    def grown(size: int) -> list[Tree]:
        rng = np.random.default_rng(seed)
        return [Tree(lifted(x), max(4, math.ceil(size * len(x) / total)), rng) for _ in range(trees)]

    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    distinct = written(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "queries")
    forest = grown(leaf_rows)
    if leaves is None:
        truth = [(np.append(q, 0.0), lifted(near)) for q, near in _truth(distinct, index, probes, k, seed)]
        while (leaves := leaves_for(forest, truth, recall, max(most_leaves, trees))) is None:  # ends at the latest when a tree is one leaf
            leaf_rows *= 2
            forest = grown(leaf_rows)
    value = spark.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            if not len(m):
                continue
            up, ids = lifted(m), batch.column(0)
            raw = pa.array([r.tobytes() for r in m], pa.binary())
            for t, tree in enumerate(value.value):
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 32) + tree.place(up)), ids, raw], names=["leaf", "id", "v"])

    def open_leaves(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            for i, row in zip(batch.column(0).to_pylist(), m):
                found = search(value.value, np.append(row, 0.0), leaves)
                yield pa.RecordBatch.from_arrays([pa.array([(t << 32) + leaf for t, leaf in found], pa.int64()), pa.array([i] * len(found), pa.int64()), pa.array([row.tobytes()] * len(found), pa.binary())], names=["leaf", "id", "v"])

    placed = written(index.mapInArrow(place, _ROW), "leaves")
    asking = distinct.mapInArrow(open_leaves, _ROW)
    # the forest has at most a fixed number of leaves: trees x sample / leaf size
    shards = placed.groupBy("leaf").count().select(F.col("leaf").alias("l"), F.ceil(F.col("count") / shard).cast("int").alias("n")).filter("n > 1")
    shards = small(written(shards, "shards"))
    # s has one type on both sides: cogroup deals by hash, and an int and a long of one value differ in it
    left = placed.join(shards, F.col("leaf") == F.col("l"), "left").withColumn("s", F.pmod(F.xxhash64("id"), F.coalesce("n", F.lit(1))).cast("int"))
    right = asking.join(shards, F.col("leaf") == F.col("l"), "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))

    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids = a["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        m = np.frombuffer(b"".join(a["v"].to_pylist()), np.float64).reshape(len(ids), -1)[order]
        out = []
        for q, v in zip(b["id"].to_pylist(), b["v"].to_pylist()):
            score = np.einsum("ij,j->i", m, np.frombuffer(v, np.float64))
            if len(score) > 4 * k:  # ties at the border stay in
                edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                near = np.flatnonzero(score >= edge)
            else:
                near = np.arange(len(score))
            near = near[np.argsort(-score[near], kind="stable")][: k + 1]
            out.append((np.full(len(near), q), ids[near], score[near]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    scored = left.select("leaf", "s", "id", "v").groupBy("leaf", "s").cogroup(right.select("leaf", "s", "id", "v").groupBy("leaf", "s")).applyInArrow(rank, "q bigint, id bigint, score double")
    scored = scored.groupBy("q", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    top = scored.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    # equal queries share an answer; each leaves itself out
    named = distinct.withColumnRenamed("id", "q").join(asked, "v").select("q", "id").distinct()
    near = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)
    out = named.withColumnRenamed("id", "query_id").join(top, "q").select("query_id", F.posexplode(near).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
