"""Resampling of clusters by counters: weights come from a 64-bit hash of (cluster, draw), so every task makes its own.

A cluster is drawn Poisson(1) times in each draw (the large-sample form of drawing as many clusters as
there are, with replacement). No list of draws meets the clusters in a join: a task turns its clusters'
sums into sums by draw, `draws` numbers a group, and those are what is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd constants of the splitmix64 generator (fixed values of the published algorithm).
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Distribution function of Poisson(1) in steps of 2**-64; a weight is the number of steps at or below the hash.
POISSON = [math.floor(sum(1 / math.factorial(j) for j in range(k + 1)) / math.e * 2**64) for k in range(16)]
POISSON = [t for t in POISSON if t < 2**64 - 4096]


def mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
    return z ^ (z >> np.uint64(31))


def counter_hash(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """64-bit hashes by (key, draw): a matrix."""
    step = (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    return mixed(mixed(keys.astype(np.int64).view(np.uint64))[:, None] + step[None, :])


def poisson_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Weights by (key, draw), each Poisson(1) distributed."""
    return np.searchsorted(np.array(POISSON, np.uint64), counter_hash(keys, draws), "right").astype(np.float64)


def hash_sql(key: str, draw: str) -> str:
    """counter_hash as a DuckDB expression, for keys that are not negative."""
    mul = lambda a, b: f"(({a})::UHUGEINT * {b}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    add = lambda a, b: f"((({a})::UHUGEINT + ({b})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"

    def fold(z: str) -> str:
        x = lambda z, k: f"list_transform([{z}], lambda q: xor(q, q >> {k}))[1]"
        return x(mul(x(mul(x(z, 30), MIX1), 27), MIX2), 31)

    return fold(add(fold(f"({key})::UBIGINT"), mul(f"({draw}) + 1", GOLDEN)))


def poisson_sql(hashed: str) -> str:
    return "(" + " + ".join(f"({hashed} >= {t}::UBIGINT)::INT" for t in POISSON) + ")"


def draw_sums(rows: DataFrame, by: list[str], cluster: Column, delta: Column, draws: int, cells: int = 1 << 20) -> DataFrame:
    """by, draw, s, c: each draw's weighted sum and count of the non-null deltas.

    cluster: a whole number is its own key, anything else goes by its 64-bit hash. Clusters are summed
    first, which also brings a cluster's rows together."""
    key = cluster if dict(rows.select(cluster.alias("k")).dtypes)["k"] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(cluster)
    sums = rows.groupBy(*by, key.cast("long").alias("_k")).agg(F.sum(delta.cast("double")).alias("_s"), F.count(delta).cast("double").alias("_c")).filter("_c > 0 and _k is not null")
    types = dict(rows.dtypes)
    names = [*by, "draw", "s", "c"]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "draw int", "s double", "c double"])
    span, arrow = np.arange(draws), _arrow(rows, by)

    def run(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))])) if by else [()] * batch.num_rows
            of = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            at = np.array([of[g] for g in groups], np.int64)
            k, s, c = (batch.column(len(by) + i).to_numpy() for i in range(3))
            for group, i in of.items():
                rows_ = np.flatnonzero(at == i)
                sum_ = totals.setdefault(group, np.zeros((2, draws)))
                for a in range(0, len(rows_), max(1, cells // draws)):
                    r = rows_[a : a + max(1, cells // draws)]
                    sum_ += np.stack([s[r], c[r]]) @ poisson_weights(k[r], span)
        if totals:
            whole = np.concatenate(list(totals.values()), axis=1)
            put = {name: [g[i] for g in totals for _ in range(draws)] for i, name in enumerate(by)}
            yield pa.RecordBatch.from_pydict({**put, "draw": np.tile(span, len(totals)).astype(np.int32), "s": whole[0], "c": whole[1]}, schema=arrow)

    parts = sums.select(*by, "_k", "_s", "_c").mapInArrow(run, schema)
    return parts.groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).select(*names)


def _arrow(rows: DataFrame, by: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(c, to_arrow_type(rows.schema[c].dataType)) for c in by] + [("draw", pa.int32()), ("s", pa.float64()), ("c", pa.float64())])


def cluster_interval(rows: DataFrame, by: list[str], cluster: Column, delta: Column, draws: int = 2000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """by, low, high, draws: percentile interval of the mean delta under resampling of whole clusters; draws without any row do not count."""
    each = draw_sums(rows, by, cluster, delta, draws).filter("c > 0")
    ratio = F.col("s") / F.col("c")
    return each.groupBy(*by).agg(F.percentile(ratio, F.lit(low)).alias("low"), F.percentile(ratio, F.lit(high)).alias("high"), F.count(F.lit(1)).alias("draws"))


def share(key: Column, i: Column) -> Column:
    """A share between 0 and 1 of 48 bits that depends on two counters only."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / 281474976710656.0


def share_sql(key: str, i: str) -> str:
    return f"((('0x' || substr(md5(({key})::VARCHAR || ':' || ({i})::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0)"
