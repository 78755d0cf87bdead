import math

import numpy as np

from tidemark.llm import ann


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = np.einsum("ij,j->i", m, v)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def data(n=900):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[rng.integers(12)] + 0.4 * rng.standard_normal(8)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(120)]
    return rows + [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7 + [float("nan")]), (5003, [1.0] * 7 + [None]), (5004, [1.0] * 7 + [float("inf")]), (5005, []), (5020, [1.0] * 3)]


def test_recall_and_exact_scores(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, every=10, k=10, leaf_rows=40, sample=400, leaves=20, shard=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 10, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {(q, i): s for q, w in brute(rows, 10, 10**6).items() for i, s in w}
    for q, found in got.items():
        assert all(abs(scores[q, i] - s) < 1e-12 for i, s in found) and len(found) == 10
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    # with every leaf open the search is exact
    full = ann.nearest(df, every=10, k=10, leaf_rows=40, sample=400, leaves=10**6, shard=64)
    exact = {}
    for r in full.orderBy("query_id", "rank").collect():
        exact.setdefault(r.query_id, []).append(r.vec_id)
    assert exact == {q: [i for i, _ in w] for q, w in want.items()}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect()] == [(0, 1, 3, 3.0)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_leaves_are_the_least_that_reach_the_recall():
    x = np.random.default_rng(5).standard_normal((2000, 16))
    forest = [ann.Tree(x, 10, np.random.default_rng(k)) for k in range(3)]
    near = [np.argsort(-(x @ x[i]))[1:11] for i in range(40)]
    leaf = [t.place(x) for t in forest]
    least = ann.leaves_for(forest, [(x[i], x[near[i]]) for i in range(40)], 0.9, 10**6)

    def recall(n):
        return np.mean([any(leaf[t][j] == b for t, b in ann.search(forest, x[i], n)) for i in range(40) for j in near[i]])

    assert recall(least) >= 0.9 > recall(least - 1)
    assert ann.leaves_for(forest, [(x[i], x[near[i]]) for i in range(40)], 0.9, least - 1) is None


def test_recall_holds_without_structure(spark):
    # small leaves stand for a large table: a fixed 112 of them hold a small share of the rows
    x = np.random.default_rng(6).standard_normal((6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, every=20, k=10, leaf_rows=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20].astype(float) @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :10]
    assert len(got) == 300 and sum(len(got[20 * i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * want.size


def test_every_query_gets_all_its_neighbours_over_many_partitions(spark):
    x = np.random.default_rng(9).standard_normal((2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in ann.nearest(df).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    score = x[::20].astype(float) @ x.astype(float).T
    score[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert len(got) == 100 and all([n for n, _ in sorted(g)] == list(range(1, 21)) for g in got.values())
    assert sum(len({v for _, v in got[20 * i]} & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * want.size


def test_an_id_repeated_very_often_leaves_room_for_others(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(7, v)] * 60 + [(100 + i, v) for i in range(30)] + [(0, [1.0, 0.1, 0.0])]
    got = [(r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).filter("query_id = 0").collect()]
    assert sorted(got) == [(1, 7), *[(k + 2, 100 + k) for k in range(19)]]
