import random

import pytest

from tidemark.llm import mixing


def shares(sizes):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: 1 + k % 3 for k, x in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        rate = left / sum(weight[x] for x in open_)
        over = {x for x in open_ if weight[x] * rate > 3 * sizes[x]}
        if not over:
            return target | {x: weight[x] * rate for x in open_}
        for x in over:
            target[x] = 3 * sizes[x]
            left -= 3 * sizes[x]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {x: rng.choice([0, 1, 5, 40, 1000, 5000]) for x in ["b", "a", "Z", "é", "", "zz", "m"][: rng.randint(1, 7)]} | {None: rng.choice([0, 7, 900])}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = shares(sizes)
    assert len(got) == len(sizes) and all(abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source]) for r in got)


def test_taken_is_near_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["a"] * 9 + ["b", "c", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    source = {i: s for i, _, s in rows}
    by = {}
    for r in got:
        s = by.setdefault(source[r.doc_id], [0, r.target])
        s[0] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(t - target) <= 9 for t, target in by.values())
