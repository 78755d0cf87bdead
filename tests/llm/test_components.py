import random

import pytest

from tidemark.llm.components import connected_components


def brute(pairs):
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("hub", [3, 1000])
def test_against_union_find(spark, hub):
    rng = random.Random(hub)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + k) for k in range(60)] + [(300 + k, 299) for k in range(9)]
    pairs += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(150, 299), (5, 5)]
    rng.shuffle(pairs)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(3), hub=hub).collect()
    want = brute([p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_rounds_run_out_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)
    assert connected_components(chain.limit(0)).collect() == []
