import random

import pytest

from tidemark.llm import jaccard


def brute(rows):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted((str(d), len(sets[k]), str(least.get(find(k)) if sets[k] else d)) for k, (d, _) in enumerate(rows))


def corpus(rng, n=160):
    vocab = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 80]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(x.upper() if rng.random() < 0.02 else x for x in w)))
            k += 1
    return rows


@pytest.mark.parametrize("most", [8_000_000, 60])
def test_against_all_pairs(spark, most):
    rows = corpus(random.Random(11)) + [(900, ""), (901, None), (902, " \t\n"), (903, "A b"), (904, "a  B"), (905, "é è"), (905, "é è")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_components(docs, most_shingles=most, bucket_entries=500).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x", 1), (5, "a b c d e f", "y", 2), (None, None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string, size int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(docs).collect())
    assert got == [("5", 2, "5"), ("None", 0, "None"), ("None", 2, "5")]
    kept = jaccard.first_of_groups(docs)
    assert kept.columns == docs.columns and kept.count() == 2


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
