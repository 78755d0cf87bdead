import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import hmm


def plain_forward(model, s):
    a, ll = model.start * model.emit[:, s[0]], 0.0
    for t in range(len(s)):
        if t:
            a = (a @ model.move) * model.emit[:, s[t]]
        ll += math.log(a.sum())
        a = a / a.sum()
    return ll


def plain_counts(model, s):
    k, n = len(model.start), len(s)
    al, be = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        al[t] = (model.start if t == 0 else al[t - 1] @ model.move) * model.emit[:, s[t]]
        al[t] /= al[t].sum()
    for t in range(n - 2, -1, -1):
        be[t] = model.move @ (model.emit[:, s[t + 1]] * be[t + 1])
        be[t] /= be[t].sum()
    g = al * be
    g /= g.sum(1, keepdims=True)
    move = np.zeros((k, k))
    for t in range(1, n):
        x = al[t - 1][:, None] * model.move * (model.emit[:, s[t]] * be[t])[None]
        move += x / x.sum()
    emit = np.zeros_like(model.emit)
    for t in range(n):
        emit[:, s[t]] += g[t]
    return g[0], move, emit


def test_segments_are_exact():
    rng = np.random.default_rng(3)
    model = hmm.Model.first(3, rng.uniform(1, 50, 20), 5)
    seqs = [rng.integers(0, 20, n).astype(np.uint16) for n in (1, 2, 127, 128, 129, 256, 700, 5)]
    s = hmm.Segments(seqs)
    total, _ = s.forward(model, *s.transfer(model))
    assert np.allclose(total, [plain_forward(model, x) for x in seqs], rtol=1e-10)
    start, move, emit, ll = s.expected(model)
    want = [plain_counts(model, x) for x in seqs]
    assert np.allclose(start, sum(w[0] for w in want), rtol=1e-4)
    assert np.allclose(move, sum(w[1] for w in want), rtol=1e-3)
    assert np.allclose(emit, sum(w[2] for w in want), rtol=1e-3, atol=1e-4)
    assert abs(ll - total.sum()) < 1e-5 * abs(ll)


def test_query_against_plain_counts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "Dog", "ran", "é", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id here"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = hmm.train_and_score(docs, states=2, rounds=2).collect()

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    def out(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0

    c = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), out(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_training_raises_the_likelihood(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{'ab'[(k // 4) % 2]}{rng.randint(0, 9)}" for k in range(80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r: sum(x.score for x in hmm.train_and_score(docs, rounds=r).filter("held_out").collect()) for r in (0, 8)}
    assert by[8] > by[0]


def test_held_out_texts_score_above_single_words(spark):
    rng = random.Random(5)
    tongues = [[f"{chr(97 + t)}{i}" for i in range(60)] for t in range(4)]
    rows = [(i, " ".join(rng.choice(tongues[i % 4])[: rng.choice((2, 3))] for _ in range(60))) for i in range(400)]
    got = hmm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score - r.base_score for r in got) / tokens > 0.3  # log10(4) = 0.6 with the four told apart at once


def test_hot_words_and_classes_add_up(spark):
    rows = [(i, " ".join(f"w{j % (i + 2)}" for j in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = hmm.block_table(docs, 5)
    counted = blocks.filter("bucket is not null").select("bucket", "block", "places", "hashes", "counts").groupBy("bucket").applyInArrow(hmm._count_bucket, hmm._COUNTS)
    v = hmm.Vocabulary.of(counted.filter("block is null"), 3)
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    assert v.words == sum(count.values()) + 3 and v.distinct == len(count) + 1
    assert v.class_words.sum() == 0 and v.class_distinct.sum() == 0 and sorted(v.hot_counts[v.hot_counts > 0]) == sorted(count.values())


def test_empty(spark):
    assert hmm.train_and_score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
