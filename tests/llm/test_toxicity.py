import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import textkit, toxicity


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(5, dtype=np.uint64), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors = rng.standard_normal((7, 16))
    index = rng.integers(0, 7, (6, 4))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 5])).astype(float)
    target = rng.standard_normal(4)

    def loss():
        return float(net.forward(vectors, index, mask)[0] @ target)

    _, state = net.forward(vectors, index, mask, keep=True)
    g, dv = net.backward(target, vectors, index, mask, state)
    for name, grad in [*g.items(), ("vectors", dv)]:
        p = vectors if name == "vectors" else net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5, name


def test_windows_cover_all_tokens():
    per = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    doc, begin, n = toxicity.window_index(per)
    first = np.cumsum(per) - per
    for d, k in enumerate(per):
        seen = set()
        for b, m in zip(begin[doc == d] - first[d], n[doc == d]):
            assert b >= 0 and b + m <= k
            seen |= set(range(b, b + m))
        assert seen == set(range(k))


def corpus(n=700):
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 200]))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["Nasty,", "vile", "gross!"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(None, "word1 word2"), (9000, None), (9001, ""), (9002, "!!! ..."), (5, rows[5][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(r.held_out == toxicity.held_out(r.doc_id) for r in got)
    wide = docs.withColumnRenamed("doc_id", "doc_id").selectExpr("doc_id", "text", "1 as score", "'x' as windows")
    kept = toxicity.clean_rows(wide, marks)
    assert kept.columns == wide.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0)]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_tokens():
    raw, offsets = textkit.columns_bytes(pa.array(["Ab, c-é 9", "", "x"]))
    raw, s, e, per = toxicity.tokens(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(s, e)] == ["ab", "c", "é", "9", "x"] and list(per) == [4, 0, 1]


def _plain_score(scorer, text):
    """One text's score, token by token in plain Python loops."""
    import math
    import re

    net, words = scorer.net, [w.encode() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return scorer.share
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def vector(word):
        raw = np.frombuffer(word, np.uint8)
        place = net.places(textkit.span_hash(raw, np.array([0]), np.array([len(raw)])))[0]
        padded = [1, *raw.tolist(), 2]
        tri = [int(textkit.mix64(np.array([padded[i] * 65536 + padded[i + 1] * 256 + padded[i + 2]], np.uint64))[0]) % toxicity.TRIGRAMS for i in range(len(raw))]
        return [*net.p["word"][place].tolist(), *np.mean([net.p["tri"][t] for t in tri], axis=0).tolist()]

    def gru(xs, side):
        w, u, bias, size = net.p["W" + side], net.p["U" + side], net.p["b" + side], toxicity.HIDDEN
        h, out = [0.0] * size, []
        for x in xs:
            a = [sum(x[i] * float(w[i, j]) for i in range(len(x))) + float(bias[j]) for j in range(3 * size)]
            b = [sum(h[i] * float(u[i, j]) for i in range(size)) for j in range(3 * size)]
            r = [sigmoid(a[j] + b[j]) for j in range(size)]
            z = [sigmoid(a[size + j] + b[size + j]) for j in range(size)]
            n = [math.tanh(a[2 * size + j] + r[j] * b[2 * size + j]) for j in range(size)]
            h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(size)]
            out.append(h)
        return out

    starts = [0] if len(words) <= 32 else [*range(0, len(words) - 32, 16), len(words) - 32]
    logits = []
    for s in starts:
        xs = [vector(w) for w in words[s : s + 32]]
        states = [f + b for f, b in zip(gru(xs, "f"), gru(xs[::-1], "b")[::-1])]
        e = [float(np.tanh(np.array(h) @ net.p["A"] + net.p["a"]) @ net.p["v"]) for h in states]
        weight = [math.exp(x - max(e)) for x in e]
        pooled = sum(np.array(h) * (x / sum(weight)) for h, x in zip(states, weight))
        logits.append(float(pooled @ net.p["w"] + net.p["o"][0]))
    top, count, one = scorer.coef
    return sigmoid(top * max(logits) + count * math.log(len(logits)) + one)


def test_scores_match_plain_loops(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scorer = toxicity.fit_on_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), least_passes=4000)
    texts = {i: t for i, t in rows[::20]} | {-1: "One éÉ nasty, word1", -2: "vile " * 45, -3: "?", -4: "x" * 500 + " gross"}
    some = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.window_scores(some, scorer).collect():
        assert abs(r.score - _plain_score(scorer, texts[r.doc_id])) < 1e-4, r.doc_id


def test_sample_bounds_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, "a" * 100) for i in range(400)] + [(7, "b"), (7, "a")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, toxic int")
    got = toxicity.sample_of(docs, labels, 50, 2000).collect()
    assert 18 <= len(got) <= 20 and len({r.doc_id for r in got}) == len(got)
    assert len(toxicity.sample_of(docs, labels, 50, 1 << 20).collect()) == 50


def test_one_very_long_text_does_not_empty_the_sample(spark):
    texts = [(i, "word " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    small = {r.doc_id for r in toxicity.sample_of(spark.createDataFrame(texts, "doc_id long, text string"), labels, 100, 10_000).collect()}
    assert len(small) > 30
    for long in sorted(small)[:3]:
        docs = spark.createDataFrame([(i, t * 1000 if i == long else t) for i, t in texts], "doc_id long, text string")
        assert {r.doc_id for r in toxicity.sample_of(docs, labels, 100, 10_000).collect()} == small - {long}
    with pytest.raises(ValueError, match="no labelled text fits"):
        toxicity.sample_of(docs, labels, 100, 10)
