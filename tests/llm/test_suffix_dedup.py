import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import suffix_dedup


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((str(d), len(t), int(gone.sum()), int(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out)


def corpus(rng):
    words = ["ab", "é", "xyz", "q", "lorem", "ipsum "]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passages = [text(rng.randint(3, 14)) for _ in range(6)]
    rows = []
    for k in range(90):
        parts = [text(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    near = text(60)
    for k in range(100, 112):
        cut = rng.randrange(len(near))
        rows.append((k, near[:cut] + "#" + near[cut + 1 :]))
    return rows + [(200, "a" * 300), (201, "a" * 39), (202, None), (203, ""), (None, near), (204, "zz" * 90), (204, "zz" * 90)]


def brute_words(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        hit = {j for i in range(len(t) - width + 1) if seen[tuple(t[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((str(d), len(hit), sum(j - 1 not in hit for j in hit)))
    return sorted(out)


def test_passages_of_words(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.repeated_spans(docs, width=40, seed=12, words=7, word_seed=3, digest=True).collect()
    assert sorted((str(r.doc_id), r.n_passage_words, r.n_passages) for r in got) == brute_words(rows, 7)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in got) == [r[:4] for r in brute(rows, 40)]


def test_production_width_over_several_blocks(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    shared = [text(n) for n in (390, 399, 400, 401, 700, 1500)]
    rows = [(k, text(rng.randint(0, 900)) + rng.choice(shared) + text(rng.randint(0, 900))) for k in range(60)]
    rows += [(100, "ab" * 700), (101, text(3000) * 2), (102, rows[0][1] + "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = suffix_dedup.repeated_spans(docs, block_mb=0).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 400)


@pytest.mark.parametrize("width,seed", [(40, 12), (25, 10)])
def test_against_every_window(spark, width, seed):
    rows = corpus(random.Random(width))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.repeated_spans(docs, width=width, seed=seed).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, width)


def test_long_documents_in_pieces():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 5000).astype(np.uint8)
    raw[3000:3600] = raw[100:700]
    unit = suffix_dedup.Unit.bytes(60, 20)
    whole = suffix_dedup.Block(raw, np.array([0, 5000]), unit)
    parts = list(suffix_dedup.pieces(raw, np.array([0, 5000]), unit, most=700))
    assert sum(int(p.n.sum()) for _, p in parts) == int(whole.n.sum()) == 5000 - 60 + 1


def test_empty(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
