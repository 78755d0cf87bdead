import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import lexical, spans

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    bag = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bag), sum(n for _, _, n in bag)
    df = Counter(t for _, b, _ in bag for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bag:
            if not n:
                continue
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(5)
    return sorted(map(tuple, lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()), key=str)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["Alpha", "beta2", "γάμμα", "Ünï", "x", "the", "THE", "中文", "İ", "rare1", "rare2", "-", "\x00", "a'b"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(n)]
    docs += [(1000 + i, "the alpha the x") for i in range(n // 2)] + [(5, "rare1 the"), (None, "rare1 rare2"), (7000, None), (7001, "")]
    rng.shuffle(docs)
    items = [(1, "The the ALPHA"), (2, "rare1 rare2 rare2 nowhere"), (3, None), (4, "..."), (5, "x " * 30 + "中文"), (5, "x"), (6, "γάμμα Ünï a b")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_and_other_k(spark):
    docs, items = corpus(9, 80)
    assert run(spark, docs, items, k=3, item_bytes=20) == brute(docs, items, 3)
    assert run(spark, docs, items, item_rows=2) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(1, 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    docs = [(1, "alpha " * 400_000 + "rare"), (2, "rare alpha"), (3, "z" * 3_000_000 + " rare"), (4, "none")]
    items = [(1, "rare alpha"), (2, "alpha")]
    assert run(spark, docs, items) == brute(docs, items)


def test_cuts_between_terms():
    texts = [b"", b"ab cd-ef gh", b"x" * 40, b"", b"one two", b"a b c d e f g h i j k l"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    new, owner = spans.cut_long(raw, offsets, 4)
    for d, t in enumerate(texts):
        parts = [bytes(raw[a:b]) for a, b, o in zip(new[:-1], new[1:], owner) if o == d]
        assert b"".join(parts) == t and [w for p in parts for w in re.findall(rb"\w+", p)] == re.findall(rb"\w+", t)
    assert sorted(set(owner)) == list(range(len(texts))) and len(new) - 1 > len(texts)


def test_terms_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical.textkit, "span_hash", lambda raw, a, b: np.zeros(len(a), np.uint64))
    v = lexical.Vocabulary([b"ab", b"cd", b"efg"])
    raw = np.frombuffer(b"cd efg ab xy abc", np.uint8)
    a = np.array([0, 3, 7, 10, 13])
    assert list(v.find(raw, a, np.array([2, 6, 9, 12, 16]))) == [1, 2, 0, -1, -1]


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = lexical.op12_query(spark, "/root/testdata/sf0.001")
    rows = con.execute(lexical.OP12_SQL)
    assert [c[0] for c in rows.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())
