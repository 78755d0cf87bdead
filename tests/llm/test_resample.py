import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from tidemark.llm import resample as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, buckets=10_000, least=20, share=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in feats(t)[1])
    t = Counter(bucket(f) for x in target for f in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        n, f = feats(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, f)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = may[: share * len(may) // 100]
    rest = [r for r in rows if r[1] < least] + may[len(drawn) :]
    return sorted([(r[0], *r[2:], k) for k, r in enumerate(drawn, 1)] + [(r[0], *r[2:], None) for r in rest], key=str)


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, rank int").repartition(5)
    return sorted(map(tuple, op.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), **options).collect()), key=str)


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["Alpha", "beta2", "γάμμα", "Ünï", "x", "the", "THE", "中文", "İ", "r" * 40, "q" * 90, "-", "\x00", "a'b"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(9000 + i, "the alpha " * 12) for i in range(n // 2)] + [(9000, "the alpha " * 12), (None, "x " * 25), (7000, None), (7001, "")]
    rng.shuffle(docs)
    return docs, ["the alpha x", None, "", "γάμμα Ünï the"]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, target = corpus(seed)
    assert run(spark, docs, target) == brute(docs, target)


def test_other_parameters_and_empty_tables(spark):
    docs, target = corpus(5, 60)
    assert run(spark, docs, target, buckets=7, least_words=3, share=60, seed=1) == brute(docs, target, 7, 3, 60, 1)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], target) == []


def test_drawn_rows_in_their_own_columns(spark):
    docs, target = corpus(6, 60)
    d = spark.createDataFrame([(*r, 1) for r in docs if r[0] is not None and r[0] != 9000], "doc_id long, text string, rank int")
    want = {r[0] for r in brute([r for r in docs if r[0] is not None and r[0] != 9000], target) if r[4]}
    got = op.drawn_rows(d, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_long_texts_are_read_in_pieces(spark):
    docs = [(1, "alpha beta " * 200_000 + "end"), (2, "z" * 2_500_000 + " y" * 30), (3, "." * 3_000_000 + "a b"), (4, "a" + "-" * 2_500_000 + "b")]
    assert run(spark, docs, ["alpha end", "a b"]) == brute(docs, ["alpha end", "a b"])


@pytest.mark.parametrize("most", [1, 3, 8, 50])
def test_cuts_keep_pairs(monkeypatch, most):
    rng = random.Random(most)
    texts = ["".join(rng.choices("ab -é", k=rng.randint(0, 40))) for _ in range(60)]
    monkeypatch.setattr(op.spans.cut_long, "__defaults__", (most,))
    monkeypatch.setattr(op.textkit.slices, "__defaults__", (most,))
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    got = [Counter() for _ in texts]
    for r, starts, lens, doc, _ in op.features(raw, np.cumsum([0, *(len(t.encode()) for t in texts)])):
        for a, n, d in zip(starts, lens, doc):
            got[d][bytes(r[a : a + n]).decode()] += 1
    assert got == [Counter(feats(t)[1]) for t in texts]


def test_hashes_of_spans():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    starts, lens = rng.integers(0, 4000, 600), np.concatenate([np.arange(1, 101), rng.integers(1, 40, 500)])
    texts = [raw[a : a + n].tobytes() for a, n in zip(starts, lens)]
    assert op.xxh64(raw, starts, lens).tolist() == [xxhash.xxh64_intdigest(t) for t in texts]
    assert op.crc32(raw, starts, lens).tolist() == [zlib.crc32(t) for t in texts]


def test_keys_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op, "xxh64", lambda raw, starts, lens: np.full(len(starts), 15, np.uint64))
    words = [b"aa", b"b", b"aa", b"cc", b"aab", b"b", b"abcdefghij", b"abcdefghik", b"abcdefghij"]
    raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    lens = np.array([len(w) for w in words])
    table = op.Interned(raw, np.cumsum(lens) - lens, lens, 97)
    assert len(set(table.slots)) == len(set(words))
    for w, s in zip(words, table.slots):
        assert (table.count[s], table.bucket[s]) == (words.count(w), zlib.crc32(w) % 97)


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = op.op13_query(spark, "/root/testdata/sf0.001")
    rows = con.execute(op.OP13_SQL)
    assert [c[0] for c in rows.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())
