import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from tidemark.llm import bpe, textkit

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(5)
    chars = list("ab 's't re ll  \n\t,.!9e'm'd'veS") + ["é", "漢", "\U0001f600", " ", "　", "٣", "\x00"]
    out = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    out += ["", None, "hello world, hello again", "a" * 3000, "xyz" * 700 + " tail", "The quick brown fox. " * 400, "  \n\n  ", "don't we'll they've"]
    return out


def test_pretokens_match_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    docs = [t or "" for t in texts()]
    raw, offsets = textkit.columns_bytes(pa.array(docs))
    s, e, per = textkit.pretokens(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(s, e)] == [m for d in docs for m in pattern.findall(d)]
    assert list(per) == [len(pattern.findall(d)) for d in docs]


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_ids_and_bytes(spark, reference, hot):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode(docs, RANKS, hot_words=hot, long_word=64).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded)) for r in got) == want
    d = bpe.digests(docs, RANKS, hot_words=hot).filter("doc_id = 3").collect()
    assert len(d) == 3 and all(r.n_tokens >= 1 for r in d)
    assert hashlib.sha256(b"twice").hexdigest() in {r.decoded_sha256 for r in d}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, RANKS).collect() == []


def test_fold_of_words_up_to_the_longest(spark):
    rng, ranks = random.Random(3), bpe.load_ranks(RANKS)
    words = [bytes(rng.choice(b"ab \xc3\xa9the") for _ in range(n)) for n in (1, 2, 3, 9, 40, 256, bpe.LONGEST)]
    df = spark.createDataFrame([([w.decode("latin-1") for w in words],)], "w array<string>")
    enc = bpe.encode_words(df, "w", "enc", ranks).first().enc
    assert [list(e) for e in enc] == [bpe.heap_encode(w, ranks) for w in words]


def test_merge_table_holds_every_pair_and_no_other():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(11)
    ids, shift, owner, merged = bpe.merge_table(ranks)
    piece = {v: k for k, v in ranks.items()}
    join = lambda a, b: merged[shift[a] + b] if owner[shift[a] + b] == a else None
    assert ids == [ranks[bytes([k])] for k in range(256)]
    assert all(join(ranks[p[:k]], ranks[p[k:]]) == r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks)
    pairs = [(rng.randrange(len(ranks)), rng.randrange(len(ranks))) for _ in range(100_000)]
    assert all(join(a, b) == ranks.get(piece[a] + piece[b]) for a, b in pairs)


def test_plans_hold_no_ranks(spark):
    """The driver keeps plans; literals of ranks in them were megabytes."""
    df = spark.createDataFrame([(["ab", "the"],), ([],), (None,)], "w array<string>")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    try:
        ranks = bpe.load_ranks(RANKS)
        out = bpe.decode_words(bpe.encode_words(df, "w", "enc", ranks), "enc", "dec", ranks)
        assert len(out._jdf.queryExecution().toString()) < 100_000
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
    assert out.columns == ["w", "enc", "dec"]
    assert [r.dec for r in out.collect()] == [["ab", "the"], [], None]


def test_repeated_words_of_many_batches(spark, reference):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}q{k % 7}" for k in range(900))) for i in range(3)], "doc_id long, text string")
    want = [reference.encode_ordinary(r.text) for r in docs.orderBy("doc_id").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert [list(r.ids) for r in bpe.encode(docs, RANKS).orderBy("doc_id").collect()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
