import json

import public_tokenizers
import pytest
import tokenizers

from tidemark.llm import token_cache

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \t\n",
    "Hello, world's  best\tday\r\n",
    "Hello, world's best day",
    "a <|endoftext|> <|ENDOFTEXT|>b<|startoftext|>",
    "H̱ ẖ é ΣαΣ İİ",
    "x y z\x1cq\x85r ́a 　 ",
    "12345 ٤٥ \U0001f600\U0001f600 中文",
    "don't we'll I'M 'sts",
    "a" * 3000,
    "word, " * 60_000,
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, n_tokens int")


def test_counts_of_odd_texts(spark, library):
    got = {r.doc_id: r for r in token_cache.token_counts(frame(spark, ODD * 2), PATH).collect()}
    assert len(got) == 2 * len(ODD)
    for i, t in enumerate(ODD * 2):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), library(t), library(t) > 2048)


def test_counts_of_the_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_cache.op11_query(spark, "/root/testdata/sf0.001").collect()} == want


def test_only_what_is_not_stored_is_encoded(spark, tmp_path, monkeypatch, library):
    cache, encoded = f"file://{tmp_path}/cache", []
    plain = token_cache._encode_missing
    monkeypatch.setattr(token_cache, "_encode_missing", lambda d, m, *a: (encoded.append(m.count()), plain(d, m, *a)))
    first = token_cache.token_counts(frame(spark, ["a b", " a  b", "c", None, ""]), PATH, cache).collect()
    assert encoded == [3] and not any(r.cached for r in first)
    second = token_cache.token_counts(frame(spark, ["a\nb", "c", "d", ""]), PATH, cache).collect()
    assert encoded == [3, 1] and [r.cached for r in sorted(second)] == [True, True, False, True]
    token_cache.token_counts(frame(spark, ["d", "c"]), PATH, cache).collect()
    assert encoded == [3, 1]
    # another tokenizer shares nothing with the stored counts
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = tokenizers.Tokenizer.from_file(str(tmp_path / "other.json"))
    got = token_cache.token_counts(frame(spark, ["ABC Def", "c"]), str(tmp_path / "other.json"), cache).collect()
    assert encoded == [3, 1, 2]
    assert [r.n_tokens for r in sorted(got)] == [len(other.encode(t, add_special_tokens=False)) for t in ["ABC Def", "c"]]


def test_a_key_stored_twice_counts_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = frame(spark, ["a b", "c"])
    want = sorted(token_cache.token_counts(docs, PATH, cache).drop("cached").collect())
    version = token_cache.load(spark, PATH).version
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{cache}/version={version}")
    rows.write.parquet(f"{cache}/version={version}/batch=other")
    assert sorted(token_cache.token_counts(docs, PATH, cache).drop("cached").collect()) == want


def test_whole_texts_where_white_space_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["a  b", "a b", " a b", None, "café\n\nx"]
    got = token_cache.token_counts(frame(spark, texts), path).collect()
    assert [r.n_tokens for r in sorted(got)] == [len(model.encode(t or "")) for t in texts]
    assert token_cache.load(spark, PATH).chunked and not token_cache.load(spark, public_tokenizers.path("byte_bpe_50k.json")).chunked


def test_a_hot_text_repeated_ids_and_an_empty_table(spark, library):
    rows = [(i % 40, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)] + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_cache.token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == sorted((i or -1, len(t), library(t)) for i, t in rows)
    assert token_cache.token_counts(docs.limit(0), PATH).collect() == []


def test_pieces_end_at_white_space():
    raw = b"ab cd\tefghijkl m " * 7
    got = list(token_cache.pieces(raw, 5))
    assert b"".join(got) == raw.replace(b"\t", b" ") and b" ".join(got).split() == raw.split()
    assert list(token_cache.pieces(b"x" * 50, 5)) == [b"x" * 50]
