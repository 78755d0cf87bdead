import hashlib
import random
import re
import zlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, jaccard, mixing


def make(spark, path):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(90)]
    docs, labels, texts = [], [], []
    for i in range(260):
        if texts and rng.random() < 0.3:
            w = rng.choice(texts).split(" ")
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edited"
            text = (" " if rng.random() < 0.5 else "  ").join(w)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([12, 60, 120]))]
            if bad := rng.random() < 0.2:
                w[rng.randrange(len(w))] = w[0] = rng.choice(["nasty", "vile"])
            text = " ".join(w)
        texts.append(text)
        docs.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        labels.append((i, 1, int(bool(re.search("nasty|vile", text)))))
    docs += [(300, None, "en", "a", 0), (301, "", "en", "b", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()} if name != "byte_bpe" else out.collect()
        out = stage(spark, out, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = out.collect()
        kept[name] = rows
        if name != "byte_bpe":
            assert out.columns == docs.columns
            assert all(before[r.doc_id] == r for r in rows)
        if name == "toxicity":
            gone = set(before) - {r.doc_id for r in rows}
            bad = {d for d, r in before.items() if re.search("nasty|vile", r.text or "")}
            assert len(gone & bad) > 0.8 * len(bad) and len(gone - bad) <= 0.05 * len(before)
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d].text or ""), d)
            assert sorted(r.doc_id for r in rows) == sorted(first.values())
        elif name == "ngram_jaccard":
            ids, s = sorted(before), {d: shingles(before[d].text) for d in before}
            up = {d: d for d in ids}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for i, a in enumerate(ids):
                for b in ids[:i]:
                    if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and find(a) != find(b):
                        up[max(find(a), find(b))] = min(find(a), find(b))
            assert sorted(r.doc_id for r in rows) == sorted({find(d) for d in ids})
        elif name == "source_mix":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sources = sorted({r.source for r in before.values()}, key=lambda x: (x is None, x or ""))
            totals = {x: sum(size(r.text) for r in before.values() if r.source == x) for x in sources}
            weight = {x: 1 + k % 3 for k, x in enumerate(sources)}
            target, open_, left = {}, set(sources), sum(totals.values())
            while True:
                rate = left / sum(weight[x] for x in open_)
                over = {x for x in open_ if weight[x] * rate > 3 * totals[x]}
                if not over:
                    break
                for x in over:
                    target[x] = 3 * totals[x]
                    left -= 3 * totals[x]
                open_ -= over
            target |= {x: weight[x] * rate for x in open_}
            for x in sources:
                taken = sum(size(r.text) for r in rows if r.source == x)
                assert abs(taken - target[x]) <= 120
            assert max((sum(r.doc_id == d for r in rows) for d in before), default=0) <= 3
        else:
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            want = sorted((r.doc_id, len(enc.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before)
            assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in rows) == want
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept["byte_bpe"]))


def test_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert mixing.mix(docs).collect() == []
    odd = spark.createDataFrame([(None, None, "x", None, 1), (None, "a", "x", None, 1), (2, "a", "x", "s", 1), (2, "a", "x", "s", 1)], "doc_id long, text string, keep_id string, source string, size int").selectExpr("*", "1 as digest", "2 as target", "3 as h", "4 as passes", "5 as comp", "6 as sid", "7 as a")
    got = exact_dedup.exact_dedup(odd).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("2", "2", 3, False), ("2", "2", 3, True), ("None", "2", 3, False), ("None", "None", 1, True)]
    assert exact_dedup.kept_rows(odd).count() == 2 and exact_dedup.kept_rows(odd).columns == odd.columns
    mix = mixing.mix(odd).collect()
    assert {r.size for r in mix} == {0, 1} and all(r.taken <= 3 * r.size for r in mix)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert jaccard.first_of_groups(odd).columns == odd.columns
    assert zlib.crc32(b"") == 0
