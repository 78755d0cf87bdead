"""Target-distribution importance resampling over hashed n-grams.

Features are all runs of one and two consecutive words, hashed to buckets. A
bucket's gain is the logarithm of its share in the target over its share in the
documents; a document's weight is the mean of its features' gains; Gumbel noise
from a hash of doc_id makes drawing the highest scores a weighted draw without
replacement. Three narrow passes do the work, none of which moves a text:

1. and 2. bucket counts of the documents and of the target: every task adds up
   one histogram of `buckets` numbers, so what is shuffled and what the driver
   gets is tasks x buckets and buckets;
3. weights of the documents, with the gains (buckets numbers) broadcast.

In a task each slice of text interns its n-grams in an open-addressed table: keys
are xxhash64 values, slots are found by linear probing for all occurrences at
once, and a hit is verified on the bytes. A slot stores the bucket and the number
of occurrences, so that crc32 is taken once for each distinct n-gram of a slice,
and the slot ids of the occurrences gather the gains.

Ranks come from counts by score and not from a sort of all documents: scores are
whole numbers within some tens of thousands, whatever the size of the table, so
running sums over the counts give each score's first rank, and row numbers inside
a score the rest (the noise spreads documents: a score holds at most about one in
2,700 of all distinct doc_ids). Only documents that can be drawn are sorted.

Defined results: a null text has no words; documents without features weigh 0;
a null doc_id has the noise of an empty one and comes after all others; rows that
repeat a doc_id are ranked one after the other; texts are read whole, long ones in
pieces between words, with the pair across a cut; an empty target or an empty table
gives counts of 0; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans, textkit
from .storage import bounded_batches, small, written

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 25, 7
#: Primes of xxhash64 (fixed values of the published algorithm).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Bytes after a text that reads of eight bytes may touch.
PAD = 8


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; raw ends with PAD bytes that are in no span."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def xxh64(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of raw[start : start + len] for all spans; raw as for lanes()."""
    view, h = lanes(raw), _P5 + lens.astype(np.uint64)
    at = starts.copy()
    for k in range(3):
        i = np.flatnonzero((lens >= 8 * (k + 1)) & (lens < 32))
        h[i] = _rotated(h[i] ^ _rotated(view[at[i]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[i] += 8
    i = np.flatnonzero((lens & 4) > 0)
    h[i] = _rotated(h[i] ^ (view[at[i]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[i] += 4
    for k in range(3):
        i = np.flatnonzero((lens & 3) > k)
        h[i] = _rotated(h[i] ^ raw[at[i] + k].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lens >= 32):
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lens[i]])
    return h


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + len] and raw[b : b + len] are equal; raw as for lanes()."""
    view, same, k = lanes(raw), np.ones(len(a), bool), 0
    i = np.flatnonzero(a != b)
    while len(i):
        left = np.minimum(lens[i] - 8 * k, 8).astype(np.uint64)
        differ = (view[a[i] + 8 * k] ^ view[b[i] + 8 * k]) << (np.uint64(64) - np.uint64(8) * left)
        same[i[differ != 0]] = False
        i = i[(differ == 0) & (lens[i] > 8 * (k + 1))]
        k += 1
    return same


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


def crc32(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of raw[start : start + len] for all spans."""
    table, c = _crc_table(), np.full(len(starts), 0xFFFFFFFF, np.uint32)
    i, k = np.flatnonzero(lens <= 64), 0
    while len(i := i[lens[i] > k]):
        c[i] = table[(c[i] ^ raw[starts[i] + k]) & np.uint32(255)] ^ (c[i] >> np.uint32(8))
        k += 1
    c ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lens > 64):
        c[i] = zlib.crc32(raw[starts[i] : starts[i] + lens[i]].tobytes())
    return c


class Interned:
    """The n-grams of a slice in an open-addressed table: `slots` has each occurrence's slot, `bucket` and `count` are by slot."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, buckets: int):
        size = 1 << max(4, int(2 * len(starts) - 1).bit_length())
        holder = np.full(size, -1, np.int64)  # the occurrence that took a slot; its hash and bytes are the key
        h, self.slots = xxh64(raw, starts, lens), np.zeros(len(starts), np.int64)
        slot, left = (h & np.uint64(size - 1)).astype(np.int64), np.arange(len(starts))
        while len(left):
            s = slot[left]
            free = holder[s] < 0
            holder[s[free]] = left[free]
            other = holder[s]
            may = np.flatnonzero((h[other] == h[left]) & (lens[other] == lens[left]))
            hit = may[same_spans(raw, starts[other[may]], starts[left[may]], lens[left[may]])]
            self.slots[left[hit]] = s[hit]
            left = np.delete(left, hit)
            slot[left] = (slot[left] + 1) & (size - 1)
        used = np.flatnonzero(holder >= 0)
        self.count, self.bucket = np.bincount(self.slots, minlength=size), np.zeros(size, np.int64)
        self.bucket[used] = crc32(raw, starts[holder[used]], lens[holder[used]]) % buckets


def _start_of_last_term(raw: np.ndarray, low: int, at: int, step: int = 4096) -> int:
    """Where the last term of raw[low:at] begins; `at` if there is none."""
    end = at
    while end > low:
        seen = np.flatnonzero(spans.TERM[raw[max(low, end - step) : end]])
        if len(seen):
            break
        end -= step
    else:
        return at
    end = max(low, end - step) + int(seen[-1])
    while end > low:
        gaps = np.flatnonzero(~spans.TERM[raw[max(low, end - step) : end]])
        if len(gaps):
            return max(low, end - step) + int(gaps[-1]) + 1
        end -= step
    return low


def features(raw: np.ndarray, offsets: np.ndarray):
    """For each slice: (bytes, starts, lens and documents of its n-grams, documents of its words)."""
    pieces, owner = spans.cut_long(raw, offsets)
    for a, b, _, _ in textkit.slices(raw, pieces):
        goes_on = a > 0 and owner[a] == owner[a - 1]
        low = _start_of_last_term(raw, int(offsets[owner[a]]), int(pieces[a])) if goes_on else int(pieces[a])
        cut = pieces[a : b + 1] - low
        cut[0] = 0
        r, begin, end, per = spans.terms(raw[low : pieces[b]], cut)
        doc = np.repeat(owner[a:b], per)
        # words side by side, one space after each
        lens = end - begin
        to = np.cumsum(lens + 1) - lens - 1
        joined = np.full(int(lens.sum()) + len(lens) + PAD, 32, np.uint8)
        joined[spans.span_places(to, lens)] = spans.bytes_at(r, begin, lens)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        skip = int(low < pieces[a])  # the word before the cut is counted where it stands
        yield joined, np.concatenate([to[skip:], to[pair]]), np.concatenate([lens[skip:], lens[pair] + 1 + lens[pair + 1]]), np.concatenate([doc[skip:], doc[pair]]), doc[skip:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket."""
    bounded_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw, starts, lens, _, _ in features(*textkit.columns_bytes(batch.column(0))):
                table = Interned(raw, starts, lens, buckets)
                total += np.bincount(table.bucket, weights=table.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains_of(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket."""
    buckets = len(have)
    ratio = (want + 1).astype(np.float64) * float(have.sum() + buckets) / ((have + 1).astype(np.float64) * float(want.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain)."""
    bounded_batches(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in batches:
            raw, offsets = textkit.columns_bytes(batch.column(1))
            n = len(offsets) - 1
            words, feats, total = (np.zeros(n, np.int64) for _ in range(3))
            for r, starts, lens, doc, word_doc in features(raw, offsets):
                table = Interned(r, starts, lens, len(value.value))
                by_slot = value.value[table.bucket]
                words += np.bincount(word_doc, minlength=n)
                feats += np.bincount(doc, minlength=n)
                np.add.at(total, doc, by_slot[table.slots])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(feats), pa.array(total // np.maximum(feats, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise), from the first 32 bits of sha256(`seed:doc_id`)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn ones, else null).

    Of the N documents of at least least_words words, floor(share * N / 100) are drawn.
    """
    gains = gains_of(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = written(weights(docs, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    may = F.col("n_words") >= least_words
    counts = rows.filter(may).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as there are scores, not documents
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("draw", F.expr(f"({share} * sum(n) over ()) div 100"))
    first = small(written(counts.filter("before < draw").select("score", "before", "draw"), "ranks"))
    drawn = rows.filter(may).join(first, "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    drawn = drawn.withColumn("rank", F.col("before") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = rows.filter(~may).unionByName(rows.filter(may).join(first, "score", "left_anti").select(*rows.columns)).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*names).unionByName(rest.select(*names))


def drawn_rows(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents in their own columns; doc_id tells documents apart."""
    ids = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op13_query(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP13_SQL = f"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT doc_id, {_RUNS} AS f, len(w)::BIGINT AS n_words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
own AS (SELECT doc_id, unnest(f) AS g FROM d),
goal AS (SELECT unnest({_RUNS}) AS g FROM (SELECT {_WORDS} AS w FROM benchmark)),
grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM own UNION SELECT g FROM goal)),
b AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM grams, crc
),
s AS (SELECT bucket, count(*)::BIGINT AS s FROM own JOIN b USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*)::BIGINT AS t FROM goal JOIN b USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM goal) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
w AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*)::DOUBLE)::BIGINT AS weight FROM own JOIN b USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
r AS (
  SELECT doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (25 * n) // 100 THEN place END::BIGINT AS rank FROM o
"""
