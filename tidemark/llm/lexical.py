"""Ranked lexical search: each item's best documents by an integer term-weight score.

A document's score for an item depends only on its occurrences of the items'
terms and on its length factor m. So

1. one narrow pass cuts every text into terms and keeps, of those in the items'
   vocabulary, their numbers (a tf-vector), and the number of all terms,
2. documents with equal tf-vector and m form a class: rows are grouped by a
   64-bit hash and by the vector and m themselves, so equality is verified and
   a hot class is reduced before the shuffle,
3. document frequencies are sums of class sizes, and each class is scored once
   against all items, in numpy over batches of classes; a task keeps the k best
   classes of each item, by score and then by smallest doc_id,
4. the k best classes of an item hold its k best documents (every class among
   them has its smallest doc_id there), so their members, at most k of each
   class, are read by ascending doc_id.

Items are handled in blocks of at most about ITEM_BYTES of text and ITEM_ROWS
rows (one longer item is a block of its own): a block's vocabulary, postings and
weights are what is broadcast and what the driver holds. Rows of the intermediate
results: one a document, one a class, and tasks x items x k.

Defined results: a null text has no terms; documents and items without terms have
no rows; null doc_ids come after all others; rows that repeat a doc_id and a text
are ranked one after the other; every row of the items is an item of its own;
texts are read whole, long ones in pieces between terms; empty tables give an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans, textkit
from .storage import bounded_batches, written

ITEM_BYTES, ITEM_ROWS = 16 << 20, 4096
#: Cells of the score matrix and of a step's contributions, in a task.
CELLS = 1 << 22
LAST = np.iinfo(np.int64).max
_BAG = "doc_id bigint, n bigint, ids array<int>, tfs array<int>"
_BEST = "item int, score bigint, first bigint, cid bigint"


class Vocabulary:
    """Distinct terms found by their 64-bit hash and then by their bytes."""

    def __init__(self, words: list[bytes]):
        lens = np.array([len(w) for w in words], np.int64)
        self.raw = np.frombuffer(b"".join(words), np.uint8)
        self.starts, self.lens = np.cumsum(lens) - lens, lens
        hashes = textkit.span_hash(self.raw, self.starts, self.starts + lens)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(words) else 0

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term of raw, -1 for one that is not in the vocabulary."""
        found = np.full(len(starts), -1, np.int64)
        h, lens = textkit.span_hash(raw, starts, ends), ends - starts
        at = np.searchsorted(self.hashes, h)
        for step in range(self.most):  # more than one step where hashes of two terms are equal
            may = np.flatnonzero((found < 0) & (at + step < len(self.hashes)))
            may = may[self.hashes[at[may] + step] == h[may]]
            term = self.order[at[may] + step]
            fits = self.lens[term] == lens[may]
            may, term = may[fits], term[fits]
            found[may] = np.where(spans.same_bytes(raw, starts[may], self.raw, self.starts[term], lens[may]), term, -1)
        return found


def _item_terms(texts: pa.Array) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """(distinct terms, for each item the numbers of its terms and how often they occur)."""
    raw, offsets = textkit.columns_bytes(texts)
    raw, starts, ends, per = spans.terms(raw, offsets)
    number, items, at, flat = {}, [], 0, raw.tobytes()
    for n in per:
        own = [number.setdefault(flat[a:b], len(number)) for a, b in zip(starts[at : at + n], ends[at : at + n])]
        items.append(np.unique(np.array(own, np.int64), return_counts=True))
        at += n
    return list(number), items


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (all terms), ids and tfs (terms of the vocabulary, ascending, and their occurrences)."""
    bounded_batches(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        width = np.int64(len(value.value.lens) + 1)
        for batch in batches:
            raw, offsets = textkit.columns_bytes(batch.column(1))
            pieces, owner = spans.cut_long(raw, offsets)
            n, keys = np.zeros(len(offsets) - 1, np.int64), []
            for a, b, r, o in textkit.slices(raw, pieces):
                r, starts, ends, per = spans.terms(r, o)
                doc = np.repeat(owner[a:b], per)
                np.add.at(n, owner[a:b], per)
                term = value.value.find(r, starts, ends)
                keys.append((doc * width + term)[term >= 0])
            keys, tfs = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
            cut = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * width).astype(np.int32))
            ids = pa.ListArray.from_arrays(cut, pa.array((keys % width).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids, pa.ListArray.from_arrays(cut, pa.array(tfs.astype(np.int32)))], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BAG)


class Postings:
    """For each term the items that hold it and its weight there, repeats included."""

    def __init__(self, items: list, weights: np.ndarray):
        item = np.repeat(np.arange(len(items)), [len(t) for t, _ in items])
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in items]])
        times = np.concatenate([np.zeros(0, np.int64), *[q for _, q in items]])
        order = np.argsort(term, kind="stable")
        self.n_items, self.item, self.weight = len(items), item[order], (times * weights[term])[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def scores(self, cut: np.ndarray, ids: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Matrix of scores (class, item)."""
        out = np.zeros((len(m), self.n_items), np.int64)
        row = np.repeat(np.arange(len(m)), np.diff(cut))
        value = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[row])
        many = self.start[ids + 1] - self.start[ids]
        upto = np.cumsum(many)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, "right")))
            at = np.repeat(self.start[ids[a:b]] - (upto[a:b] - many[a:b]), many[a:b]) + np.arange(upto[a - 1] if a else 0, upto[b - 1])
            np.add.at(out.reshape(-1), np.repeat(row[a:b], many[a:b]) * self.n_items + self.item[at], np.repeat(value[a:b], many[a:b]) * self.weight[at])
            a = b
        return out


def _k_best(rows: np.ndarray, k: int) -> np.ndarray:
    """Of rows (item, score, first, cid) the k best of each item."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
    begin = np.searchsorted(rows[:, 0], rows[:, 0])
    return rows[np.arange(len(rows)) - begin < k]


def best_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """item, score, first, cid: every item's k best classes of each task."""
    value = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches):
        post = value.value
        best, least = np.zeros((0, 4), np.int64), np.ones(post.n_items, np.int64)
        step = max(1, CELLS // max(1, post.n_items))
        for whole in batches:
            for batch in (whole.slice(a, step) for a in range(0, whole.num_rows, step)):
                cid, m, first = (batch.column(i).fill_null(LAST).to_numpy(zero_copy_only=False) for i in range(3))
                cut = batch.column(3).offsets.to_numpy().astype(np.int64)
                ids, tfs = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (3, 4))
                score = post.scores(cut - cut[0], ids, tfs, m)
                row, item = np.nonzero(score >= least)
                best = _k_best(np.concatenate([best, np.column_stack([item, score[row, item], first[row], cid[row]])]), k)
                full = np.flatnonzero(np.bincount(best[:, 0], minlength=post.n_items) == k)
                least[full] = best[np.searchsorted(best[:, 0], full, "right") - 1, 1]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), *[pa.array(best[:, i]) for i in (1, 2, 3)]], names=["item", "score", "first", "cid"])

    return classes.select("cid", "m", "first", "ids", "tfs").mapInArrow(run, _BEST)


def _search_block(docs: DataFrame, items: pa.Table, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    words, own = _item_terms(items["text"].combine_chunks())
    rows = written(bags(docs, Vocabulary(words)), "bags")
    total = rows.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    if not total.n or not words:
        return None
    # decimals, as 25 * n * N can pass 64 bits
    m = F.expr(f"75L + (25 * cast(n AS decimal(18, 0)) * cast({total.n} AS decimal(18, 0))) div {total.l}L")
    members = rows.filter(F.size("ids") > 0).select("doc_id", m.alias("m"), "ids", "tfs").withColumn("h", F.xxhash64("m", "ids", "tfs"))
    same = ["h", "m", "ids", "tfs"]
    classes = members.groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    df = classes.select(F.explode("ids").alias("t"), "size").groupBy("t").agg(F.sum("size").alias("df")).toArrow()
    weights = np.zeros(len(words), np.int64)
    for t, n in zip(df["t"].to_pylist(), df["df"].to_pylist()):
        weights[t] = math.floor(1000 * math.log((2 * total.n + 2) / (2 * n + 1)))
    best = best_classes(classes, Postings(own, weights), k)
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), "first", "cid")
    best = written(best.withColumn("place", F.row_number().over(by_class)).filter(F.col("place") <= k).drop("place", "first"), "best")
    # at most k classes an item: the classes are found by number, their documents by hash and then by vector and m
    found = written(classes.join(F.broadcast(best.select("cid").distinct()), "cid", "left_semi").select("cid", *same), "winners")
    near = members.join(F.broadcast(found.select("h").distinct()), "h", "left_semi")
    by_id = Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last())
    near = near.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k).drop("place")
    near = found.join(near, same).select("cid", "doc_id")
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(own), dtype=np.int32)), "item_id": items["item_id"]}))
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = near.join(F.broadcast(best), "cid").withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k)
    return out.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES, item_rows: int = ITEM_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0."""
    spark = docs.sparkSession
    items = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("i")), "items")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-total.size // item_bytes), -(-total.n // item_rows))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).orderBy("i").select("item_id", "text").toArrow()
        found = _search_block(docs, block, k)
        out = out if found is None else out.unionByName(found)
    return out


def op12_query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
b AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark),
stats AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * stats.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, stats GROUP BY t, stats.n),
q AS (SELECT item_id, t, count(*)::BIGINT AS q FROM b GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * stats.n) // stats.l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t), stats GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""
