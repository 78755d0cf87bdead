"""A hidden Markov language model, trained on all training documents.

1. One pass cuts texts into blocks of words; each block's distinct words, by
   64-bit hash, go to hash buckets of bounded size with their training counts.
   There every word gets its corpus count c, which goes back to the blocks that
   hold it. No vocabulary is ever in one place: the driver gets the HOT most
   frequent words, found by a distributed top-k, and the sums of the classes.
2. The hidden chain emits symbols: the most frequent words are symbols of their
   own, other words share a class by hash and have a smoothed probability within
   it, the end of a text is a symbol too. Baum-Welch: each partition sums the
   expected starts, transitions and emissions of its documents under the present
   model, the sums are added across partitions by position (states x symbols
   values, a fixed number), and the next model is their normalised form. States
   start out inclined to stay, which lets a state take up a language or a topic.
   Rounds go on until one gains less than `least_gain` a token.
3. Scaled forward recursion gives each text's exact likelihood. Documents are
   cut into segments whose transfer matrices are multiplied, so that long texts
   cost as much a word as short ones and nothing is approximated.

Defined results: a null text has only its end token; a null doc_id hashes as the
empty string (held out); without training documents every count is 0 and the
model stays at its start; repeated rows count as often as they stand there; an
empty table gives an empty result; texts of any length are scored whole; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import bounded_batches, written

ADD = 0.1
HOT, CLASSES = 2048, 1023
END = HOT + CLASSES
SYMBOLS = END + 1
#: Inclination of a state to stay, against moving anywhere, at the start.
STAY = 9.0


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _press(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _open(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


_BLOCKS = "block bigint, ids array<bigint>, lens binary, codes binary, bucket bigint, places binary, hashes binary, counts binary"


def block_table(docs: DataFrame, buckets: int, block_mb: int = 12) -> DataFrame:
    """Rows of two kinds. bucket null: a block's documents (ids, words per document,
    word codes). Else: the block's distinct words in that bucket (their codes, hashes
    and training counts)."""

    def run(batches):
        from pyspark import TaskContext

        base, k = TaskContext.get().partitionId() << 24, 0
        ids, lens, codes, hashes, size = [], [], [], [], 0

        def flush():
            h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            at = np.cumsum([0] + [len(x) for x in hashes])
            code = np.concatenate([inverse[at[i] + c] for i, c in enumerate(codes)])
            per = np.concatenate(lens)
            train = ~np.array([held_out(d) for d in ids], bool)
            n = np.bincount(code, weights=np.repeat(train, per), minlength=len(h)).astype(np.int32)
            # frequent words get small codes, which compress well
            rank = np.argsort(-np.bincount(code, minlength=len(h)), kind="stable")
            new = np.empty(len(h), np.int32)
            new[rank] = np.arange(len(h), dtype=np.int32)
            rows = [(base + k, ids, _press(per.astype(np.int32)), _press(new[code]), None, None, None, None)]
            where = (h >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                pick = order[cut[b] : cut[b + 1]]
                if len(pick):
                    rows.append((base + k, None, None, None, b, _press(new[pick]), h[pick].tobytes(), _press(n[pick])))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _BLOCK_TYPES)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for batch in batches:
            these = batch.column(0).to_pylist()
            raw, offsets = textkit.columns_bytes(batch.column(1))
            for a, b, r, o in textkit.slices(raw, offsets):
                r = textkit.lower_ascii(r)
                s, e, per = textkit.words(r, o)
                h, c = np.unique(textkit.span_hash(r, s, e), return_inverse=True)
                ids += these[a:b]
                lens.append(per)
                codes.append(c.astype(np.int32))
                hashes.append(h)
                size += len(r)
                if size >= block_mb << 20:
                    yield flush()
                    ids, lens, codes, hashes, size, k = [], [], [], [], 0, k + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, _BLOCKS)


_BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_COUNTS = "block bigint, bucket bigint, places binary, counts binary, symbols binary, listed binary, words bigint, distinct bigint, hot_hash array<bigint>, hot_count array<bigint>, class_words array<bigint>, class_distinct array<bigint>"
_COUNT_SCHEMA = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("symbols", pa.binary()), ("listed", pa.binary()), ("words", pa.int64()), ("distinct", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("hot_hash", "hot_count", "class_words", "class_distinct")]
)


def _count_bucket(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's words: a row for each block that holds some of
    them (counts; symbol: class, or -1 for one of the bucket's HOT most frequent
    words, whose hashes are in `listed`) and one row of the bucket's sums (block null)."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table["hashes"]]
    counts = [_open(x.as_py(), np.int32) for x in table["counts"]]
    h, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    c = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    group = (h % np.uint64(CLASSES)).astype(np.int64)
    top = np.lexsort((h, -c))[:HOT]
    top = top[c[top] > 0]
    symbol = group.astype(np.int32)
    symbol[top] = -1
    at = np.cumsum([0] + [len(p) for p in parts])
    rows = []
    for k, (block, places) in enumerate(zip(table["block"].to_pylist(), table["places"].to_pylist())):
        mine = inverse[at[k] : at[k + 1]]
        rows.append((block, bucket, places, _press(c[mine]), _press(symbol[mine]), h[mine][symbol[mine] < 0].tobytes(), None, None, None, None, None, None))
    sums = [np.bincount(group, weights=w, minlength=CLASSES).astype(np.int64).tolist() for w in (c, c > 0)]
    rows.append((None, bucket, None, None, None, None, int(c.sum()), int((c > 0).sum()), h[top].view(np.int64).tolist(), c[top].tolist(), *sums))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _COUNT_SCHEMA.types)], schema=_COUNT_SCHEMA)


class Vocabulary:
    """Corpus statistics of a fixed size: totals, the hot words by hash, sums of the classes without them."""

    def __init__(self, words: int, distinct: int, hot: list, classes: list, train_docs: int):
        self.words = words + train_docs
        self.distinct = distinct + (train_docs > 0)
        self.ends = train_docs
        self.class_words, self.class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for group, n, d in classes:
            self.class_words[group], self.class_distinct[group] = n, d
        hashes = np.array([h for h, _ in hot], np.int64).view(np.uint64)
        counts = np.array([n for _, n in hot], np.int64)
        group = (hashes % np.uint64(CLASSES)).astype(np.int64)
        np.subtract.at(self.class_words, group, counts)
        np.subtract.at(self.class_distinct, group, 1)
        self.hot_counts = np.zeros(HOT)
        self.hot_counts[: len(counts)] = counts
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @classmethod
    def of(cls, sums: DataFrame, train_docs: int) -> "Vocabulary":
        """From the buckets' sums: the hot words by a top-k, all else added up in tasks."""
        total = sums.agg(F.sum("words").alias("w"), F.sum("distinct").alias("d")).first()
        listed = sums.select(F.inline(F.arrays_zip(F.col("hot_hash").alias("h"), F.col("hot_count").alias("n"))))
        hot = listed.orderBy(F.desc("n"), "h").limit(HOT).collect()
        groups = sums.select(F.posexplode(F.arrays_zip(F.col("class_words").alias("n"), F.col("class_distinct").alias("d"))).alias("g", "x"))
        classes = groups.groupBy("g").agg(F.sum("x.n").alias("n"), F.sum("x.d").alias("d")).collect()
        return cls(total.w or 0, total.d or 0, [tuple(r) for r in hot], [tuple(r) for r in classes], train_docs)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words by hash."""
        group = HOT + (hashes % np.uint64(CLASSES)).astype(np.int64)
        if not len(self.hashes):
            return group
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], group)


_ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, within double, symbols binary"
_ENCODED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("symbols", pa.binary())])


def _encode_block(docs: pa.Table, counts: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    """A block's documents with the base score, the probability within classes and their symbols."""
    if not docs.num_rows:
        return _ENCODED_SCHEMA.empty_table()
    ids, per = docs["ids"][0].as_py(), _open(docs["lens"][0].as_py(), np.int32).astype(np.int64)
    codes = _open(docs["codes"][0].as_py(), np.int32)
    n = sum(len(_open(x.as_py(), np.int32)) for x in counts["places"])
    c, sym = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for p, k, s, words in zip(counts["places"], counts["counts"], counts["symbols"], counts["listed"]):
        at, own = _open(p.as_py(), np.int32), _open(s.as_py(), np.int32).astype(np.int64)
        c[at] = _open(k.as_py(), np.int64)
        listed = own < 0
        own[~listed] += HOT
        own[listed] = vocabulary.symbols(np.frombuffer(words.as_py(), np.uint64))
        sym[at] = own
    v = vocabulary
    scale = v.words + ADD * (v.distinct + 1)
    base = np.log10((c + ADD) / scale)
    group = sym - HOT
    within = np.where(group >= 0, np.log10((c + ADD) / (v.class_words[np.maximum(group, 0)] + ADD * (v.class_distinct[np.maximum(group, 0)] + 1))), 0.0)
    cut = np.concatenate([[0], np.cumsum(per)])

    def total(values):
        out = np.zeros(len(per))
        some = per > 0
        out[some] = np.add.reduceat(values[codes], cut[:-1][some])
        return out

    symbols = sym[codes].astype(np.uint16)
    end = np.array([END], np.uint16).tobytes()
    return pa.Table.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([held_out(d) for d in ids]),
            pa.array(per + 1),
            pa.array(total((c > 0).astype(float)).astype(np.int64) + (v.ends > 0)),
            pa.array(total(base) + math.log10((v.ends + ADD) / scale)),
            pa.array(total(within)),
            pa.array([symbols[a:b].tobytes() + end for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
        ],
        schema=_ENCODED_SCHEMA,
    )


SEGMENT = 128


class Model:
    """start (K), move (K, K) and emit (K, SYMBOLS), all rows sum to 1."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, weights: np.ndarray, seed: int):
        """A seeded disturbance of the symbol frequencies for each state."""
        rng = np.random.default_rng(seed)
        emit = (weights + 1.0) * rng.uniform(0.2, 1.8, (states, len(weights)))
        move = rng.uniform(0.5, 1.5, (states, states)) + STAY * states * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start, move, emit, weights, prior: float = 1.0):
        """Normalised expected counts, with a prior of the symbol frequencies so that nothing is impossible."""
        share = (weights + ADD) / (weights + ADD).sum()
        emit = emit + prior * len(weights) * share / len(emit)
        return cls((start + ADD) / (start + ADD).sum(), (move + ADD) / (move + ADD).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class Segments:
    """Symbol sequences cut into segments of at most SEGMENT, longest first, as (SEGMENT, n)."""

    def __init__(self, sequences: list[np.ndarray]):
        lens = np.array([len(s) for s in sequences])
        pieces = -(-lens // SEGMENT)
        self.doc = np.repeat(np.arange(len(lens)), pieces)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(lens[self.doc] - self.place * SEGMENT, SEGMENT)
        flat, begin = np.concatenate(sequences), np.cumsum(lens) - lens
        order = np.argsort(-size, kind="stable")
        self.doc, self.place, size = self.doc[order], self.place[order], size[order]
        at = begin[self.doc] + self.place * SEGMENT
        self.alive = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than t
        index = np.minimum(at + np.arange(SEGMENT)[:, None], len(flat) - 1)
        self.symbols = flat[index].astype(np.int64)
        # segments by place, for walking documents from segment to segment
        by = np.lexsort((self.doc, self.place))
        cut = np.searchsorted(self.place[by], np.arange(int(pieces.max()) + 1))
        self.steps = [by[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.n, self.docs = len(order), len(lens)

    def transfer(self, model: Model, kind=np.float64):
        """Each segment's transfer matrix, scaled, and the log of its scale."""
        k = len(model.start)
        emit, step = np.ascontiguousarray(model.emit.T, kind), model.move.astype(kind)
        out, scale = np.empty((self.n, k, k), kind), np.zeros(self.n)
        for t in range(SEGMENT):
            m = int(self.alive[t])
            if not m:
                break
            b = emit[self.symbols[t, :m]][:, None, :]
            if t == 0:
                out[:m] = step[None] * b
                new = self.place[:m] == 0
                out[:m][new] = model.start[None, None] * b[new]
            else:
                out[:m] = (out[:m].reshape(-1, k) @ step).reshape(m, k, k) * b
            if t % 2:  # rare words soon take single precision to its end
                s = out[:m].sum((1, 2))
                out[:m] /= s[:, None, None]
                scale[:m] += np.log(s)
        s = out.sum((1, 2))
        return out / s[:, None, None], scale + np.log(s)

    def forward(self, model: Model, matrices, scale):
        """Log-likelihood of each document, and the state distribution before each segment."""
        k = len(model.start)
        now, total, before = np.full((self.docs, k), 1 / k), np.zeros(self.docs), np.empty((self.n, k))
        for seg in self.steps:
            d = self.doc[seg]
            before[seg] = now[d]
            a = np.einsum("ni,nij->nj", now[d], matrices[seg])
            s = a.sum(1)
            now[d] = a / s[:, None]
            total[d] += np.log(s) + scale[seg]
        return total, before

    def expected(self, model: Model):
        """Expected starts, moves and emissions (Baum-Welch), and the log-likelihood, in single precision."""
        k = len(model.start)
        matrices, scale = self.transfer(model, np.float32)
        total, before = self.forward(model, matrices, scale)
        after, now = np.empty((self.n, k), np.float32), np.ones((self.docs, k))
        for seg in reversed(self.steps):
            d = self.doc[seg]
            after[seg] = now[d]
            b = np.einsum("nij,nj->ni", matrices[seg], now[d])
            now[d] = b / b.sum(1, keepdims=True)
        emit, move_ = np.ascontiguousarray(model.emit.T, np.float32), model.move.astype(np.float32)
        alpha = np.zeros((SEGMENT, self.n, k), np.float32)
        a = before = before.astype(np.float32)
        for t in range(SEGMENT):
            m = int(self.alive[t])
            if not m:
                break
            step = a[:m] @ move_
            if t == 0:
                step[self.place == 0] = model.start
            a = step * emit[self.symbols[t, :m]]
            a /= a.sum(1, keepdims=True)
            alpha[t, :m] = a
        start, move, out = np.zeros(k), np.zeros((k, k)), np.zeros((k, model.emit.shape[1]))
        beta = after.copy()
        for t in range(SEGMENT - 1, -1, -1):
            m = int(self.alive[t])
            if not m:
                continue
            g = alpha[t, :m] * beta[:m]
            g /= g.sum(1, keepdims=True)
            alpha[t, :m] = g
            b = beta[:m] * emit[self.symbols[t, :m]]
            later = self.place[:m] > 0  # of first tokens only those of later segments follow one
            prev = alpha[t - 1, :m] if t else before[:m]
            z = ((prev @ move_) * b).sum(1)
            scaled = prev / z[:, None]
            move += (scaled.T @ b if t else scaled[later].T @ b[later]) * model.move
            if t == 0:
                start += g[self.place[:m] == 0].sum(0)
            nb = b @ move_.T
            beta[:m] = nb / nb.sum(1, keepdims=True)
        m = self.alive
        mask = np.arange(self.n)[None, :] < m[:, None]
        flat = self.symbols[mask]
        for i in range(k):
            out[i] = np.bincount(flat, weights=alpha[:, :, i][mask], minlength=model.emit.shape[1])
        return start, move, out, float(total.sum())


def _sequences(batches, column: int, most: int = 400_000):
    """Groups of rows (index into batch, symbols) of about `most` symbols."""
    held, size, rows = [], 0, []
    for batch in batches:
        for k in range(batch.num_rows):
            s = np.frombuffer(batch.column(column)[k].as_py(), np.uint16)
            rows.append(tuple(batch.column(i)[k].as_py() for i in range(batch.num_columns) if i != column))
            held.append(s)
            size += len(s)
            if size >= most:
                yield rows, held
                held, size, rows = [], 0, []
    if held:
        yield rows, held


def baum_welch(encoded: DataFrame, model: Model, weights: np.ndarray, rounds: int, least_gain: float, least_rounds: int = 4) -> tuple[Model, list[float]]:
    """Rounds of expectation over all training documents, until one gains less than least_gain a token
    or there were `rounds`; the log-likelihood before each."""
    k, m = model.emit.shape
    seen = []
    context = encoded.sparkSession.sparkContext
    for _ in range(rounds):
        value = context.broadcast(model)

        def expect(batches):
            total = None
            for _, sequences in _sequences(batches, 0):
                start, move, emit, ll = Segments(sequences).expected(value.value)
                found = np.concatenate([[ll], start, move.ravel(), emit.ravel()])
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_pydict({"v": pa.array([total.tolist()], pa.list_(pa.float64()))})

        sums = encoded.filter(~F.col("held_out")).select("symbols").mapInArrow(expect, "v array<double>")
        rows = sums.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not rows:
            break
        v = np.zeros(1 + k + k * k + k * m)
        for r in rows:
            v[r.i] = r.x
        seen.append(float(v[0]))
        tokens = v[1 + k + k * k :].sum()
        model = Model.of_counts(v[1 : 1 + k], v[1 + k : 1 + k + k * k].reshape(k, k), v[1 + k + k * k :].reshape(k, m), weights)
        if len(seen) >= least_rounds and seen[-1] - seen[-2] < least_gain * tokens:
            break
    return model, seen


def train_and_score(docs: DataFrame, states: int = 8, rounds: int = 30, least_gain: float = 0.015, seed: int = 7, bucket_mb: int = 48) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / (bucket_mb << 20)))
    blocks = written(block_table(texts, buckets), "blocks")
    counted = blocks.filter("bucket is not null").select("bucket", "block", "places", "hashes", "counts")
    counted = written(counted.groupBy("bucket").applyInArrow(_count_bucket, _COUNTS), "counts")
    ids = blocks.filter("bucket is null")
    is_out = F.pmod(F.crc32(F.coalesce(F.col("i").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    train_docs = ids.select(F.explode("ids").alias("i")).filter(~is_out).count()
    vocabulary = Vocabulary.of(counted.filter("block is null"), train_docs)
    value = context.broadcast(vocabulary)
    left = ids.select("block", "ids", "lens", "codes").groupBy("block")
    right = counted.filter("block is not null").select("block", "places", "counts", "symbols", "listed").groupBy("block")
    encoded = written(left.cogroup(right).applyInArrow(lambda d, c: _encode_block(d, c, value.value), _ENCODED), "encoded")
    weights = np.concatenate([vocabulary.hot_counts, vocabulary.class_words, [train_docs]]).astype(float)
    model, _ = baum_welch(encoded, Model.first(states, weights, seed), weights, rounds, least_gain)
    model_value = context.broadcast(model)

    def score(batches):
        for rows, sequences in _sequences(batches, 6):
            s = Segments(sequences)
            total, _ = s.forward(model_value.value, *s.transfer(model_value.value))
            a = list(zip(*rows))
            score = total / math.log(10) + np.array(a[5])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[0], pa.int64()), pa.array(a[1], pa.bool_()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.int64()), pa.array(a[4], pa.float64()), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    out = encoded.mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.words).cast("long").alias("train_tokens"), "base_score", "score")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
