"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A token (run of ASCII letters, digits and bytes above 0x7F, A-Z lower-cased) is
the embedding of its word, if enough training texts hold it, next to the mean
embedding of its character trigrams. A bidirectional GRU reads windows of
`WINDOW` tokens that overlap by half, attention pools its states to one logit a
window, and a text's score is a logistic function of its highest window logit
and the number of windows. All of it is trained here, in numpy in one task, on a
bounded sample: at most `most_docs` labelled rows that may be learnt from and
`most_bytes` of their texts, taken by hash of the id (a text that does not fit in
what is left is passed over), with all windows of their whole texts; a quarter of the sample is kept from the network to fit the final
function. The driver holds the finished network only (under 1 MB). Scoring reads
whole texts, all windows, without a shuffle.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2.
Scores never see labels, lang, source or doc_id.

Defined results: null texts and texts without tokens get the share of toxic rows
in the sample; without any labelled rows, or with one class only, every score is
that share (0 for no rows); a null doc_id is not held out; labels that are null
or contradict each other: nulls are left out and a row is toxic if any of its
labels is; of rows that repeat a doc_id one text, the least, is learnt from;
repeated rows get repeated scores; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import bounded_batches, written

WINDOW, STEP = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION, TRIGRAMS = 8, 8, 12, 8, 2048
THRESHOLD = 0.3
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, token starts and ends, tokens per document."""
    raw = textkit.lower_ascii(raw)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = _SOLID[raw]
    cuts = offsets[:-1][offsets[:-1] < n]
    before = np.concatenate([[False], solid[:-1]])
    before[cuts] = False
    after = np.concatenate([solid[1:], [False]])
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return raw, starts, ends, np.diff(np.searchsorted(starts, offsets))


class Words:
    """Distinct words: hashes and trigram ids (flat, with the first place of each word)."""

    def __init__(self, raw, starts, ends):
        self.hash, first, self.codes = np.unique(textkit.span_hash(raw, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        n = e - s
        self.at = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(self.at, n)
        place = np.repeat(s, n) + within
        mid = raw[place].astype(np.uint64)
        left = np.where(within == 0, 1, raw[np.maximum(place - 1, 0)]).astype(np.uint64)
        right = np.where(within == np.repeat(n, n) - 1, 2, raw[np.minimum(place + 1, len(raw) - 1)]).astype(np.uint64)
        self.tri = (textkit.mix64(left * np.uint64(65536) + mid * np.uint64(256) + right) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.len = n


def window_index(per: np.ndarray):
    """(document, first token, tokens) of all windows: WINDOW tokens every STEP, the last one ending the text."""
    count = np.where(per > 0, 1 + np.maximum(0, -(-(per - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(per)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * STEP, np.maximum(per[doc] - WINDOW, 0))
    return doc, (np.cumsum(per) - per)[doc] + begin, np.minimum(per[doc], WINDOW)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters p by name; vocabulary: sorted hashes of the words with an embedding (row 0: any other)."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
        normal = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32),
            "tri": (0.3 * rng.standard_normal((TRIGRAMS, CHAR_DIM))).astype(np.float32),
            **{f"{k}{s}": normal(*n) for s in "fb" for k, n in (("W", (d, 3 * h)), ("U", (h, 3 * h)))},
            **{f"b{s}": np.zeros(3 * h, np.float32) for s in "fb"},
            "A": normal(2 * h, a),
            "a": np.zeros(a, np.float32),
            "v": normal(a, 1)[:, 0],
            "w": normal(2 * h, 1)[:, 0],
            "o": np.zeros(1, np.float32),
        }

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, words: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(words.len):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        char = np.add.reduceat(self.p["tri"][words.tri], words.at, axis=0) / words.len[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][self.places(words.hash)], char], axis=1).astype(np.float32)

    def _run(self, x, mask, side: str, keep: bool):
        """GRU over x (T, B, 3H: inputs times W) in reading order of the side; states in text order."""
        p, (t_, b, _), h_ = self.p, x.shape, HIDDEN
        h, out, saved = np.zeros((b, h_), x.dtype), np.empty((t_, b, h_), x.dtype), []
        for t in range(t_) if side == "f" else range(t_ - 1, -1, -1):
            u = h @ p["U" + side]
            rz = _sigmoid(x[t, :, : 2 * h_] + u[:, : 2 * h_])
            r, z = rz[:, :h_], rz[:, h_:]
            n = np.tanh(x[t, :, 2 * h_ :] + r * u[:, 2 * h_ :])
            m = mask[t][:, None]
            if keep:
                saved.append((t, h, r, z, n, u[:, 2 * h_ :]))
            h = h + m * ((1 - z) * (n - h))
            out[t] = h
        return out, saved

    def forward(self, vectors, index, mask, keep: bool = False):
        """Window logits; vectors (words, dim), index and mask (T, B)."""
        p = self.p
        sides, saved = [], {}
        for s in "fb":
            x = (vectors @ p["W" + s] + p["b" + s])[index]
            out, saved[s] = self._run(x, mask, s, keep)
            sides.append(out)
        h = np.concatenate(sides, axis=2)
        u = np.tanh(h @ p["A"] + p["a"])
        e = np.where(mask > 0, u @ p["v"], -1e9)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        c = np.einsum("tb,tbh->bh", w, h)
        return c @ p["w"] + p["o"][0], (h, u, w, c, saved)

    def backward(self, d, vectors, index, mask, state):
        """Gradients of p and of vectors for logit gradients d (B)."""
        p, (h, u, w, c, saved), g = self.p, state, {}
        g["w"], g["o"] = c.T @ d, np.array([d.sum()], d.dtype)
        dc = d[:, None] * p["w"]
        dw = np.einsum("bh,tbh->tb", dc, h)
        de = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tb,tba->a", de, u)
        du = de[:, :, None] * p["v"] * (1 - u * u)
        g["A"], g["a"] = np.einsum("tbh,tba->ha", h, du), du.sum((0, 1))
        dh_all = w[:, :, None] * dc + du @ p["A"].T
        dv = np.zeros_like(vectors)
        k = HIDDEN
        for side, part in (("f", dh_all[:, :, :k]), ("b", dh_all[:, :, k:])):
            dx, dU, dh = np.zeros((*index.shape, 3 * k), vectors.dtype), np.zeros_like(p["U" + side]), np.zeros_like(part[0])
            for t, h0, r, z, n, un in reversed(saved[side]):
                m = mask[t][:, None]
                dh = dh + part[t]
                dn = m * dh * (1 - z) * (1 - n * n)
                dz = m * dh * (h0 - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dx[t, :, :k], dx[t, :, k : 2 * k], dx[t, :, 2 * k :] = dr, dz, dn
                du_ = np.concatenate([dr, dz, dn * r], axis=1)
                dU += h0.T @ du_
                dh = dh * (1 - m * (1 - z)) + du_ @ p["U" + side].T
            flat, at = dx.reshape(-1, 3 * k), index.ravel()
            dword = np.stack([np.bincount(at, weights=flat[:, j], minlength=len(vectors)) for j in range(3 * k)], axis=1).astype(vectors.dtype)
            g["U" + side], g["b" + side], g["W" + side] = dU, flat.sum(0), vectors.T @ dword
            dv += dword @ p["W" + side].T
        return g, dv

    def windows(self, words: Words, per: np.ndarray, batch: int = 4096):
        """(document of each window, its logit) for the tokens of a slice."""
        doc, begin, n = window_index(per)
        out, vectors = np.empty(len(doc), np.float32), self.inputs(words)
        for a in range(0, len(doc), batch):
            b = begin[a : a + batch]
            size = int(n[a : a + batch].max())
            step = np.arange(size)[:, None]
            mask = (step < n[a : a + batch]).astype(np.float32)
            index = words.codes[np.where(mask > 0, b + step, b)]
            out[a : a + batch] = self.forward(vectors, index, mask)[0]
        return doc, out


def train(texts: list[str], toxic: np.ndarray, least_passes: int = 100_000, seed: int = 5, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """A network fitted to all windows of the texts, labelled as their texts are; 3 to 16 rounds, for at least that many passes."""
    raw, offsets = textkit.columns_bytes(pa.array(texts, pa.large_string()))
    raw, starts, ends, per = tokens(raw, offsets)
    words = Words(raw, starts, ends)
    doc_of = np.repeat(np.arange(len(per)), per)
    pairs = np.unique(words.codes * len(per) + doc_of)
    in_docs = np.bincount(pairs // max(len(per), 1), minlength=len(words.hash))
    net = Network(words.hash[in_docs >= max(4, len(texts) // 600)], seed)
    doc, begin, n = window_index(per)
    rng = np.random.default_rng(seed)
    chosen = rng.permutation(len(doc))
    rounds = max(3, min(16, -(-least_passes // max(len(chosen), 1))))
    place = net.places(words.hash)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, total = 0, rounds * -(-len(chosen) // 256)
    for _ in range(rounds):
        rng.shuffle(chosen)
        for a in range(0, len(chosen), 256):
            pick = chosen[a : a + 256]
            mask = (np.arange(WINDOW)[:, None] < n[pick]).astype(np.float32)
            code = words.codes[np.where(mask > 0, begin[pick] + np.arange(WINDOW)[:, None], begin[pick])]
            used, index = np.unique(code, return_inverse=True)
            index = index.reshape(code.shape)
            size = words.len[used]
            at = np.cumsum(size) - size
            tri = words.tri[np.arange(int(size.sum())) + np.repeat(words.at[used] - at, size)]
            char = np.add.reduceat(net.p["tri"][tri], at, axis=0) / size[:, None].astype(np.float32)
            vectors = np.concatenate([net.p["word"][place[used]], char], axis=1).astype(np.float32)
            logit, state = net.forward(vectors, index, mask, keep=True)
            d = ((_sigmoid(logit) - toxic[doc[pick]]) / len(pick)).astype(np.float32)
            g, dv = net.backward(d, vectors, index, mask, state)
            word_g, tri_g = np.zeros_like(net.p["word"]), np.zeros_like(net.p["tri"])
            np.add.at(word_g, place[used], dv[:, :WORD_DIM])
            np.add.at(tri_g, tri, np.repeat(dv[:, WORD_DIM:] / size[:, None], size, axis=0).astype(np.float32))
            g |= {"word": word_g + decay * net.p["word"], "tri": tri_g + decay * net.p["tri"]}
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for k, x in g.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (x - m1)
                m2 += 0.001 * (x * x - m2)
                net.p[k] -= (lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Network and the logistic function of (highest logit, log of windows) fitted on rows the network has not seen."""

    def __init__(self, net: Network | None, share: float, coef=(1.0, 0.0, 0.0)):
        self.net, self.share, self.coef = net, share, np.array(coef, float)

    @classmethod
    def fit(cls, texts: list[str], toxic: np.ndarray, **options) -> "Scorer":
        share = float(toxic.mean()) if len(toxic) else 0.0
        if len(set(toxic.tolist())) < 2 or len(toxic) < 8:
            return cls(None, share)
        own = np.arange(len(texts)) % 4 != 3
        net = train([t for t, o in zip(texts, own) if o], toxic[own], **options)
        found = cls(net, share)
        rest = np.flatnonzero(~own)
        top, count = found.highest([texts[i] for i in rest])
        y = toxic[rest][count > 0].astype(float)
        x = np.column_stack([top, np.log(np.maximum(count, 1)), np.ones(len(top))])[count > 0]
        if len(y) >= 8 and 0 < y.sum() < len(y):
            w = found.coef.copy()
            prior = np.diag([0.05, 2.0, 0.05])
            start = w.copy()
            for _ in range(50):  # Newton steps with a prior at the network's own logit
                p = _sigmoid(x @ w)
                grad = x.T @ (p - y) + prior @ (w - start)
                step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + prior, grad)
                w -= np.clip(step, -1, 1)
            if w[0] > 0.1:
                found.coef = w
        return found

    def highest(self, texts: list[str]):
        raw, offsets = textkit.columns_bytes(pa.array(texts, pa.large_string()))
        top, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        for a, b, r, o in textkit.slices(raw, offsets):
            for_docs, logits = self.logits(r, o)
            np.maximum.at(top, a + for_docs, logits)
            count[a:b] = np.bincount(for_docs, minlength=b - a)
        return top, count

    def logits(self, raw, offsets):
        raw, starts, ends, per = tokens(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        return self.net.windows(Words(raw, starts, ends), per)

    def scores(self, raw, offsets):
        """(document of each window, window probability, score of each document) of a slice."""
        n = len(offsets) - 1
        score = np.full(n, self.share)
        if self.net is None:
            return np.zeros(0, np.int64), np.zeros(0), score
        doc, logit = self.logits(raw, offsets)
        top, count = np.full(n, -np.inf), np.bincount(doc, minlength=n)
        np.maximum.at(top, doc, logit)
        some = count > 0
        score[some] = _sigmoid(np.column_stack([top[some], np.log(count[some]), np.ones(int(some.sum()))]) @ self.coef)
        return doc, _sigmoid(logit), score


def sample_of(docs: DataFrame, labels: DataFrame, most_docs: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows of least hash: at most most_docs of them, and most_bytes of text.

    Raises if there are labelled rows but none of their texts fits."""
    may = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "sample")
    # at most most_docs pairs; a text that does not fit is passed over, and those behind it still count
    taken, left = [], most_bytes
    sizes = rows.select("doc_id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    for r in sizes:
        if r.size <= left:
            taken.append((r.doc_id,))
            left -= r.size
    if sizes and not taken:
        raise ValueError(f"no labelled text fits into most_bytes={most_bytes}")
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(taken, "doc_id bigint")), "doc_id")


def fit_on_sample(docs: DataFrame, labels: DataFrame, most_docs: int = 5000, most_bytes: int = 10 << 20, **options) -> Scorer:
    """A scorer trained in one task on a sample of labelled rows; a lost executor only repeats that task."""

    def fit(batches):
        got = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        got.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        scorer = Scorer.fit([r[1] for r in got], np.array([r[2] for r in got], np.int64), **options)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(scorer)], pa.binary())})

    rows = sample_of(docs, labels, most_docs, most_bytes).select("doc_id", "text", "toxic").coalesce(1)
    found = rows.mapInArrow(fit, "model binary").first()
    return pickle.loads(found.model) if found else Scorer.fit([], np.zeros(0, np.int64))


def window_scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per document: doc_id, score, windows array<float> (a probability for each window, in order)."""
    bounded_batches(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in batches:
            raw, offsets = textkit.columns_bytes(batch.column(1))
            for a, b, r, o in textkit.slices(raw, offsets):
                doc, window, score = value.value.scores(r, o)
                cut = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), pa.array(window.astype(np.float32)))], names=["doc_id", "score", "windows"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, windows array<float>")


def toxicity(docs: DataFrame, labels: DataFrame, most_docs: int = 5000) -> DataFrame:
    """doc_id, held_out, score, predicted: trains on the sample, then scores every document."""
    scored = window_scores(docs, fit_on_sample(docs, labels, most_docs))
    out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, most_docs: int = 5000) -> DataFrame:
    """The rows of docs that are not predicted toxic, in one pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    value = docs.sparkSession.sparkContext.broadcast(fit_on_sample(docs, labels, most_docs))
    place = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            raw, offsets = textkit.columns_bytes(batch.column(place))
            score = [value.value.scores(r, o)[2] for _, _, r, o in textkit.slices(raw, offsets)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op8_query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
