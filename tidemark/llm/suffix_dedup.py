"""Removal of repeated byte strings by a depth-limited radix order of suffixes.

Suffixes are ordered by most-significant-digit passes and only down to the
threshold depth; a suffix that is alone in its group after a pass goes no
further, and the groups left at the full depth are exactly the repeated
windows. Three passes are enough because digits are long and are compared as
64-bit hashes:

1. Every window of `width` bytes is filed under its least `seed`-byte string (by
   hash, the leftmost of equals), so equal windows are filed alike, and the
   windows of a document fall into runs that share one such string. First digit:
   that string. A run whose string stands nowhere else holds nothing repeated.
2. Second digit: all bytes that the run's windows cover. If another run has the
   same ones, each of its windows is repeated.
3. Full depth, for runs whose string is shared by runs with other bytes: each
   window's `width` bytes.

Why not one suffix a byte: an order of all suffixes moves 12 bytes and more for
each byte of text. Filing them by shared strings moves a seventieth of that, and
drops most suffixes after the first digit.

Between passes only hashes travel, packed by bucket of bounded size, each value
at most once a block of documents, so a text copied a million times costs a
bucket one entry a block. What comes back is a bit for each value: repeated or
not. Texts are kept in compressed blocks, which each pass joins with its bits.

The same passes can also run on words: suffixes start at words, the threshold is
`words` of them. That finds passages which are shorter in bytes than `width`;
they are counted and not removed.

Hashes are sums over scrambled values of eight bytes each (of a word, for words),
so that strings without much variety do not collide in a pattern; two of d
distinct strings are taken for equal with a probability of about d * d / 2**65.

Defined results: a null text is empty; texts under `width` bytes keep all;
documents without ids and repeated rows are documents of their own; a text of any
length is cut into pieces that overlap by a window; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import bounded_batches, written

WIDTH, SEED = 400, 128
WORDS, WORD_SEED = 50, 16
_PLACE = np.uint64((1 << 28) - 1)
_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        full = np.full(max(n, 2 * len(_inverse)), np.uint64(pow(int(textkit._M), -1, 1 << 64)))
        full[0] = 1
        _inverse = np.multiply.accumulate(full)
    return _inverse[:n]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    n, m = len(v), len(v) - w + 1
    a = np.full(-(-n // w) * w, np.iinfo(v.dtype).max, v.dtype)
    a[:n] = v
    a = a.reshape(-1, w)
    before = np.minimum.accumulate(a, axis=1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def digits(raw: np.ndarray) -> np.ndarray:
    """A scrambled value of the eight bytes that start at each place; those of the last seven are cut short."""
    d = np.concatenate([raw, np.zeros(7, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        d = d[:-k] | (d[k:] << np.uint64(8 * k))
    return textkit.mix64(d)


class Unit:
    """What suffixes are made of. reach: how many units beyond its own a value covers."""

    def __init__(self, width: int, seed: int, reach: int, values):
        self.width, self.seed, self.reach, self.values = width, seed, reach, values

    @classmethod
    def bytes(cls, width: int, seed: int) -> "Unit":
        return cls(width, seed, 7, digits)

    @classmethod
    def words(cls, width: int, seed: int) -> "Unit":
        return cls(width, seed, 0, lambda hashes: hashes)


class Piece:
    """Some whole documents, or a stretch of a long one, and the runs of their windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit: Unit):
        n, width, seed = len(raw), unit.width, unit.seed
        self.unit = unit
        self.lo = self.n = self.d = np.zeros(0, np.int64)
        self.key = self.all = np.zeros(0, np.uint64)
        if n < width:
            return
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(unit.values(raw) * textkit.powers(n + 1)[:n], out=self.sums[1:])
        valid = np.zeros(n - width + 2, np.int32)
        long = np.diff(offsets) >= width
        valid[offsets[:-1][long]] += 1
        valid[offsets[1:][long] - width + 1] -= 1
        valid = np.cumsum(valid)[:-1] > 0
        if not valid.any():
            return
        seeds = self.hashes(np.arange(n - seed + 1), seed)
        least = sliding_min((seeds & ~_PLACE) | np.arange(len(seeds), dtype=np.uint64), width - seed + 1)
        at = (least & _PLACE).astype(np.int64)
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        self.lo = np.flatnonzero(first)
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        self.n = np.flatnonzero(last) + 1 - self.lo
        self.d = at[self.lo] - self.lo
        self.key = seeds[at[self.lo]]
        end = self.lo + self.n - 1 + width - unit.reach
        whole = (self.sums[end] - self.sums[self.lo]) * _inverse_powers(n + 1)[self.lo]
        self.all = textkit.mix64(textkit.mix64(whole ^ (self.n.astype(np.uint64) << np.uint64(32))) + self.d.astype(np.uint64) * np.uint64(3) + self.key)

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        return textkit.mix64((self.sums[starts + length - self.unit.reach] - self.sums[starts]) * _inverse_powers(len(self.sums))[starts])


def pieces(raw: np.ndarray, offsets: np.ndarray, unit: Unit, most: int = 1 << 20):
    """(place in raw, Piece); every window of a document is in exactly one piece."""
    for a, b, r, o in textkit.slices(raw, offsets, most):
        base = int(offsets[a])
        if len(r) <= 2 * most:
            yield base, Piece(r, o, unit)
        else:
            for x in range(0, len(r) - unit.width + 1, most):
                part = r[x : x + most + unit.width - 1]
                yield base + x, Piece(part, np.array([0, len(part)]), unit)


class Block:
    """All runs of a block's documents, in a fixed order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit: Unit):
        self.pieces = list(pieces(raw, offsets, unit))
        self.size, self.offsets = len(raw), offsets
        cat = lambda f, kind: np.concatenate([f(b, p) for b, p in self.pieces] or [np.zeros(0, kind)])
        self.lo, self.n = cat(lambda b, p: p.lo + b, np.int64), cat(lambda b, p: p.n, np.int64)
        self.key, self.all = cat(lambda b, p: p.key, np.uint64), cat(lambda b, p: p.all, np.uint64)
        self.piece = cat(lambda b, p: np.full(len(p.lo), b), np.int64)
        self.alls, self.first_all, self.of_all, self.count_all = np.unique(self.all, return_index=True, return_inverse=True, return_counts=True)
        self.keys, self.of_key = np.unique(self.key, return_inverse=True)
        self.width = unit.width

    def key_table(self):
        """For each distinct string: a digest of the bytes of its runs, and whether they differ in the block."""
        lo, hi = np.full(len(self.keys), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(self.keys), np.uint64)
        np.minimum.at(lo, self.of_key, self.all)
        np.maximum.at(hi, self.of_key, self.all)
        return lo, lo != hi

    def open_windows(self, full: np.ndarray, mixed: np.ndarray):
        """Windows whose repetition the first two passes leave open, and those of
        repeated runs that may equal one: (run, start, hash, open)."""
        alone = np.zeros(len(self.lo), bool)
        alone[self.first_all] = True
        take = np.flatnonzero(mixed & (~full | alone))
        run = np.repeat(take, self.n[take])
        start = np.arange(len(run)) - np.repeat(np.cumsum(self.n[take]) - self.n[take], self.n[take]) + self.lo[run]
        h = np.zeros(len(run), np.uint64)
        for base, p in self.pieces:
            mine = np.flatnonzero(self.piece[run] == base)
            if len(mine):
                h[mine] = p.hashes(start[mine] - base, self.width)
        return start, h, ~full[run]


def _bucketed(values: np.ndarray, buckets: int):
    """(bucket, places) of sorted distinct values."""
    b = ((values >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k + 1] > cut[k]:
            yield k, order[cut[k] : cut[k + 1]]


_PACKED = "kind int, bucket bigint, block bigint, vals binary, more binary, marks binary"
_PACKED_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("vals", pa.binary()), ("more", pa.binary()), ("marks", pa.binary())])
_BITS = "kind int, bucket bigint, block bigint, bits binary"
_BITS_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())])
ALL, KEY, WINDOW = range(3)


def _packed(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PACKED_SCHEMA.types)], schema=_PACKED_SCHEMA)


def _repeated(table: pa.Table) -> pa.Table:
    """For each block's values in a bucket a bit each: does the value stand elsewhere
    too (for strings: in runs of other bytes)?"""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    vals = [np.frombuffer(x.as_py(), np.uint64) for x in table["vals"]]
    at = np.cumsum([0] + [len(v) for v in vals])
    marks = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(v)) for x, v in zip(table["marks"], vals)])
    uniq, inverse = np.unique(np.concatenate(vals), return_inverse=True)
    if kind % 3 == KEY:
        more = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["more"]])
        lo, hi = np.full(len(uniq), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(uniq), np.uint64)
        np.minimum.at(lo, inverse, more)
        np.maximum.at(hi, inverse, more)
        yes = (lo != hi) | (np.bincount(inverse, weights=marks, minlength=len(uniq)) > 0)
    else:
        yes = np.bincount(inverse, weights=1 + marks, minlength=len(uniq)) > 1
    yes = yes[inverse]
    rows = [(kind, bucket, b, np.packbits(yes[at[k] : at[k + 1]]).tobytes()) for k, b in enumerate(table["block"].to_pylist())]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _BITS_SCHEMA.types)], schema=_BITS_SCHEMA)


def _bits(table: pa.Table, kind: int, values: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that came back for these sorted distinct values."""
    found = {b.as_py(): x.as_py() for k, b, x in zip(table["kind"], table["bucket"], table["bits"]) if k.as_py() == kind}
    out = np.zeros(len(values), bool)
    for b, places in _bucketed(values, buckets):
        out[places] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=len(places)).astype(bool)
    return out


def block_table(docs: DataFrame, block_mb: int) -> DataFrame:
    """(block, ids, lens, text): compressed blocks of whole documents."""

    def run(batches):
        from pyspark import TaskContext

        block, ids, lens, raws, size = TaskContext.get().partitionId() << 24, [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict(
                {"block": [block], "ids": pa.array([ids], pa.list_(pa.int64())), "lens": pa.array([np.concatenate(lens).tolist()], pa.list_(pa.int64())), "text": pa.array([zstandard.compress(b"".join(raws), 1)], pa.binary())}
            )

        for batch in batches:
            these = batch.column(0).to_pylist()
            raw, offsets = textkit.columns_bytes(batch.column(1))
            for a, b, r, o in textkit.slices(raw, offsets):
                ids += these[a:b]
                lens.append(np.diff(o))
                raws.append(r.tobytes())
                size += len(r)
                if size >= block_mb << 20:
                    yield row()
                    block, ids, lens, raws, size = block + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(run, "block bigint, ids array<bigint>, lens array<bigint>, text binary")


def _open_block(lens, text, units: list[Unit]):
    """Bytes, offsets, and for each unit its Block: the first is of bytes, the others of words."""
    raw = np.frombuffer(zstandard.decompress(text.as_py()), np.uint8) if len(text.as_py()) else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.array(lens.as_py(), np.int64))])
    blocks = [Block(raw, offsets, units[0])]
    if len(units) > 1:
        starts, ends, per = textkit.words(raw, offsets)
        hashes = np.concatenate([textkit.span_hash(raw, starts[k : k + 200_000], ends[k : k + 200_000]) for k in range(0, len(starts), 200_000)] or [np.zeros(0, np.uint64)])
        blocks += [Block(hashes, np.concatenate([[0], np.cumsum(per)]), u) for u in units[1:]]
    return raw, offsets, blocks


def _covered(b: Block, full: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Which units are covered by the windows of the runs `full` and by those that start at `hit`."""
    edge = np.zeros(b.size + 1, np.int32)
    np.add.at(edge, b.lo[full], 1)
    np.add.at(edge, (b.lo + b.n - 1 + b.width)[full], -1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + b.width, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_document(gone: np.ndarray, offsets: np.ndarray):
    """Covered units and maximal covered runs of each document."""
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(gone)]
    begin[cuts] = gone[cuts]
    run, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begin)])
    return run[offsets[1:]] - run[offsets[:-1]], spans[offsets[1:]] - spans[offsets[:-1]]


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, block_mb: int = 4, bucket_mb: int = 8, digest: bool = False, words: int | None = None, word_seed: int = WORD_SEED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and what is kept:
    kept binary, or with digest its kept_sha256. With a number of words also
    n_passage_words and n_passages: words in strings of that many words which start
    anywhere else too, and maximal runs of such words."""
    bounded_batches(docs.sparkSession)
    units = [Unit.bytes(width, seed)] + ([Unit.words(words, word_seed)] if words else [])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / (bucket_mb << 20)))
    blocks = written(block_table(texts, block_mb), "texts")

    def first_passes(batches):
        for batch in batches:
            for block, lens, text in zip(batch.column("block").to_pylist(), batch.column("lens"), batch.column("text")):
                for u, b in enumerate(_open_block(lens, text, units)[2]):
                    more, differ = b.key_table()
                    rows = [(3 * u + ALL, k, block, b.alls[p].tobytes(), None, np.packbits(b.count_all[p] > 1).tobytes()) for k, p in _bucketed(b.alls, buckets)]
                    rows += [(3 * u + KEY, k, block, b.keys[p].tobytes(), more[p].tobytes(), np.packbits(differ[p]).tobytes()) for k, p in _bucketed(b.keys, buckets)]
                    if rows:
                        yield _packed(rows)

    passed = blocks.select("block", "lens", "text").mapInArrow(first_passes, _PACKED)
    bits = written(passed.groupBy("kind", "bucket").applyInArrow(_repeated, _BITS), "bits")

    def state(u: int, b: Block, table: pa.Table):
        full = _bits(table, 3 * u + ALL, b.alls, buckets)[b.of_all]
        mixed = _bits(table, 3 * u + KEY, b.keys, buckets)[b.of_key]
        return full, b.open_windows(full, mixed)

    def last_pass(texts_: pa.Table, table: pa.Table) -> pa.Table:
        rows = []
        for block, lens, text in zip(texts_["block"].to_pylist(), texts_["lens"], texts_["text"]):
            for u, b in enumerate(_open_block(lens, text, units)[2]):
                _, (_, h, _) = state(u, b, table)
                uniq, count = np.unique(h, return_counts=True)
                rows += [(3 * u + WINDOW, k, block, uniq[p].tobytes(), None, np.packbits(count[p] > 1).tobytes()) for k, p in _bucketed(uniq, buckets)]
        return pa.Table.from_batches([_packed(rows)] if rows else [], schema=_PACKED_SCHEMA)

    windows = blocks.select("block", "lens", "text").groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(last_pass, _PACKED)
    more_bits = written(windows.groupBy("kind", "bucket").applyInArrow(_repeated, _BITS), "bits")

    columns = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())]
    columns += [("n_passage_words", pa.int64()), ("n_passages", pa.int64())] if words else []
    schema = pa.schema(columns)

    def covered(u: int, b: Block, table: pa.Table) -> np.ndarray:
        full, (start, h, is_open) = state(u, b, table)
        uniq, inverse = np.unique(h, return_inverse=True)
        return _covered(b, full, start[_bits(table, 3 * u + WINDOW, uniq, buckets)[inverse] & is_open])

    def remove(texts_: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        for ids, lens, text in zip(texts_["ids"], texts_["lens"], texts_["text"]):
            raw, offsets, made = _open_block(lens, text, units)
            gone = covered(0, made[0], table)
            removed, spans = _per_document(gone, offsets)
            rest, at = raw[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
            pieces_ = [rest[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            pieces_ = [hashlib.sha256(x).hexdigest() for x in pieces_] if digest else pieces_
            found = [ids.as_py(), np.diff(offsets), removed, spans, pieces_]
            for u, b in enumerate(made[1:], 1):
                found += _per_document(covered(u, b, table), b.offsets)
            out.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(found, columns)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    both = bits.unionAll(more_bits)
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, ", ".join(f"{c} {names[t]}" for c, t in columns))


def op1_query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True, words=WORDS)
