"""Byte-level BPE encoding and decoding.

Spark higher-order functions fold the ranked merges over the bytes of distinct
words: a word is an array of one-byte pieces, each step joins the leftmost
adjacent pair of least rank, and the rank of a joined piece is looked up in arrays
by the ids of its two parts. Decoding concatenates the pieces of the ids. Bytes travel as
Latin-1 characters, one character a byte. The arrays are one row of a written table, which is
broadcast: literals of a plan would be held by the driver many times over.

The first Arrow pass cuts the texts of a block (about `block_mb` of whole
documents) into words and numbers the distinct ones; the blocks are written; the
fold encodes the distinct words of each; the second pass puts each document's ids
in order. A table of at most `hot_words` encodings of words that
repeat, itself made by the same fold, is broadcast so that common words are
folded once and not once a block; what it holds changes no result.

Words of more than `long_word` bytes, for which re-building an array at each
merge would be quadratic, go through a heap form of the same merges.

Defined results: a null text is an empty text (no ids); ids and positions are
exact for texts of any length; repeated rows give repeated results; an empty
table gives an empty result; further columns are ignored by encode().
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .storage import bounded_batches, written

#: Bound of the broadcast table: about 16 MB, whatever the size of the corpus.
HOT_WORDS = 1 << 18
NO_RANK = 2147483647
#: Places in a word have 10 bits in the fold, ids 21.
LONGEST = 1023
ID = (1 << 21) - 1
NO_PAIR = NO_RANK << 31


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 piece, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(id of each byte, shift of each id, owners, merged ids): pieces a and b join to merged[shift[a] + b] if owners[shift[a] + b] is a.

    All pairs of pieces whose concatenation is a piece: the rows of a sparse table by a, shifted so that no two
    of their entries meet, and no
    sum of a shift and an id lies beyond the arrays. A lookup is two reads of arrays."""
    if len(ranks) < 256 or (most := max(ranks.values())) > ID:
        raise ValueError("ranks must hold all bytes and lie below 2**21")
    rows: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None:
                rows.setdefault(a, []).append((b, rank))
    shift, rng, size = [0] * (most + 1), np.random.default_rng(0), 2 * sum(map(len, rows.values())) + most + 1
    owner, merged = np.full(size, -1), np.zeros(size, np.int64)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        at, to = np.array(row).T
        for k in range(5, 13):
            tried = rng.integers(0, len(owner) - most, 1 << k)
            fits = (owner[tried[:, None] + at] < 0).all(1)
            if fits.any():
                shift[a] = int(tried[fits.argmax()])
                break
        else:  # a row that fits nowhere gets room of its own
            shift[a] = len(owner)
            owner, merged = np.concatenate([owner, np.full(most + 1, -1)]), np.concatenate([merged, np.zeros(most + 1, np.int64)])
        owner[shift[a] + at], merged[shift[a] + at] = a, to
    owner, merged = owner.tolist(), merged.tolist()
    return [ranks[bytes([k])] for k in range(256)], shift, owner, merged


def rank_table(spark: SparkSession, ranks: Broadcast) -> DataFrame:
    """One row: the arrays B, D, O and G of merge_table() and the pieces P by rank, made in a task."""

    def made(batches):
        for _ in batches:
            pieces = [""] * (max(ranks.value.values()) + 1)
            for piece, rank in ranks.value.items():
                pieces[rank] = piece.decode("latin-1")
            merges = {n: pa.array([v], pa.list_(pa.int32())) for n, v in zip("BDOG", merge_table(ranks.value))}
            yield pa.RecordBatch.from_pydict(merges | {"P": [pieces]})

    return written(spark.range(0, 1, 1, 1).mapInArrow(made, "B array<int>, D array<int>, O array<int>, G array<int>, P array<string>"), "ranks")


#: Fold of one word w by the merge table (B, D, O, G). The state is one array of numbers, one for each piece: the rank of the
#: pair that it begins (31 bits), its place (10 bits) and its id (21 bits). The least number is thus the leftmost pair of least
#: rank, whose rank is the id of the joined piece; a merge looks up its two new pairs and leaves all other numbers as they are.
_ID = lambda x: f"({x} & {ID})"
#: Bound names stand in for a let: transform(array(value), name -> body)[0].
_LET = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"


def _piece(at: str, a: str, b: str) -> str:
    """The number of piece a, followed by piece b (null: by none); at: its place, shifted."""
    spot = f"cast(D[{a}] + {b} as int)"
    rank = f"if(get(O, {spot}) = {a}, shiftleft(cast(G[{spot}] as bigint), 31), {NO_PAIR}L)"
    return f"({rank} | {at} | {a})"


def _fold_sql() -> str:
    byte = "transform(sequence(1, length(w)), i -> B[ascii(substring(w, i, 1))])"
    start = _LET("c", byte, f"transform(c, (a, i) -> {_piece('shiftleft(cast(i as bigint), 21)', 'a', 'get(c, i + 1)')})")
    # a merge of the pair m at place j: its neighbour to the right goes, the pair to the left ends later
    place = lambda x: f"({x} & {LONGEST << 21})"
    joined, left = "cast(shiftright(m, 31) as int)", "s[j - 2]"
    merged = _piece(place("m"), "n", _ID("get(s, j + 1)"))
    before = f"if(j > 1, concat(slice(s, 1, j - 2), array({_piece(place(left), f'cast({_ID(left)} as int)', 'n')}, {merged})), array({merged}))"
    step = _LET("n", joined, f"concat({before}, slice(s, j + 2, size(s)))")
    step = _LET("j", "cast(array_position(s, m) as int)", step)
    step = _LET("m", "array_min(s)", f"if(m >= {NO_PAIR}L, s, {step})")
    return f"aggregate(sequence(2, length(w)), {start}, (s, i) -> {step}, s -> transform(s, x -> cast({_ID('x')} as int)))"


def _with_arrays(df: DataFrame, names: str, out: str, sql: str, ranks: dict[bytes, int], table: DataFrame | None) -> DataFrame:
    """Add column `out`: sql, in which the arrays `names` of the rank table have their names. Each row is joined to all of them."""
    table = rank_table(df.sparkSession, df.sparkSession.sparkContext.broadcast(ranks)) if table is None else table
    for name in names:
        sql = _LET(name, f"_array_{name}", sql)
    arrays = F.broadcast(table.select(*[F.col(n).alias(f"_array_{n}") for n in names]))
    return df.crossJoin(arrays).withColumn(out, F.expr(sql)).drop(*arrays.columns)


def encode_words(df: DataFrame, words: str, out: str, ranks: dict[bytes, int], table: DataFrame | None = None) -> DataFrame:
    """Add column `out`: array<array<int>>, the ids of each of the Latin-1 words in column `words`; a row should have many words.

    table: rank_table() of the ranks, if it is there already."""
    return _with_arrays(df, "BDOG", out, f"transform({words}, w -> {_fold_sql()})", ranks, table)


def decode_words(df: DataFrame, ids: str, out: str, ranks: dict[bytes, int], table: DataFrame | None = None) -> DataFrame:
    """Add column `out`: array<string>, the concatenated pieces of each array of ids, as Latin-1."""
    return _with_arrays(df, "P", out, f"transform({ids}, e -> aggregate(e, '', (a, i) -> concat(a, P[i])))", ranks, table)


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word in n log n: a heap of (rank, place) over linked pieces."""
    n = len(word)
    end = list(range(1, n + 1))
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        j = end[i]
        alive[j] = False
        end[i] = e
        if e < n:
            prev[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : e])) is not None:
            heapq.heappush(heap, (r, prev[i], e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


_BLOCK = "ids array<bigint>, lens binary, codes binary, slots binary, tail array<string>, long_ids binary, long_lens binary, long_text array<string>"


class Block:
    """Some whole documents: their word codes and where each distinct word first stands.

    Slices are numbered on their own first, so that only distinct words are kept as 64-bit values.
    """

    def __init__(self):
        self.ids, self.raw, self.lens, self.codes = [], [], [], []
        self.starts, self.ends, self.hashes, self.bytes = [], [], [], 0

    def add(self, ids: list, raw: np.ndarray, offsets: np.ndarray) -> None:
        s, e, per = textkit.pretokens(raw, offsets)
        h, first, codes = np.unique(textkit.span_hash(raw, s, e), return_index=True, return_inverse=True)
        self.ids += ids
        self.raw.append(raw.tobytes())
        self.lens.append(per.astype(np.int32))
        self.codes.append(codes.astype(np.int32))
        self.starts.append((s[first] + self.bytes).astype(np.int32))
        self.ends.append((e[first] + self.bytes).astype(np.int32))
        self.hashes.append(h)
        self.bytes += len(raw)

    def close(self):
        """(hashes, starts, ends, codes, Latin-1 text): distinct words of the block and all its words."""
        h, first, inverse = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        inverse, base = inverse.astype(np.int32), np.cumsum([0] + [len(x) for x in self.hashes])
        codes = np.concatenate([inverse[base[k] + c] for k, c in enumerate(self.codes)])
        return h, np.concatenate(self.starts)[first], np.concatenate(self.ends)[first], codes, b"".join(self.raw).decode("latin-1")


def blocks_of(batches, block_bytes: int):
    block = Block()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        raw, offsets = textkit.columns_bytes(batch.column(1))
        for a, b, r, o in textkit.slices(raw, offsets):
            block.add(ids[a:b], r, o)
            if block.bytes >= block_bytes:
                yield block
                block = Block()
    if block.ids:
        yield block


def _as_row(block: Block, hot_hashes: np.ndarray, ranks, long_word: int) -> dict:
    """The block as one row, with the distinct words that the hot table lacks.

    slots, by code: a place in the hot table, or below zero -1 - place in tail + long words.
    """
    uniq, starts, ends, codes, text = block.close()
    slots = np.full(len(uniq), -1, np.int32)
    if len(hot_hashes) and len(uniq):
        at = np.minimum(np.searchsorted(hot_hashes, uniq), len(hot_hashes) - 1)
        known = hot_hashes[at] == uniq
        slots[known] = at[known]
    size = ends - starts
    tail = np.flatnonzero((slots < 0) & (size <= long_word))
    big = np.flatnonzero((slots < 0) & (size > long_word))
    slots[tail] = -1 - np.arange(len(tail))
    slots[big] = -1 - len(tail) - np.arange(len(big))
    done = [heap_encode(text[starts[k] : ends[k]].encode("latin-1"), ranks()) for k in big]
    piece = {v: k for k, v in ranks().items()} if done else {}
    return {
        "ids": block.ids,
        "lens": np.concatenate(block.lens).tobytes(),
        "codes": codes.tobytes(),
        "slots": slots.tobytes(),
        "tail": [text[a:b] for a, b in zip(starts[tail].tolist(), ends[tail].tolist())],
        "long_ids": np.array([x for d in done for x in d], np.int32).tobytes(),
        "long_lens": np.array([len(d) for d in done], np.int32).tobytes(),
        "long_text": [b"".join(piece[x] for x in d).decode("latin-1") for d in done],
    }


def _expand(lens: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Indices that replace each code by its run at[code] .. at[code] + lens[code]."""
    n = lens[codes]
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(at[codes] - first, n)


def _dictionary(slots, hot_lens, hot_flat, own_lens, own_flat):
    """(lengths, flat values) of a block's distinct words, from the hot table and the block's own."""
    hot = slots >= 0
    own = -1 - slots[~hot].astype(np.int64)
    lens = np.empty(len(slots), np.int64)
    lens[hot], lens[~hot] = hot_lens[slots[hot]], own_lens[own]
    out = np.empty(int(lens.sum()), hot_flat.dtype)
    to = np.cumsum(lens) - lens
    hot_at, own_at = np.cumsum(hot_lens, dtype=np.int64) - hot_lens, np.cumsum(own_lens) - own_lens
    for sel, take_lens, at, codes, flat in ((hot, hot_lens, hot_at, slots[hot], hot_flat), (~hot, own_lens, own_at, own, own_flat)):
        if sel.any():
            out[_expand(lens, to, np.flatnonzero(sel))] = flat[_expand(take_lens, at, codes)]
    return lens, out


def _lens(lists) -> np.ndarray:
    f = pc.utf8_length if pa.types.is_string(lists.type) or pa.types.is_large_string(lists.type) else pc.list_value_length
    return f(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _documents(batches, hot, most_words: int = 100_000):
    """(ids of documents, token ids, their cuts, decoded bytes, their cuts), some documents at a time."""
    hot_lens, hot_ids, hot_blens, hot_bytes = hot
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
            codes, slots, per, long_lens, long_ids = (np.frombuffer(row[n].as_py(), np.int32) for n in ("codes", "slots", "lens", "long_lens", "long_ids"))
            enc, dec, long_text = row["enc"].values, row["dec"].values, row["long_text"].values
            own_ids = np.concatenate([enc.flatten().to_numpy(zero_copy_only=False).astype(np.int32), long_ids])
            own_bytes = np.frombuffer("".join([*dec.to_pylist(), *long_text.to_pylist()]).encode("latin-1"), np.uint8)
            lens, all_ids = _dictionary(slots, hot_lens, hot_ids, np.concatenate([_lens(enc), long_lens.astype(np.int64)]), own_ids)
            blens, all_bytes = _dictionary(slots, hot_blens, hot_bytes, np.concatenate([_lens(dec), _lens(long_text)]), own_bytes)
            at, bat = np.cumsum(lens) - lens, np.cumsum(blens) - blens
            ids, ends = row["ids"].as_py(), np.cumsum(per.astype(np.int64))
            a = 0
            while a < len(per):
                base = int(ends[a] - per[a])
                b = max(a + 1, int(np.searchsorted(ends, base + most_words, "right")))
                mine = codes[base : ends[b - 1]]
                ends_in = np.concatenate([[0], ends[a:b] - base])
                yield (
                    ids[a:b],
                    all_ids[_expand(lens, at, mine)],
                    np.concatenate([[0], np.cumsum(lens[mine])])[ends_in],
                    all_bytes[_expand(blens, bat, mine)],
                    np.concatenate([[0], np.cumsum(blens[mine])])[ends_in],
                )
                a = b


def hot_table(texts: DataFrame, ranks: dict[bytes, int], table: DataFrame, most: int, block_mb: int, long_word: int):
    """(hashes, (lengths, ids, byte lengths, bytes)): encodings of at most `most` repeated words, by hash."""
    schema = "word string, n bigint"

    def count(batches):
        for block in blocks_of(batches, block_mb << 20):
            _, starts, ends, codes, text = block.close()
            n = np.bincount(codes, minlength=len(starts))
            keep = np.flatnonzero(ends - starts <= long_word)
            words = [text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]
            for a in range(0, len(keep), 50_000):
                yield pa.RecordBatch.from_pydict({"word": words[a : a + 50_000], "n": n[keep[a : a + 50_000]]})

    counted = written(texts.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least count that leaves at most `most` words, from a histogram of counts
    left, least = 0, NO_RANK
    for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect():
        left += r.c
        if left > most:
            break
        least = r.n

    def lists(batches):
        for words in (batch.column(0) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["w"])

    chosen = counted.filter(F.col("n") >= max(least, 2)).select("word").mapInArrow(lists, "w array<string>")
    made = written(decode_words(encode_words(chosen, "w", "enc", ranks, table), "enc", "dec", ranks, table), "hot")

    def pack(batches):
        for batch in batches:
            words, ids, dec = (batch.column(k).flatten() for k in range(3))
            raw = [w.encode("latin-1") for w in words.to_pylist()]
            ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
            if not len(raw):
                continue
            hashes = textkit.span_hash(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
            parts = (hashes, _lens(ids).astype(np.int32), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), _lens(dec).astype(np.int32))
            text = "".join(dec.to_pylist()).encode("latin-1")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*(p.tobytes() for p in parts), text)], names=["h", "lens", "ids", "blens", "raw"])

    packed = made.select("w", "enc", "dec").mapInArrow(pack, "h binary, lens binary, ids binary, blens binary, raw binary").toArrow()
    h, lens, ids, blens, raw = (np.frombuffer(b"".join(x.as_buffer() for x in packed[k]), t) for k, t in enumerate((np.uint64, np.int32, np.int32, np.int32, np.uint8)))
    del packed
    order = np.argsort(h)
    return h[order], (lens[order], _in_order(ids, lens, order), blens[order], _in_order(raw, blens, order))


def _in_order(flat: np.ndarray, lens: np.ndarray, order: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The runs of flat in another order, some at a time, as their indices take eight bytes an element."""
    at = np.cumsum(lens, dtype=np.int64) - lens
    return np.concatenate([flat[:0], *[flat[_expand(lens, at, order[k : k + step])] for k in range(0, len(order), step)]])


def encoded_blocks(docs: DataFrame, ranks: dict[bytes, int], hot_words: int, block_mb: int, long_word: int):
    """(DataFrame of blocks with their words encoded and decoded, broadcast hot table)."""
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    ranks_value = context.broadcast(ranks)
    table = rank_table(docs.sparkSession, ranks_value)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_word = min(long_word, LONGEST)
    hashes, hot = hot_table(texts, ranks, table, hot_words, block_mb, long_word)
    hashes_value, hot_value = context.broadcast(hashes), context.broadcast(hot)

    def cut(batches):
        for block in blocks_of(batches, block_mb << 20):
            row = _as_row(block, hashes_value.value, lambda: ranks_value.value, long_word)
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_ARROW)

    # written, so that a task has one Python worker at a time and a lost executor does not cut its texts again
    blocks = decode_words(encode_words(written(texts.mapInArrow(cut, _BLOCK), "blocks"), "tail", "enc", ranks, table), "enc", "dec", ranks, table)
    return blocks.drop("tail"), hot_value


def encode(docs: DataFrame, ranks_path: str, hot_words: int = HOT_WORDS, block_mb: int = 6, long_word: int = 256) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: one row per document."""
    ranks = load_ranks(ranks_path)
    blocks, hot_value = encoded_blocks(docs, ranks, hot_words, block_mb, long_word)

    def emit(batches):
        for doc_ids, ids, cut, text, bcut in _documents(batches, hot_value.value):
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)),
                    "decoded": pa.array([text[a:b].tobytes() for a, b in zip(bcut[:-1], bcut[1:])], pa.binary()),
                }
            )

    return blocks.mapInArrow(emit, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, hot_words: int = HOT_WORDS, block_mb: int = 6, long_word: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with digests in place of the arrays."""
    ranks = load_ranks(ranks_path)
    blocks, hot_value = encoded_blocks(docs, ranks, hot_words, block_mb, long_word)

    def emit(batches):
        for doc_ids, ids, cut, text, bcut in _documents(batches, hot_value.value):
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": np.diff(cut).astype(np.int64),
                    "ids_sha256": [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(cut[:-1], cut[1:])],
                    "decoded_sha256": [hashlib.sha256(text[a:b].tobytes()).hexdigest() for a, b in zip(bcut[:-1], bcut[1:])],
                }
            )

    return blocks.mapInArrow(emit, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("codes", pa.binary()), ("slots", pa.binary())]
    + [("tail", pa.list_(pa.string())), ("long_ids", pa.binary()), ("long_lens", pa.binary()), ("long_text", pa.list_(pa.string()))]
)


def op10_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
