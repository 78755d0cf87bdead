"""Whole texts as byte arrays: words, pre-tokens and their 64-bit hashes in numpy.

Nothing here knows Spark. Texts come as an Arrow string column (a null counts
as an empty text) and are handled in slices of about SLICE bytes of whole
documents, so memory follows the slice and the longest single document.
Words are told apart by 64-bit hashes: two of d distinct words share one with
probability about d * d / 2**65.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _C1
    h = h ^ (h >> np.uint64(27))
    h = h * _C2
    return h ^ (h >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 2 * len(_powers)), _M)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers[:n]


def columns_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(raw: np.ndarray, offsets: np.ndarray, most: int = SLICE):
    """Runs of whole documents of at most `most` bytes (or one longer document):
    (first row, last row + 1, bytes, offsets within them)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], all spans non-empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    total = int(first[-1] + lens[-1])
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    terms = (raw[np.repeat(starts, lens) + within].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()) + 1)[within]
    return mix64(np.add.reduceat(terms, first) ^ (lens.astype(np.uint64) << np.uint64(56)))


_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D: starts, ends and words per document."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_WS[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    per = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per


#: Characters of the Unicode property White_Space (fixed values).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
LETTER, NUMBER, OTHER, SPACE = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the matches of the byte-level BPE split pattern
    (contractions, optional space + letters / numbers / others, white space that
    leaves its last character to what follows), and their number per document."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    cls = _classes()[cp]
    docs = np.searchsorted(at, offsets)
    first = np.zeros(n + 1, bool)
    first[docs] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    space = cls == SPACE
    # a run after a plain space takes that space along
    glued = np.zeros(n, bool)
    glued[1:] = start[1:] & ~space[1:] & (cp[:-1] == 32) & ~first[1:n]
    # the last character of white space before something else stands apart
    apart = np.zeros(n, bool)
    apart[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    cut = (start & ~glued) | apart
    quote = np.flatnonzero(cut & (cp == 39))
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        stop = np.concatenate([first, np.ones(3, bool)])
        q = quote[~stop[quote + 1]]
        a, b = pad[q + 1], pad[q + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & ~stop[q + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for sel, k in ((q[one], 2), (q[two], 3)):
            cut[sel + 1] = False
            rest = sel + k
            cut[rest[rest < n]] = True
    begin = np.flatnonzero(cut)
    starts = at[begin]
    ends = np.append(starts[1:], len(raw))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
