"""Terms in texts: runs of letters, digits and other bytes beyond ASCII, as spans of numpy bytes."""

from __future__ import annotations

import numpy as np

from . import textkit

#: ASCII digits and letters, and every byte of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def blanked(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z lower-cased and a space for every byte that is in no term."""
    return np.where(TERM[raw], textkit.lower_ascii(raw), np.uint8(32))


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(blanked bytes, starts, ends, terms per document)."""
    raw = blanked(raw)
    return raw, *textkit.words(raw, offsets)


def cut_long(raw: np.ndarray, offsets: np.ndarray, most: int = textkit.SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with further cuts in documents longer than `most`, each between two terms, and the document of
    each piece. A document without such a place (one endless term) stays whole."""
    long = np.flatnonzero(np.diff(offsets) > most)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    cuts = []
    for d in long:
        at, end = int(offsets[d]) + most, int(offsets[d + 1])
        while at < end:
            gap = next((g for g in range(at, end, most) if not TERM[raw[g : min(end, g + most)]].all()), None)
            if gap is None:
                break
            gap += int(np.argmin(TERM[raw[gap : min(end, gap + most)]]))
            cuts.append(gap)
            at = gap + most
    new = np.sort(np.concatenate([offsets, np.array(cuts, np.int64)]))
    owner = np.searchsorted(np.array(cuts, np.int64), new[:-1], "right")
    return new, np.arange(len(new) - 1) - owner


def span_places(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of all spans, one after the other."""
    first = np.cumsum(lens) - lens
    return np.repeat(starts - first, lens) + np.arange(int(lens.sum()))


def bytes_at(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """raw[start : start + len] of all spans, one after the other."""
    return raw[span_places(starts, lens)]


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each pair of spans of equal, positive length whether their bytes are equal."""
    if not len(lens):
        return np.zeros(0, bool)
    equal = bytes_at(a, a_starts, lens) == bytes_at(b, b_starts, lens)
    return np.logical_and.reduceat(equal, np.cumsum(lens) - lens)
