"""Words and their hashes for whole Arrow batches of texts, with numpy: no Python loop over words or characters.

Texts are handled as UTF-8 bytes in pieces of about ``PIECE`` bytes (a longer text is a piece of its own), so memory is
bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each bit of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    full = 1 << max(16, int(size - 1).bit_length())
    return _powers(full)


def pieces(texts: pa.Array):
    """(first row, bytes, offsets) of pieces of a string column; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, o, d = texts.buffers()
    offsets = np.frombuffer(o, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (one more at the end)."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word, from prefix sums of a polynomial over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; the caller leaves out runs that reach into the next text."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out + words[k : k + len(out)]) * _BASE
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each text the sorted distinct hashes of its shingles: all runs of ``width`` words (A-Z lower-cased), the
    whole sequence if it has fewer words, nothing if it has none."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    runs = shingle_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            yield shingle_hashes(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)
