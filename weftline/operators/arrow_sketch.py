"""The sketch of many strands at once with numpy: what ``sketch.emissions`` says in column functions, many times faster.

The strands of an Arrow batch are taken in pieces of about ``PIECE`` bytes and laid end to end. Masks are run boundaries,
k-mer hashes are put together from those of halves, window minima are doubled, and a position counts where a
window's hash changes: array operations over the whole piece, no loop over symbols, k-mers or strands. Hashes and minima are made for blocks of window positions, so a long
strand needs its letters, and a number and a place for each symbol, and nothing else of its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.config import SketchParams
from weftline.functions.rolling import BASES, PRIME, SYMBOL_BASE

from .bloom import may_hold

PIECE = 1 << 18
#: Fixed value: letters of the longest motif of the ``microsat`` mask.
MOTIF = 6
#: Bytes of the other strand.
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCAtgca")
SCHEMA = "key binary, read_id long, fw boolean, start long, end long, raw_length long, place long"


def _residue(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for x below 2^62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    return x


def kmer_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all rows of ``k`` neighbouring codes."""
    out = []
    for base in BASES:
        power, have, whole, size = codes, 1, None, 0
        while True:
            if k & have:  # k as a sum of powers of two, smallest first
                n = len(power) - size
                whole = power if whole is None else _residue(whole[:n] * pow(base, have, PRIME) + power[size:])
                size += have
            if have * 2 > k:
                break
            power = _residue(power[:-have] * pow(base, have, PRIME) + power[have:])
            have *= 2
        squared = _residue(whole * whole)
        out.append(_residue(_residue(squared * squared) * whole))
    return (out[0] << 31) + out[1]


def _chars(texts: pa.Array, row: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts end to end, and where each begins (one more at the end); bytes where all are ASCII."""
    part = pc.fill_null(texts.slice(row, stop - row), "")
    size = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    data = part.buffers()[2]
    if data is not None and at[-1]:
        begin = int(np.frombuffer(part.buffers()[1], np.int32)[part.offset])
        chars = np.frombuffer(data, np.uint8)[begin : begin + at[-1]]
        if chars.max() < 128:
            return chars, at
    texts = part.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _tandem_runs(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tandem runs of the shortest motif of up to ``MOTIF`` letters, or single letters, from left to right: where they begin, and the
    letters of their motifs.

    Where a text equals itself moved by m letters for at least m letters in a row, a motif of m letters is repeated. So each place has the
    length of the run that would begin there; runs that do begin are those that are reached from the strand's start, which doubling of
    steps finds."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.repeat(at[1:], np.diff(at))  # the end of each letter's strand
    places, motif, length = np.arange(n), np.ones(n, np.int64), np.ones(n, np.int64)
    for m in range(min(MOTIF, n - 1), 0, -1):  # a shorter motif goes before
        same = np.zeros(n, bool)
        same[:-m] = (chars[m:] == chars[:-m]) & (places[:-m] + m < stop[:-m])
        # how many letters from each place on equal those m further
        ends = np.where(same, n, places)
        equal = np.minimum.accumulate(ends[::-1])[::-1] - places
        again = equal >= m
        motif[again], length[again] = m, m * (1 + equal[again] // m)
    begins = np.zeros(n + 1, bool)
    begins[at[:-1][np.diff(at) > 0]] = True
    step = np.append(np.minimum(places + length, stop), n)
    last = np.flatnonzero(step[:-1] == stop)
    step[last] = n  # strands end here; the next begins on its own
    reached = -1
    while (count := int(begins.sum())) != reached:
        reached = count
        begins[step[np.flatnonzero(begins)]] = True
        step = step[step]
    starts = np.flatnonzero(begins[:-1])
    return starts, motif[starts]


def _symbols(chars: np.ndarray, at: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the symbols of strands end to end, and where each begins in ``chars``."""
    if mask == "microsat":
        starts, size = _tandem_runs(chars, at)
        codes = np.zeros(len(starts), np.int64)  # polynomials of the letters of a motif and a final dot
        for i in range(MOTIF):
            there = size > i
            codes[there] = (codes[there] * SYMBOL_BASE + chars[starts[there] + i].astype(np.int64)) % PRIME
        return (codes * SYMBOL_BASE + ord(".")) % PRIME, starts
    first = np.ones(len(chars), bool)
    if mask == "hpc":
        first[1:] = chars[1:] != chars[:-1]
        first[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(first)
    return chars[starts].astype(np.int64), starts


def both_strands(chars: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that lie end to end, followed by their reverse complements, of which the last sequence's is the first."""
    turned = _COMPLEMENT[chars[::-1]] if chars.dtype == np.uint8 else np.where(chars[::-1] < 128, _COMPLEMENT[chars[::-1] & 127], chars[::-1])
    return np.concatenate((chars, turned.astype(chars.dtype))), np.concatenate((at, 2 * at[-1] - at[-2::-1]))


def pieces(batch: pa.RecordBatch, column: str):
    """The rows of a batch in parts of about ``PIECE`` bytes of a text column: (first row, row after the last, code points, bounds)."""
    texts, row = batch.column(column), 0
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(upto, upto[row] + PIECE, "right")) - 1)
        yield row, stop, *_chars(texts, row, stop)
        row = stop


def tandem_runs(strands: DataFrame) -> DataFrame:
    """(read_id, fw, raw_length, starts, motifs): the symbols of the ``microsat`` mask of each strand."""

    def run(batches):
        for batch in batches:
            for row, stop, chars, at in pieces(batch, "seq"):
                starts, motif = _tandem_runs(chars, at)
                bounds = np.searchsorted(starts, at)
                own = starts - np.repeat(at[:-1], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (own, motif)]
                part = batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("read_id", "fw", "raw_length")), *lists], names=["read_id", "fw", "raw_length", "starts", "motifs"])

    return strands.select("read_id", "fw", "raw_length", "seq").mapInArrow(run, "read_id long, fw boolean, raw_length long, starts array<long>, motifs array<long>")


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(low - before, size) + np.arange(size.sum())


def window_minima(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each ``width`` neighbours and where it is; of equal ones the left one."""
    best, where, have = h, np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        right = best[step:] < best[:-step]
        best, where = np.where(right, best[step:], best[:-step]), np.where(right, where[step:], where[:-step])
        have += step
    return best, where


def sketch_strands(chars: np.ndarray, at: np.ndarray, p: SketchParams):
    """(strand, windows, start, end, place) of the chunks of strands that lie end to end in ``chars``, each chunk of a
    strand once: window hashes, raw start and end (inclusive), and the symbol at the start, the last three within the strand."""
    codes, starts = _symbols(chars, at, p.mask)
    first = np.searchsorted(starts, at)
    shifts = np.diff(first) - p.span + 1
    strand = np.flatnonzero(shifts > 0)
    # segments: a block of window positions with the position before it, if there is one, and the symbols that it needs
    blocks = -(-shifts[strand] // p.block)
    owner, number = np.repeat(strand, blocks), _ranges(np.zeros(len(strand), np.int64), blocks)
    low = np.maximum(number * p.block - 1, 0)
    size = np.minimum((number + 1) * p.block, shifts[owner]) - low + p.span - 1
    group = np.cumsum(size) // max(p.block, PIECE)
    parts = []
    for g in np.unique(group):
        s = np.flatnonzero(group == g)
        place = _ranges(first[owner[s]] + low[s], size[s])
        begin = np.cumsum(size[s]) - size[s]
        h = kmer_hashes(codes[place], p.k)
        best, where = window_minima(h, p.window_size + 1)
        positions = _ranges(begin, size[s] - p.span + 1)
        windows = np.stack([best[positions + j * p.window_size] for j in range(p.num_windows)], axis=1)
        new = np.ones(len(positions), bool)
        new[1:] = (windows[1:] != windows[:-1]).any(axis=1)
        count = size[s] - p.span + 1
        head = np.cumsum(count) - count
        new[head] = number[s] == 0  # the first position of a strand; in later blocks it is there for comparison only
        positions = positions[new]
        a, z = place[where[positions]], place[where[positions + (p.num_windows - 1) * p.window_size] + p.k - 1]
        parts.append((np.repeat(owner[s], count)[new], windows[new], a, z))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, np.zeros((0, p.num_windows), np.int64), none, none, none
    owner, windows, a, z = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((*windows.T, z, a, owner))
    owner, windows, a, z = owner[order], windows[order], a[order], z[order]
    once = np.ones(len(owner), bool)
    once[1:] = (owner[1:] != owner[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1]) | (windows[1:] != windows[:-1]).any(axis=1)
    owner, windows, a, z = owner[once], windows[once], a[once], z[once]
    after = np.append(starts[1:], len(chars))
    return owner, windows, starts[a] - at[owner], after[z] - 1 - at[owner], a - first[owner]


def _keys(windows: np.ndarray) -> pa.Array:
    """Window hashes in a row, the first byte of each the highest."""
    width = 8 * windows.shape[1]
    offsets = np.arange(len(windows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(windows), [None, pa.py_buffer(offsets), pa.py_buffer(windows.astype(">i8").tobytes())])


def sketched(reads: DataFrame, p: SketchParams, keep: np.ndarray | None = None, both: bool = True, only: tuple[str, ...] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of both strands of reads (read_id, raw_length, sequence), or of the forward ones. ``keep``: a ``bloom.key_filter``; chunks whose
    key cannot be in it do not leave the task. ``only``: the columns that are needed; others are not made. ``carried``: more columns
    of the reads that their chunks have too."""
    kinds = dict(reads.select(*carried).dtypes)
    schema = {c.split()[0]: c for c in [*SCHEMA.split(", "), *(f"{c} {kinds[c]}" for c in carried)] if only is None or c.split()[0] in (*only, *carried)}
    words = None if keep is None else reads.sparkSession.sparkContext.broadcast(keep)  # its size is bounded

    def run(batches):
        for batch in batches:
            for row, stop, chars, at in pieces(batch, "sequence"):
                n = stop - row
                strand, windows, start, end, place = sketch_strands(*(both_strands(chars, at) if both else (chars, at)), p)
                if words is not None:
                    there = may_hold(words.value, windows)
                    strand, windows, start, end, place = (x[there] for x in (strand, windows, start, end, place))
                fw = strand < n
                own = pa.array(row + np.where(fw, strand, 2 * n - 1 - strand))
                made = {"key": lambda: _keys(windows), "fw": lambda: pa.array(fw), "start": lambda: pa.array(start, pa.int64()), "end": lambda: pa.array(end, pa.int64()), "place": lambda: pa.array(place, pa.int64())}  # noqa: B023
                yield pa.RecordBatch.from_arrays([made[c]() if c in made else batch.column(c).take(own) for c in schema], names=list(schema))

    return reads.select("read_id", "raw_length", "sequence", *carried).mapInArrow(run, ", ".join(schema.values()))
