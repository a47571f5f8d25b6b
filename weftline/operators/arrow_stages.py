"""Stages of the sketch as one row for each strand: what ``sketch`` has as arrays of structs in column functions, from numpy for whole
batches. A strand's rows are counted and hashed in order; they are text for ``ROWS`` rows at a time, so none is held whole as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.config import SketchParams

from .arrow_sketch import _ranges, _symbols, _tandem_runs, both_strands, kmer_hashes, pieces, window_minima

ROWS = 1 << 17
_STRAND = "read_id long, fw boolean, raw_length long"
#: What each stage has beside the strand.
COLUMNS = {
    "eligible": "n_symbols long, n_positions long",
    "masked": "n_symbols long, symbols string, intervals string",
    "tandem": "n_symbols long, intervals string, motifs string",
    "kmers": "n_kmers long, least long, most long, hashes string",
    "minima": "n_windows long, minima string",
    "vectors": "n_positions long, vectors string",
    "emissions": "n_emissions long, emissions string",
}


def _line(*parts) -> pa.Array:
    """Numbers, and texts between them, as one text a row with a comma behind."""
    return pc.binary_join_element_wise(*(pc.cast(pa.array(x), pa.string()) if isinstance(x, np.ndarray) else x for x in parts), ",", "")


def _hex(windows: np.ndarray) -> pa.Array:
    """Window hashes in a row as hex digits."""
    offsets = np.arange(len(windows) + 1, dtype=np.int32) * np.int32(16 * windows.shape[1])
    return pa.Array.from_buffers(pa.string(), len(windows), [None, pa.py_buffer(offsets), pa.py_buffer(windows.astype(">i8").tobytes().hex().encode())])


def _digests(size: np.ndarray, text: Callable[[slice], pa.Array]) -> list[str]:
    """md5 of each strand's rows, joined by commas: ``size`` rows a strand, ``text`` gives some of all rows."""
    bounds = np.concatenate(([0], np.cumsum(size)))
    sums = [hashlib.md5(usedforsecurity=False) for _ in size]
    for low in range(0, int(bounds[-1]), ROWS):
        high = min(low + ROWS, int(bounds[-1]))
        part = text(slice(low, high))
        at, data = np.frombuffer(part.buffers()[1], np.int32), memoryview(part.buffers()[2])
        for i in range(int(np.searchsorted(bounds, low, "right")) - 1, int(np.searchsorted(bounds, high))):
            a, b = max(int(bounds[i]), low), min(int(bounds[i + 1]), high)
            sums[i].update(data[at[a - low] : at[b - low] - (b == bounds[i + 1])])  # no comma behind the last
    return [x.hexdigest() for x in sums]


def _texts(chars: np.ndarray, bounds: np.ndarray) -> pa.Array:
    if chars.dtype == np.uint8:
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(chars.tobytes())])
    return pa.array([chars[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def _intervals(chars: np.ndarray, at: np.ndarray, starts: np.ndarray, first: np.ndarray) -> list[str]:
    """The raw intervals of all symbols."""
    own, after = np.repeat(at[:-1], np.diff(first)), np.append(starts[1:], len(chars))
    return _digests(np.diff(first), lambda r: _line(starts[r] - own[r], "-", after[r] - 1 - own[r]))


def stage_of(chars: np.ndarray, at: np.ndarray, p: SketchParams, stage: str) -> tuple[np.ndarray, list]:
    """The strands that have rows in a stage, of those that lie end to end, and the columns of the stage."""
    if stage == "tandem":
        starts, motif = _tandem_runs(chars, at)
        first = np.searchsorted(starts, at)
        there, size = np.flatnonzero(np.diff(first)), np.diff(first)
        found = _intervals(chars, at, starts, first), _digests(size, lambda r: _line(motif[r]))
        return there, [size[there], *([x[i] for i in there] for x in found)]
    codes, starts = _symbols(chars, at, p.mask)
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    if stage == "masked":
        there, found = np.flatnonzero(n), _intervals(chars, at, starts, first)
        return there, [n[there], _texts(chars[starts], first).take(pa.array(there)), [found[i] for i in there]]
    there = np.flatnonzero(n >= p.span)
    n, low = n[there], first[there]
    if stage == "eligible" or not len(there):
        return there, [n, n - p.span + 1] if stage == "eligible" else [[] for _ in COLUMNS[stage].split(",")]
    h = kmer_hashes(codes, p.k)  # those over the end of a strand are in no row
    if stage == "kmers":
        size = n - p.k + 1
        rows, begin = h[_ranges(low, size)], np.cumsum(size) - size
        return there, [size, np.minimum.reduceat(rows, begin), np.maximum.reduceat(rows, begin), _digests(size, lambda r: _line(rows[r]))]
    best, where = window_minima(h, p.window_size + 1)
    size = n - (p.k + p.window_size if stage == "minima" else p.span) + 1
    rows, base = _ranges(low, size), np.repeat(low, size)
    if stage == "minima":
        return there, [size, _digests(size, lambda r: _line(best[rows[r]], ":", where[rows[r]] - base[r]))]
    shift = [j * p.window_size for j in range(p.num_windows)]
    new = np.ones(len(rows), bool)
    if stage == "emissions":
        new[1:] = np.logical_or.reduce([best[rows[1:] + j] != best[rows[:-1] + j] for j in shift])
        begin = np.cumsum(size) - size
        new[begin] = True
        size = np.add.reduceat(new, begin, dtype=np.int64)
        rows, base = rows[new], base[new]

    def text(r: slice) -> pa.Array:
        at, own = rows[r], base[r]
        vector = _hex(np.stack([best[at + j] for j in shift], axis=1)), ":", where[at] - own, ":", where[at + shift[-1]] - own
        return _line(at - own, ":", *vector) if stage == "emissions" else _line(*vector)

    return there, [size, _digests(size, text)]


def stages(reads: DataFrame, p: SketchParams, stage: str) -> DataFrame:
    """(read_id, fw, raw_length) of both strands of each read, with the columns of a stage; strands without a row of it are left out."""
    if stage == "masked" and p.mask == "microsat":
        raise ValueError("symbols of the microsat mask are the stage tandem")
    names = [c.split()[0] for c in f"{_STRAND}, {COLUMNS[stage]}".split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS[stage].split(", ")]

    def run(batches):
        for batch in batches:
            for row, stop, chars, at in pieces(batch, "sequence"):
                there, columns = stage_of(*both_strands(chars, at), p, stage)
                fw = there < stop - row
                own = pa.array(row + np.where(fw, there, 2 * (stop - row) - 1 - there))
                found = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("read_id").take(own), pa.array(fw), batch.column("raw_length").take(own), *found], names=names)

    return reads.select("read_id", "raw_length", "sequence").mapInArrow(run, f"{_STRAND}, {COLUMNS[stage]}")


# two bits a symbol as in ``functions.sequence``, for whole batches

_CODES = np.full(256, 255, np.uint8)
_CODES[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_PACKED = "read_id long, raw_length long, valid boolean, packed binary"


def packed_reads(reads: DataFrame) -> DataFrame:
    """(read_id, raw_length, valid, packed): sequences at two bits a symbol; null where there is another letter than ACGT in either case."""

    def run(batches):
        for batch in batches:
            for row, stop, chars, at in pieces(batch, "sequence"):
                codes = _CODES[np.minimum(chars, 255).astype(np.uint8)]
                wrong = np.concatenate(([0], np.cumsum(codes == 255)))[at]
                null = batch.column("sequence").slice(row, stop - row).is_null().to_numpy(zero_copy_only=False)
                valid, size = wrong[1:] == wrong[:-1], np.diff(at)
                begin = np.concatenate(([0], np.cumsum(-(-size // 4))))
                whole = np.zeros(4 * int(begin[-1]), np.uint8)
                whole[_ranges(4 * begin[:-1], size)] = codes & 3
                four = whole.reshape(-1, 4)
                data = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
                packed = pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(data.tobytes())])
                packed, same = pc.if_else(pa.array(valid & ~null), packed, None), batch.slice(row, stop - row)
                yield pa.RecordBatch.from_arrays([same.column("read_id"), same.column("raw_length"), pa.array(valid, mask=null), packed], names=["read_id", "raw_length", "valid", "packed"])

    return reads.select("read_id", "raw_length", "sequence").mapInArrow(run, _PACKED)


def unpacked_reads(packed: DataFrame, start: int, length: int) -> DataFrame:
    """Packed reads with their ``decoded`` sequence, and ``piece``: ``length`` symbols of it from ``start`` (from 0)."""

    def run(batches):
        for batch in batches:
            data = pc.fill_null(batch.column("packed"), b"")
            bytes_of = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            begin = 4 * np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            symbols = _LETTERS[np.stack([bytes_of >> 2 * i & 3 for i in range(4)], axis=1).ravel()]
            there = batch.column("packed").is_valid()
            size = np.where(there.to_numpy(zero_copy_only=False), pc.fill_null(batch.column("raw_length"), 0).to_numpy(zero_copy_only=False), 0)

            def cut(low, n):
                found = _texts(symbols[_ranges(low, n)], np.concatenate(([0], np.cumsum(n))))  # noqa: B023
                return pc.if_else(there, found, None)  # noqa: B023

            columns = [*batch.columns, cut(begin[:-1], size), cut(begin[:-1] + start, np.clip(size - start, 0, length))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded", "piece"])

    return packed.select("read_id", "raw_length", "valid", "packed").mapInArrow(run, f"{_PACKED}, decoded string, piece string")
