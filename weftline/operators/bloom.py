"""A Bloom filter of keys: which keys of one side of a join cannot be on the other side, before anything is shuffled.

Each task sets the bits of its own keys; the words of all tasks are put together by word. The filter has about ``BITS_A_KEY`` bits for each key,
at most ``MOST_BITS`` in all, which bounds what is sent to the driver and to the tasks; for more keys than it could tell apart there is no
filter, and the join goes without."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES, BITS_A_KEY, MOST_BITS = 4, 10, 1 << 27
#: Multipliers of the mixing function.
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def places(windows: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each row of window hashes in a filter of ``bits`` (a power of two)."""
    h = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        h = _mixed(h + column.astype(np.uint64) + np.uint64(1))
    step = _mixed(h) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def may_hold(words: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether a key can be in the filter: true for all that are, and for about one in a hundred of the others."""
    at = places(windows, 64 * len(words))
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def key_filter(keys: DataFrame, num_windows: int) -> np.ndarray | None:
    """The filter of the keys of a table (key), or None if there are too many. The table is read twice, so it should be written."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    bits = 1 << max(6, int(BITS_A_KEY * n).bit_length())
    if bits > MOST_BITS:
        return None

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            data = b"".join(batch.column(0).to_pylist())
            at = places(np.frombuffer(data, ">i8").astype(np.int64).reshape(-1, num_windows), bits).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(words[there].view(np.int64))], names=["word", "value"])

    found = keys.select("key").mapInArrow(run, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out
