"""Which numbers cannot be in a table: a Bloom filter that keeps rows which a join would drop out of its shuffle.

Each task sets two bits for each of its numbers; the words of all tasks are put together by word. The filter has ``BITS_EACH`` bits for a number, rounded up to a power
of two, and ``MOST_BITS`` at most (16 MB), which bounds what goes to the driver and to the tasks whatever the table's size. It only says
"cannot be there" or "may be there", so an exact join follows, at once or in a later step, and results do not depend on it. A table of more numbers than
``MOST_BITS`` has no filter, as most numbers would pass.

Nulls of the table set nothing, and a null that is asked for cannot be there. Repeated numbers and ties set the same bits again. An empty table
has an empty filter. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec

BITS_EACH, MOST_BITS = 12, 1 << 27


def _places(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = textvec.mix(x.view(np.uint64))
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def may_hold(words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each number of ``x`` (int64) can be in the filter."""
    out = np.ones(len(x), bool)
    for at in _places(x, 64 * len(words)):
        out &= ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return out


def members(table: DataFrame, name: str):
    """The filter of the numbers in a column, as a broadcast variable, or None if there are too many. The table is read twice, so it
    should be written."""
    n = table.count()
    if n > MOST_BITS:
        return None
    bits = max(64, min(MOST_BITS, 1 << (BITS_EACH * n).bit_length()))

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(words[there].view(np.int64))], names=["word", "value"])

    numbers = table.select(F.col(name).cast("long").alias("x")).where("x is not null")
    found = numbers.mapInArrow(run, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return table.sparkSession.sparkContext.broadcast(out)


def may_be_in(column: Column, filter_) -> Column:
    """Whether a number can be in the filter; only this column goes to Python."""

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(may_hold(filter_.value, x.to_numpy(np.int64)))

    return column.isNotNull() & test(F.coalesce(column, F.lit(0).cast("long")))
