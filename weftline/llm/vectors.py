"""Vectors of Arrow batches as matrices of integers, and sums over all tasks of small matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a component is multiplied by before its floor is taken.
SCALE = 64


def finite(column: pa.Array, width: int | None = None, exactly: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the places of the vectors of a list column that are not null and hold neither nulls nor values that are
    not finite, and their components as doubles. Vectors shorter than ``width`` (by default the longest) are continued with zeros;
    ``exactly`` leaves those out that do not have just ``width`` components."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    stop = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = np.asarray(column.is_valid()) & (bad[stop] == bad[stop - size])
    if exactly:
        good &= size == width
    rows = np.flatnonzero(good)
    width = int(size[rows].max(initial=0)) if width is None else width
    if len(rows) == len(size) and (size == width).all():
        return rows, flat.reshape(len(rows), width)
    out, n = np.zeros((len(rows), width)), size[rows]
    line = np.repeat(np.arange(len(rows)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[line, place] = flat[np.repeat(stop[rows] - n, n) + place]
    return rows, out


def floors(matrix: np.ndarray, limit: int) -> np.ndarray:
    """floor(64 * c) of each component as a 64-bit integer; what is beyond ``limit`` in size is held there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * matrix), -limit, limit).astype(np.int64)


def summed(rows: DataFrame, part: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """The sum of the arrays of ``cells`` doubles that ``part`` gives for the batches of each task. Each task adds its own
    up first; sums over tasks are made by cell in a shuffle, so the driver gets one number a cell."""

    def run(batches):
        total = np.zeros(cells)
        for x in part(batches):
            total += x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["cell", "value"])

    found = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["value"].to_numpy()
    return out
