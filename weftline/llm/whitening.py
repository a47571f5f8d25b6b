"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance of the vectors is never made. A block Q of orthonormal columns is multiplied by it in one Spark pass: every task
adds up Xᵀ(XQ) over its rows, centred first, and the driver gets the sum, as large as the block. Rayleigh-Ritz on the block
(the eigenvectors of Qᵀ times the product) gives approximate eigenvectors and, from the same product, their residuals. QR of the
product is the next block. It ends when the residuals of all components are below ``TOLERANCE`` of the largest eigenvalue,
which bounds the error of each eigenvalue by as much. The block has twice as many columns as components are asked for, at most one for each
dimension; where residuals fall too slowly, as with eigenvalues close together at the block's end, it is doubled, and a block of all
dimensions is exact in one pass. So the number of passes does not grow with the data, and the driver holds block by dimension numbers.

Vectors that are null or hold null or non-finite components are left out. Vectors of different lengths: shorter ones are continued
with zeros. Components times 64 beyond 2^40 in size are held there. Centred values are exact multiples of 1 / n before they are rounded
to doubles. Directions whose variance is below ``LEAST`` of the largest cannot be told from rounding and give no component: equal vectors
or a single one give no rows, nor does an empty table. Equal eigenvalues have no eigenvectors of their own; any basis of their space is
right, and all rows use the same. Repeated rows and null ids count like others. Long vectors are only limited by the block in the driver. Of
the input the id and the vector are read, so other columns may have any name. ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import finite, floors, summed

COMPONENTS = 32
#: Fixed value: what is added to the floor of each component.
SHIFT = 1_000_000
LIMIT = 1 << 40
#: Residuals, as a share of the largest eigenvalue, at which a component is certified.
TOLERANCE = 1e-13
#: Passes that a block may need still, by the pace of its residuals, before it is doubled.
PATIENCE = 12
LEAST = 1e-11
SEED = 7
_LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with component sums ``sums``; unit eigenvectors in the columns of ``axes`` by falling ``values``;
    ``trace`` of the covariance; ``residual``: the largest one that was left, as a share of the largest eigenvalue."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    def scaled(self) -> np.ndarray:
        return self.axes / np.sqrt(self.values)


def integers(matrix: np.ndarray) -> np.ndarray:
    return floors(matrix, LIMIT) + SHIFT


def times_n(x: np.ndarray, n: int, sums) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers, or Python's where those could overflow."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    near = x - base
    if n * (int(np.abs(near).max(initial=0)) + 1) >= 1 << 62:
        near, rest = near.astype(object), rest.astype(object)
    return near * n - rest


def squares(centred: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null beyond a long."""
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] <= _LONGEST:
        return (centred * centred).sum(axis=1).tolist()
    wide = centred.astype(object)
    return [s if s <= _LONGEST else None for s in (wide * wide).sum(axis=1).tolist()]


def totals(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """(n, sums): how many vectors remain and the exact sum of each dimension."""

    def run(batches):
        n, sums, of = 0, np.zeros(0, object), np.zeros(0, np.int64)
        for batch in batches:
            rows, m = finite(batch.column(0))
            n += len(rows)
            if m.shape[1] > len(sums):
                more = m.shape[1] - len(sums)
                sums, of = np.append(sums, np.zeros(more, object)), np.append(of, np.zeros(more, np.int64))
            # short vectors end in zeros here, which the sum over all then counts as it counts those of other tasks
            sums[: m.shape[1]] += integers(m).sum(axis=0).astype(object)
            of[: m.shape[1]] += len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(sums))], pa.int32()), pa.array(["0", *map(str, sums)], pa.string()), pa.array([n, *of.tolist()], pa.int64())], names=["dimension", "total", "of"]
        )

    found = vectors.mapInArrow(run, "dimension int, total string, of long").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("of").alias("of")).collect()
    by = {r["dimension"]: (int(r["total"]), r["of"]) for r in found}
    n = by.pop(-1, (0, 0))[1]
    return n, tuple(by[d][0] + SHIFT * (n - by[d][1]) for d in range(len(by)))


def leading(multiply: Callable[[np.ndarray], np.ndarray], width: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest eigenvalues of a symmetric matrix and their eigenvectors, of which only products with a block are
    known: (values, vectors, largest residual, passes)."""
    rng, k = np.random.default_rng(seed), min(k, width)
    size, last, passes = min(width, 2 * k), np.inf, 0
    block = np.linalg.qr(rng.standard_normal((width, size)))[0]
    while True:
        product, passes = multiply(block), passes + 1
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, product = block @ turn, product @ turn
        if values[0] <= 0:
            return values[:k], ritz[:, :k], 0.0, passes
        worst = float(np.linalg.norm(product - ritz * values, axis=0)[:k].max() / values[0])
        if worst <= TOLERANCE or size == width and passes > 1 or size == width and worst <= 100 * TOLERANCE:
            return values[:k], ritz[:, :k], worst, passes
        pace = worst / last
        if np.isfinite(last) and (pace >= 1 or np.log(TOLERANCE / worst) / np.log(pace) > PATIENCE):
            product = np.hstack([product, rng.standard_normal((width, min(width, 2 * size) - size)) * values[0]])
            size, worst = product.shape[1], np.inf
        last, block = worst, np.linalg.qr(product)[0]


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening:
    """The whitening of ``vectors`` (one list column): a pass for the sums, then one for each product."""
    n, sums = totals(vectors)
    width = len(sums)
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    trace = 0.0

    def multiply(block: np.ndarray) -> np.ndarray:
        nonlocal trace
        wide = block.shape[1]

        def part(batches):
            for batch in batches:
                _, m = finite(batch.column(0), width)
                d = times_n(integers(m), n, sums).astype(np.float64) / n
                yield np.append((d.T @ (d @ block)).ravel(), (d * d).sum())

        out = summed(vectors, part, width * wide + 1) / n
        trace = float(out[-1])
        return out[:-1].reshape(width, wide)

    values, axes, residual, passes = leading(multiply, width, k)
    there = values > LEAST * max(values[0], 0)
    return Whitening(n, sums, axes[:, there], values[there], trace, residual, passes)


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of whitened vectors less the identity, by a pass over all of them."""
    k, width, scaled = len(w.values), len(w.sums), w.scaled()
    if not k:
        return 0.0

    def part(batches):
        for batch in batches:
            _, m = finite(batch.column(0), width)
            y = times_n(integers(m), w.n, w.sums).astype(np.float64) / w.n @ scaled
            yield np.append((y.T @ y).ravel(), y.sum(axis=0))

    out = summed(vectors, part, k * k + k) / w.n
    mean = out[k * k :]
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    vectors = table.select(vector_col)
    w = fit(vectors, k)
    error, scaled, width = identity_error(vectors, w), w.scaled(), len(w.sums)
    wide, explained = len(w.values), w.values / w.trace if len(w.values) else w.values
    kind = table.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, m = finite(batch.column(1), width)
            if not len(rows) or not wide:
                continue
            centred = times_n(integers(m), w.n, w.sums)
            y = centred.astype(np.float64) / w.n @ scaled
            own, size = np.repeat(np.arange(len(rows)), wide), len(rows) * wide
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[own])), pa.array(np.tile(np.arange(1, wide + 1), len(rows)), pa.int32()), pa.array(np.full(size, w.n), pa.int64()),
                    pa.array(squares(centred), pa.int64()).take(pa.array(own)), pa.array(y.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(size, error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return table.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
