"""Centroid clustering with Yinyang filters: the rows of Lloyd's algorithm on integers, with most distances left out.

Centroids are put into groups once. Each vector keeps an upper bound of the distance to its own centroid and, for each group, a lower
bound of the distances to the group's other centroids. After centroids have moved, the upper bound grows by the move of the own centroid
and each lower bound falls by the largest move of its group. A vector whose upper bound is below all lower bounds stays where it is
(the global filter; if not, its own distance is measured and it is asked again). Otherwise the groups whose bound is not above the
distance are scanned exactly, and no others (the group filter). Distances are exact integers; bounds are doubles rounded to the safe side,
and a vector is only spared if its centroid is strictly nearer, so ties go to the smaller number as in a full scan.

The vectors with their bounds are a table in the shared folder, written once a round; sums and counts of clusters are added up by
task and then by cell, so a cluster with a third of all vectors is a few numbers of each task. The driver holds centroids: ``k`` times the
dimensions.

Vectors that do not have ``width`` components, or hold null or non-finite ones, are left out. Components times 64 beyond 2^27 in size
are held there, so that distances fit a long. Centroids start as the ``k`` vectors with the smallest hashes of their ids; ids that are equal are put in
order by their vectors, null ids come last; with fewer vectors there are fewer centroids. An empty cluster keeps its centroid. An empty table
gives an empty one; repeated rows count as often as they are there. Of the input the id and the vector are read, so other columns may have any
name. ``inertia`` is null where it does not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash
from .vectors import finite, floors

K, ROUNDS, WIDTH = 16, 3, 64
LIMIT = 1 << 27
#: Centroids of a group, about.
GROUP = 4
#: The share by which bounds are moved to the safe side after each operation.
SLACK = 1e-12
_EXACT = 1 << 53


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` to rows of ``c``."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if x.shape[1] * most * most < _EXACT:  # all sums are exact as doubles, whose products are much faster
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering the centroids themselves. It changes work and no result."""
    if groups <= 1:
        return np.zeros(len(centroids), int)
    c = centroids.astype(np.float64)
    heads = c[np.linspace(0, len(c) - 1, groups).astype(int)]
    for _ in range(5):
        own = ((c[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        heads = np.stack([c[own == g].mean(axis=0) if (own == g).any() else heads[g] for g in range(groups)])
    return np.unique(own, return_inverse=True)[1]


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower, scanned) after the bounds have been moved: the nearest centroid of each row, its bounds, and the number
    of distances that were measured. ``own`` is -1 for rows that have no centroid yet."""
    own, upper, lower, scanned = own.copy(), upper.copy(), lower.copy(), np.zeros(len(x), np.int64)
    at = np.flatnonzero((own < 0) | (upper >= lower.min(axis=1)))
    best = np.full(len(x), np.iinfo(np.int64).max)
    old = own.copy()
    have = at[own[at] >= 0]
    if len(have):  # the distance to the own centroid, which may be enough
        d = np.empty(len(have), np.int64)
        for j in np.unique(own[have]):
            mine = own[have] == j
            d[mine] = distances(x[have[mine]], c[j : j + 1])[:, 0]
        best[have], upper[have], scanned[have] = d, np.sqrt(d.astype(np.float64)) * (1 + SLACK), 1
        at = at[(own[at] < 0) | (upper[at] >= lower[at].min(axis=1))]
    first = best.copy()
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(lower.shape[1]):
        members = np.flatnonzero(group == g)
        rows = at[(own[at] < 0) | (lower[at, g] <= upper[at])]
        if not len(rows):
            continue
        d = distances(x[rows], c[members])
        scanned[rows] += len(members)
        place = d.argmin(axis=1)  # of equal ones the smaller number
        near, which = d[np.arange(len(rows)), place], members[place]
        better = (near < best[rows]) | ((near == best[rows]) & (which < own[rows])) | (own[rows] < 0)
        moved = rows[better]
        own[moved], best[moved] = which[better], near[better]
        upper[moved] = np.sqrt(near[better].astype(np.float64)) * (1 + SLACK)
        seen.append((rows, members, d))
    for rows, members, d in seen:  # the nearest other centroid of each group that was scanned
        d = np.where(members[None] == own[rows][:, None], np.iinfo(np.int64).max, d)
        lower[rows, group[members[0]]] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)
    left = np.flatnonzero((old >= 0) & (own != old))  # the centroid that was left is one of its group's others now
    if len(left):
        g = group[old[left]]
        lower[left, g] = np.minimum(lower[left, g], np.sqrt(first[left].astype(np.float64)) * (1 - SLACK))
    return own, upper, lower, scanned


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel(), kind))


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, x) of the vectors that are kept."""

    def run(batches):
        for batch in batches:
            rows, m = finite(batch.column(1), width, exactly=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), _lists(floors(m, LIMIT), pa.int32())], names=[id_col, "x"])

    return table.select(id_col, vector_col).mapInArrow(run, f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, x array<int>")


def _round(state: DataFrame, id_col: str, c: np.ndarray, group: np.ndarray, moves: np.ndarray | None) -> DataFrame:
    """One assignment of all vectors; ``moves`` of the centroids since the last one, None in the first."""
    groups = int(group.max()) + 1
    most = None if moves is None else np.array([moves[group == g].max() for g in range(groups)])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _matrix(batch.column("x"), np.int64), batch.num_rows
            if moves is None:
                own, upper, lower, before = np.full(n, -1), np.full(n, np.inf), np.zeros((n, groups)), np.zeros(n, np.int64)
            else:
                own, before = batch.column("cluster").to_numpy().astype(np.int64), batch.column("scanned").to_numpy()
                upper, lower = batch.column("upper").to_numpy(), _matrix(batch.column("lower"), np.float64)
                upper = (upper + moves[own]) * (1 + SLACK)
                lower = np.maximum(lower - most - SLACK * (lower + most), 0)
            own, upper, lower, scanned = assign(x, own, upper, lower, c, group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("x"), pa.array(own, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(before + scanned, pa.int64())], names=[id_col, "x", "cluster", "upper", "lower", "scanned"]
            )

    return state.mapInArrow(run, f"`{id_col}` {state.schema[id_col].dataType.simpleString()}, x array<int>, cluster int, upper double, lower array<double>, scanned long")


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Centroids after their vectors: the floor of sum by count, exactly; an empty one stays."""
    k, width = c.shape

    def run(batches):
        sums, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            own, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"), np.int64)
            for j in np.unique(own):
                mine = x[own == j]
                sums[j] += mine.sum(axis=0).astype(object)
                counts[j] += len(mine)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(there, width), pa.int32()), pa.array(np.tile(np.arange(width), len(there)), pa.int32()),
                pa.array([str(s) for s in sums[there].ravel()], pa.string()), pa.array(np.repeat(counts[there], width), pa.int64()),
            ],
            names=["cluster", "dimension", "total", "of"],
        )

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, dimension int, total string, of long")
    out = c.copy()
    for r in parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("of").alias("of")).collect():
        out[r["cluster"], r["dimension"]] = int(r["total"]) // r["of"]
    return out


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """A row for each vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned (distances that were
    measured for it in all rounds)."""
    spark, kept = table.sparkSession, integer_vectors(table, id_col, vector_col, width)
    order = F.sha2(F.concat(F.lit("1:"), F.col(id_col).cast("string")), 256)
    heads = kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()
    kind = kept.schema[id_col].dataType.simpleString()
    if not heads:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned long")
    c = np.array([r["x"] for r in heads], np.int64).reshape(len(heads), width)
    groups = grouped(c, max(1, len(c) // group))
    state, moves = stash(_round(kept, id_col, c, groups, None)), None
    for _ in range(rounds):
        new = _moved(state, c)
        # doubles of exact differences, so a move is right to a few units in its last place
        moves = np.sqrt(((new - c).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        last, c = state, new
        state = stash(_round(last, id_col, c, groups, moves))
        unstash(last)

    def measure(batches):
        for batch in batches:
            own, x = batch.column("cluster").to_numpy(), _matrix(batch.column("x"), np.int64)
            d = x - c[own] if batch.num_rows else x
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("cluster"), pa.array((d * d).sum(axis=1), pa.int64()), batch.column("scanned")], names=[id_col, "cluster", "distance", "scanned"])

    measured = stash(state.select(id_col, "cluster", "x", "scanned").mapInArrow(measure, f"`{id_col}` {kind}, cluster int, distance long, scanned long"))
    unstash(state)
    by = {r["cluster"]: int(r["s"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    about = spark.createDataFrame([(j, fits(s), fits(sum(by.values())), names[j]) for j, s in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return measured.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")
