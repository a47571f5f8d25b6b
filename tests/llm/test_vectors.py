"""Whitening and clustering of vectors against plain numpy and Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids, oracles, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, cluster string, n int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", "y", 1) for i, v in vectors], SCHEMA).repartition(parts)


def plain_whitening(vectors, k):
    """{row place: (deviation, whitened)} and (values, trace) with Python integers and numpy's eigenvectors."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    exact = [[n * c - t for c, t in zip(r, s, strict=True)] for r in x]
    d = np.array(exact, float).reshape(n, width) / max(n, 1)
    cov = d.T @ d / n
    values, axes = np.linalg.eigh(cov)
    return [i for i, _ in kept], [sum(c * c for c in r) for r in exact], d, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(cov)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    spread = np.array([9.0, 5, 4, 3, 2.5, 1.5, 1, 0.7, 0.5, 0.4])
    vectors = [(i, [float(c) for c in row]) for i, row in enumerate(rng.standard_normal((300, 10)) * spread + 3)]
    vectors += [(300, None), (301, [float("nan")] * 10), (302, [1.0, float("inf"), *[0.0] * 8]), (303, [1.0, None, *[0.0] * 8]), (None, [1.5] * 10), (5, [2.0] * 10), (5, [2.0] * 10), (304, [1.0, 2.0]), (305, [])]
    ids, deviations, d, values, axes, trace = plain_whitening(vectors, 4)
    got = whitening.whitened(table(spark, vectors), k=4).collect()
    assert len(got) == 4 * len(ids) and {r["n"] for r in got} == {len(ids)}
    assert sorted((r["vec_id"] is None, r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((i is None, i, v) for i, v in zip(ids, deviations, strict=True))
    for c in range(4):
        want = d @ axes[:, c] / math.sqrt(values[c])
        mine = [(-1 if r["vec_id"] is None else r["vec_id"], r["whitened"]) for r in got if r["component"] == c + 1]
        sign = np.sign(dict(mine)[0] * want[0])
        pairs = zip(sorted(mine), sorted((-1 if i is None else i, sign * w) for i, w in zip(ids, want, strict=True)), strict=True)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in pairs)
        assert all(abs(r["explained"] - values[c] / trace) < 1e-10 for r in got if r["component"] == c + 1)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_without_rows_or_variance(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(9)], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whitened(table(spark, vectors, 2)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]  # one direction only
    assert {r["component"] for r in whitening.whitened(table(spark, flat)).collect()} == {1}


def test_whitening_of_long_and_large_vectors(spark):
    vectors = [(i, [1e30 * (-1) ** i, *[float(i)] * 700]) for i in range(6)]
    got = whitening.whitened(table(spark, vectors), k=2).collect()
    # what is left beside such a component is lost in its rounding
    assert len(got) == 6 and {r["deviation"] for r in got} == {None} and got[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("gap", ["wide", "close", "ties"])
def test_blocks_end_with_certified_components(gap):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    values = {"wide": 0.6 ** np.arange(60), "close": 1 - 0.001 * np.arange(60), "ties": np.repeat([5.0, 3.0, 1.0], 20)}[gap]
    matrix = (q * values) @ q.T
    got, axes, residual, passes = whitening.leading(lambda b: matrix @ b, 60, 5)
    assert np.allclose(got, values[:5], rtol=1e-12) and residual < 1e-11 and passes < 60
    assert np.abs(matrix @ axes - axes * got).max() < 1e-10 and np.abs(axes.T @ axes - np.eye(5)).max() < 1e-12
    if gap == "wide":
        assert passes > 2 and np.allclose(np.abs((q[:, :5] * axes).sum(axis=0)), 1)


def plain_clusters(vectors, k, rounds, width):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    c = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        new = []
        for j, y in enumerate(c):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            new.append([sum(z) // len(mine) for z in zip(*mine, strict=True)] if mine else y)
        c = new
    out = [(i, *near(x)[::-1]) for i, x in kept]
    total = lambda j: sum(d for _, o, d in out if o == j)
    return [(i, o, d, total(o), sum(x[2] for x in out), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for i, o, d in out]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize(("k", "width", "grid"), [(5, 3, True), (16, 4, True), (12, 6, False), (1, 2, True)])
def test_clusters_equal_full_scans(spark, k, width, grid):
    rng = random.Random(k)
    value = (lambda: rng.choice([-0.1, 0.0, 0.02, 0.5])) if grid else (lambda: rng.gauss(rng.choice([-3, 0, 4]), 0.2))
    vectors = [(i, [value() for _ in range(width)]) for i in range(240)]  # on a grid there are many ties
    vectors += [(7, vectors[7][1]), (7, vectors[8][1]), (None, vectors[3][1]), (900, None), (901, [0.0] * (width + 1)), (902, [float("nan")] * width), (903, [None] * width), (904, [])] + [(2000 + i, [0.25] * width) for i in range(150)]
    got = centroids.clusters(table(spark, vectors), k=k, width=width).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(plain_clusters(vectors, k, 3, width), key=key)


def test_filters_leave_distances_out(spark):
    rng = random.Random(1)
    vectors = [(i, [10.0 * (i % 16 == j) + rng.gauss(0, 0.1) for j in range(16)]) for i in range(800)]
    got = centroids.clusters(table(spark, vectors), width=16, rounds=6).collect()
    assert sum(r["scanned"] for r in got) < 0.45 * len(got) * 16 * 7
    assert sorted(r["distance"] for r in got) == sorted(r[2] for r in plain_clusters(vectors, 16, 6, 16))


def test_clusters_of_few_large_or_no_vectors(spark):
    assert centroids.clusters(table(spark, [(1, None)], 1)).count() == 0
    few = centroids.clusters(table(spark, [(i, [float(i)] * 64) for i in range(3)], 2)).collect()
    assert {r["distance"] for r in few} == {0} and len({r["cluster"] for r in few}) == 3
    large = centroids.clusters(table(spark, [(i, [3e38 * (-1) ** i] * 64) for i in range(40)], 2), k=1).collect()
    assert len(large) == 40 and {r["inertia"] for r in large} == {None} and all(r["distance"] > 0 for r in large)


def test_query_equals_oracle(spark, same, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = source.where("vec_id < 4").withColumn("vec_id", F.col("vec_id") + 100_000).withColumn("embedding", F.when(F.col("vec_id") == 100_001, F.slice("embedding", 1, 63)).when(F.col("vec_id") == 100_002, F.transform("embedding", lambda c, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(c))))
    source.union(odd).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    same(queries.op12_centroid_clustering, oracles.ORACLES["op12_centroid_clustering"], str(tmp_path))
    got = queries.op11_embedding_whitening(spark, str(tmp_path))
    assert got.count() == 32 * (source.count() + 1) and got.first()["identity_error"] < 1e-9
