"""The filter that keeps rows out of a join's shuffle: no number of the table is ever missed, and its size is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import jaccard_join, members, textvec


def test_filter_holds_all_of_a_table_and_little_else(spark):
    rng = np.random.default_rng(1)
    inside = [*map(int, rng.integers(-(1 << 63), 1 << 63, 5000)), 0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(x,) for x in [*inside, *inside[:50], None]], "n long").repartition(5)
    words = members.members(df, "n").value
    assert members.may_hold(words, np.array(inside, np.int64)).all()
    outside = rng.integers(-(1 << 63), 1 << 63, 20_000)
    assert members.may_hold(words, outside).mean() < 0.05


def test_filter_of_nothing_and_of_too_many(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in range(100)], "n long")
    there = members.members(df.limit(0), "n")
    rows = spark.createDataFrame([(1,), (None,)], "x long")
    assert rows.where(members.may_be_in(F.col("x"), there)).count() == 0
    there = members.members(df, "n")
    assert [r["x"] for r in rows.where(members.may_be_in(F.col("x"), there)).collect()] == [1]
    monkeypatch.setattr(members, "MOST_BITS", 64)
    assert members.members(df, "n") is None


def test_jaccard_join_is_the_same_without_filters_and_with_full_ones(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(3 * i + k, " ".join(words[i : i + 40] + [f"x{k}"] * (k > 1))) for i in range(8) for k in range(3)]
    rows += [(5, "some other text"), (None, " ".join(words)), (None, "only without an id"), (100, ""), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = lambda: sorted(map(str, jaccard_join.jaccard_components(df, 3, 80).collect()))
    first = result()
    for most in (4, 128):  # none at all; one in which nearly everything may be
        monkeypatch.setattr(members, "MOST_BITS", most)
        assert result() == first


def test_no_task_of_the_jaccard_join_has_two_python_processes(spark, small, monkeypatch):
    """Workers stay for later tasks, each with its memory: a filter by a column function and a hash in one task are two for a core."""
    plans, stash = [], jaccard_join.stash
    monkeypatch.setattr(jaccard_join, "stash", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stash(df))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert jaccard_join.jaccard_components(docs, 5, 80).count() == docs.count()
    assert sum("MapInArrow" in p for p in plans) > 2 and not [p for p in plans if "MapInArrow" in p and "ArrowEvalPython" in p]


def test_sets_are_those_of_the_ids_whatever_the_filter(spark, monkeypatch):
    docs = spark.createDataFrame([*((i, f"a text of {i} and {i % 7}") for i in range(200)), (None, "no id"), (3, "another text of 3")], "doc_id long, text string").repartition(3)
    ids = docs.where("doc_id % 2 = 1").selectExpr("doc_id as id")
    want = sorted((i, f"a text of {i} and {i % 7}") for i in range(1, 200, 2)) + [(3, "another text of 3")]
    for most in (members.MOST_BITS, 512, 16):  # a good filter, a full one that the join follows, none
        monkeypatch.setattr(members, "MOST_BITS", most)
        got = jaccard_join._sets(docs, ids, 3).collect()
        odd = [r for r in got if r["id"] % 2]
        assert len(odd) == len(want) and {r["id"] for r in odd} == {i for i, _ in want} and len(got) - len(odd) <= (10 if most > 512 else 0)


def test_a_worker_holds_little_beside_its_batch():
    text = " ".join(f"w{i * 7919 % 5000}" for i in range(400))
    texts = pa.array([text] * 1500)  # 3 MB
    textvec._powers.cache_clear()
    tracemalloc.start()
    try:
        n = sum(len(s) for _, data, offsets in textvec.pieces(texts) for s in textvec.shingle_sets(data, offsets, 5))
        assert n == 1500 * 396 and tracemalloc.get_traced_memory()[1] < 16e6  # 37 MB with pieces of a megabyte
    finally:
        tracemalloc.stop()
