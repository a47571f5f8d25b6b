"""An index that is kept: laid out by key, added to, and probed by any number of query batches without being shuffled.

Three tables, each in parts by batch: the chunks and the key table (occurrences of each key), bucketed by key, and the ids and names of
the indexed reads. A fourth one logs the batches that are complete, with the parameters of the sketch. Reads are added as a batch of their
own, so what is there stays where it is: work grows with the reads that are added. A batch that is given again replaces what a failed attempt has
left, and adds nothing once it is in the log; readers see logged batches only. ``compact`` puts all batches into one.

Joins with a batch of queries shuffle the queries only, and merged key counts need no shuffle either, as every part has the same buckets. Chunks of
one key are in one bucket, so one with a large share of all chunks makes a large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import JoinParams, SketchParams
from weftline.shared import scope, swept, written

from .bloom import key_filter
from .index import key_table, merged_keys
from .matching import chains, normalised, query_matches
from .report import named
from .sketch import chunks

_PARTS = ("chunks", "keys", "reads")
_LOG = "batch long, whole boolean, n_reads long, n_chunks long, k int, num_windows int, window_size int, mask string, buckets int"
_MODE = "spark.sql.sources.partitionOverwriteMode"


@contextmanager
def _by_batch(spark: SparkSession) -> Iterator[None]:
    """Overwrites replace the batches that they write and no others."""
    before = spark.conf.get(_MODE, None)
    spark.conf.set(_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.unset(_MODE) if before is None else spark.conf.set(_MODE, before)


@dataclass(frozen=True)
class StoredIndex:
    """The name that its tables begin with, the parameters that queries have to be sketched with, and the number of buckets."""

    name: str
    params: SketchParams
    buckets: int
    _filters: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def batches(self, spark: SparkSession) -> list[int]:
        """The complete batches, without those that a compaction has replaced."""
        log = sorted((r["batch"], r["whole"]) for r in spark.table(f"{self.name}_log").select("batch", "whole").collect())
        since = max((b for b, whole in log if whole), default=-1)
        return [b for b, _ in log if b >= since]

    def _part(self, spark: SparkSession, part: str, batches: list[int] | None = None) -> DataFrame:
        return spark.table(f"{self.name}_{part}").where(F.col("batch").isin(self.batches(spark) if batches is None else batches)).drop("batch")

    def _filter(self, spark: SparkSession, batches: list[int]) -> np.ndarray | None:
        """The filter of the keys of these batches, made once until there are others; None if there are too many keys."""
        at = tuple(batches)
        if at not in self._filters:
            self._filters.clear()
            self._filters[at] = key_filter(self._part(spark, "keys", batches), self.params.num_windows)
        return self._filters[at]

    def chunks(self, spark: SparkSession) -> DataFrame:
        return self._part(spark, "chunks")

    def reads(self, spark: SparkSession) -> DataFrame:
        return self._part(spark, "reads")

    def keys(self, spark: SparkSession) -> DataFrame:
        """(key, n, least, most) over all batches."""
        return merged_keys(self._part(spark, "keys"))

    def append(self, reads: DataFrame, batch: int | None = None) -> bool:
        """Adds reads with ids of their own as the batch of that number (by default the next one). False if there is that
        batch already, and nothing is done. One writer at a time."""
        spark = reads.sparkSession
        with swept(spark):
            there = self.batches(spark)
            number = max(there, default=-1) + 1 if batch is None else batch
            if spark.table(f"{self.name}_log").where(F.col("batch") == number).count():
                return False
            if not reads.join(self.reads(spark), "read_id", "left_semi").isEmpty():
                raise ValueError("reads with ids of indexed ones")
            self._put(spark, chunks(reads, self.params), reads.select("read_id", "name"), number, False)
        return True

    def compact(self, spark: SparkSession) -> None:
        """All batches as one with a sorted file for each bucket; the others are deleted once it is in the log."""
        old = self.batches(spark)
        with scope():
            self._put(spark, written(self.chunks(spark)), self.reads(spark), max(old) + 1, True)
        for part in _PARTS:
            for b in old:
                spark.sql(f"ALTER TABLE {self.name}_{part} DROP IF EXISTS PARTITION (batch = {b})")

    def _put(self, spark: SparkSession, chunk_rows: DataFrame, names: DataFrame, number: int, whole: bool) -> None:
        batch = F.lit(number).cast("long").alias("batch")
        put = lambda part: spark.table(f"{self.name}_{part}").where(F.col("batch") == number)
        with _by_batch(spark), swept(spark):
            # dealt by key first, so that each bucket is one file; keys are then counted bucket by bucket, without another shuffle
            chunk_rows.select(*_COLUMNS["chunks"]).repartition(self.buckets, "key").withColumn("batch", batch).write.mode("overwrite").insertInto(f"{self.name}_chunks")
            key_table(put("chunks")).select(*_COLUMNS["keys"], batch).repartition(self.buckets, "key").write.mode("overwrite").insertInto(f"{self.name}_keys")
            names.select("read_id", "name", batch).write.mode("overwrite").insertInto(f"{self.name}_reads")
            p = self.params
            row = (number, whole, put("reads").count(), put("chunks").count(), p.k, p.num_windows, p.window_size, p.mask, self.buckets)
            spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").insertInto(f"{self.name}_log")

    def overlaps(self, queries: DataFrame, j: JoinParams = JoinParams()) -> DataFrame:  # noqa: B008
        """Named overlaps of ``queries`` with the indexed reads. Chunks of queries whose key cannot be in the index do not leave the task
        that makes them."""
        spark = queries.sparkSession
        there = self.batches(spark)  # one state of the index for all that is read of it
        q = chunks(queries, self.params, keep=self._filter(spark, there))
        return named(chains(normalised(query_matches(q, self._part(spark, "chunks", there), j)), j), queries, self._part(spark, "reads", there))

    def drop(self, spark: SparkSession) -> None:
        for part in (*_PARTS, "log"):
            spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")


_COLUMNS = {"chunks": ["key", "read_id", "fw", "start", "end", "raw_length"], "keys": ["key", "n", "least", "most"]}


def new_index(spark: SparkSession, name: str, p: SketchParams = SketchParams(), buckets: int | None = None, folder: str | None = None) -> StoredIndex:  # noqa: B008
    """An index without reads, whose tables begin with ``name``; one of that name is replaced. ``folder``: where its files go, by
    default the warehouse."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = StoredIndex(name, p, n)
    index.drop(spark)
    key = "key binary"
    kinds = {"chunks": f"{key}, read_id long, fw boolean, start long, `end` long, raw_length long", "keys": f"{key}, n long, least long, most long", "reads": "read_id long, name string"}
    for part, columns in kinds.items():
        by = "" if part == "reads" else f"CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS"
        at = f"LOCATION '{folder}/{part}'" if folder else ""
        spark.sql(f"CREATE TABLE {name}_{part} ({columns}, batch long) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (batch) {by} {at}")
    at = f"LOCATION '{folder}/log'" if folder else ""
    spark.sql(f"CREATE TABLE {name}_log ({_LOG.replace(' long', ' bigint')}) USING parquet {at}")
    return index


def store_index(reads: DataFrame, name: str, p: SketchParams = SketchParams(), buckets: int | None = None, folder: str | None = None) -> StoredIndex:  # noqa: B008
    """The index of ``reads``, which are its first batch."""
    out = new_index(reads.sparkSession, name, p, buckets, folder)
    out.append(reads)
    return out


def open_index(spark: SparkSession, name: str) -> StoredIndex:
    """An index that is there, by the parameters in its log."""
    r = spark.table(f"{name}_log").orderBy("batch").first()
    if r is None:
        raise ValueError(f"the index {name} has no batch yet")
    return StoredIndex(name, SketchParams(r["k"], r["num_windows"], r["window_size"], r["mask"]), r["buckets"])
