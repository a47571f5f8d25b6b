"""Tables written once for several readers in the folder that all executors share, and small tables dealt over all cores."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: Spark's setting that deletes the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths that this process has written and nobody has dropped yet.
_paths: set[str] = set()
#: Of each ``scope`` that is open, the innermost last: the paths that were made in it.
_scopes: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local run gets a temporary one; on a cluster, whose
    executors would each write to a disk of their own, it is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there when the process ends is deleted."""
    path = f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}"
    _paths.add(path)
    if _scopes:
        _scopes[-1].add(path)
    return path


@contextmanager
def scope() -> Iterator[None]:
    """What is written inside is deleted at the end, so a long session does not gather tables: results have to be taken
    before, or be a written table that ``outlives`` it."""
    _scopes.append(set())
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(path)


def outlives(df: DataFrame) -> DataFrame:
    """A written table that the innermost scope leaves to the one around it."""
    if _scopes and (path := getattr(df, "_weftline_path", None)):
        _scopes[-1].discard(path)
        if len(_scopes) > 1:
            _scopes[-2].add(path)
    return df


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs inside go when it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: computed once, and safe from lost executors. The shuffle files of the query
    go when it has ended. A table that is written already stays as it is. ``dropped`` deletes it; what is left when the
    process ends is deleted then."""
    if getattr(df, "_weftline_path", None):
        return df
    spark = df.sparkSession
    path = fresh_path(spark)
    with swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` has written, once nothing reads it any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_weftline_path", None):
            _delete(path)


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if path in _paths and jvm is not None:
        _paths.discard(path)
        active = SparkContext._active_spark_context
        conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_paths):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder then stays
            return


def spread(df: DataFrame, by: str) -> DataFrame:
    """``df`` dealt over all cores by ``by`` where it lies in fewer files than there are cores, as one file of one row group
    is one task however it is split. Larger tables are read where they lie, without a shuffle."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(2 * cores, by) if 0 < files < cores else df
