"""Query mode on a stream: reads arrive as files and are held against an index that was built before.

Grouping after the join is within one query read, so a micro-batch of whole reads gives the same overlaps as a batch run:
there is no state and no watermark. The index is a bucketed table, so a micro-batch shuffles its own chunks only. How many
files a micro-batch takes is bounded, so that a folder that is full at the start, or fills up after a pause, does not become one huge batch.
Results are written by the number of the batch: one that comes again after a failure replaces what it has written before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.config import JoinParams
from weftline.operators.stored import StoredIndex
from weftline.shared import scope
from weftline.sources.reads import OVERLAPS, fasta_records, fasta_text

#: Files of a micro-batch.
FILES = 64


def table_stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = FILES) -> DataFrame:
    """Rows of the Parquet files of a folder, in micro-batches of at most ``files`` files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def fasta_stream(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Records of the FASTA files of a folder (gzip too), as ``fasta_records`` takes them; files have to be whole when they appear."""
    return fasta_text(spark.readStream.option("maxFilesPerTrigger", files), folder)


def batch_sink(path: str, tsv: bool = False) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own, ``batch=NUMBER``, and replaces what is there."""

    def put(overlaps: DataFrame, number: int) -> None:
        out = overlaps.write.mode("overwrite")
        at = f"{path}/batch={number}"
        out.option("sep", "\t").csv(at) if tsv else out.parquet(at)

    return put


def sunk(spark: SparkSession, path: str, tsv: bool = False) -> DataFrame:
    """What ``batch_sink`` has written, without the numbers of batches."""
    reader = spark.read.schema(f"{OVERLAPS}, batch long")
    return (reader.option("sep", "\t").csv(path) if tsv else reader.parquet(path)).drop("batch")


def stream_overlaps(queries: DataFrame, index: StoredIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, j: JoinParams = JoinParams(), every: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:  # noqa: B008
    """Starts a query that gives the overlaps of each micro-batch of ``queries`` (a stream of reads, or of what ``prepare``
    makes reads of) to ``sink``: all that is there and then an end, or with ``every`` (such as ``10 seconds``) without end. ``sink`` gets
    the number of the batch too, as a batch can come again after a failure; ``batch_sink`` is one that stands that."""

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            sink(index.overlaps(prepare(batch) if prepare else batch, j), number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_fasta(spark: SparkSession, folder: str, index: StoredIndex, out: str, checkpoint: str, j: JoinParams = JoinParams(), files: int = FILES, every: str | None = None) -> StreamingQuery:  # noqa: B008
    """Overlaps of the FASTA files that are in a folder, or come to it, as tab-separated lines in ``out``."""
    return stream_overlaps(fasta_stream(spark, folder, files), index, batch_sink(out, tsv=True), checkpoint, j, every, fasta_records)
