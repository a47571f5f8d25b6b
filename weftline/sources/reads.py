"""Where sequences come from: tables, FASTA and FASTQ files (gzip too); and where overlaps go: a TSV without header.

A read is (read_id, name, raw_length, sequence). Ids do not depend on scheduling: they come from the table's key, or from
the place of the record in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.sequence import fold
from weftline.shared import written

#: Blocks of files, a few dozen bytes each, that are sent to all tasks.
BLOCKS = 100_000
#: The columns of an overlap.
OVERLAPS = "left string, left_len long, left_start long, left_end long, left_strand string, right string, right_len long, right_start long, right_end long, right_strand string"


def table_reads(table: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """A table's texts folded to sequences, its key as the id. A null text is an empty sequence; rows without a key go."""
    out = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("read_id"), F.col(id_col).cast("string").alias("name"), fold(F.coalesce(text_col, F.lit(""))).alias("sequence"))
    return out.select("read_id", "name", F.length("sequence").cast("long").alias("raw_length"), "sequence")


def sequence_reads(table: DataFrame, id_col: str, name_col: str, sequence_col: str) -> DataFrame:
    """A table that holds sequences already."""
    return table.select(F.col(id_col).cast("long").alias("read_id"), F.col(name_col).cast("string").alias("name"), F.length(sequence_col).cast("long").alias("raw_length"), F.col(sequence_col).alias("sequence"))


def _cut(reader, paths, mark: str) -> DataFrame:
    """(path, block, body): pieces of text files, cut at each line that begins with ``mark``."""
    text = reader.option("lineSep", f"\n{mark}").text(paths)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("body"))


def _numbered(records: DataFrame) -> DataFrame:
    """Ids by file and place. Records of a block lie in a row in one task, so their numbers there less the first of them are
    their places in the block; before them come all records of the blocks and files before. Only one row a block is shuffled, and the
    bodies stay where they were read: the blocks go to all tasks if there are at most ``BLOCKS``, and are joined by Spark's choice otherwise."""
    records = records.withColumn("at", F.monotonically_increasing_id())
    parts = written(records.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    before = F.sum("n").over(W.orderBy("path", "block").rowsBetween(W.unboundedPreceding, -1))  # one row a block
    offsets = parts.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    if parts.count() <= BLOCKS:
        offsets = F.broadcast(offsets)
    return records.join(offsets, ["path", "block"]).withColumn("read_id", F.col("offset") + F.col("at"))


def fasta_text(reader, paths) -> DataFrame:
    """The pieces of FASTA files, in batch or on a stream, that ``fasta_records`` makes reads of."""
    return _cut(reader, paths, ">")


def fasta_records(text: DataFrame) -> DataFrame:
    r = text.withColumn("body", F.regexp_replace("body", "^>", ""))
    r = r.where(F.regexp_like("body", F.lit(r"\S")))  # neither name nor sequence
    r = r.withColumn("name", F.regexp_extract("body", r"^[ \t]*([^\s]*)", 1)).withColumn("sequence", F.regexp_replace(F.regexp_replace("body", r"^[^\n]*(\n|$)", ""), r"\s+", ""))
    return _numbered(r).select("read_id", "name", F.length("sequence").cast("long").alias("raw_length"), "sequence")


def fasta_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """Records ``>name ...`` and lines of sequence. The name ends at the first blank and may be missing; white space in
    sequences goes."""
    return fasta_records(fasta_text(spark.read, list(paths)))


def fastq_reads(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of four lines; qualities are dropped. Files are cut at lines that begin with an at-sign: a piece whose third
    line begins with a plus is a record. A quality line that begins with an at-sign makes a piece of its own, which has no such
    line. Sequence and quality may be empty lines, and empty lines may stand between records; lines that make no record, as in
    a cut file, are left out."""
    text = _cut(spark.read, list(paths), "@").where(F.col("body") != "")
    # a file's first record still has its mark, behind empty lines at most
    body = F.when(F.col("block") == 0, F.regexp_replace("body", r"^\s*@(?=[^\n]*\n[^\n]*\n\+)", "")).otherwise(F.col("body"))
    lines = F.split(body, "\n", 4)
    r = text.withColumn("lines", lines).where(F.get("lines", F.lit(2)).startswith("+"))
    r = r.select("path", "block", F.regexp_extract(F.get("lines", F.lit(0)), r"^([^\s]*)", 1).alias("name"), F.regexp_replace(F.get("lines", F.lit(1)), r"\s+", "").alias("sequence"))
    return _numbered(r).select("read_id", "name", F.length("sequence").cast("long").alias("raw_length"), "sequence")


def write_overlaps(overlaps: DataFrame, path: str) -> None:
    """Ten columns separated by tabs, no header."""
    overlaps.select("left", "left_len", "left_start", "left_end", "left_strand", "right", "right_len", "right_start", "right_end", "right_strand").write.mode("overwrite").option("sep", "\t").csv(path)


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(OVERLAPS).csv(path)
