"""The programs on a command line.

    python -m weftline overlaps OUT FILE...             all-vs-all overlaps of the sequences of files
    python -m weftline query OUT INDEX_FILE FILE...     overlaps of the sequences of files with those of an index file
    python -m weftline stream OUT INDEX_FILE FOLDER     the same for the FASTA files of a folder, as a stream

OUT is a folder for tab-separated lines (``stream``: one folder a batch in it); run counters go to the error output. Files are FASTA or
FASTQ by their names (.gz too). Each file is read once: its reads are kept as a table while the program runs, as are chunks and
chains, from which overlaps and counters are made. ``stream`` ends when all files are done, or with ``--every`` goes on for those that come;
started again with the same ``--checkpoint`` it goes on where it was. With spark-submit, give ``--py-files`` a zip of the package, or
let this program send it itself.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import MASKS, JoinParams, SketchParams
from weftline.operators.matching import chains, normalised, query_matches
from weftline.operators.report import COUNTERS, named, run
from weftline.operators.sketch import chunks
from weftline.operators.stored import store_index
from weftline.shared import fresh_path, scope, written
from weftline.sources.reads import fasta_reads, fastq_reads, write_overlaps
from weftline.streaming.query_mode import FILES, stream_fasta, sunk


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("weftline", description="Approximate overlaps of sequences.")
    own = argparse.ArgumentParser(add_help=False)
    p, j = SketchParams(), JoinParams()
    for name, value in (("k", p.k), ("num-windows", p.num_windows), ("window-size", p.window_size), ("min-coverage", j.min_coverage), ("max-length-difference", j.max_length_difference), ("chain-gap", j.chain_gap)):
        own.add_argument(f"--{name}", type=int, default=value)
    own.add_argument("--max-coverage", type=int, default=j.max_coverage)
    own.add_argument("--mask", choices=MASKS, default=p.mask)
    programs = out.add_subparsers(dest="program", required=True)
    one = programs.add_parser("overlaps", parents=[own])
    two = programs.add_parser("query", parents=[own])
    three = programs.add_parser("stream", parents=[own])
    for x in (one, two, three):
        x.add_argument("out")
    for x in (two, three):
        x.add_argument("index")
    for x in (one, two):
        x.add_argument("files", nargs="+")
    three.add_argument("folder")
    three.add_argument("--checkpoint", help="where the stream keeps its progress; by default it begins anew")
    three.add_argument("--max-files", type=int, default=FILES, help="files of a batch")
    three.add_argument("--every", help="how often to look for new files, such as '10 seconds'; without it the program ends when all files are done")
    return out


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Reads of all files with ids that go on from FASTA to FASTQ files."""
    fastq = [f for f in files if f.removesuffix(".gz").endswith((".fq", ".fastq"))]
    fasta = [f for f in files if f not in fastq]
    parts = [f(spark, *paths) for f, paths in ((fasta_reads, fasta), (fastq_reads, fastq)) if paths]
    if len(parts) == 2:  # odd ids and even ids, as no kind has to be counted for that
        parts = [x.withColumn("read_id", 2 * F.col("read_id") + i) for i, x in enumerate(parts)]
    return reduce(DataFrame.union, parts)


def send_package(spark: SparkSession) -> None:
    """Gives the package to the executors of a cluster."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    if not spark.sparkContext.master.startswith("local"):
        send_package(spark)
    p = SketchParams(a.k, a.num_windows, a.window_size, a.mask)
    j = JoinParams(a.min_coverage, a.max_coverage, a.max_length_difference, a.chain_gap)
    if a.program == "overlaps":
        with scope():
            done = run(written(read_files(spark, a.files)), p, j)
            write_overlaps(done.overlaps(), a.out)
            _tell({c: done.counters[c] for c in COUNTERS})
        return
    with scope():
        index = store_index(written(read_files(spark, [a.index])), f"weftline_{uuid.uuid4().hex}", p, folder=fresh_path(spark))
        try:
            if a.program == "query":
                queries = written(read_files(spark, a.files))
                found = written(chains(normalised(query_matches(chunks(queries, p), index.chunks(spark), j)), j))
                write_overlaps(named(found, queries, index.reads(spark)), a.out)
                n = found.count()
            else:
                stream_fasta(spark, a.folder, index, a.out, a.checkpoint or fresh_path(spark), j, a.max_files, a.every).awaitTermination()
                n = sunk(spark, a.out, tsv=True).count()
            keys = index.keys(spark).agg(F.count("*").alias("distinct_chunks"), F.count_if(F.col("n") == 1).alias("singleton_chunks")).first()
            _tell({**keys.asDict(), "chain_matches": n})
        finally:
            index.drop(spark)


def _tell(counters: dict[str, int]) -> None:
    for name, value in counters.items():
        print(f"{name}\t{value}", file=sys.stderr)
