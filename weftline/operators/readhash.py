"""Scans of reads with their hashes or k-mers, lookups by hash, and subsets of reads in a given list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subset(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the reads in ``ids`` (read_id); a read that is listed twice comes twice."""
    return rows.join(ids.select("read_id"), "read_id")


def with_hashes(reads: DataFrame, hashes: DataFrame) -> DataFrame:
    """(read_id, sequence, positions, hashes); empty arrays for reads without hashes."""
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    return reads.select("read_id", "sequence").join(hashes, "read_id", "left").select("read_id", "sequence", none(F.col("positions"), "array<bigint>").alias("positions"), none(F.col("hashes"), "array<string>").alias("hashes"))


def kmer_lookup(hashes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(read_id, positions, kmers): for each hash its node and orientation in ``nodes`` (hash, node, fw), null if it has
    none, in the order of the positions."""
    rows = hashes.select("read_id", F.posexplode(F.arrays_zip("positions", "hashes")).alias("i", "x")).select("read_id", "i", F.col("x.positions").alias("pos"), F.col("x.hashes").alias("hash"))
    found = rows.join(nodes.select("hash", F.struct("node", "fw").alias("kmer")), "hash", "left")
    back = found.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("i", "pos", "kmer"))).alias("x"))
    return back.select("read_id", F.col("x.pos").alias("positions"), F.col("x.kmer").alias("kmers"))
