"""Named overlaps, run counters, and the two programs as functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.config import JoinParams, SketchParams
from weftline.shared import outlives, scope, written

from . import cells
from .bloom import key_filter
from .index import key_table, within
from .matching import chains, matches, normalised, query_matches, reads_with_match
from .sketch import chunks


def named(chain_rows: DataFrame, left_reads: DataFrame, right_reads: DataFrame) -> DataFrame:
    """Ten columns: name, length, start, end and strand of both reads. Chains carry the lengths, names come by join, so of
    the reads only ids and names are read."""
    strand = lambda c: F.when(F.col(c), "fw").otherwise("bw")
    l = left_reads.select(F.col("read_id").alias("left"), F.col("name").alias("l_name"))  # noqa: E741
    r = right_reads.select(F.col("read_id").alias("right"), F.col("name").alias("r_name"))
    return chain_rows.join(l, "left").join(r, "right").select(
        F.col("l_name").alias("left"), F.col("l_len").alias("left_len"), F.col("l_start").alias("left_start"), F.col("l_end").alias("left_end"), strand("l_fw").alias("left_strand"),
        F.col("r_name").alias("right"), F.col("r_len").alias("right_len"), F.col("r_start").alias("right_start"), F.col("r_end").alias("right_end"), strand("r_fw").alias("right_strand"),
    )


def overlaps(reads: DataFrame, p: SketchParams = SketchParams(), j: JoinParams = JoinParams()) -> DataFrame:  # noqa: B008
    """All-vs-all overlaps of ``reads``."""
    return named(chains(normalised(matches(chunks(reads, p), j)), j), reads, reads)


def query_overlaps(queries: DataFrame, index: DataFrame, p: SketchParams = SketchParams(), j: JoinParams = JoinParams(), prune: bool = False) -> DataFrame:  # noqa: B008
    """Overlaps of each query with the reads of an index. ``prune``: the index is large and shares few keys with the queries; a
    Bloom filter of the queries' keys then keeps the other chunks of the index from being shuffled."""
    q, keep = chunks(queries, p), None
    if prune:
        q = written(q)
        keep = key_filter(q, p.num_windows)
    return named(chains(normalised(query_matches(q, chunks(index, p, keep=keep), j)), j), queries, index)


@dataclass(frozen=True)
class Run:
    """What an all-vs-all run leaves: its chains as a written table, the reads, and its nine counters."""

    reads: DataFrame
    chains: DataFrame
    counters: dict[str, int]

    def overlaps(self) -> DataFrame:
        return named(self.chains, self.reads, self.reads)


def run(reads: DataFrame, p: SketchParams = SketchParams(), j: JoinParams = JoinParams()) -> Run:  # noqa: B008
    """An all-vs-all run with its counters. Reads are sketched once and joined once: chunks, keys and chains are written, and
    everything that is counted or reported is read from these. Only the chains stay."""
    with scope():
        c, seen, ok = written(chunks(reads, p)), Observation(), within(F.col("n"), j)
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        # counted as they are written, in the last stage, so that no task counts twice; keys of one occurrence are needed no more
        every = key_table(c).observe(
            seen, F.count("*").alias("distinct_chunks"), total(F.when(ok, F.col("n"))).alias("read_chunk_matches"), F.count_if(F.col("n") == 1).alias("singleton_chunks"),
            F.coalesce(F.max(F.when(ok, F.col("n"))), F.lit(0)).alias("max_chunk_size"),
        )
        keys = written(every.where("n > 1"))
        found = outlives(written(chains(normalised(matches(c, j, counts=keys)), j)))
        parts = [
            reads.agg(F.count("*").alias("number_reads")),
            reads_with_match(c, j, keys).agg(F.count("*").alias("reads_with_match")),
            found.groupBy("left", "right").agg(F.count("*").alias("chains"), F.sum("n_matches").alias("matches"))
            .agg(F.count("*").alias("read_pair_matches"), total("chains").alias("chain_matches"), total("matches").alias("window_matches")),
        ]
        return Run(reads, found, {k: int(v) for x in (seen.get, *(x.first().asDict() for x in parts)) for k, v in x.items()})


COUNTERS = ["number_reads", "distinct_chunks", "read_chunk_matches", "singleton_chunks", "reads_with_match", "read_pair_matches", "chain_matches", "window_matches", "max_chunk_size"]


def stats(reads: DataFrame, p: SketchParams = SketchParams(), j: JoinParams = JoinParams()) -> DataFrame:  # noqa: B008
    """The nine counters of an all-vs-all run, one row; nothing that the run has written stays. Chains are counted in the cells where they
    are made, so what is written grows with the reads and not with their pairs."""
    with scope():
        seen: dict[str, int] = {}
        blocks = cells.packed(chunks(reads, p), j, seen=seen)
        matched = F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 8
        parts = [reads.agg(F.count("*").alias("number_reads")), blocks.agg(matched.cast("long").alias("reads_with_match")), cells.totals(blocks, j)]
        counters = {k: int(v) for x in (seen, *(x.first().asDict() for x in parts)) for k, v in x.items()}
    return reads.sparkSession.createDataFrame([tuple(counters[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
