"""Mixing sources to target weights by entropy balancing.

Each document gets a rate: how often it should be taken. The rates that differ least from one (relative entropy, each
document counted by its words) among those that give every group its target of words are exponential tilts,
``exp(sum of the multipliers of the document's groups)``. The multipliers solve a convex dual by Newton steps. For one
column the Hessian is diagonal, so each group steps on its own: a few numbers beside each group in a Spark table, of which
nothing goes to the driver. Groups of several columns at once (say source and language) are tied; there a Spark aggregation over
the cells (combinations of groups) gives gradient and Hessian, and the driver solves that system of at most ``GROUPS`` groups.

Rates become whole copies: everyone gets the whole part, and documents are put in an order by a hash of their id; those
before a cut get one more. The cut of each group is the one whose words are nearest to what is missing. It is found by
histograms of the hash, three levels deep, so no group is sorted or held by one task: a source with a third of all rows
is a few thousand rows of each histogram. Rows without doc_id are ordered by a hash of their text. Where several rows
share the place of a cut (a repeated doc_id, repeated rows) further levels part them by a hash of the text and, for rows that
are equal in all of this, by a number that each row got when sizes were written; equal rows are interchangeable, so results do
not depend on partitioning or reruns.

Null texts and blank texts have size 0, are never part of a sum and get no copies that matter; very long texts count like others;
a null source is a group of its own, last in order. An empty table gives an empty one. Of the input doc_id, source and text are
read, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stash, unstash, words

MAX_TIMES, STEPS, TOLERANCE, LONGEST_STEP = 3, 100, 1e-13, 1.0
#: The most groups of several columns whose multipliers are solved together: a dense system in the driver.
GROUPS = 4096
#: The most sources, a few numbers each, that are sent to all tasks so that documents stay where they are.
SOURCES = 100_000
#: Bits of the order hash that each level of the histograms resolves.
LEVELS = (12, 12, 16)
BITS = sum(LEVELS)
#: The same for rows at one place: a hash of the text, then the row's own number.
TIES = (12, 12, 12, 12)
TIE_BITS = sum(TIES)


def order_hash(doc_id: Column, text: Column) -> Column:
    """A number below ``2 ** BITS`` from a doc_id, from the text where there is none."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def tie_hash(text: Column) -> Column:
    """A number below ``2 ** TIE_BITS``: half of it from the text, half from the row. To be written before it is used."""
    low = (1 << TIE_BITS // 2) - 1
    return F.xxhash64(text).bitwiseAND(low) * (low + 1) + F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(low)


def share_out(sources: DataFrame, times: int = MAX_TIMES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights 1, 2, 3 and again in order of the source share all
    words; a target stops at ``times`` its source's size and the rest is shared again. In order of size by weight the
    targets that stop come first, so running sums find them at once. One row a source: a small table."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    out = sources.withColumn("weight", (F.pmod(place - 1, F.lit(3)) + 1).cast("double")).withColumn("most", (times * F.col("source_size")).cast("double"))
    before = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    left = lambda c, w: F.sum(c).over(every) - F.coalesce(F.sum(w).over(before), F.lit(0.0))
    out = out.withColumn("level", left(F.col("source_size").cast("double"), F.col("most")) / left(F.col("weight"), F.col("weight")))
    out = out.withColumn("full", F.col("most") < F.col("weight") * F.col("level"))
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    return out.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * (rest / share)).alias("target"))


def tilted(sources: DataFrame) -> DataFrame:
    """``sources`` (source_size, target) with ``rate``, the exponential of each group's multiplier: Newton steps on the dual of
    one column, within the row. A group without words or target has the rate 0."""
    words, target = F.col("source_size").cast("double"), F.col("target")

    def step(lam: Column, _: Column) -> Column:
        now = words * F.exp(lam)
        return lam - F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), (now - target) / now))

    solved = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    return sources.withColumn("rate", F.when((words > 0) & (target > 0), F.exp(solved)).otherwise(0.0))


def entropy_balance(cells: DataFrame, targets: dict[str, dict]) -> dict[str, dict]:
    """Multipliers by column and group, for several columns. ``cells``: the columns of ``targets`` and ``words``; targets:
    words by column and group (at least one word in each group that has a target)."""
    names = [(c, g) for c in targets for g in targets[c]]
    if len(names) > GROUPS:
        raise ValueError(f"{len(names)} groups; at most {GROUPS} are solved together")
    at = {x: i for i, x in enumerate(names)}
    want = np.array([targets[c][g] for c, g in names], float)
    lam = np.zeros(len(names))
    spark = cells.sparkSession
    for _ in range(STEPS):
        now = cells
        for c in targets:
            small = spark.createDataFrame([(g, float(lam[at[c, g]])) for g in targets[c]], f"g {cells.schema[c].dataType.simpleString()}, l_{c} double")
            now = now.join(small, now[c].eqNullSafe(small["g"])).drop("g")
        now = now.select(*targets, (F.col("words") * F.exp(reduce(lambda a, b: a + b, [F.col(f"l_{c}") for c in targets]))).alias("w"))
        # one pass gives the sums by pair of groups: the Hessian, with the gradient on its diagonal
        hess = np.zeros((len(names), len(names)))
        columns = list(targets)
        for i, a in enumerate(columns):
            for b in columns[i:]:
                for x, y, w in now.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum("w").alias("w")).collect():
                    hess[at[a, x], at[b, y]] = hess[at[b, y], at[a, x]] = w
        gradient = np.diag(hess) - want
        if np.all(np.abs(gradient) <= TOLERANCE * want):
            break
        step = np.linalg.lstsq(hess, gradient, rcond=None)[0]
        lam -= step / max(1.0, np.abs(step).max() / LONGEST_STEP)
        if np.abs(step).max() < 1e-15:
            break
    return {c: {g: float(lam[at[c, g]]) for g in targets[c]} for c in targets}


def _narrowed(docs: DataFrame, open_at: DataFrame, column: str, levels: tuple[int, ...]) -> DataFrame:
    """(source, want, low, have, upto, rows): for each source the value ``low`` of ``column`` at which the running sum of
    sizes reaches ``want``, the sum before it and with it, and the rows there. open_at: source, want, have."""
    shift, at = sum(levels), open_at.withColumn("low", F.lit(0).cast("long"))
    for bits in levels:
        shift -= bits
        o = at.select(F.col("source").alias("s"), "want", "have", "low")
        inside = docs.join(o, docs["source"].eqNullSafe(o["s"])).where(F.shiftright(column, shift + bits) == F.col("low"))
        bins = inside.groupBy("source", F.shiftright(column, shift).alias("bin")).agg(F.sum("size").cast("double").alias("size"), F.count("*").alias("rows"), F.first("want").alias("want"), F.first("have").alias("have"))
        upto = bins.withColumn("upto", F.col("have") + F.sum("size").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
        cross = upto.where(F.col("upto") >= F.col("want")).groupBy("source").agg(F.min(F.struct("bin", F.col("want").alias("want"), (F.col("upto") - F.col("size")).alias("have"), "upto", "rows")).alias("c"))
        last, at = at, stash(cross.select("source", "c.want", F.col("c.bin").alias("low"), "c.have", "c.upto", "c.rows"))
        unstash(last)
    return at


def cuts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut, cut_tie): documents with ``place`` below the cut, or at it with ``tie`` below the other one, have words
    nearest to ``want``. docs: source, place, tie, size."""
    with_it = F.col("upto") - F.col("want") <= F.col("want") - F.col("have")
    found = _narrowed(docs, wanted.select("source", F.col("want").cast("double").alias("want"), F.lit(0.0).alias("have")), "place", LEVELS)
    single = found.where("rows = 1").select("source", F.when(with_it, F.col("low") + 1).otherwise(F.col("low")).alias("cut"), F.lit(0).cast("long").alias("cut_tie"))
    shared = found.where("rows > 1")
    if shared.isEmpty():
        return single
    o = shared.select(F.col("source").alias("s"), "low")
    there = stash(docs.join(o, docs["source"].eqNullSafe(o["s"]) & (docs["place"] == o["low"])).select("source", "tie", "size"))
    parted = _narrowed(there, shared.select("source", "want", "have"), "tie", TIES)
    tie = parted.select(F.col("source").alias("s"), F.when(with_it, F.col("low") + 1).otherwise(F.col("low")).alias("cut_tie"))
    return single.union(shared.join(tie, shared["source"].eqNullSafe(tie["s"])).select("source", F.col("low").alias("cut"), "cut_tie"))


def mixed(docs: DataFrame, times: int = MAX_TIMES, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row of ``docs`` (doc_id, source, text), and the columns
    ``carry`` of it, such as the text."""
    text = F.col("text")
    sized = stash(docs.select("doc_id", "source", *carry, F.size(words(text)).cast("long").alias("size"), order_hash(F.col("doc_id"), text).alias("place"), tie_hash(text).alias("tie")))
    plan = tilted(share_out(sized.groupBy("source").agg(F.sum("size").alias("source_size")), times))
    plan = plan.withColumn("whole", F.floor(F.col("rate") + 1e-9))
    plan = stash(plan.select("source", "source_size", "target", "whole", (F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("source_size")).alias("want")))
    cut = cuts(sized.where("size > 0"), plan.where("want > 1e-6").select("source", "want")).withColumnRenamed("source", "c")
    cut = plan.join(cut, plan["source"].eqNullSafe(F.col("c")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("cut_tie", F.lit(0)).alias("cut_tie"))
    if plan.count() <= SOURCES:  # else Spark chooses how to join
        cut = F.broadcast(cut)
    out = sized.join(cut, sized["source"].eqNullSafe(cut["s"]))
    more = (F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & (F.col("tie") < F.col("cut_tie")))
    copies = F.least(F.lit(times), F.col("whole") + F.when(more, 1).otherwise(0))
    return out.select("doc_id", *carry, "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
