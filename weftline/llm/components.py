"""Connected components of a link table: smallest label of the neighbours, then of the label, until nothing changes.

Links may be repeated, in either direction and to themselves; those with a null end join nothing and are left out. An
empty table has no components. Other columns are ignored. Labels do not depend on the order of rows: of several smallest there is
only one. Ids are numbers, so texts and their lengths play no part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def components(links: DataFrame) -> DataFrame:
    """(id, label) for each id of ``links`` (a, b): label is the smallest id that links reach. Written to the shared
    folder each round, so lineage stays short; every step is a join or a partial aggregation, and hubs spread."""
    both = stash(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = stash(step)
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        done = step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"), "was")
        done = stash(done)
        changed = not done.where("label <> was").isEmpty()
        unstash(step)
        unstash(labels)
        labels = done.select("id", "label")
        labels._weftline_path = done._weftline_path
        if not changed:
            unstash(both)
            return labels
