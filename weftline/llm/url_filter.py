"""URL filter: a sort-merge range join of reversed-host keys with nested rule intervals.

A host such as ``www.example.net`` becomes the key ``net.example.www.``. All keys of a domain and its
subdomains then lie in one interval that starts at the domain's own key, and the intervals of two rules
are nested or disjoint. A sorted sweep over keys and interval starts therefore needs, for each nesting
depth, only the interval that began last: together these are the stack of active rules. Paths are
compared for the rules on the stack, and the longest rule wins.

The sweep runs over the distinct hosts, in segments of the key order, so a host with a third of all rows is
one row of it; an interval is copied to each segment that it meets. Only DataFrame operations are used.

Nulls, urls without ``://`` and empty tables: host and path are empty, no rule fits, the verdict is the default.
Repeated rows are judged alike. Of rules of one length that fit, the one later by code point wins, and of the same rule
twice its ``block``. Very long urls are read whole, in time that grows with their length. Columns that clash with those
added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lower_ascii, without

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hosts that are looked at to place the segments' bounds; the bounds decide on balance only.
BOUND_SAMPLE, SEGMENTS = 2048, 48


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each followed by a dot: a domain's key is a prefix of its subdomains' keys."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts(host) with ``__active``: the rules whose interval holds the host's key."""
    spark = hosts.sparkSession
    rules = (
        rules.where("host is not null and host <> '' and path is not null and verdict is not null").distinct()
        .withColumn("host", lower_ascii(F.col("host")))
        .groupBy("host")
        .agg(F.collect_set(F.struct("path", F.concat("host", "path").alias("rule"), "verdict")).alias("own"))
        .withColumn("key", host_key(F.col("host")))
        .withColumn("depth", F.size(F.split("host", r"\.", -1)))
        # the interval ends before the key whose last dot is one character higher
        .withColumn("end", F.expr("concat(substring(key, 1, length(key) - 1), '/')"))
    )
    depths = [r[0] for r in rules.select("depth").distinct().collect()]  # a host name has 127 labels at most
    keyed = hosts.withColumn("key", host_key(F.col("host")))
    seen = sorted(r[0] for r in keyed.select("key").orderBy(F.xxhash64("key"), "key").limit(BOUND_SAMPLE).collect())
    bounds = sorted({seen[len(seen) * i // SEGMENTS] for i in range(1, SEGMENTS)}) if seen else []
    at = F.array(*[F.lit(b) for b in bounds]).cast("array<string>")
    segment = lambda c: F.size(F.filter(at, lambda b: b <= c))
    event = lambda kind, extra: [F.lit(kind).alias("kind"), "key", "host", *extra]
    starts = rules.withColumn("segment", F.explode(F.sequence(segment(F.col("key")), segment(F.col("end")))))
    events = starts.select(*event(0, ["end", "own", "depth", "segment"])).unionByName(
        keyed.select(*event(1, [F.lit(None).cast("string").alias("end"), F.lit(None).cast("array<struct<path:string,rule:string,verdict:string>>").alias("own"), F.lit(0).alias("depth"), segment(F.col("key")).alias("segment")]))
    )
    w = W.partitionBy("segment").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    stack = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("end", "own")), ignorenulls=True).over(w).alias(f"d{d}") for d in sorted(depths)]
    none = F.array().cast("array<struct<path:string,rule:string,verdict:string>>")
    live = [F.when(F.col(f"d{d}.end") > F.col("key"), F.col(f"d{d}.own")).otherwise(none) for d in sorted(depths)]
    swept = events.select("kind", "key", "host", *stack).where("kind = 1")
    return swept.select("host", (F.flatten(F.array(*live)) if live else none).alias("__active")).where(F.size("__active") > 0)


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (the rule's, else ``default``)."""
    host, path = url_parts(F.col(url_col))
    parts = without(pages, *({"host", "path", "rule", "verdict", "__active", "__hit"} - {url_col})).withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    active = _sweep(parts.where("host <> ''").select("host").distinct(), rules)
    fits = F.filter("__active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    out = parts.join(active, "host", "left").withColumn("__hit", best)
    columns = [*[c for c in parts.columns if c not in ("host", "path")], "host", "path"]
    return out.select(*columns, F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))
