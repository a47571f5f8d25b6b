"""What the operators of this subpackage share: tables, the shared folder, and native text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.shared import dropped as unstash
from weftline.shared import spread
from weftline.shared import written as stash

__all__ = ["SPACES", "lower_ascii", "spaced", "spread", "stash", "table", "unstash", "without", "words"]

#: White space of all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, _UPPER, _LOWER)


def spaced(c: Column) -> Column:
    """A text with each white-space character turned into a space; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for x in SPACES[1:]:
        out = F.replace(out, F.lit(x), F.lit(" "))
    return out


def words(c: Column) -> Column:
    """The words of a text in order; null gives an empty array."""
    return F.array_remove(F.split(spaced(c), " ", -1), "")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add (names are compared as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
