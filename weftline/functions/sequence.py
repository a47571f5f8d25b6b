"""Column functions on sequences and arrays; all are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """A text as a sequence: its letters a-z in either case, the alphabet mapped onto ACGT in turn."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]+", ""), _LETTERS, ("ACGT" * 7)[:26])


def reverse_complement(seq: Column) -> Column:
    """The other strand; letters other than ACGT in either case stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def letters(seq: Column) -> Column:
    """The characters of a sequence as an array; empty for an empty sequence."""
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def ahead(values: Column, by: int) -> Column:
    """An array from its element ``by`` (from 0) on."""
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def head(values: Column, n: Column) -> Column:
    return F.slice(values, F.lit(1), F.greatest(n, F.lit(0)))


def length_difference(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.abs((a1 - a0) - (b1 - b0))


# two bits a symbol, four symbols a byte, the first in the lowest bits: A 0, C 1, G 2, T 3


def twobit_valid(seq: Column) -> Column:
    return F.regexp_like(seq, F.lit("^[ACGTacgt]*$"))


def twobit_encode(seq: Column) -> Column:
    """The packed form as binary; null if there is another letter. The number of symbols is kept beside it."""
    digits = F.transform(letters(F.translate(F.upper(seq), "ACGT", "0123")), lambda d: d.cast("int"))
    # pairs of neighbours, then pairs of pairs; every fourth element is a byte
    two = F.zip_with(digits, ahead(digits, 1), lambda a, b: a + 4 * F.coalesce(b, F.lit(0)))
    four = F.zip_with(two, ahead(two, 2), lambda a, b: a + 16 * F.coalesce(b, F.lit(0)))
    packed = F.transform(F.filter(four, lambda x, i: i % 4 == 0), lambda x: F.lpad(F.hex(x), 2, "0"))
    return F.when(twobit_valid(seq), F.unhex(F.array_join(packed, "")))


def twobit_decode(packed: Column, size: Column) -> Column:
    """Upper-case symbols of a packed sequence of ``size`` symbols."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(packed), "(..)", "$1 "), " "), lambda b: b != ""), lambda b: F.conv(b, 16, 10).cast("int"))
    four = lambda b: F.concat(*[F.substring(F.lit("ACGT"), F.pmod(F.shiftright(b, 2 * i), F.lit(4)) + 1, F.lit(1)) for i in range(4)])
    return F.substring(F.array_join(F.transform(codes, four), ""), F.lit(1), size)


def twobit_slice(packed: Column, size: Column, start: int, length: int) -> Column:
    """``length`` symbols from ``start`` (from 0), read from the bytes that hold them."""
    first, last = start // 4, (start + length - 1) // 4
    part = F.substring(packed, first + 1, last - first + 1)
    whole = twobit_decode(part, F.least(size - 4 * first, F.lit(4 * (last - first + 1))))
    return F.substring(whole, start - 4 * first + 1, length)
