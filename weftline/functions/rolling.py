"""The hash of a k-mer, in column functions; numpy and SQL give the same numbers.

A symbol is a number (``code``). A row of symbols is a polynomial of them modulo a prime, which can be put together from the
polynomials of its parts: twice, to two bases. ``scatter``, a permutation of the residues, takes the order of the
alphabet out of it; the two residues make a number of 62 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prime 2^31 - 1, so that all products fit 64 bits; the bases of the two polynomials and that of a symbol
#: of several letters. The fifth power permutes the residues, as 5 does not divide the prime less one.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_597_334_677)
SYMBOL_BASE = 1_664_525


def code(symbol: Column, letters: int = 1) -> Column:
    """A symbol as a number: the code point of a letter, a polynomial of them for symbols of several ``letters``."""
    if letters == 1:
        return F.ascii(symbol).cast("long")
    return F.aggregate(F.filter(F.split(symbol, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * SYMBOL_BASE + F.ascii(c), F.lit(PRIME)))


def joined(left: Column, right: Column, right_size: int, base: int) -> Column:
    """The polynomial of two neighbouring rows of symbols."""
    return F.pmod(left * pow(base, right_size, PRIME) + right, F.lit(PRIME))


def scatter(x: Column) -> Column:
    p = F.lit(PRIME)
    squared = F.pmod(x * x, p)
    return F.pmod(F.pmod(squared * squared, p) * x, p)


def hashed(first: Column, second: Column) -> Column:
    return scatter(first) * (1 << 31) + scatter(second)


def digits(h: Column) -> Column:
    """A hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))
