"""From reads to window chunks: strands, masks, k-mers, sliding minima, window vectors and changes.

Everything up to a chunk is inside one row, so no step needs a shuffle; the first one is on the chunk's key, by the join.
The stages are column functions: a strand is cut to blocks of window positions before anything of the length of a sequence
is exploded, and a block is an array that doubles its way to k-mers and window minima. ``chunks`` gives the same rows from
``arrow_sketch``, which is what the joins use.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import SketchParams
from weftline.functions.rolling import BASES, code, digits, hashed, joined
from weftline.functions.sequence import ahead, head, reverse_complement

from .arrow_sketch import sketched

_MARK = "\x01"
#: What one symbol of a mask spans: a letter, a run of a letter, or a tandem run of a motif of up to six letters.
_RUNS = {"none": "(.)", "hpc": r"(.)\1*", "microsat": r"(.{1,6}?)\1+|(.)"}


def strands(reads: DataFrame) -> DataFrame:
    """Both strands of each read: (read_id, fw, raw_length, seq)."""
    both = F.array(F.struct(F.lit(True).alias("fw"), F.col("sequence").alias("seq")), F.struct(F.lit(False).alias("fw"), reverse_complement(F.col("sequence")).alias("seq")))
    return reads.where(F.col("sequence").isNotNull()).select("read_id", "raw_length", F.explode(both).alias("x")).select("read_id", "x.fw", "raw_length", "x.seq")


def masked(strand: DataFrame, mask: str = "hpc") -> DataFrame:
    """(read_id, fw, raw_length, syms): symbols ``s`` with the raw interval ``a`` to ``z`` (inclusive) that each spans.

    ``none``: each letter; ``hpc``: a run of one letter is one symbol; ``microsat``: a motif of at most six letters
    repeated in tandem is one symbol, the shortest motif at the leftmost place first (symbols end in a dot there, so that
    a row of symbols reads in one way only)."""
    pattern = F.lit(_RUNS[mask])
    marked = strand.withColumn("marked", F.regexp_replace("seq", pattern, F.lit(f"{_MARK}$0")))
    tokens = F.slice(F.split("marked", _MARK), 2, F.greatest(F.size(F.split("marked", _MARK)) - 1, F.lit(0)))
    at = F.filter(F.transform(F.split("marked", ""), lambda c, i: F.when(c == _MARK, i)), lambda i: i.isNotNull())
    parts = marked.select("read_id", "fw", "raw_length", tokens.alias("tokens"), F.transform(at, lambda p, j: p - j).alias("starts"))
    if mask == "microsat":
        symbol = lambda t: F.concat(F.regexp_replace(t, F.lit(r"^(.{1,6}?)\1+$"), F.lit("$1")), F.lit("."))
    else:
        symbol = lambda t: F.substring(t, F.lit(1), F.lit(1))
    syms = F.zip_with("tokens", "starts", lambda t, a: F.struct(symbol(t).alias("s"), a.alias("a"), (a + F.length(t) - 1).alias("z")))
    return parts.select("read_id", "fw", "raw_length", syms.alias("syms"))


def eligible(mask_rows: DataFrame, p: SketchParams) -> DataFrame:
    """Strands with symbols enough for one position of all windows."""
    return mask_rows.where(F.size("syms") >= p.span)


def blocks(mask_rows: DataFrame, p: SketchParams) -> DataFrame:
    """Strands cut to blocks: (read_id, fw, raw_length, base, shifts, begins, syms). A block's positions are followed by
    all symbols that their windows need, and all but the first block have the position before them too."""
    last = F.size("syms") - p.span  # the last window position
    # slices only, so that a long strand is not copied to each of its blocks
    cut = F.transform(F.sequence(F.lit(0), F.floor(last / p.block).cast("int")), lambda b: F.struct(b.alias("b"), F.slice("syms", F.greatest(b * p.block - 1, F.lit(0)) + 1, F.lit(p.block + 1 + p.span)).alias("syms"), last.alias("last")))
    rows = eligible(mask_rows, p).select("read_id", "fw", "raw_length", F.explode(cut).alias("x"))
    base = F.greatest(F.col("x.b") * p.block - 1, F.lit(0))
    shifts = F.least((F.col("x.b") + 1) * p.block - 1, F.col("x.last")) - base + 1
    return rows.select("read_id", "fw", "raw_length", base.alias("base"), shifts.alias("shifts"), (F.col("x.b") == 0).alias("begins"), "x.syms")


def _doubled(df: DataFrame, name: str, width: int, combine) -> tuple[DataFrame, Column]:
    """``df`` with the columns that the result needs, and the combination of each ``width`` neighbours of an array."""
    have = 1
    while have * 2 <= width:
        df = df.withColumn(f"{name}{have * 2}", F.zip_with(f"{name}{have}", ahead(F.col(f"{name}{have}"), have), combine))
        have *= 2
    return df, F.col(f"{name}{have}")


def hashed_kmers(block_rows: DataFrame, p: SketchParams) -> DataFrame:
    """Blocks with ``h``: the hash of each k-mer (``functions.rolling``), in order of the symbols."""
    letters = 7 if p.mask == "microsat" else 1
    df, n, parts = block_rows, F.size("syms") - p.k + 1, []
    for i, base in enumerate(BASES):
        name = f"p{i}_"
        df = df.withColumn(f"{name}1", F.transform("syms", lambda x: code(x["s"], letters)))
        have = 1
        while have * 2 <= p.k:
            df = df.withColumn(f"{name}{have * 2}", F.zip_with(f"{name}{have}", ahead(F.col(f"{name}{have}"), have), lambda a, b: joined(a, b, have, base)))  # noqa: B023
            have *= 2
        kmer, at = None, 0
        for bit in reversed(range(p.k.bit_length())):  # k as a sum of powers of two, largest first
            if (size := p.k & (1 << bit)) :
                piece = ahead(F.col(f"{name}{size}"), at)
                kmer = piece if kmer is None else F.zip_with(kmer, piece, lambda a, b: joined(a, b, size, base))  # noqa: B023
                at += size
        df = df.withColumn(f"{name}k", head(kmer, n))
        parts.append(f"{name}k")
    return df.select(*block_rows.columns, F.zip_with(*parts, lambda a, b: hashed(a, b)).alias("h"))


def minima(kmer_rows: DataFrame, p: SketchParams) -> DataFrame:
    """Blocks with ``m``: for each k-mer place the smallest (hash, place) of ``window_size + 1`` k-mers from there on; of
    equal hashes the leftmost."""
    df = kmer_rows.withColumn("m1", F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    width = p.window_size + 1
    df, top = _doubled(df, "m", width, lambda a, b: F.least(a, b))
    have = 1 << (width.bit_length() - 1)
    whole = top if have == width else F.zip_with(top, ahead(top, width - have), lambda a, b: F.least(a, b))
    return df.select(*[c for c in kmer_rows.columns if c != "h"], head(whole, F.size("h") - p.window_size).alias("m"))


def vectors(minimum_rows: DataFrame, p: SketchParams) -> DataFrame:
    """Blocks with ``v``: for each window position the hashes of all windows, the place of the first window's minimum and
    that of the last window's."""
    acc = F.transform("m", lambda x: F.struct(F.array(x["h"]).alias("v"), x["p"].alias("a"), x["p"].alias("z")))
    for j in range(1, p.num_windows):
        acc = F.zip_with(acc, ahead(F.col("m"), j * p.window_size), lambda a, x: F.struct(F.concat(a["v"], F.array(x["h"])).alias("v"), a["a"].alias("a"), x["p"].alias("z")))
    return minimum_rows.select(*[c for c in minimum_rows.columns if c != "m"], head(acc, F.col("shifts")).alias("v"))


def emissions(vector_rows: DataFrame) -> DataFrame:
    """Blocks with ``e``: the positions where the hashes differ from those of the position before, and a strand's first.
    A minimum that only moves to an equal hash is no change."""
    before = F.concat(F.array(F.lit(None).cast("array<bigint>")), F.transform("v", lambda x: x["v"]))
    pairs = F.zip_with("v", before, lambda x, b: F.struct(x.alias("x"), b.alias("b")))
    indexed = F.transform(F.slice(pairs, F.lit(1), F.size("v")), lambda y, i: F.struct(y["x"].alias("x"), i.alias("i"), F.when(i == 0, F.col("begins")).otherwise(y["x"]["v"] != y["b"]).alias("new")))
    rows = vector_rows.withColumn("t", indexed)
    out = F.transform(F.filter("t", lambda y: y["new"]), lambda y: F.struct((y["i"] + F.col("base")).alias("shift"), y["x"]["v"].alias("v"), y["x"]["a"].alias("a"), y["x"]["z"].alias("z")))
    return rows.select(*[c for c in vector_rows.columns if c != "v"], out.alias("e"))


def emitted(reads: DataFrame, p: SketchParams) -> DataFrame:
    """Blocks of all strands of ``reads`` with their emissions."""
    return emissions(vectors(minima(hashed_kmers(blocks(masked(strands(reads), p.mask), p), p), p), p))


def chunks(reads: DataFrame, p: SketchParams = SketchParams(), columns_only: bool = False, keep: np.ndarray | None = None) -> DataFrame:  # noqa: B008
    """(key, read_id, fw, start, end, raw_length): window chunks of both strands. The key is the row of window hashes, eight bytes each;
    start and end are raw, inclusive and on the strand itself. Equal chunks of a strand are one.

    Strands are sketched in Arrow batches; ``columns_only`` uses column functions throughout (see README for the cost),
    with a shuffle at the end, as the blocks of a strand can repeat a chunk. ``keep``, a filter of keys, leaves out chunks of other
    keys where they are made (Arrow batches only)."""
    if not columns_only:
        return sketched(reads, p, keep).drop("place")
    e = F.transform("e", lambda x: F.struct(F.unhex(F.array_join(F.transform(x["v"], digits), "")).alias("key"), F.get("syms", x["a"])["a"].cast("long").alias("start"), F.get("syms", x["z"] + (p.k - 1))["z"].cast("long").alias("end")))
    rows = emitted(reads, p).select("read_id", "fw", "raw_length", F.explode(F.array_distinct(e)).alias("x"))
    return rows.select("x.key", "read_id", "fw", "x.start", "x.end", "raw_length").distinct()


def read_keys(reads: DataFrame, p: SketchParams = SketchParams(), keep: np.ndarray | None = None) -> DataFrame:  # noqa: B008
    """(key, read_id) of all ``chunks``, once for each, from Arrow batches."""
    return sketched(reads, p, keep, only=("key", "read_id"))


def read_hashes(reads: DataFrame, p: SketchParams = SketchParams()) -> DataFrame:  # noqa: B008
    """(read_id, positions, hashes): the minimizers of the forward strand with one window, by place. Arrays of a read are
    bounded by its own length."""
    one = SketchParams(p.k, 1, p.window_size, p.mask, p.block)
    found = sketched(reads, one, both=False).groupBy("read_id").agg(F.array_sort(F.collect_set(F.struct(F.col("place").alias("pos"), F.lower(F.hex("key")).alias("hash")))).alias("x"))
    return found.select("read_id", F.col("x.pos").alias("positions"), F.col("x.hash").alias("hashes"))
