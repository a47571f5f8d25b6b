"""N-gram Jaccard join by parity sketches.

A text's set is its distinct shingles of ``width`` words. Texts link when ``100 * intersection >= percent * union``.

Sketches. The range of 64-bit shingle hashes is cut into ``m`` equal parts, and the hashes in a part are XORed to one
word: a parity sketch in which each differing shingle changes one word at most, so the number of differing words is a
lower bound of the symmetric difference. Two sets of a size band that link differ in ``d`` shingles at most, and with
``m = d + spare + agree`` parts they agree in ``spare + agree`` words at least. A set whose empty parts do not exceed
``spare`` (what chance leaves empty, and five deviations more) need not emit them; any other emits all. So two linked sets
meet in ``agree`` keys (band, part, word) at least, and each of them can go without its ``agree - 1`` most frequent ones:
the rarest key that they share stays. That keeps passages which many documents repeat out of the buckets. A set is in its
own size band and in the one below if a smaller partner may be there. A second sketch of single bits (``FINE`` bits for
each allowed difference) gives a Hamming distance that drops most false candidates before sets are fetched. What is left
is verified on the hashed shingles of whole texts, which are written once for the texts that are in a candidate pair; filters of
bounded size (``members``) keep the texts that are in none, and keys of one text, out of the shuffles.

Groups. Equal sets are one vertex from the start. The result needs connectivity and not all pairs, so candidates are
taken in rounds: first the words of ``FIRST`` parts, each bucket as a star around its smallest member; verified links are
contracted; then all parts, but only buckets that still hold several components: first as a star around the member that
shares most, which is the centre of its copies, then with ``PIVOTS`` times as many pivots in each round. A bucket of no more
members than pivots is then complete. What a join looks keys up in is written first, so that Spark knows its size: where it
is below ``spark.sql.autoBroadcastJoinThreshold`` the buckets are not shuffled at all, otherwise both sides are, and
adaptive execution splits the hot keys. Sizes and bit sketches are compared inside the join, so it gives plausible pairs only. No link between different
components is left unexamined when the rounds end, and a group of near copies costs its members times the pivots.

Null, empty and blank texts have an empty set, link with nothing and are their own component; rows without doc_id
get a null component unless an equal text has one. Rows that share a doc_id are one vertex. Extra columns are ignored.
An empty table gives an empty one. Ties cannot change the result: links do not depend on the order in which pairs are examined, and a
component has one smallest doc_id. Very long texts are treated whole, and their sketches have parts in proportion to their sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import stash, unstash
from .components import components
from .members import may_be_in, may_hold, members

BAND, FINE = 1.4, 16
#: The lowest bits of a key hold the number of its band.
BAND_BITS = 6
FIRST, PIVOTS = 4, 16
#: The parts are joined in this many passes, so that the shuffle files of one pass are on disk at a time.
PASSES = 4
#: Words of 64 bits that a bucket row carries of a bit sketch; longer sketches are folded to that, and compared whole later.
CARRIED = 8
#: A filter of fewer bits for a number lets more than one in twenty others through, and is followed by the exact join.
CROWDED = 8
#: Rows of keys that a task holds in arrays at a time.
KEY_ROWS = 4096


@lru_cache(maxsize=65536)
def differing(size: int, percent: int) -> int:
    """The most elements in which two linked sets can differ if the smaller has ``size``."""
    larger = size * 100 // percent
    return max((size + b) - 2 * -(-percent * (size + b) // (100 + percent)) for b in range(max(size, larger - 40), larger + 1))


@lru_cache(maxsize=1024)
def band_parts(band: int, percent: int) -> tuple[int, int, int]:
    """(parts, spare, agree) of the sketches of a size band."""
    low, top = BAND**band, math.ceil(BAND ** (band + 1))
    d = math.floor((100 - percent) / (100 + percent) * (top + top * 100 / percent))
    agree = 1 + max(min(8, int(low / 8)), int(low / 32))
    m = d + agree
    while m < 8 * top:
        void = math.exp(-low / m)
        spare = math.ceil(m * void + 5 * math.sqrt(m * void * max(0.0, 1 - (1 + low / m) * void)))
        if d + spare + agree <= m:
            break
        m = d + spare + agree
    return m, m - d - agree, agree


@lru_cache(maxsize=65536)
def bands(size: int, percent: int) -> list[int]:
    """The band of a set, and the next lower one if a linked set can lie there."""
    own = math.floor(math.log(size) / math.log(BAND) + 1e-12)
    least = math.ceil(size * percent / 100)
    low = math.floor(math.log(least) / math.log(BAND) + 1e-12) if least else own
    return list(range(low, own + 1))


@lru_cache(maxsize=1024)
def _edges(m: int) -> np.ndarray:
    return np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m)


def _sketch(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fine bits) of a set of sorted hashes; no keys if only equal sets can link with it."""
    keys = [np.zeros(0, np.uint64)]
    if not differing(len(s), percent):
        return keys[0], keys[0]
    for band in bands(len(s), percent):
        m, spare, _ = band_parts(band, percent)
        at = np.concatenate(([0], np.searchsorted(s, _edges(m))))
        counts = np.diff(np.concatenate((at, [len(s)])))
        word = np.zeros(m, np.uint64)
        filled = np.flatnonzero(counts)
        word[filled] = np.bitwise_xor.reduceat(s, at[filled])
        parts = filled if m - len(filled) <= spare else np.arange(m)
        key = textvec.mix(word[parts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band * 1_000_003 + 1) * (parts.astype(np.uint64) + np.uint64(1)))
        keys.append(key << np.uint64(BAND_BITS) | np.uint64(band))
    width = 64 * max(1, -(-FINE * (differing(len(s), percent) + 1) // 64))
    width = 64 * (1 << int(width // 64 - 1).bit_length())  # powers of two, so that a longer sketch folds onto a shorter one
    bits = np.bincount((textvec.mix(s) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.concatenate(keys), np.packbits(bits, bitorder="little").view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketched(docs: DataFrame, width: int, percent: int, without=None) -> DataFrame:
    """(doc_id, n, keys, fine): size and sketches of each text's set. ``without``: a filter of ids, and only rows that cannot be in it are taken;
    it is asked in the same Python process, as a second one would hold memory beside it."""

    def run(batches):
        for batch in batches:
            if without is not None:
                batch = batch.filter(pa.array(~may_hold(without.value, batch.column("doc_id").to_numpy())))
            for row, data, offsets in textvec.pieces(batch.column("text")):
                n, keys, fine = [], [], []
                for s in textvec.shingle_sets(data, offsets, width):
                    n.append(len(s))
                    k, f = _sketch(s, percent) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                    keys.append(k)
                    fine.append(f)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(n)), pa.array(n, pa.int64()), _lists(keys), _lists(fine)], names=["doc_id", "n", "keys", "fine"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, keys array<long>, fine array<long>")


def identified(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, h1, h2): size and identity of each text's set."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in textvec.pieces(batch.column("text")):
                n, h1, h2 = [], [], []
                for s in textvec.shingle_sets(data, offsets, width):
                    n.append(len(s))
                    # identity: two independent 64-bit sums over the set
                    h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(textvec.mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(n)), *(pa.array(x, pa.int64()) for x in (n, h1, h2))], names=["doc_id", "n", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The hashed sets of some vertices (id): each text is hashed once and written, however many pairs it is in. A filter of the ids
    is asked in the process that hashes, so texts are not shuffled. The few others that it lets through have sets here too, which
    pairs never ask for; a filter that is too full to tell most of them is followed by the exact join."""
    ids = stash(ids.select("id").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    there = members(ids, "id")
    if there is None:
        rows = rows.join(ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            if there is not None:
                batch = batch.filter(pa.array(may_hold(there.value, batch.column("id").to_numpy())))
            for row, data, offsets in textvec.pieces(batch.column("text")):
                sets = list(textvec.shingle_sets(data, offsets, width))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sets)), _lists(sets)], names=["id", "s"])

    found = rows.mapInArrow(run, "id long, s array<long>")
    if there is not None and 64 * len(there.value) < CROWDED * ids.count():
        found = found.join(ids, "id", "left_semi")
    out = stash(found)
    unstash(ids)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def parts(column):
        values, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
        return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(parts(batch.column("sa")), parts(batch.column("sb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _exploded(rows: DataFrame, k: int, there) -> DataFrame:
    """(id, key): the keys of pass ``k`` that may be in the filter."""

    def run(batches):
        for batch in (whole.slice(i, KEY_ROWS) for whole in batches for i in range(0, len(whole), KEY_ROWS)):
            keys, at = batch.column("keys"), batch.column("keys").offsets.to_numpy()
            values = keys.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            mine = (values >> BAND_BITS) % PASSES == k
            values, row = values[mine], row[mine]
            if there is not None:
                held = may_hold(there.value, values)
                values, row = values[held], row[held]
            order = np.lexsort((values, row))
            values, row = values[order], row[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
            values, row = values[first], row[first]
            for i in range(0, len(values), 1 << 16):
                part = batch.column("id").take(pa.array(row[i : i + (1 << 16)]))
                yield pa.RecordBatch.from_arrays([part, pa.array(values[i : i + (1 << 16)])], names=["id", "key"])

    return rows.select("id", "keys").mapInArrow(run, "id long, key long")


def _may_link(percent: int):
    """Whether sizes (na, nb) and the Hamming distance of fine sketches (finea, fineb) leave a link possible."""
    far = F.aggregate(F.zip_with("finea", "fineb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent)
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return near & ((F.size("finea") != F.size("fineb")) | (far <= most))


def _plausible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link."""
    for x in "ab":
        pairs = pairs.join(sizes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"fine{x}")), x)
    return pairs.where(_may_link(percent)).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    base = stash(identified(docs, width))
    sets = stash(base.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id")))
    # one row for each different set: the row of its smallest doc_id, and only that is sketched. The others are few or many; a filter
    # of their ids tells most rows that stay, so that those need not be shuffled
    chosen = sets.where("id is not null").select("id").distinct()
    filled = base.where("n > 0 and doc_id is not null").select("doc_id")
    others = stash(filled.join(chosen, filled["doc_id"] == chosen["id"], "left_anti").distinct())
    shared_ids = filled.count() - filled.distinct().count()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    there = members(others, "doc_id")
    # these few texts are written before they are sketched: a filter in Python and a sketch in one task would be two processes
    some = rows.join(chosen, "id", "left_semi") if there is None else stash(rows.where(may_be_in(F.col("id"), there)).join(chosen, "id", "left_semi"))
    vertex = sketched(some.withColumnRenamed("id", "doc_id"), width, percent)
    if there is not None:
        vertex = vertex.union(sketched(rows.withColumnRenamed("id", "doc_id"), width, percent, there))
    vertex = vertex.where("n > 0").withColumnRenamed("doc_id", "id")
    if shared_ids:
        vertex = vertex.distinct()
    vertex = stash(vertex)
    unstash(others, some)
    sizes = stash(vertex.select("id", "n", "fine"))
    found = None  # verified links so far
    labels = None
    tested = None
    written = []

    def keep(df: DataFrame) -> DataFrame:
        written.append(stash(df))
        return written[-1]

    def relabel():
        nonlocal labels
        labels = components(found)

    def examine(pairs: DataFrame, hashed: DataFrame | None = None) -> None:
        """Verifies pairs that have not been examined yet, and contracts the links."""
        nonlocal found, tested
        pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        ids = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        likely = keep(_plausible(pairs, keep(sizes.join(ids, "id", "left_semi")), percent))
        if likely.isEmpty():
            return
        tested = likely if tested is None else tested.union(likely)
        own = hashed if hashed is not None else _sets(docs, likely.select(F.col("a").alias("id")).union(likely.select("b")), width)
        good = keep(_verified(likely, own, percent))
        if hashed is None:
            unstash(own)
        if not good.isEmpty():
            found = good if found is None else found.union(good)
            relabel()

    # a star in each bucket of the first parts
    some = vertex.select("id", F.explode(F.slice("keys", 1, FIRST)).alias("key"))
    shared = keep(some.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a"))
    examine(some.join(shared, "key").where("id <> a").select("a", F.col("id").alias("b")))
    # every part, buckets of several components only
    bucket, parts = None, []
    for k in range(PASSES):
        own = F.filter("keys", lambda x: F.pmod(F.shiftright(x, BAND_BITS), F.lit(PASSES)) == k)
        every = vertex.select(F.explode(F.array_distinct(own)).alias("key"))
        # most keys are of one text: only counts of keys are shuffled for them
        often = stash(every.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"))
        parts.append(keep(_exploded(vertex, k, members(often, "key")).join(often, "key").select("key", "id", "g")))
        unstash(often)
        bucket = parts[0] if bucket is None else bucket.union(parts[-1])
    unstash(vertex)
    labelled = bucket.withColumn("c", F.col("id")) if labels is None else bucket.join(labels, "id", "left").withColumn("c", F.coalesce("label", "id"))
    mixed = keep(labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    bucket = bucket.join(mixed, "key", "left_semi").select("key", "id", "g")
    # of the keys of a text in a band, its most frequent ones are not needed
    band = F.pmod("key", F.lit(1 << BAND_BITS)).cast("int")
    spared = F.element_at(F.array(*[F.lit(band_parts(b, percent)[2] - 1) for b in range(1 << BAND_BITS)]), band + 1)
    rank = F.row_number().over(Window.partitionBy("id", "band").orderBy(F.desc("g"), "key"))
    bucket = bucket.withColumn("band", band).withColumn("rank", rank).where(F.col("rank") > spared).select("key", "id")
    # bucket rows carry what decides whether a pair is plausible, so that only such pairs come out of the join
    folded = F.transform(F.sequence(F.lit(0), F.least(F.size("fine"), F.lit(CARRIED)) - 1), lambda i: F.aggregate(F.filter("fine", lambda _, j: j % CARRIED == i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
    short = sizes.select("id", "n", F.when(F.size("fine") > 0, folded).otherwise(F.col("fine")).alias("fine"))
    bucket = keep(bucket.join(short, "id").select("key", "id", "n", "fine"))
    unstash(*parts, mixed)
    hashed = _sets(docs, bucket, width)
    pivots, done = 1, bucket
    while True:
        now = bucket.withColumn("c", F.col("id")) if labels is None else bucket.join(labels, "id", "left").withColumn("c", F.coalesce("label", "id"))
        state = keep(now.groupBy("key").agg(F.count("*").alias("g"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "g"))
        now = keep(now.join(state, "key").select("key", "id", "n", "fine", "c", "g"))
        unstash(done)
        if now.isEmpty():
            break
        # the text that shares most is the centre of its copies: all buckets of a group choose the same pivots
        shares = now.groupBy("id").agg(F.sum("g").alias("shared"))
        few = now.where(F.col("g") <= pivots).select("key", "id", "n", "fine", "c")
        many = now.where(F.col("g") > pivots)
        salt = F.pmod(F.xxhash64("id", F.lit(pivots)), F.lit(pivots))
        ranked = many.join(shares, "id").select("key", salt.alias("salt"), F.struct("shared", -F.col("id"), "id", "n", "fine", "c").alias("p"))
        picked = ranked.groupBy("key", "salt").agg(F.max("p").alias("p")).select("key", "p.id", "p.n", "p.fine", "p.c")
        left = keep(few.union(picked).select("key", *[F.col(x).alias(f"{x}a") for x in ("id", "n", "fine", "c")]))
        right = now.select("key", *[F.col(x).alias(f"{x}b") for x in ("id", "n", "fine", "c")])
        examine(left.join(right, (left["key"] == right["key"]) & (F.col("ca") != F.col("cb")) & _may_link(percent)).select(F.col("ida").alias("a"), F.col("idb").alias("b")), hashed)
        done, bucket = now, many.select("key", "id", "n", "fine")
        pivots *= PIVOTS
    whole = sets if labels is None else sets.join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("id"))
    whole = whole.select("h1", "h2", F.col("id").alias("c"))
    out = base.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(whole, ["h1", "h2"], "left")
    # a component is named after its smallest doc_id; a text without words after itself
    out = keep(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id")))
    for df in [*written[:-1], base, sets, sizes, hashed]:
        unstash(df)
    return out
