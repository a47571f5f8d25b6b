"""Lempel-Ziv phrase fingerprints.

A text is parsed to the phrases of a growing dictionary: each phrase is the longest one that is known already and the character behind
it, and becomes known. Texts that share passages share phrases, much as a compressor would profit from one when it reads the other. The set of phrases is
hashed and its ``SIZE`` smallest hashes, of 48 bits, are the fingerprint (base64; shorter for texts of fewer phrases). The likeness
of two fingerprints is the share of the smallest hashes of both together that are in both: an estimate of the Jaccard similarity of the phrase sets,
exact for texts with at most ``SIZE`` phrases.

``fingerprints`` compares each document with an edited copy, whose last quarter is replaced by the start of the next document, and with
the next document itself. Documents are in order of doc_id, null last, and of a hash of the text where ids are equal; rows equal in both are
one document of that order and get equal results. After the last comes the first; a document alone is its own next one.

The order is made without a sort of texts in one place: ids and text hashes, small rows, are dealt by range, and the first of each range
bounds it. Each document goes to its range, and the first of a range also to the one before, as that one's last has to be compared with
it: one shuffle of the texts. A row that is repeated very often gets a range of its own, which is spread over several tasks. The driver holds one key for
each range and for each such row.

A null text counts as empty; an empty text has no phrases and an empty fingerprint, two of them are alike (1). Very long texts are parsed whole, with a
dictionary of their phrases in memory. Ties and repeated rows are as above; an empty table gives an empty one. Other columns are left out, so
they may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SIZE = 128
#: The base of the phrase polynomial, and the multipliers and shifts of the mixing function.
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Characters whose hashes are made together.
PIECE = 1 << 20
#: Ranges for each shuffle partition.
RANGES = 4
_KEY = ["absent", "doc_id", "tie"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    return tuple(np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64)))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def parse(chars: np.ndarray, trie: dict[int, int], node: int, at: int, ends: list[int]) -> tuple[int, int]:
    """Goes on with a parse from the phrase ``node`` at place ``at``: known phrases are numbers in ``trie`` by the number before
    and the character; the places where new phrases end are added to ``ends``. Gives the phrase and the place where it stopped."""
    known, add, count = trie.get, ends.append, len(trie)
    for low in range(0, len(chars), PIECE):
        for c in chars[low : low + PIECE].tolist():
            at += 1
            key = node << 21 | c
            node = known(key, 0)
            if not node:
                count += 1
                trie[key] = count
                add(at)
    return node, at


def hashes(chars: np.ndarray, start: int, ends: np.ndarray) -> np.ndarray:
    """A hash of each phrase; the first begins at ``start``. Sums of characters times powers, from which any range can be
    taken, are made for about ``PIECE`` characters at a time."""
    out, row = [], 0
    while row < len(ends):
        stop = max(row + 1, int(np.searchsorted(ends, start + PIECE, "right")))
        part = ends[row:stop] - start
        power, inverse = _powers(max(PIECE, int(part[-1])))
        each = mixed(chars[start : start + part[-1]].astype(np.uint64) + np.uint64(1)) * power[: part[-1]]
        upto = np.concatenate(([np.uint64(0)], np.cumsum(each, dtype=np.uint64)))
        begin = np.concatenate(([0], part[:-1]))
        out.append(mixed((upto[part] - upto[begin]) * inverse[begin] + (part - begin).astype(np.uint64)))
        start, row = int(ends[stop - 1]), stop
    return np.concatenate(out) >> np.uint64(16) if out else np.zeros(0, np.uint64)


def smallest(phrase_hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    if len(phrase_hashes) > 8 * size:
        phrase_hashes = phrase_hashes[phrase_hashes <= np.partition(phrase_hashes, 4 * size)[4 * size]]
    out = np.sort(phrase_hashes)
    return out[np.insert(out[1:] != out[:-1], 0, True)][:size] if len(out) else out


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Of the ``size`` smallest hashes of both fingerprints together, the share that is in both; 1 for two empty ones."""
    both = np.sort(np.concatenate((a, b)))
    if not len(both):
        return 1.0
    again = np.append(both[1:] == both[:-1], False)
    first = np.insert(~again[:-1], 0, True)  # the first of equal ones
    return float(again[first][:size].sum() / min(size, int(first.sum())))


def encoded(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def fingerprint(text: str, size: int = SIZE) -> np.ndarray:
    """The fingerprint of one text as numbers."""
    chars, ends = points(text), []
    parse(chars, {}, 0, 0, ends)
    return smallest(hashes(chars, 0, np.array(ends, np.int64)), size)


class _Parsed:
    """A document with the state of its parse where its last quarter begins."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.rows = doc_id, text, 1
        self.chars, self.ends = points(text), []
        self.cut = len(text) - len(text) // 4
        self.trie: dict[int, int] = {}
        self.node, at = parse(self.chars[: self.cut], self.trie, 0, 0, self.ends)
        self.before, self.sure = dict(self.trie) if self.cut < len(text) else self.trie, len(self.ends)
        parse(self.chars[self.cut :], self.trie, self.node, at, self.ends)
        del self.trie
        self.hashes = hashes(self.chars, 0, np.array(self.ends, np.int64))
        self.fingerprint = smallest(self.hashes)

    def beside(self, following: _Parsed) -> tuple:
        """The result's columns: the edited copy goes on from the kept state, so its first part is not parsed again."""
        quarter = len(self.text) - self.cut
        edited, ends = self.text[: self.cut] + following.text[:quarter], []
        parse(following.chars[:quarter], self.before, self.node, self.cut, ends)
        start = self.ends[self.sure - 1] if self.sure else 0
        more = hashes(np.concatenate((self.chars[: self.cut], following.chars[:quarter])), start, np.array(ends, np.int64))
        other = smallest(np.concatenate((self.hashes[: self.sure], more)))
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(self.fingerprint), encoded(other),
            likeness(self.fingerprint, other), likeness(self.fingerprint, following.fingerprint),
        )


def _tuple(r) -> tuple:
    return bool(r["absent"]), r["doc_id"] if r["doc_id"] is not None else 0, r["tie"]


def _ranges(keys: DataFrame, parts: int) -> tuple[list[tuple], list[int], dict[tuple, list[int]]]:
    """(bounds, ways, first): where ranges begin; over how many tasks each is spread; and by the first key of a range, the
    ranges before that need it. keys: distinct keys with ``rows``."""
    dealt = keys.repartitionByRange(parts * RANGES, *_KEY).groupBy(F.spark_partition_id().alias("p"))
    found = dealt.agg(F.min(F.struct(*_KEY)).alias("k"), F.sum("rows").alias("rows")).collect()
    total = sum(r["rows"] for r in found)
    bounds = sorted((*_tuple(r["k"]), 0) for r in found)
    often = max(16, total // (2 * parts))
    hot = {(*_tuple(r), 0): r["rows"] for r in keys.where(F.col("rows") > often).collect()}  # at most 2 * parts
    if hot:  # each alone in a range that ends right behind it
        bounds = sorted({*bounds, *hot, *((*k[:3], 1) for k in hot)})

        def place(batches):
            for batch in batches:
                got = [bisect_right(bounds, (*_tuple(r), 0)) - 1 for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), *batch.columns], names=["range", *_KEY])

        kind = keys.schema["doc_id"].dataType.simpleString()
        rows = keys.select(*_KEY).mapInArrow(place, f"range int, absent boolean, doc_id {kind}, tie long").groupBy("range").agg(F.min(F.struct(*_KEY)).alias("k")).collect()
        starts = {r["range"]: (*_tuple(r["k"]), 0) for r in rows}
    else:
        starts = dict(enumerate(bounds))
    ways = [-(-hot[b] // often) if b in hot else 1 for b in bounds]
    there, first = sorted(starts), {}
    for i, own in enumerate(there):
        first.setdefault(starts[there[(i + 1) % len(there)]], []).append(own)
    return bounds, ways, first


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs`` (doc_id,
    text), dealt over ``parts`` tasks (by default Spark's shuffle partitions)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    bounds, ways, first = _ranges(stash(rows.groupBy(*_KEY).agg(F.count("*").alias("rows"))), parts)
    if not bounds:
        return spark.createDataFrame([], result)

    def deal(batches):
        lent: set[tuple] = set()
        for batch in batches:
            to, way, guest, of = [], [], [], []
            for i, r in enumerate(batch.select(_KEY).to_pylist()):
                key = (*_tuple(r), 0)
                own = bisect_right(bounds, key) - 1
                to.append(own), way.append(i % ways[own]), guest.append(False), of.append(i)
                if key in first and key not in lent:  # once is enough, whatever the number of equal rows
                    lent.add(key)
                    for other in first[key]:
                        for w in range(ways[other]):
                            to.append(other), way.append(w), guest.append(True), of.append(i)
            part = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(way, pa.int32()), pa.array(guest, pa.bool_()), *part.columns], names=["to", "way", "guest", *_KEY, "text"])

    def compare(batches):
        pending, at = None, None
        for batch in batches:
            done = []
            for to, way, guest, doc_id, t in zip(*(batch.column(c).to_pylist() for c in ("to", "way", "guest", "doc_id", "text")), strict=True):
                if (to, way) != at:
                    if pending:
                        done += [pending.beside(pending)] * pending.rows
                    pending, at = None, (to, way)
                if guest:
                    if pending:
                        done += [pending.beside(_Parsed(doc_id, t))] * pending.rows
                        pending = None
                elif pending and (pending.doc_id, pending.text) == (doc_id, t):
                    pending.rows += 1
                else:
                    now = _Parsed(doc_id, t)
                    if pending:
                        done += [pending.beside(now)] * pending.rows
                    pending = now
            yield batch_of(done)
        if pending:
            yield batch_of([pending.beside(pending)] * pending.rows)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    target = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * len(target)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    dealt = rows.mapInArrow(deal, f"to int, way int, guest boolean, absent boolean, doc_id {kind}, tie long, text string")
    placed = dealt.repartition(parts, "to", "way").sortWithinPartitions("to", "way", "guest", *_KEY)
    return placed.select("to", "way", "guest", "doc_id", "text").mapInArrow(compare, result)
