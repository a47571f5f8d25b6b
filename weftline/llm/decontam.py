"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of the training texts.

Index. Items (cut to units of at most ``UNIT`` words) form an inverted index. A posting's impact is its BM25 part divided
by the unit's score against itself, so a passage that holds a unit scores one and ``THRESHOLD`` means the same for all
units. Postings are in unit order in blocks of ``BLOCK`` units with the largest impact of each block. Terms are split as
WAND does it with its pivot: the most frequent ones are left out of candidate search as long as they give no unit more
than ``COMMON`` of its score, so a unit that reaches the threshold must get the rest from the other terms.

Search. Passages are windows of ``2 * UNIT`` words, one every ``UNIT`` words, so each unit-long stretch is whole in one.
All passages of a piece of text are searched at once. In each the terms are ordered by their largest impact, and the pivot is the
one at which their sum reaches the threshold: terms before it cannot make a result by themselves, so blocks are opened for those from
the pivot on, passages without a pivot are skipped, and block maxima are added up by (passage, block). Only blocks whose bound
reaches the threshold are scored exactly, unit by unit. Nothing above the threshold is missed and no passage is left out.

Verification. An item is split into a question and an answer (its last line or sentence, at least a quarter and
``ANSWER`` words). The share of the 3-word shingles of each that the passage holds must be ``OVERLAP`` for both.

The index goes to the tasks in slices of at most ``SLICE`` bytes of item text, measured before anything is collected; a
larger benchmark is taken slice by slice, one pass each. The number of units, their mean length and the units that hold a
term are counted over the whole benchmark, so scores do not depend on the slices: these only part the postings.

Null and empty texts match nothing, a null doc_id is one id like others; an item without id or words is ignored; an empty table on
either side finds nothing. Very long texts are searched whole, piece by piece of a batch. Repeated items and rows give one
row for each pair of ids, with the best passage (the highest score, then the larger overlaps); a score on the threshold
counts as reaching it. Extra columns are ignored by ``contaminated`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import stash, unstash

UNIT, BLOCK, THRESHOLD, COMMON, OVERLAP, SHINGLE, ANSWER = 64, 8, 0.5, 0.2, 0.5, 3, 8
K1, B = 1.2, 0.75
SLICE = 8 << 20
#: Candidates that are scored together.
SCORED = 1 << 14


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textvec.word_bounds(data, np.array([0, len(data)]))
    return textvec.word_hashes(data, starts, ends)


def _answer_at(text: str) -> int:
    """The place in words where the answer of an item begins."""
    words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    at = 0
    for m in re.finditer(r"\n|(?<=[.!?])\x20", text.rstrip()):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text[: m.start()]))
        if words - n >= max(ANSWER, words // 4):
            at = n
    return at or max(0, words - max(ANSWER, words // 3))


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """The inverted index of one slice of items; arrays only, so it travels cheaply. ``whole``: the units and words of the
    whole benchmark, the sorted terms of the slice (others may be among them) and the units of the benchmark that hold each;
    without it the items are all there are."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, int, np.ndarray, np.ndarray] | None = None):
        self.item, self.parts, lists = [], [], []
        for item, text in items:
            h = _word_hashes(text or "")
            at = _answer_at(text or "")
            halves = [np.unique(textvec.shingle_hashes(x, min(SHINGLE, len(x)))) if len(x) else x for x in (h[:at], h[at:])]
            for a in range(0, len(h), UNIT):
                self.item.append(item)
                self.parts.append(halves)
                lists.append(h[a : a + UNIT])
        n = len(lists)
        self.blocks = -(-n // BLOCK)
        lengths = np.array([len(x) for x in lists], float)
        every = np.concatenate(lists) if n else np.zeros(0, np.uint64)
        unit = np.repeat(np.arange(n), lengths.astype(int))
        self.terms = np.unique(every)
        term = np.searchsorted(self.terms, every)
        pairs, tf = np.unique(term * max(n, 1) + unit, return_counts=True)
        self.p_term, self.p_unit = pairs // max(n, 1), pairs % max(n, 1)
        df = np.bincount(self.p_term, minlength=len(self.terms))
        units, total, among, held = whole or (n, lengths.sum(), self.terms, df)
        held = held[np.searchsorted(among, self.terms)]
        idf = np.log(1 + (units - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * lengths / max(total / units, 1)) if n else lengths
        raw = idf[self.p_term] * tf * (K1 + 1) / (tf + norm[self.p_unit])
        own = np.bincount(self.p_unit, raw, minlength=n)
        self.impact = raw / np.maximum(own[self.p_unit], 1e-12)
        self.first = np.searchsorted(self.p_term, np.arange(len(self.terms) + 1))
        # frequent terms leave the candidate search while no unit owes them more than COMMON
        owed, common = np.zeros(n), np.zeros(len(self.terms), bool)
        for t in np.argsort(-df, kind="stable"):
            if df[t] < 2:
                break
            span = slice(self.first[t], self.first[t + 1])
            more = owed.copy()
            more[self.p_unit[span]] += self.impact[span]
            if n and more.max() > COMMON:
                break
            owed, common[t] = more, True
        self.searched = ~common
        self.need = THRESHOLD - (owed.max() if n else 0) - 1e-9
        # block maxima of the searched terms
        keep = self.searched[self.p_term]
        key = self.p_term[keep] * max(self.blocks, 1) + self.p_unit[keep] // BLOCK
        keys, at = np.unique(key, return_inverse=True)
        self.b_max = np.zeros(len(keys))
        np.maximum.at(self.b_max, at, self.impact[keep])
        self.b_term, self.b_block = keys // max(self.blocks, 1), keys % max(self.blocks, 1)
        self.b_first = np.searchsorted(self.b_term, np.arange(len(self.terms) + 1))
        self.pb_key, at = np.unique(self.p_term * max(self.blocks, 1) + self.p_unit // BLOCK, return_index=True)
        self.pb_first = np.append(at, len(self.p_term))
        self.t_max = np.zeros(len(self.terms))
        np.maximum.at(self.t_max, self.b_term, self.b_max)
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def _blocks(self, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage and block as one number, largest impact) of all blocks of the terms ``t`` of passages ``w``."""
        many = self.b_first[t + 1] - self.b_first[t]
        place = _ranges(self.b_first[t], many)
        return np.repeat(w, many) * self.blocks + self.b_block[place], self.b_max[place]

    def _candidates(self, w: np.ndarray, t: np.ndarray, windows: int) -> np.ndarray:
        """The blocks (numbered with their passage) whose bound reaches what is needed. The terms of a passage are put in
        order of their largest impact; before the pivot they cannot reach it together, so only the blocks of the others are
        opened, and a passage without a pivot is skipped. What lies before the pivot is opened for passages with blocks left."""
        order = np.lexsort((self.t_max[t], w))
        w, t = w[order], t[order]
        upto = np.cumsum(self.t_max[t])
        head = np.searchsorted(w, np.arange(windows))
        upto -= np.concatenate(([0.0], upto))[head][w]
        behind = upto >= self.need
        before = np.bincount(w[~behind], self.t_max[t[~behind]], minlength=windows)
        key, most = self._blocks(w[behind], t[behind])
        keys, back = np.unique(key, return_inverse=True)
        bound = np.bincount(back, most, minlength=len(keys))
        left = bound + before[keys // self.blocks] >= self.need
        keys, bound = keys[left], bound[left]
        still = np.zeros(windows, bool)
        still[keys // self.blocks] = True
        rest = ~behind & still[w]
        key, most = self._blocks(w[rest], t[rest])
        if len(keys) and len(key):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[at] == key
            bound = bound + np.bincount(at[ok], most[ok], minlength=len(keys))
        return keys[bound >= self.need]

    def _scores(self, terms: np.ndarray, head: np.ndarray, size: np.ndarray, block: np.ndarray):
        """(candidate, unit within the block, score) of what reaches the threshold. Candidates: where the terms of their passage
        begin in ``terms``, how many there are, and the block."""
        owner = np.repeat(np.arange(len(block)), size)
        key = terms[_ranges(head, size)] * self.blocks + block[owner]
        at = np.minimum(np.searchsorted(self.pb_key, key), len(self.pb_key) - 1)
        ok = self.pb_key[at] == key
        at, owner = at[ok], owner[ok]
        n = self.pb_first[at + 1] - self.pb_first[at]
        p = _ranges(self.pb_first[at], n)
        score = np.bincount(np.repeat(owner, n) * BLOCK + self.p_unit[p] % BLOCK, self.impact[p], minlength=1)
        return [(x // BLOCK, x % BLOCK, float(score[x])) for x in np.flatnonzero(score >= THRESHOLD).tolist()]

    def search(self, words: np.ndarray, first: np.ndarray):
        """(text, item, score, question overlap, answer overlap) for the texts whose words begin at ``first``."""
        at = np.flatnonzero(self.slots[(words >> np.uint64(44)).astype(np.int64)])
        term = np.searchsorted(self.terms, words[at])
        ok = self.terms[np.minimum(term, len(self.terms) - 1)] == words[at]
        at, term = at[ok], term[ok]
        doc = np.searchsorted(first, at, "right") - 1
        slot = (at - first[doc]) // UNIT
        # windows are numbered over the piece: each text has one for each UNIT words begun
        count = -(-np.diff(first) // UNIT)
        start = np.concatenate(([0], np.cumsum(count)))
        own = start[doc] + slot
        pair = np.unique(np.concatenate((own, own[slot > 0] - 1)) * len(self.terms) + np.concatenate((term, term[slot > 0])))
        w, t = pair // len(self.terms), pair % len(self.terms)
        inside = self.searched[t]
        good = self._candidates(w[inside], t[inside], int(start[-1]))
        head = np.searchsorted(w, np.arange(start[-1] + 1))
        best: dict = {}
        for i in range(0, len(good), SCORED):
            window, block = good[i : i + SCORED] // self.blocks, good[i : i + SCORED] % self.blocks
            for c, u, score in self._scores(t, head[window], head[window + 1] - head[window], block):
                unit, d = int(block[c]) * BLOCK + u, int(np.searchsorted(start, window[c], "right")) - 1
                a = first[d] + (int(window[c]) - start[d]) * UNIT
                # an item of several units may go on after the passage
                more = len(self.parts[unit][0]) + len(self.parts[unit][1])
                passage = words[max(first[d], a - more) : min(first[d + 1], a + 2 * UNIT + more)]
                shares = [self._share(x, passage) for x in self.parts[unit]]
                if min(shares) >= OVERLAP:
                    found = (score, *shares)
                    k = (d, self.item[unit])
                    best[k] = max(best.get(k, found), found)
        return [(d, item, *v) for (d, item), v in sorted(best.items())]

    @staticmethod
    def _share(part: np.ndarray, passage: np.ndarray) -> float:
        if not len(part):
            return 1.0
        held = np.isin(part, textvec.shingle_hashes(passage, SHINGLE))
        for width in range(1, SHINGLE):  # parts of fewer words than a shingle
            held |= np.isin(part, textvec.shingle_hashes(passage, width)) if len(part) == 1 else False
        return float(held.mean())


def _unit_counts(items: DataFrame) -> DataFrame:
    """(slice, term, units, words) of ``items`` (slice, text): the units that hold each term; in the row without a term all
    units and their words."""

    def run(batches):
        for batch in batches:
            slices, terms, units, words = [], [], [], []
            for k, text in zip(batch.column("slice").to_pylist(), batch.column("text"), strict=True):
                h = _word_hashes(text.as_py())
                if not len(h):
                    continue
                held = [np.unique(h[a : a + UNIT]) for a in range(0, len(h), UNIT)]
                own, n = np.unique(np.concatenate(held), return_counts=True)
                slices.append(np.full(len(own) + 1, k))
                terms.append(pa.concat_arrays([pa.array(own.view(np.int64)), pa.nulls(1, pa.int64())]))
                units.append(np.append(n, len(held)))
                words.append(np.append(np.zeros(len(own), np.int64), len(h)))
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slices), pa.int64()), pa.concat_arrays(terms), *(pa.array(np.concatenate(x), pa.int64()) for x in (units, words))], names=["slice", "term", "units", "words"])

    counts = items.select(F.col("slice").cast("long"), "text").mapInArrow(run, "slice long, term long, units long, words long")
    return counts.groupBy("slice", "term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))


def _indexes(benchmark: DataFrame):
    """The broadcast index of each slice of ``benchmark``, in turn."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / SLICE))
    known = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    known = known.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    counts = whole = None
    if slices > 1:
        counts = stash(_unit_counts(known))
        every = counts.groupBy("term").agg(F.sum("units").alias("units"), F.sum("words").alias("words"))
        whole = every.where("term is null").select("units", "words").first()
    for k in range(slices):
        items = sorted((r[0], r[1]) for r in known.where(F.col("slice") == k).select("item_id", "text").collect())
        if whole is None:
            index = Index(items)
        else:
            terms = counts.where((F.col("slice") == k) & F.col("term").isNotNull()).select("term")
            own = every.select("term", "units").join(terms, "term", "left_semi").toArrow()
            term, units = own["term"].to_numpy().view(np.uint64), own["units"].to_numpy()
            order = np.argsort(term)
            index = Index(items, (whole["units"], whole["words"], term[order], units[order]))
        if len(index.terms):
            yield spark.sparkContext.broadcast(index)
    if counts is not None:
        unstash(counts)


def _found(index: Index, texts: pa.Array):
    """(row, item, score, overlaps) for the texts of a batch."""
    for row, data, offsets in textvec.pieces(texts):
        starts, ends, first = textvec.word_bounds(data, offsets)
        for d, *x in index.search(textvec.word_hashes(data, starts, ends), first):
            yield row + d, *x


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the items that texts of ``docs`` hold."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = []
    for shared in _indexes(benchmark):

        def run(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [(ids[row].as_py(), *x) for row, *x in _found(shared.value, batch.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64(), pa.int64(), *[pa.float64()] * 3], strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.union, found)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("v"))
    return best.select("doc_id", "item_id", "v.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns. Each row is judged by its own text, so ids may
    be missing or shared; texts pass through and nothing is shuffled."""
    for shared in _indexes(benchmark):

        def run(batches, shared=shared):
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, *_ in _found(shared.value, batch.column("text"))]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
