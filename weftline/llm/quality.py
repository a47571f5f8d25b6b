"""Quality classifier: supervised subword embeddings.

Each word, word pair and character n-gram of a text is hashed to a row of an embedding matrix (a pair by the XOR of its
words' hashes, so that all pairs of equal words share a row); a document is the average of
its rows, and a softmax layer gives the probability of each label. Matrix and layer are learned together by stochastic
gradient descent in numpy, one document a step. The fit uses a bounded sample of labelled rows: ``SAMPLE`` documents at
most with ``SAMPLE_CHARS`` characters together, the ones whose ids have the smallest hashes, equal texts once. Scoring
uses whole texts of all rows: since the layer is linear, a model travels as one number a row of the matrix, and a batch
is scored with a few array operations.

A null or empty text has no features and gets the score of the bias alone. Repeated rows get equal scores; a score on the
threshold counts as reaching it. Labels that repeat count once, the smallest of an id; of documents that share an id the one with
the smallest hash of its text is learned from, so reruns agree. A very long text is scored whole, and learned from unless it
alone passes ``SAMPLE_CHARS``. A table with no labelled row of both kinds gives the share of label 1 (one half without labels)
as everyone's score; an empty table gives an empty one. Only the text is an input of a score; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

SAMPLE, SAMPLE_CHARS = 4000, 40_000_000
WORD_BITS, PAIR_BITS, GRAM_BITS, GRAMS = 16, 16, 16, (3, 4)
DIMENSIONS, EPOCHS, RATE, SEED = 8, 8, 20.0, 7
THRESHOLD = 0.3
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(data: np.ndarray, offsets: np.ndarray):
    """Rows of the matrix for the words and n-grams of a piece of texts: [(rows, first row of each text), ...]."""
    starts, ends, first = textvec.word_bounds(data, offsets)
    words = textvec.word_hashes(data, starts, ends, lower=False)
    out = [((words >> np.uint64(64 - WORD_BITS)).astype(np.int32), first)]
    lower = textvec.word_hashes(data, starts, ends)
    inner = np.ones(max(0, len(lower) - 1), bool)
    inner[first[(first > 0) & (first < len(lower))] - 1] = False
    pairs = (((lower[1:] ^ lower[:-1])[inner] >> np.uint64(64 - PAIR_BITS)).astype(np.int32)) + np.int32(1 << WORD_BITS)
    out.append((pairs, np.concatenate(([0], np.cumsum(np.maximum(np.diff(first) - 1, 0))))))
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    if at[-1] != len(chars):  # bytes that are no UTF-8: counted text by text
        at = np.concatenate(([0], np.cumsum([len(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])))
    for k, n in enumerate(GRAMS):
        h = np.zeros(max(0, len(chars) - n + 1), np.uint32)
        for j in range(n):
            h ^= chars[j : j + len(h)] * _MULTIPLIERS[j]
            h = (h << np.uint32(5)) ^ (h >> np.uint32(27)) if j + 1 < n else h
        h *= np.uint32(0x9E3779B1)
        rows = (h >> np.uint32(32 - GRAM_BITS)).astype(np.int32) + np.int32((1 << WORD_BITS) + (1 << PAIR_BITS) + k * (1 << GRAM_BITS))
        # a text's grams begin before its last n - 1 characters; those that reach into the next text are cut off
        lo, hi = at[:-1], np.maximum(at[:-1], at[1:] - (n - 1))
        keep = np.zeros(len(rows) + 1, np.int8)
        np.add.at(keep, np.minimum(lo, len(rows)), 1)
        np.add.at(keep, np.minimum(hi, len(rows)), -1)
        rows = rows[np.cumsum(keep[:-1], dtype=np.int8) > 0] if len(rows) else rows
        out.append((rows, np.concatenate(([0], np.cumsum(np.minimum(hi, len(h)) - np.minimum(lo, len(h)))))))
    return out


def size() -> int:
    return (1 << WORD_BITS) + (1 << PAIR_BITS) + len(GRAMS) * (1 << GRAM_BITS)


class Model:
    """A fitted model, folded: the log-odds of label 1 are the bias and the mean of the text's row weights."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for rows, first in features(data, offsets):
            upto = np.concatenate(([0.0], np.cumsum(self.weights[rows], dtype=np.float64)))
            total += upto[first[1:]] - upto[first[:-1]]
            n += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -60, 60)))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Stochastic gradient descent on softmax of averaged embeddings; deterministic."""
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model(np.zeros(size(), np.float32), prior)
    docs = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, counts = np.unique(np.concatenate([rows for rows, _ in features(data, np.array([0, len(data)]))]), return_counts=True)
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    e = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size(), DIMENSIONS)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.array([-prior / 2, prior / 2], np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = part @ e[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[labels[i]] -= 1
            e[ids] -= (rate * part)[:, None] * (w @ g)
            w -= 0.01 * rate * np.outer(mean, g)
            b -= 0.001 * rate * g
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fits on labelled rows that are not held out."""
    own = labels.where(f"doc_id is not null and {label} in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE ids at most are broadcast; of rows that share an id the one with the smallest hash of its text counts
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", F.length("text").alias("n"), F.xxhash64("text").alias("h")).where("text is not null")
    sized = rows.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).groupBy("x.h").agg(F.min("doc_id").alias("doc_id"), F.min("x.n").alias("n")).collect()
    # of equal texts one, and only as many characters as the driver can hold, in order of the hash; a text too many is passed over
    sized.sort(key=lambda r: (r["h"], r["doc_id"]))
    total, ids = 0, []
    for r in sized:
        if total + r["n"] <= SAMPLE_CHARS:
            total += r["n"]
            ids.append((r["doc_id"], r["h"]))
    if not ids:
        return fit([], [])
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, h long")
    got = {r["doc_id"]: r for r in rows.join(F.broadcast(few), ["doc_id", "h"]).collect()}
    return fit([got[i]["text"] for i in sorted(got)], [got[i]["label"] for i in sorted(got)])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, data, offsets in textvec.pieces(batch.column(1))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold, with all their columns; texts pass through once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            parts = [shared.value.scores(data, offsets) for _, data, offsets in textvec.pieces(batch.column("text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
