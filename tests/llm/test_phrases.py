"""Phrase fingerprints against a parse with sets of strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import phrases


def plain_phrases(text):
    known, out, start = set(), [], 0
    for i in range(1, len(text) + 1):
        if text[start:i] not in known:
            known.add(text[start:i])
            out.append(text[start:i])
            start = i
    return out


def plain_hash(phrase):
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    return mix((sum(mix(ord(c) + 1) * pow(phrases.BASE, i, 1 << 64) for i, c in enumerate(phrase)) + len(phrase)) & mask) >> 16


def plain_fingerprint(text):
    return np.array(sorted({plain_hash(p) for p in plain_phrases(text)})[: phrases.SIZE], np.uint64)


def plain_likeness(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    both = sorted(a | b)[: phrases.SIZE]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def plain_result(rows):
    """Each row by a walk over the distinct documents in order."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    docs = sorted({(i, t or "", h) for i, t, h in rows}, key=key)
    out = {}
    for n, (i, t, h) in enumerate(docs):
        following = docs[(n + 1) % len(docs)][1]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        a, b, c = map(plain_fingerprint, (t, edited, following))
        out[i, h] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), phrases.encoded(a), phrases.encoded(b), plain_likeness(a, b), plain_likeness(a, c))
    return [out[i, h] for i, _, h in rows]


WORDS = ["river", "stone", "évé", "the", "of", "a", "𝄞", "winter", "north", "\n"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
def test_fingerprint_equals_sets_of_phrases(monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    rng = random.Random(2)
    for t in ["", "a", "aa", "a" * 500, text(rng, 3), text(rng, 60), text(rng, 3000), "".join(chr(rng.randrange(97, 100)) for _ in range(4000))]:
        got = phrases.fingerprint(t)
        assert got.tolist() == plain_fingerprint(t).tolist() and len(got) == min(128, len(set(plain_phrases(t))))
        other = phrases.fingerprint(t[: len(t) // 2] + "other")
        assert phrases.likeness(got, other) == plain_likeness(got, other) and phrases.likeness(got, got) == 1.0


def documents(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, rows int").repartition(parts)
    keyed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    return df, [tuple(r) for r in keyed]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_equal_plain_version(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(10**9), text(rng, rng.randint(0, 80))) for _ in range(120)]
    rows += [(i, rng.choice([None, "", "abc", "tie " + text(rng, 5)])) for i in range(40) for _ in range(rng.randint(1, 3))]
    rows += [(None, text(rng, 20)), (None, None), (50, "same text of one id " * 3)] + [(50, "copies of a row")] * 200
    rows += [(10**9 + 1, text(rng, 20_000))]
    df, keyed = documents(spark, rows)
    got = phrases.fingerprints(df, parts).collect()
    assert order(map(tuple, got)) == order(plain_result(keyed))


def test_often_repeated_rows_are_spread(spark):
    rows = [(7, "a hot row")] * 900 + [(i, f"text {i}") for i in range(300)]
    df, keyed = documents(spark, rows)
    keys = df.groupBy(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64("text").alias("tie")).agg(F.count("*").alias("rows"))
    bounds, ways, first = phrases._ranges(keys, 8)
    assert max(ways) >= 8 and sum(len(v) for v in first.values()) <= len(bounds)
    assert order(map(tuple, phrases.fingerprints(df, 8).collect())) == order(plain_result(keyed))


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(None, None)], [(3, "x")] * 50, [(1, "first text"), (2, "second text")]])
def test_small_tables(spark, rows):
    df, keyed = documents(spark, rows, 2)
    assert order(map(tuple, phrases.fingerprints(df, 4).collect())) == order(plain_result(keyed))


def test_edited_copies_are_nearer_than_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 400")
    got = phrases.fingerprints(docs).collect()
    assert sum(r["near_edited"] > r["near_next"] + 0.1 for r in got) >= 0.97 * len(got)
    by = {}
    for r, t in zip(sorted(got, key=lambda r: r["doc_id"]), [r["text"] for r in docs.orderBy("doc_id").collect()], strict=True):
        assert by.setdefault(t, r["fingerprint"]) == r["fingerprint"]
