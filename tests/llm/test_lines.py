"""Line rules on very long lines, and the navigation rule against a regular expression."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import line_clean

NAVIGATION = re.compile(r"[^|>»•·\n]{0,40}(?:[|>»•·][^|>»•·\n]{0,40}){2,}")


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in line_clean.line_clean(df, cleaned_col="clean").collect()}


@pytest.mark.parametrize("piece", ["a · ", "a | ", "b > ", "• ", "»", "word ", "http://x"])
def test_a_line_of_a_million_pieces_ends_in_seconds(spark, piece):
    start = time.time()
    got = judged(spark, [piece * 1_000_000, "short"])
    assert len(got) == 2 and time.time() - start < 60
    if piece.strip() in ("»", "•"):
        assert got[0]["n_bad_lines"] == 1 and got[0]["clean"] == ""


def test_navigation_equals_regular_expression(spark):
    rng = random.Random(4)
    parts = ["|", ">", "»", "•", "·", "item", " ", "x" * 39, "x" * 40, "x" * 41, "𝄞" * 40, "\t"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(600)] + ["|||", "a|b", "a|b|", "|", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", "line", line_clean.measured_line(F.col("line")).alias("m"))
    got = {r["i"]: r["bad"] for r in df.select("i", line_clean.bad_line(F.col("m")).alias("bad")).collect()}
    for i, x in enumerate(lines):
        n = len("".join(x.split()))
        symbols = n >= 20 and sum(c in line_clean.SYMBOLS for c in x) > line_clean.MAX_SYMBOLS * n
        assert got[i] == (n > 0 and (symbols or bool(NAVIGATION.fullmatch(x)))), x
