"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

Every line is judged on its own by three rules:
- punctuation: it is long enough to be prose and more than ``max_symbols`` of its characters are symbols;
- navigation: it is a short list of separated items (``a | b | c``, bullets, arrows) or hardly anything but a link;
- boilerplate: it holds a phrase of ``BOILERPLATE`` and is shorter than ``boilerplate_chars``.
A document is kept unless the lines that went held more than ``max_lost`` of its word characters, or the base rules
fail it (too few words, or too many words in repeated windows). Everything is evaluated inside the row with array
expressions: no shuffle, no Python, and one long document or one hot source is no burden to others.

A null or empty text has no words, fails the base rules and is not kept. Repeated rows and equal texts are judged alike, so there are
no ties. Very long texts and very long lines are treated whole: every rule is linear and none recurses. An empty table gives an empty
one. Columns that clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced, without

#: Phrases of lines that belong to a site and not to a text.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "subscribe to our newsletter", "sign up for our newsletter", "click here", "log in", "sign in", "skip to content",
    "follow us on", "share this", "read more", "back to top", "powered by", "lorem ipsum", "javascript is disabled",
]
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 0.3
MAX_SYMBOLS, MAX_LOST, BOILERPLATE_CHARS = 0.15, 0.5, 120
#: What separates the items of a navigation line, and the most characters of an item.
PARTS, PART_CHARS = "|>»•·", 40
#: Characters that the base measures count as symbols.
SYMBOLS = "#*$%&|<>"


def _bare(c: Column, *chars: str) -> Column:
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def measured_line(line: Column) -> Column:
    """A line with the number of its characters in words."""
    return F.struct(line.alias("line"), F.length(_bare(spaced(line), " ")).alias("n"))


def bad_line(x: Column) -> Column:
    """Whether a measured line fails the punctuation, navigation or boilerplate rule; a line without words never does."""
    line, n = x["line"], x["n"]
    punctuation = (n >= 20) & (F.length(line) - F.length(_bare(line, *SYMBOLS)) > MAX_SYMBOLS * n)
    # separators are counted and a longer piece is looked for, as an expression that repeats a group recurses once a repeat
    navigation = (F.length(line) - F.length(F.translate(line, PARTS, "")) >= 2) & ~F.regexp_like(line, F.lit(f"[^{PARTS}]{{{PART_CHARS + 1}}}"))
    link = (F.contains(line, F.lit("://")) | F.contains(line, F.lit("www."))) & F.regexp_like(line, F.lit(r"^\s*(?:https?://|www\.)\S+\s*$"))
    boilerplate = (n <= BOILERPLATE_CHARS) & F.regexp_like(F.lower(line), F.lit("|".join(BOILERPLATE)))
    return (n > 0) & (punctuation | navigation | link | boilerplate)


def _ahead(c: Column, by: int) -> Column:
    """An array from its element ``by`` on."""
    return F.slice(c, 1 + by, F.greatest(F.size(c) - by, F.lit(0)))


def _measured(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the base columns, and what they are made of in columns that start with two underscores.

    The hash of a window is made by doubling: pairs of words, then of pairs, then of fours. Windows that occur again
    are found by sorting, and only in texts whose windows are not all different.
    """
    none = F.array().cast("array<bigint>")
    out = docs.withColumns({"__spaced": spaced(text), "__lines": F.split(F.coalesce(text, F.lit("")), "\n", -1)})
    out = out.withColumn("__words", F.array_remove(F.split("__spaced", " ", -1), ""))
    bare = _bare(F.coalesce(text, F.lit("")), *SYMBOLS)
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.replace("__spaced", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length(F.coalesce(text, F.lit(""))) - F.length(bare)).cast("long"),
        "__lines": F.filter(F.transform("__lines", measured_line), lambda x: x["n"] > 0),
        "__w1": F.transform("__words", lambda w: F.xxhash64(w)),
    })
    width = 1
    while width < WINDOW:
        at = f"__w{width}"
        out = out.withColumn(f"__w{2 * width}", F.zip_with(at, _ahead(F.col(at), width), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    out = out.withColumn("__windows", F.slice(f"__w{WINDOW}", 1, F.greatest(F.size("__words") - (WINDOW - 1), F.lit(0))))
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    by_hash = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(again, by_hash))
    pairs = F.zip_with("__sorted", _ahead(F.col("__sorted"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__at", F.array_sort(F.array_distinct(F.flatten(pairs))))
    adds = F.zip_with("__at", _ahead(F.col("__at"), 1), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))).cast("long"))
    return out.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines.line"))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(adds, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    })


def line_clean(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, cleaned_col: str | None = None) -> DataFrame:
    """``docs`` with the base measures, base_failed, n_bad_lines, lost_chars and kept; with ``cleaned_col`` also the
    text less its bad lines."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "lost_chars", "kept"]
    docs = without(docs, *(set(added) - {text_col}))
    out = _measured(docs, F.col(text_col)).withColumn("__bad", F.filter("__lines", bad_line))
    lost = F.aggregate("__bad", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MAX_REPEATED))
    out = out.withColumns({"n_bad_lines": F.size("__bad").cast("long"), "lost_chars": lost, "base_failed": failed})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars")))
    columns = [*docs.columns, *added]
    if cleaned_col:
        good = F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda x: ~bad_line(measured_line(x)))
        out, columns = out.withColumn(cleaned_col, F.array_join(good, "\n")), [*columns, cleaned_col]
    return out.select(*columns)
