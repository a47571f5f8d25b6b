"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern knows.

Patterns give the base spans (``assign``, ``access``, ``hex``). Beyond them, each long token with letters and digits is a
candidate. Its encoding is inferred (hex, base 32, letters and digits, base 64) and its symbols become numbers below the
alphabet's size. Three tests ask whether it looks like random output: chi-squared uniformity over the alphabet, the runs
test about the middle of the alphabet, and the serial correlation of neighbours. A token is random only if every test says
so, so its p-value is the largest of two kinds. The first holds the chi-squared value against that of names and text of the
same length, whose letters coincide more often (``COINCIDENCE``). The second holds the deviates of all three tests against
those of an ordered token, which grow with the root of its length (``ORDERED`` of it). Both fall with the length. The
p-values of all candidates of all documents go through the Benjamini-Hochberg procedure at ``RATE``, on a grid of hundredths
of a power of ten so that it needs only counts per grid step. Accepted tokens become ``random`` spans if no base span holds them.

Only DataFrame functions are used. A span's place is found by marking matches and adding up lengths, in code points.
Null and empty texts have no spans, an empty table gives an empty one; repeated rows are judged alike, and each counts among
the tested tokens. Spans of different kinds may overlap; equal starts are ordered by kind. Very long texts and texts of many
spans are searched whole, in time that grows with their length (sorting and searching spans apart). Of the input only id and
text are read. The result of a first pass, one narrow row a document, is written to the shared folder, so texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

KINDS = ["assign", "access", "hex", "random"]
BASE = KINDS[:3]
PATTERNS = {
    "assign": r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
RATE, COINCIDENCE, ORDERED = 0.01, 0.045, 1.0
#: Steps of the grid for p-values: a hundredth of a power of ten, down to 1e-300.
GRID, LEAST = 100, 300
#: Matches whose places are summed together.
PIECE = 128
#: The alphabets by name, in the order in which they are tried.
ALPHABETS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"
_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def marked_spans(text: Column, kind: str, may: Column) -> Column:
    """Leftmost non-overlapping matches of a kind's pattern, with their text; ``may``: a cheap test that few texts pass."""
    pattern = F.lit(PATTERNS[kind])
    # the marks themselves do not occur in any pattern, so putting another control character there moves nothing
    safe = F.replace(F.replace(text, F.lit(_OPEN), F.lit(_OTHER)), F.lit(_CLOSE), F.lit(_OTHER))
    parts = F.split(F.regexp_replace(safe, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), _OPEN, -1)

    def step(state: Column, part: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        span = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), (state["at"] + F.length(match)).alias("end"), match.alias("match"))
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), F.concat(state["found"], F.array(span)).alias("found"))

    def placed(t: Column) -> Column:
        # each part but the first is a match, the closing mark and what follows. Lengths are summed within pieces of PIECE
        # parts and over pieces, as growing one array part by part would cost the square of their number
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 2) / PIECE).cast("int")), lambda b: F.slice(t, b * PIECE + 2, F.lit(PIECE)))
        none = F.array().cast("array<bigint>")
        size = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n + F.length(x) - 1)
        first = F.struct(F.length(F.get(t, F.lit(0))).cast("long").alias("at"), none.alias("all"))
        before = lambda ps: F.aggregate(ps, first, lambda s, p: F.struct((s["at"] + size(p)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        start = lambda at: F.struct(at.alias("at"), F.array().cast(_SPAN).alias("found"))
        return bound(pieces, lambda ps: F.flatten(F.zip_with(ps, before(ps), lambda p, at: F.aggregate(p, start(at), step, lambda s: s["found"]))))

    none = F.array().cast(_SPAN)
    return F.when(may, bound(parts, lambda t: F.when(F.size(t) > 1, placed(t)).otherwise(none))).otherwise(none)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def overlapped(span: Column, starts: Column, ends: Column) -> Column:
    """Whether a span meets one of some sorted spans without overlaps, by binary search: of those that start before its end
    the last one ends last."""
    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(starts, mid) < span["end"]
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    n = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + 1)).cast("int") + 1), F.struct(F.lit(0).alias("lo"), F.size(starts).alias("hi")), halve, lambda s: s["lo"])
    return F.when(F.size(starts) == 0, F.lit(False)).otherwise((n > 0) & (F.get(ends, n - 1) > span["start"]))


def base_spans(text: Column) -> dict[str, Column]:
    assign = marked_spans(text, "assign", (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & F.regexp_like(text, F.lit(PATTERNS["assign"])))
    access = marked_spans(text, "access", F.contains(text, F.lit("AKIA")))
    hexes = marked_spans(text, "hex", F.regexp_like(text, F.lit("[0-9a-f]{24}")))
    return {
        "assign": F.filter(assign, lambda s: F.length(F.regexp_extract(s["match"], PATTERNS["assign"], 1)) >= 6),
        "access": F.filter(access, lambda s: F.length(s["match"]) >= 20),
        "hex": hexes,
    }


def battery(token: Column) -> Column:
    """struct(encoding, n, uniform, runs, serial, p): the statistics as normal deviates, and p from all three."""
    bare = F.rtrim(token, F.lit("="))
    first = lambda pick: F.coalesce(*[F.when(F.regexp_like(bare, F.lit(r)), F.lit(pick(i))) for i, (_, r, _) in enumerate(ALPHABETS)])
    alphabet, name = first(lambda i: ALPHABETS[i][2]), first(lambda i: ALPHABETS[i][0])
    letters = F.filter(F.split(bare, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: (F.position(c, alphabet) - 1).cast("double"))
    return F.transform(
        F.array(F.struct(name.alias("encoding"), F.length(alphabet).cast("double").alias("k"), codes.alias("x"), F.array_distinct(codes).alias("d"))),
        _statistics,
    )[0]


def _statistics(t: Column) -> Column:
    k, x, n = t["k"], t["x"], F.size(t["x"]).cast("double")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    squares = total(F.transform(t["d"], lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))))
    chi = squares * k / n - n
    uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    high = total(F.transform(x, lambda v: F.when(2 * v >= k, 1.0).otherwise(0.0)))
    nexts = F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    firsts = F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))
    changes = total(F.zip_with(firsts, nexts, lambda a, b: F.when((2 * a >= k) != (2 * b >= k), 1.0).otherwise(0.0)))
    mean = 2 * high * (n - high) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    runs = (changes + 1 - mean) / spread
    m = total(x) / n
    var = total(F.transform(x, lambda v: (v - m) * (v - m)))
    serial = total(F.zip_with(firsts, nexts, lambda a, b: (a - m) * (b - m))) / F.greatest(var, F.lit(1e-9)) * F.sqrt(n)
    # chi-squared of text: pairs of equal symbols as often as COINCIDENCE says, or twice the chance level for small alphabets
    often = F.greatest(F.lit(COINCIDENCE), 2 / k)
    expected, wide = (n - 1) * (k * often - 1) + k - 1, F.sqrt(2 * (k - 1) + 2 * n * (k * often - 1))
    z = (expected - chi) / wide
    tail = lambda z: 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(690.0))))  # noqa: E731  the normal tail by a logistic curve
    p = F.greatest(tail(z), tail(ORDERED * F.sqrt(n) - F.greatest(F.abs(uniform), F.abs(runs), F.abs(serial))))
    return F.struct(t["encoding"].alias("encoding"), n.alias("n"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), p.alias("p"))


def step_of(p: Column) -> Column:
    """The grid step of a p-value; the step's value is not below p."""
    return F.least(F.lit(GRID * LEAST), F.greatest(F.lit(0), F.floor(-GRID * F.log10(F.greatest(p, F.lit(1e-300))))))


def accepted_step(steps: DataFrame, rate: float = RATE) -> int:
    """The lowest accepted step of all candidates' ``step``; above every step if none is."""
    counts = {r["step"]: r["n"] for r in steps.groupBy("step").agg(F.count("*").alias("n")).collect()}  # GRID * LEAST + 1 rows at most
    total, so_far, best = sum(counts.values()), 0, GRID * LEAST + 1
    for step in sorted(counts, reverse=True):
        so_far += counts[step]
        if 10 ** (-step / GRID) <= rate * so_far / total:
            best = step
    return best


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, spans) of each row: array of struct(kind, start, end, match), by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    shape = F.regexp_like(text, F.lit("[A-Za-z0-9+/_-]{20}"))
    found = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in base_spans(text).items()], marked_spans(text, "random", shape).alias("long"))
    mixed = lambda s: F.regexp_like(s["match"], F.lit("[0-9]")) & F.regexp_like(s["match"], F.lit("[A-Za-z]"))
    bounds = {f"{k}_{x}": F.transform(k, lambda s: s[x]) for k in BASE for x in ("start", "end")}  # noqa: B023
    found = found.withColumns({"base": F.concat(*BASE), "long": F.filter("long", mixed)} | bounds)
    at = {k: (F.col(f"{k}_start"), F.col(f"{k}_end")) for k in BASE}
    fresh = F.filter("long", lambda s: ~(overlapped(s, *at["assign"]) | overlapped(s, *at["access"]) | overlapped(s, *at["hex"])))
    found = found.select("id", "base", fresh.alias("long"))
    tested = F.transform("long", lambda s: F.struct(s.alias("span"), battery(s["match"]).alias("t")))
    tokens = F.transform(tested, lambda c: F.struct(c["span"].alias("span"), step_of(c["t"]["p"]).cast("int").alias("step")))
    first = stash(found.select("id", "base", tokens.alias("tokens")))
    least = accepted_step(first.select(F.explode("tokens.step").alias("step")), rate)
    more = F.transform(F.filter("tokens", lambda c: c["step"] >= least), lambda c: c["span"])
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("a"), F.element_at(place, s["kind"]).alias("b"), s.alias("s")))
    return first.select(F.col("id").alias(id_col), F.transform(F.array_sort(keyed), lambda x: x["s"]).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as a string; ``found`` has doc_id and spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
