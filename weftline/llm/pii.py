"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, schemes, plus signs, digits and identifier
cues. Each anchor is handed to a small local parser that expands it to the left and right and validates the result:

- ``email``: the run of local characters before an at-sign, and a domain of two labels or more after it;
- ``ip``: four numbers of at most 255 from a digit on;
- ``card``: 12 to 19 digits, single blanks or hyphens between them, that pass the Luhn check;
- ``phone``: a plus sign and 9 to 15 digits with blanks, brackets, dots and hyphens;
- ``iban``: two capital letters before digits, the whole account number passing the mod-97 check;
- ``login``: ``user:password@host`` after a scheme;
- ``account``: 6 to 17 digits after a cue such as ``account no:``.

Spans of one kind do not overlap and are found from left to right; a match that fails validation is consumed and dropped.
Spans of different kinds may overlap; equal starts are ordered by kind. Offsets are code points, the end exclusive. Null and
empty texts have no spans, an empty table gives an empty one. Very long texts are searched whole: no pattern has a bound on
length but those of its number of digits, and none is tried twice on the same run of characters, so the work for a text is
linear in its length. Repeated rows are judged alike. Of the input only id and text are read; ``redacted`` keeps all columns.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "login", "account"]
BASE = KINDS[:4]
#: Words that announce an account number.
CUES = ["account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "customer id", "Customer ID", "SSN", "ssn"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[^\s/@:?#]++:[^\s/@?#]++@[A-Za-z0-9.-]++")
_ACCOUNT = re.compile(r"(?:\s*+(?:number|no\.?|num\.?|id|#))?+\s*+[:#=]?+\s*+([0-9]{6,17}+)(?![0-9])")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for x, kind in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in "0123456789"), *((c, "cue") for c in CUES)]:
        found.add_word(x, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of all spans of a text, by start and kind."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = iban = login = account = 0  # where the last match of each kind ended
    for i, kind in _anchors().iter(text):
        if kind == "digit":
            if i and text[i - 1] in "0123456789":
                continue  # within a run of digits
            if i >= ip and (m := _IP.match(text, i)):
                ip = m.end()
                if all(map(_small, m[0].split("."))):
                    out.append((i, ip, 1))
            if i >= card and (m := _CARD.match(text, i)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((i, card, 2))
            if i - 2 >= iban and text[i - 1] in _LOCAL and text[i - 2] in _LOCAL and not (i > 2 and text[i - 3].isalnum()) and (m := _IBAN.match(text, i - 2)):
                iban = m.end()
                if int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1:
                    out.append((i - 2, iban, 4))
        elif kind == "at":
            start = i
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < i and (m := _DOMAIN.match(text, i + 1)):
                email = m.end()
                out.append((start, email, 0))
        elif kind == "plus":
            if i >= phone and (m := _PHONE.match(text, i)):
                phone = m.end()
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((i, phone, 3))
        elif kind == "scheme":
            if i + 1 >= login and (m := _LOGIN.match(text, i + 1)):
                login = m.end()
                out.append((i + 1, login, 5))
        elif i >= account and (m := _ACCOUNT.match(text, i + 1)):
            account = m.end()
            out.append((m.start(1), account, 6))
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return out


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, at, name = [], 0, None
    stop = 0
    for start, end, kind in found:
        if name is not None and start < stop:
            stop = max(stop, end)
            continue
        if name is not None:
            out.append(f"<{name}>")
            at = stop
        out.append(text[at:start])
        name, stop = KINDS[kind].upper(), end
    if name is not None:
        out.append(f"<{name}>")
        at = stop
    return "".join([*out, text[at:]])


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans as array of struct(kind, start, end)) of each row, ``redacted`` text included."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, clean = [], []
            for t in batch.column(1).to_pylist():
                found = spans(t) if t else []
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in found])
                clean.append(redact(t, found) if found else t)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(clean, pa.string())], names=[id_col, "spans", "redacted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:long,end:long>>, redacted string")


def redacted(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the spans of its texts replaced and, where there is one, the length column counted anew."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [redact(t, found) if t and (found := spans(t)) else t for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(names, batch.columns, strict=True)) | {text_col: pa.array(texts, pa.string())}
            if length_col in columns:
                columns[length_col] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[length_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans as a string; ``found`` has doc_id and spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
