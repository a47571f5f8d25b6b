"""Plain versions of contracts, for tests."""

import hashlib
import math
import re

ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def digest(spans, kinds):
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return [sum(s[0] == k for s in spans) for k in kinds], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(t):
    t = t or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return digest(out, ["assign", "access", "hex"])


def pii(t):
    t = t or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return digest(out, ["email", "ip", "card", "phone"])


ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"]


def battery(token):
    """(chi-squared, runs and serial deviates, p of all three) of a token, symbol by symbol."""
    token = token.rstrip("=")
    alphabet = next(a for a in ALPHABETS if all(c in a for c in token))
    k, n, x = len(alphabet), len(token), [alphabet.index(c) for c in token]
    chi = sum((x.count(s) - n / k) ** 2 / (n / k) for s in range(k))
    high = [2 * v >= k for v in x]
    up, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * up * (n - up) / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9))
    m = sum(x) / n
    serial = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / max(sum((v - m) ** 2 for v in x), 1e-9) * math.sqrt(n)
    often = max(0.045, 2 / k)
    z = ((n - 1) * (k * often - 1) + k - 1 - chi) / math.sqrt(2 * (k - 1) + 2 * n * (k * often - 1))
    tail = lambda z: 1 / (1 + math.exp(min(1.5976 * z + 0.07056 * z**3, 690)))
    deviates = (chi - (k - 1)) / math.sqrt(2 * (k - 1)), (runs - mean) / spread, serial
    return *deviates, max(tail(z), tail(math.sqrt(n) - max(map(abs, deviates))))


def random_spans(texts):
    """The random spans of each text: long tokens beside all base spans, through the battery and Benjamini-Hochberg."""
    tokens = []
    for i, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6] + [(m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(a < m.end() and m.start() < b for a, b in base):
                p = battery(m[0])[3]
                tokens.append((i, m.start(), m.end(), min(30000, max(0, math.floor(-100 * math.log10(max(p, 1e-300)))))))
    best = 30001
    for step in sorted({t[3] for t in tokens}):
        if 10 ** (-step / 100) <= 0.01 * sum(t[3] >= step for t in tokens) / len(tokens):
            best = step
            break
    return [(i, a, b) for i, a, b, step in tokens if step >= best]


def accounts(t):
    """Account numbers, logins and account cues by looking at every place of a text."""
    out = []
    end = 0
    for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", t):
        moved = m[0][4:] + m[0][:4]
        if int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in moved)) % 97 == 1:
            out.append(("iban", m.start(), m.end()))
    for m in re.finditer("://", t):
        got = re.match(r"[^\s/@:?#]+:[^\s/@?#]+@[A-Za-z0-9.-]+", t[m.end() :])
        if got and m.end() >= end:
            end = m.end() + got.end()
            out.append(("login", m.end(), end))
    return out


def numbers_after_cues(t, cues):
    """Account numbers, by looking at every place of a text for a cue that ends there, sign by sign."""
    out, end = [], 0

    def blanks(q):
        while q < len(t) and t[q].isspace():
            q += 1
        return q

    for p in range(1, len(t) + 1):
        if p <= end or not any(t.endswith(c, 0, p) for c in cues):
            continue
        q = blanks(p)
        name = next((w for w in ("number", "no.", "no", "num.", "num", "id", "#") if t.startswith(w, q)), None)
        q = blanks(q + len(name) if name else p)
        q = blanks(q + 1 if t[q : q + 1] and t[q] in ":#=" else q)
        stop = q
        while stop < len(t) and t[stop] in "0123456789":
            stop += 1
        if 6 <= stop - q <= 17:
            out.append(("account", q, stop))
            end = stop
    return out

