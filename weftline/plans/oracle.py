"""DuckDB SQL for the engine's queries, built from the same parameters by plain relational steps: one row for each symbol
and k-mer, window functions over them, and joins. Only texts of queries are made here."""

from __future__ import annotations

from weftline.config import JoinParams, SketchParams
from weftline.functions.rolling import BASES, PRIME

P, J = SketchParams(), JoinParams()


def reads(table: str = "documents", key: str = "doc_id", pre: str = "") -> str:
    return f"""{pre}reads AS (
  SELECT {key}::BIGINT AS read_id, {key}::VARCHAR AS name, length(sequence)::BIGINT AS raw_length, sequence FROM (
    SELECT {key}, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence
    FROM {table} WHERE {key} IS NOT NULL) x)"""


def strands(pre: str = "") -> str:
    return f"""{pre}strands AS (
  SELECT read_id, true AS fw, raw_length, sequence AS seq FROM {pre}reads
  UNION ALL SELECT read_id, false, raw_length, reverse(translate(sequence, 'ACGTacgt', 'TGCAtgca')) FROM {pre}reads)"""


def symbols(pre: str = "") -> str:
    """Homopolymer runs: one row for each, with its place and raw interval."""
    return f"""{pre}letters AS (
  SELECT read_id, fw, raw_length, unnest(range(raw_length)) AS p, unnest(string_split(seq, '')) AS s FROM {pre}strands WHERE raw_length > 0),
{pre}starts AS (
  SELECT * FROM {pre}letters QUALIFY s IS DISTINCT FROM lag(s) OVER (PARTITION BY read_id, fw ORDER BY p)),
{pre}syms AS MATERIALIZED (
  SELECT read_id, fw, raw_length, s, p AS a, coalesce(lead(p) OVER w, raw_length) - 1 AS z, row_number() OVER w - 1 AS c,
         count(*) OVER (PARTITION BY read_id, fw) AS n FROM {pre}starts WINDOW w AS (PARTITION BY read_id, fw ORDER BY p))"""


def tandem(motif: int = 6, doublings: int = 18, pre: str = "") -> str:
    """Tandem runs of the ``microsat`` mask. Each place has the run that would begin there; those that do begin are reached from
    the first place of their strand, by steps that double."""
    same = ", ".join(f"coalesce(s = lead(s, {m}) OVER w, false) AS q{m}" for m in range(1, motif + 1))
    until = ", ".join(f"min(CASE WHEN NOT q{m} THEN p END) OVER (PARTITION BY read_id, fw ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - p AS e{m}" for m in range(1, motif + 1))
    size = " ".join(f"WHEN e{m} >= {m} THEN {m}" for m in range(1, motif + 1))
    length = " ".join(f"WHEN e{m} >= {m} THEN {m} * (1 + e{m} // {m})" for m in range(1, motif + 1))
    steps = "".join(f""",
{pre}r{i + 1} AS MATERIALIZED (SELECT k FROM {pre}r{i} UNION SELECT nxt FROM {pre}r{i} JOIN {pre}j{i} USING (k)),
{pre}j{i + 1} AS MATERIALIZED (SELECT a.k, b.nxt FROM {pre}j{i} a JOIN {pre}j{i} b ON a.nxt = b.k)""" for i in range(doublings))
    return f"""{pre}letters AS (
  SELECT read_id, fw, raw_length, unnest(range(raw_length)) AS p, unnest(string_split(seq, '')) AS s,
         unnest(range(raw_length)) + coalesce(sum(raw_length) OVER (ORDER BY read_id, fw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k
  FROM {pre}strands WHERE raw_length > 0),
{pre}same AS (SELECT read_id, fw, raw_length, k, p, {same} FROM {pre}letters WINDOW w AS (PARTITION BY read_id, fw ORDER BY p)),
{pre}until AS (SELECT read_id, fw, raw_length, k, p, {until} FROM {pre}same),
{pre}runs AS MATERIALIZED (SELECT read_id, fw, raw_length, k, p, CASE {size} ELSE 1 END AS motif, CASE {length} ELSE 1 END AS len FROM {pre}until),
{pre}r0 AS (SELECT k FROM {pre}runs WHERE p = 0),
{pre}j0 AS (SELECT k, k + len AS nxt FROM {pre}runs WHERE p + len < raw_length){steps},
{pre}tandem AS (SELECT read_id, fw, raw_length, p AS a, p + len - 1 AS z, motif FROM {pre}runs JOIN {pre}r{doublings} USING (k))"""


def kmers(p: SketchParams = P, pre: str = "") -> str:
    """Hashes of k-mers by doubling: polynomials of 2, 4, 8 ... symbols from neighbours, then the sum of powers that k is,
    then the fifth power of both residues."""
    over = "OVER (PARTITION BY read_id, fw ORDER BY c)"
    steps, have, last = [f"{pre}k1 AS MATERIALIZED (SELECT read_id, fw, c, n, unicode(s)::BIGINT AS a1, unicode(s)::BIGINT AS b1 FROM {pre}syms)"], 1, f"{pre}k1"
    while have * 2 <= p.k:
        name = f"{pre}k{have * 2}"
        more = ", ".join(f"({x}{have} * {pow(base, have, PRIME)} + lead({x}{have}, {have}) {over}) % {PRIME} AS {x}{have * 2}" for x, base in zip("ab", BASES, strict=True))
        steps.append(f"{name} AS (SELECT *, {more} FROM {last})")
        last, have = name, have * 2
    whole = []
    for x, base in zip("ab", BASES, strict=True):
        out, at = "", 0
        for bit in reversed(range(p.k.bit_length())):
            if p.k >> bit & 1:
                piece = f"lead({x}{1 << bit}, {at}) {over}" if at else f"{x}{1 << bit}"
                out = f"({out} * {pow(base, 1 << bit, PRIME)} + {piece}) % {PRIME}" if at else piece
                at += 1 << bit
        whole.append(f"{out} AS {x}")
    fourth = lambda x: f"((({x} * {x}) % {PRIME}) * (({x} * {x}) % {PRIME})) % {PRIME}"
    steps.append(f"""{pre}whole AS (SELECT read_id, fw, c, n, {", ".join(whole)} FROM {last}),
{pre}kmers AS MATERIALIZED (
  SELECT read_id, fw, c, n, ({fourth("a")} * a % {PRIME}) * 2147483648 + {fourth("b")} * b % {PRIME} AS h FROM {pre}whole WHERE a IS NOT NULL)""")
    return ",\n".join(steps)


def minima(p: SketchParams = P, pre: str = "") -> str:
    """The smallest hash, and of equal ones the leftmost, as one number that sorts so."""
    return f"""{pre}mins AS (
  SELECT read_id, fw, c, n, min(h::HUGEINT * 4294967296 + c) OVER (PARTITION BY read_id, fw ORDER BY c ROWS BETWEEN CURRENT ROW AND {p.window_size} FOLLOWING) AS m
  FROM {pre}kmers WHERE n >= {p.span}),
{pre}minima AS MATERIALIZED (SELECT read_id, fw, c, n, (m // 4294967296)::BIGINT AS h, (m % 4294967296)::BIGINT AS p FROM {pre}mins WHERE c <= n - {p.k} - {p.window_size})"""


def vectors(p: SketchParams = P, pre: str = "") -> str:
    lead = lambda x, j: x if not j else f"lead({x}, {j * p.window_size}) OVER w"
    v = ", ".join(f"{lead('h', j)} AS h{j}" for j in range(p.num_windows))
    digits = " || ".join(f"printf('%016x', h{j})" for j in range(p.num_windows))
    return f"""{pre}vectors AS (
  SELECT *, {digits} AS key FROM (SELECT read_id, fw, c, n, {v}, p AS a, {lead("p", p.num_windows - 1)} AS z FROM {pre}minima WINDOW w AS (PARTITION BY read_id, fw ORDER BY c)) x
  WHERE c <= n - {p.span})"""


def emissions(pre: str = "") -> str:
    return f"""{pre}emissions AS (SELECT * FROM {pre}vectors QUALIFY key IS DISTINCT FROM lag(key) OVER (PARTITION BY read_id, fw ORDER BY c))"""


def chunks(p: SketchParams = P, pre: str = "") -> str:
    return f"""{pre}chunks AS MATERIALIZED (
  SELECT DISTINCT e.key, e.read_id, e.fw, x.a AS start, y.z AS "end", x.raw_length
  FROM {pre}emissions e JOIN {pre}syms x ON x.read_id = e.read_id AND x.fw = e.fw AND x.c = e.a
  JOIN {pre}syms y ON y.read_id = e.read_id AND y.fw = e.fw AND y.c = e.z + {p.k - 1})"""


def to_chunks(table: str = "documents", key: str = "doc_id", p: SketchParams = P, pre: str = "") -> str:
    return ",\n".join([reads(table, key, pre), strands(pre), symbols(pre), kmers(p, pre), minima(p, pre), vectors(p, pre), emissions(pre), chunks(p, pre)])


def covered(j: JoinParams = J) -> str:
    most = "" if j.max_coverage is None else f" AND n <= {j.max_coverage}"
    return f"covered AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM chunks) x WHERE n >= {j.min_coverage}{most})"


def matches(j: JoinParams = J, order: str = "<", left: str = "covered", right: str = "covered", read: bool = True) -> str:
    pair = f"l.read_id {order} r.read_id AND " if read else ""
    return f"""matches AS MATERIALIZED (
  SELECT l.key, l.read_id AS "left", r.read_id AS "right", l.start AS l_start, l."end" AS l_end, r.start AS r_start, r."end" AS r_end,
         l.fw AS l_fw, r.fw AS r_fw, l.raw_length AS l_len, r.raw_length AS r_len
  FROM {left} l JOIN {right} r ON l.key = r.key WHERE {pair}abs((l."end" - l.start) - (r."end" - r.start)) <= {j.max_length_difference})"""


NORMAL = """normal AS (
  SELECT "left", "right",
    CASE WHEN l_fw THEN l_start ELSE l_len - 1 - l_end END AS l_start, CASE WHEN l_fw THEN l_end ELSE l_len - 1 - l_start END AS l_end,
    CASE WHEN l_fw THEN r_start ELSE r_len - 1 - r_end END AS r_start, CASE WHEN l_fw THEN r_end ELSE r_len - 1 - r_start END AS r_end,
    true AS l_fw, l_fw = r_fw AS r_fw FROM matches)"""


def chains(j: JoinParams = J) -> str:
    return f"""steps AS (
  SELECT *, CASE WHEN (r_start - l_start) - lag(r_start - l_start) OVER (PARTITION BY "left", "right", r_fw ORDER BY r_start - l_start) > {j.chain_gap} THEN 1 ELSE 0 END AS brk FROM normal),
islands AS (
  SELECT *, sum(brk) OVER (PARTITION BY "left", "right", r_fw ORDER BY r_start - l_start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps),
chains AS (
  SELECT "left", "right", min(l_start) AS l_start, max(l_end) AS l_end, true AS l_fw, min(r_start) AS r_start, max(r_end) AS r_end, r_fw, count(*) AS n_matches
  FROM islands GROUP BY "left", "right", r_fw, island)"""


def named(right: str = "reads") -> str:
    return f"""SELECT l.name AS "left", l.raw_length AS left_len, l_start AS left_start, l_end AS left_end, CASE WHEN l_fw THEN 'fw' ELSE 'bw' END AS left_strand,
  r.name AS "right", r.raw_length AS right_len, r_start AS right_start, r_end AS right_end, CASE WHEN r_fw THEN 'fw' ELSE 'bw' END AS right_strand
FROM chains JOIN reads l ON l.read_id = "left" JOIN {right} r ON r.read_id = "right" """
