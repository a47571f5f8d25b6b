"""DuckDB SQL that gives the rows of the queries by other means."""

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filter"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM p) q, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)
"""

ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, v) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS n FROM l0),
bad AS (
  SELECT r, line, n,
    (n >= 20 AND length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > 0.15 * n)
    OR regexp_matches(line, '^[^|>»•·\n]{0,40}(?:[|>»•·][^|>»•·\n]{0,40}){2,}$')
    OR regexp_matches(line, '^\s*(?:https?://|www\.)\S+\s*$')
    OR (n <= 120 AND regexp_matches(lower(line), 'all rights reserved|accept cookies|cookie policy|privacy policy|terms of service|terms of use|subscribe to our newsletter|sign up for our newsletter|click here|log in|sign in|skip to content|follow us on|share this|read more|back to top|powered by|lorem ipsum|javascript is disabled')) AS b
  FROM l WHERE n > 0),
ls AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (b) AS n_bad_lines,
         coalesce(sum(n) FILTER (b), 0)::BIGINT AS lost_chars FROM bad GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ls USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM m
"""

ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = w.doc_id
"""

ORACLES["op7_mix_sources"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 10))::BIGINT AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
s AS (SELECT source, z, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM s0),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * z / w, source IS NULL, source) AS k FROM s),
lev AS (
  SELECT source, z, w, 3.0 * z < w * (sum(z) OVER () - coalesce(sum(3.0 * z) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS is_full
  FROM o WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT (sum(z) - coalesce(sum(3.0 * z) FILTER (is_full), 0)) / sum(w) FILTER (NOT is_full) AS per_weight FROM lev),
t AS (
  SELECT source, z, CASE WHEN is_full THEN 3.0 * z ELSE w * per_weight END AS target FROM lev, g),
q AS (
  SELECT source, z, target, CASE WHEN z > 0 THEN floor(target / z + 1e-9) ELSE 0 END AS whole,
         CASE WHEN z > 0 THEN greatest(0, target / z - floor(target / z + 1e-9)) * z ELSE 0 END AS want FROM t),
c AS (
  SELECT d.r, d.u, q.source, want, sum(size) OVER (PARTITION BY q.source ORDER BY u) AS upto,
         coalesce(sum(size) OVER (PARTITION BY q.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE size > 0 AND want > 1e-6),
x AS (
  SELECT source, min(CASE WHEN upto - want <= want - have THEN u + 1 ELSE u END) AS cut FROM c WHERE upto >= want AND have < want GROUP BY source)
SELECT doc_id, size, z AS source_size, target, (least(3, whole + CASE WHEN u < coalesce(cut, 0) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM q.source
"""

ORACLES["op4_tool_calls"] = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
asks AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'user'),
says AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'assistant'),
refs AS (
  SELECT a.*, t.target, b.turn IS NOT NULL AS known, q.turn IS NOT NULL AS closed
  FROM asks a, LATERAL (SELECT CASE WHEN a.turn % 8 < 6 THEN a.turn + 2 WHEN a.turn >= 8 THEN a.turn - 8 END AS target) t
  LEFT JOIN asks b ON b.conv_id = a.conv_id AND b.turn = t.target LEFT JOIN says q ON q.conv_id = a.conv_id AND q.turn = t.target + 1),
waits AS (SELECT conv_id, turn FROM refs WHERE target > turn AND known AND closed),
places AS (
  SELECT refs.*, CASE WHEN w1.turn IS NULL THEN 0 WHEN w2.turn IS NULL THEN 1 WHEN w3.turn IS NULL THEN 2 ELSE 3 END AS steps
  FROM refs LEFT JOIN waits w1 ON w1.conv_id = refs.conv_id AND w1.turn = refs.turn LEFT JOIN waits w2 ON w2.conv_id = refs.conv_id AND w2.turn = refs.turn + 2
  LEFT JOIN waits w3 ON w3.conv_id = refs.conv_id AND w3.turn = refs.turn + 4),
x AS (
  SELECT m.*, m.role = 'user' AS ask, m.role = 'assistant' AND c.turn IS NOT NULL AS linked, m.role = 'user' AND r.turn IS NOT NULL AS answered, p.target,
         CASE WHEN m.role = 'user' THEN p.steps WHEN m.role = 'assistant' THEN c.steps END AS steps,
         CASE WHEN p.target IS NULL THEN '' WHEN NOT p.known THEN '"unknown reference after"' WHEN NOT p.closed THEN '"open reference after"' ELSE '' END AS fault
  FROM m LEFT JOIN places p ON m.role = 'user' AND p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN places c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1
  LEFT JOIN says r ON r.conv_id = m.conv_id AND r.turn = m.turn + 1),
y AS (
  SELECT *, CASE WHEN ask AND turn % 8 = 4 THEN '"bad argument turn"' || CASE WHEN fault = '' THEN '' ELSE ',' || fault END ELSE fault END AS faults,
         '{"arguments":{' || CASE WHEN target IS NULL THEN '' ELSE '"after":{"result_of":"' || target || '"},' END || '"message":' || to_json(text)::VARCHAR
         || ',"turn":' || CASE WHEN turn % 8 = 4 THEN '"' || turn || '"' ELSE turn::VARCHAR END || '},"faults":[' AS head FROM x),
z AS (SELECT *, head || faults || '],"id":"' || turn || '","name":"reply","state":"' AS body FROM y)
SELECT conv_id, turn, role, CASE WHEN ask THEN turn + 2 * steps WHEN linked THEN turn - 1 + 2 * steps ELSE turn END AS anchor_turn,
       (CASE WHEN ask OR linked THEN 2 * steps ELSE 0 END + linked::INTEGER)::INTEGER AS depth,
       (CASE WHEN ask THEN CASE WHEN turn % 8 = 6 THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS n_calls, (linked OR answered)::BIGINT AS n_linked,
       (CASE WHEN NOT ask THEN 0 ELSE ((turn % 8 = 4)::INTEGER + (fault <> '')::INTEGER) * CASE WHEN turn % 8 = 6 THEN 2 ELSE 1 END END)::BIGINT AS n_faults,
  '{' || CASE WHEN ask THEN '"calls":[' || body || CASE WHEN answered THEN 'answered' ELSE 'open' END || '"}' || CASE WHEN turn % 8 = 6 THEN ',' || body || 'duplicate"}' ELSE '' END || '],' ELSE '' END
  || '"content":' || CASE WHEN ask THEN '""' ELSE to_json(text)::VARCHAR END || ',"conv_id":' || conv_id
  || CASE WHEN role = 'assistant' THEN ',"result_of":"' || (turn - 1) || '","result_state":"' || CASE WHEN linked THEN 'linked' ELSE 'orphan' END || '"' ELSE '' END
  || ',"role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' AS json
FROM z
"""


def _clustering(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    """Lloyd's rounds with all distances: one row for each vector and dimension, for each vector and centroid."""

    def assigned(i: int) -> str:
        return f"""
d{i} AS (SELECT v.vec_id, c.j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c USING (p) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT vec_id, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{i} GROUP BY vec_id)"""

    def moved(i: int) -> str:
        return f"""
s{i} AS (SELECT a.j, v.p, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x FROM v JOIN a{i - 1} a USING (vec_id) GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT c.j, c.p, coalesce(s.x, c.x) AS x FROM c{i - 1} c LEFT JOIN s{i} s USING (j, p))"""

    steps = "".join(f",{moved(i)},{assigned(i)}" for i in range(1, rounds + 1))
    return f"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(range({width})) AS p, unnest(list_transform(e, lambda x: floor(64 * x)::BIGINT)) AS x FROM e),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS j FROM e QUALIFY j < {k}),
c0 AS MATERIALIZED (SELECT j, p, x FROM first JOIN v USING (vec_id)),{assigned(0)}{steps},
names AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (j)
"""


ORACLES["op12_centroid_clustering"] = _clustering()
