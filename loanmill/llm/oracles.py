"""The same in DuckDB SQL, for the queries that SQL can express."""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')"


OP5 = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
lines AS (
  SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT r) >= 5),
judged AS (
  SELECT k.*, coalesce(k.doc_id <> p.last, FALSE) AS gone FROM keyed k LEFT JOIN repeated p USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

_PATTERNS = [
    (
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?"""
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
]


def _found(rank: int, kind: str, pattern: str, group: int, shortest: int) -> str:
    return f"""SELECT doc_id, r, '{kind}' AS kind, {rank} AS rank,
    unnest(regexp_extract_all(text, '{pattern}', 0)) AS met,
    unnest(regexp_extract_all(text, '{pattern}', {group})) AS held, {shortest} AS shortest,
    unnest(string_split_regex(text, '{pattern}')) AS gap,
    generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS pos FROM texts"""


_SPAN = "kind || ':' || start || ':' || stop"
OP9 = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found(i, *p) for i, p in enumerate(_PATTERNS))}),
placed AS (
  SELECT *, sum(length(gap) + coalesce(length(met), 0)) OVER (PARTITION BY r, kind ORDER BY pos) AS stop
  FROM found),
spans AS (
  SELECT r, kind, rank, CAST(stop - length(met) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM placed WHERE met IS NOT NULL AND length(held) >= shortest)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({_SPAN}, ',' ORDER BY start, rank) FILTER (kind <> 'pem'), '')) AS base_sha256,
  coalesce(string_agg({_SPAN}, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN spans USING (r) GROUP BY t.doc_id, r
"""

OP10 = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, r, list_distinct(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
shingles AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r
  GROUP BY a.doc_id, b.doc_id, a.r, b.r, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM sets LEFT JOIN least USING (doc_id)
"""

# The unsigned CRC-32 of a decimal number: DuckDB has no function for it.
_CRC32 = """xor(list_reduce(
  list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
  lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)),
  CAST(4294967295 AS BIGINT)), 4294967295)"""
OP12 = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
led AS (SELECT *, {_CRC32} % 6 AS h FROM own),
paths AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS path
  FROM led o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
members AS (
  SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM paths),
nodes AS (
  SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (len(path) = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, path[1:depth]),
childed AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.node[1:n.depth] = n.node) AS n_children
  FROM nodes n)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n.ends_sha256,
  (SELECT count(*) FROM childed u WHERE u.n_children = 0 AND u.depth >= n.depth AND u.node[1:n.depth] = n.node) AS n_leaves,
  (SELECT CAST(sum((u.n_convs - 1) * coalesce(length(u.node[u.depth].text), 0)) AS BIGINT)
   FROM childed u WHERE u.depth >= n.depth AND u.node[1:n.depth] = n.node) AS saved_tokens
FROM childed n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""

ORACLES = {"op5_line_runs": OP5, "op9_blob_ledger": OP9, "op10_divide_skip": OP10, "op12_conversation_trie": OP12}
