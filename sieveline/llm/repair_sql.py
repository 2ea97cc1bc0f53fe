"""DuckDB equivalent of op13: a recursive query that keeps, of every state, the cheapest and then ASCII-least edits so far.

A value is the cost in nine digits followed by the edits, so that the least string is the best; null is what can't be reached.
"""

from __future__ import annotations

#: crc32 from a table of 256 entries; {bytes} is a list of bytes.
CRC_TABLE = """crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i))"""


def crc32(hexed: str, size: str) -> str:
    """crc32 of the bytes that ``hexed`` writes in hex; reads the table crc, joined as it is."""
    listed = f"list_transform(range({size}), lambda zk: ('0x' || substr({hexed}, 2 * zk + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {listed}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _plus(v: str, cost: str, edit: str) -> str:
    return f"(printf('%09d', CAST(left({v}, 9) AS INT) + {cost}) || substr({v}, 10) || '{edit}')"


def _keep(v: str, initial: str) -> str:
    return f"CASE WHEN NOT n.gone AND n.ini = '{initial}' THEN {_plus(v, 'n.cut', 'K')} END"


def _rerole(v: str) -> str:
    return f"CASE WHEN NOT n.gone THEN {_plus(v, '3 + n.cut', 'R')} END"


def _drop(v: str) -> str:
    return _plus(v, "4", "D")


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (SELECT *, {crc32("hex(encode(k))", "length(k)")} % 20 AS fate FROM src, crc),
dam AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM dam),
bare AS (
  SELECT *, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS ahead
  FROM num),
n AS (
  SELECT *, b = '' AS blank, b <> '' AND again AS dup, b <> '' AND NOT again AND right(b, 1) NOT IN ('.', '!', '?') AS trunc,
         b = '' OR again AS gone, CASE WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut
  FROM bare),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
         count(*) FILTER (ahead IS NOT NULL AND ahead || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last
  FROM n GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' AS s0, NULL::VARCHAR AS s1, '000000003I' AS su, '000000006II' AS sa FROM stats
  UNION ALL
  SELECT conv_id, pos, s0, s1, su, least(xa, {_plus("su", "3", "I")}) FROM (
    SELECT conv_id, pos, s0, s1, xa, least(xu, {_plus("s0", "3", "I")}, {_plus("s1", "3", "I")}, {_plus("xa", "3", "I")}) AS su FROM (
      SELECT w.conv_id, n.pos, {_drop("w.s0")} AS s0,
             least({_drop("w.s1")}, {_keep("w.s0", "s")}) AS s1,
             least({_drop("w.su")}, {_keep("w.s0", "u")}, {_keep("w.s1", "u")}, {_keep("w.sa", "u")}, {_rerole("w.s0")}, {_rerole("w.s1")}, {_rerole("w.sa")}) AS xu,
             least({_drop("w.sa")}, {_keep("w.su", "a")}, {_rerole("w.su")}) AS xa
      FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.pos = w.pos + 1) a) b),
best AS (SELECT w.conv_id, least(w.s0, w.sa) AS v FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = s.last),
step AS (SELECT conv_id, v, generate_subscripts(string_split(substr(v, 10), ''), 1) AS j FROM best WHERE length(v) > 9),
edit AS (
  SELECT conv_id, j, substr(v, 9 + j, 1) AS e, count(*) FILTER (substr(v, 9 + j, 1) <> 'I') OVER w AS pos, count(*) FILTER (substr(v, 9 + j, 1) <> 'D') OVER w AS k
  FROM step WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
put AS (
  SELECT e.conv_id, e.j, e.e, e.k, n.role, n.text, n.ini, bool_or(e.e = 'K' AND n.ini = 's') OVER (PARTITION BY e.conv_id) AS sys
  FROM edit e LEFT JOIN n ON e.e <> 'I' AND n.conv_id IS NOT DISTINCT FROM e.conv_id AND n.pos = e.pos),
flat AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - (CASE WHEN sys THEN 1 ELSE 0 END)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
  FROM put WHERE e <> 'D' GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       coalesce(left(b.v, 9)::BIGINT, 0) AS cost, coalesce(substr(b.v, 10), '') AS audit, sha256(coalesce(f.t, '')) AS repaired_sha256
FROM every o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN flat f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
