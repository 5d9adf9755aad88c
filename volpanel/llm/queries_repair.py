"""Query and SQL of operator 12 (conversation structure repair)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, repair


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_rows(common.read(spark, sf_dir, "conversations"))


# the check sum of id and turn, bit by bit over their ASCII characters
_SHIFT = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
_CRC = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {_SHIFT}), 4294967295)"
_KEEP = lambda arc, letter, more, turn: f"CASE WHEN {arc}.c < 999999 THEN {{'c': {arc}.c + {more}, 'a': {arc}.a || '{letter}', 't': {arc}.t || {turn}}} ELSE {arc} END"
_NONE = "{'c': 999999, 'a': '', 't': ''}"
_IN = lambda s, role: _KEEP(s, "I", 2, f"'{role}:' || chr(10)")
_INS = lambda *more: f"list_min([{', '.join(more)}])"
# insertions before a row: two of them at the most
_U = _INS("s2", *(_IN(s, "user") for s in ("s0", "s1", "s3")))
_A = _INS("s3", _IN("u2", "assistant"))
_OPEN = f"SELECT conv_id, position, s0, s1, {_INS('u2', _IN('a3', 'user'))} AS s2, a3 AS s3 FROM (SELECT *, {_A} AS a3 FROM (SELECT *, {_U} AS u2 FROM walk))"
_T = "'{}:' || r.text || chr(10)"
_D = lambda s: _KEEP(s, "D", 3, "''")
_K = lambda s, first: f"CASE WHEN r.stays AND r.first = '{first}' THEN {_KEEP(s, 'K', 'r.cut', 'r.role || chr(58) || r.text || chr(10)')} ELSE {_NONE} END"
_R = lambda s, role: f"CASE WHEN r.stays THEN {_KEEP(s, 'R', '2 + r.cut', _T.format(role))} ELSE {_NONE} END"
_SQL = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
kinds AS (SELECT k, {_CRC} % 20 AS kind FROM (SELECT DISTINCT k FROM keyed)),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
         FROM keyed JOIN kinds USING (k) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position, left(role, 1) AS first, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare FROM hurt),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY position) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  concat(lag(first) OVER (PARTITION BY conv_id ORDER BY position), first) AS pair, lag(first) OVER (PARTITION BY conv_id ORDER BY position) IS NOT NULL AS has_before FROM placed),
r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faulty),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (has_before AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(position) AS n FROM r GROUP BY 1),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS position, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NONE} AS s1, {_NONE} AS s2, {_NONE} AS s3 FROM facts
  UNION ALL
  SELECT w.conv_id, r.position, {_D('s0')}, list_min([{_D('s1')}, {_K('s0', 's')}]),
         list_min([{_D('s2')}, {", ".join(f"{_K(s, 'u')}, {_R(s, 'user')}" for s in ("s0", "s1", "s3"))}]), list_min([{_D('s3')}, {_K('s2', 'a')}, {_R('s2', 'assistant')}])
  FROM ({_OPEN}) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.position = w.position + 1),
done AS (SELECT w.conv_id, list_min([s0, s3]) AS best FROM ({_OPEN}) w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.position)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""

QUERIES = {"op12_repair_conversations": op12_repair_conversations}
ORACLE_SQL = {"op12_repair_conversations": _SQL}
