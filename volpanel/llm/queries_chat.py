"""Query and SQL of operator 3 (chat formatting)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, common


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(common.read(spark, sf_dir, "conversations"))


_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
                  concat('<|im_start|>', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS line
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
p AS (SELECT conv_id, position, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY position) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT position, upto, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM p WHERE position = n GROUP BY 1, 2)
SELECT conv_id, position AS n_turns, n_snapshots, upto AS rendered
FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.position = w.position AND p.upto = w.upto AND p.position < p.n)"""

QUERIES = {"op3_chat_collapse": op3_chat_collapse}
ORACLE_SQL = {"op3_chat_collapse": _SQL}
