"""Query and SQL of operator 9 (embedding near-dedup)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, near_vectors


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark, 4096)
    return near_vectors.near_duplicates(common.read(spark, sf_dir, "embeddings"))


_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

QUERIES = {"op9_near_vectors": op9_near_vectors}
ORACLE_SQL = {"op9_near_vectors": _SQL}
