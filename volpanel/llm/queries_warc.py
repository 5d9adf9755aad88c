"""Query and SQL of operator 6 (WARC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, warc


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_rows(common.read(spark, sf_dir, "pages"), common.shared_path(spark, "archive"))


_NUMBER = "CAST(concat('0x', substr(h, g * 5 + 1, 5)) AS INTEGER)"
_DIGITS = " || ".join(f"substr('{warc.BASE32}', (({_NUMBER} >> {b}) & 31) + 1, 1)" for b in (15, 10, 5, 0))
_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_DIGITS}), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""

QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {"op6_warc": _SQL}
