"""Query and SQL of operator 1 (secret scans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, secret_scan


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return secret_scan.digest_rows(common.read(spark, sf_dir, "documents"))


def _kind(rank: int, rule: secret_scan.Rule) -> str:
    pattern = (f"({rule.head})({rule.value})" if rule.value else f"({rule.head})").replace("'", "''")
    if rule.any_case:
        pattern = pattern.replace("(password", "(?i:password", 1).replace("(" + "(?i:", "((?i:", 1)
    value = pattern.count("(") - pattern.count("(?") if rule.value else 1
    return f"""
    SELECT row_id, {rank} AS rank, '{rule.kind}' AS kind, starts + 1 AS at, starts AS first, starts + length(whole) AS last FROM (
      SELECT row_id, whole, value,
             CAST(list_sum(list_transform(between_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS starts
      FROM (SELECT row_id, wholes, between_, unnest(range(1, len(wholes) + 1)) AS i, unnest(wholes) AS whole, unnest(values_) AS value
            FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS wholes, regexp_extract_all(text, '{pattern}', {value}) AS values_,
                         string_split_regex(text, '{pattern}') AS between_
                  FROM docs)))
    WHERE length(whole) >= {rule.min_chars} AND length(value) >= {rule.min_value}"""


def _sql() -> str:
    kinds = " UNION ALL ".join(_kind(k, r) for k, r in enumerate(secret_scan.DEFAULT_RULES))
    base = len(secret_scan.BASE_RULES)
    shown = "concat(kind, ':', first, ':', last)"
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE_RULES))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({kinds}),
per AS (SELECT row_id, {counts},
               coalesce(string_agg({shown}, ',' ORDER BY first, rank) FILTER (rank < {base}), '') AS base,
               string_agg({shown}, ',' ORDER BY first, rank) AS spans
        FROM found GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row_id)"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL = {"op1_secret_scan": _sql()}
