"""Queries of operators 5 (SentencePiece) and 8 (token counts). SQL has no tokenizers; tests hold both to the libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sentencepiece_stream, token_counts


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.small_batches(spark)
    return sentencepiece_stream.encoded_rows(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.small_batches(spark)
    docs, path, pattern = common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    # an earlier run has left the counts of every second document's text: the run over all meets hits and misses, and appends
    cache = common.shared_path(spark, "token-cache")
    token_counts.fill_cache(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0), cache, path, pattern)
    return token_counts.count_rows(docs, cache, path, pattern)


QUERIES = {"op5_sentencepiece": op5_sentencepiece, "op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
