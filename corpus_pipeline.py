"""A corpus pipeline: each stage works on all that the one before it kept.

Stages: the quality classifier drops what it rejects; the n-gram Jaccard join keeps one document of each group; benchmark
decontamination drops contaminated documents; secret scans replace secrets in the texts by marks; SentencePiece encodes.
All but the last return the columns of documents.

Defined results of every stage: an empty table gives an empty one; rows are judged one by one, so repeated rows and repeated
or null ids keep their rows (but for near copies, of which one row stays); a null text counts as the empty one, is never
contaminated, holds no secret and has no tokens; further columns pass through all stages but the last. Trained models and the library's vocabulary have no SQL: tests hold the
stages to brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm import common, decontaminate, jaccard, quality, secret_scan, sentencepiece_stream

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier, learned on these documents' labels, gives a score of at least 0.3."""
    common.small_batches(spark)
    model = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= 0.3)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row, of the smallest doc_id."""
    common.small_batches(spark)
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs of which benchmark windows cover less than a twentieth."""
    return decontaminate.drop_documents(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets replaced by marks; n_chars follows the text."""
    common.small_batches(spark)
    found = secret_scan.redacted(docs, n="__n").withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    import public_tokenizers

    common.small_batches(spark)
    return sentencepiece_stream.encoded_rows(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
