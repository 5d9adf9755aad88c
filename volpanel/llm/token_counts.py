"""Token counts with a digest cache.

A text's key is the SHA-256 of its normalised content and the SHA-256 of the tokenizer's file; the cache is a Parquet table
(content_digest, tokenizer_digest, n_tokens) in shared storage. A run joins the documents' distinct contents to it, encodes
what misses once each, appends those counts, and joins every document to the cache. Copies meet in one row before the first
shuffle (partial aggregation), so a content that a third of all rows hold is encoded once and loads no task.

Misses are encoded piece by piece: the vocabulary's pre-tokenizer cuts a text into pieces that are encoded independently of
each other, so a task asks the library only for pieces that it has not met.

Defined results: a null text counts as empty and has no tokens; strings of special tokens inside a text count as the
library's default has them (one token); repeated rows each get their count; an empty table gives an empty table; a null
doc_id passes through.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Distinct pieces that a task remembers before it starts anew.
CACHE_PIECES, ENCODED_AT_ONCE = 200_000, 500


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def normalised(text: Column) -> Column:
    """What the digest is taken of. Byte-level vocabularies keep every byte, so only null and empty become one."""
    return F.coalesce(text, F.lit(""))


@lru_cache(2)
def byte_bpe_counter(path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """Counts the tokens of texts for a byte-level vocabulary of the tokenizers library; pattern is its pre-tokenizer's.

    One per process: the tasks that a worker runs one after another share it and what it has met.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads would only hold memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    find = regex.compile(pattern).findall
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        if len(known) >= CACHE_PIECES:
            known.clear()
        rows = []
        for text in texts:
            marks = len(special.findall(text)) if special and any(s in text for s in specials) else 0
            rows.append((marks, [p for part in special.split(text) for p in find(part)] if marks else find(text)))
        new = list({p for _, pieces in rows for p in pieces if p not in known})
        for at in range(0, len(new), ENCODED_AT_ONCE):  # the library's results are large next to the counts
            part = new[at : at + ENCODED_AT_ONCE]
            known.update(zip(part, (len(x.ids) for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [marks + sum(map(known.__getitem__, pieces)) for marks, pieces in rows]

    return count


def encode_misses(contents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(content_digest, n_tokens) of (content_digest, text)."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = byte_bpe_counter(path, pattern)
        for batch in batches:
            yield pd.DataFrame({"content_digest": batch["content_digest"], "n_tokens": count(batch["text"].tolist())})

    return contents.select("content_digest", "text").mapInPandas(encoded, "content_digest binary, n_tokens long")


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The cache's rows of one tokenizer, one per content. A cache that is not there yet is made, empty."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as e:  # noqa: BLE001  any store's "not found" arrives as AnalysisException
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(cache)
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return found.where(F.col("tokenizer_digest") == tokenizer).select("content_digest", "n_tokens")


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def fill_cache(docs: DataFrame, cache: str, path: str, pattern: str, text: str = "text") -> None:
    """Encodes the distinct contents that the cache lacks and appends their counts.

    Two runs may append the same content at the same time; counts are a function of the key, so either row serves.
    """
    tokenizer = tokenizer_digest(path)
    contents = docs.select(content_digest(F.col(text)).alias("content_digest"), normalised(F.col(text)).alias("text"))
    known = cached(docs.sparkSession, cache, tokenizer)
    misses = contents.groupBy("content_digest").agg(F.first("text").alias("text"))  # copies become one row before they are moved
    if not known.isEmpty():  # digests first: few missing ones filter the texts where they lie, and only missing texts are encoded
        missing = common.stored(contents.select("content_digest").distinct().join(known, "content_digest", "left_anti"), "missing")
        misses = misses.join(missing, "content_digest", "left_semi")
    encode_misses(misses, path, pattern).select("content_digest", F.lit(tokenizer).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)


def with_counts(keyed: DataFrame, cache: str, path: str) -> DataFrame:
    """keyed, which has content_digest, with n_tokens of the cache in its place; null where the cache has no such content."""
    counts = cached(keyed.sparkSession, cache, tokenizer_digest(path)).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = common.stored(counts, "counts")  # read straight into the join, whose other side can then be split at a hot content
    return keyed.join(counts, "content_digest", "left").drop("content_digest")


def count_tokens(docs: DataFrame, cache: str, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, in place of a column of that name; its cache is filled first. The join moves all columns of docs: select those needed before."""
    fill_cache(docs, cache, path, pattern, text)
    digests = docs.select(*(F.col(c).alias("__own_digest" if c == "content_digest" else c) for c in docs.columns if c != "n_tokens"))
    out = with_counts(digests.withColumn("content_digest", content_digest(F.col(text))), cache, path)
    return out.withColumnRenamed("__own_digest", "content_digest")


def count_rows(docs: DataFrame, cache: str, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, as the contract of op8 names them."""
    fill_cache(docs, cache, path, pattern)
    text = F.col("text")
    keyed = docs.select("doc_id", F.octet_length(normalised(text)).cast("long").alias("n_bytes"), content_digest(text).alias("content_digest"))
    return with_counts(keyed, cache, path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
