"""Helpers shared by the corpus operators: tables, shared folders, batch sizes."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.sources.steps import shared_folder

#: Documents that one Arrow batch holds: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256
#: Tokens of more characters are not remembered, so that a number of tokens bounds a worker's memory.
REMEMBERED_CHARS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Where stored tables lie, while their DataFrames are held.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors, and gives the planner true sizes.

    `by` names a column of few values by which the files are parted.
    """
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete stored tables, or one folder of theirs, that nothing reads any more: disk is needed for the steps that follow."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{_PATHS[df]}/{part}")
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def steady(df: DataFrame) -> DataFrame:
    """df, or df stored if a shuffle makes it: rows of files come in the same order at every reading, those of a shuffle do not."""
    return stored(df, "steady") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 after division by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents outside the held-out fifth, the same ones at every run.

    The ids are chosen by hash from all labels, so the sample's size is bounded by `rows`; that bound is what makes the
    broadcast of the chosen ids safe. Conflicting labels of one id count as their maximum; of an id's rows the smallest text counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
