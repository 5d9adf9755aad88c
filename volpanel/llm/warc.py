"""WARC archives: one record per page, identical payloads as revisits, and reading back by boundary-chain verification.

Writing. A payload's digest finds its equals; of a group the row of the largest id is written whole, the others as revisit
records that name it. Records go through Spark's text writer, whose line separator is the blank pair of lines that ends
every WARC record, so the part files are archives byte for byte and lie wherever Spark can write.

Reading. The archives are read by splits of any size with the version line as the separator: each piece between two version
lines is a candidate record, whose header, if it is one, tells where its successor must begin. Byte offsets are running
sums of the pieces' lengths: within a split, then over the splits of a file, one small row each. A payload can hold version lines and whole headers too, so a candidate counts only if it is
reached from the file's start: runs of candidates that follow each other without another pointer leading into them are
contracted to one pointer, and pointer jumping over those (each round doubles the distance) finds what the start reaches.
Pieces of a record whose payload holds version lines are put together again.

Defined results: a null payload is the empty one; a null id is written as "null" and read as null, never named by a revisit
unless no other id is there, in which case all of the group are responses; rows of equal ids and payloads are all responses;
an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    hexes = F.sha1(payload)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(hexes, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda n, bits: F.substring(F.lit(BASE32), F.shiftright(n, bits).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(numbers, lambda n: F.concat(*(digit(n, b) for b in (15, 10, 5, 0)))), "")


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another one of equal payload."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= least_bytes).select("page_id", sha1_base32(F.col("payload")).alias("digest"))
    groups = stored(keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n"), "groups")
    return keyed.join(groups, "digest").where("NOT page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): each page as a WARC record without the blank lines behind it."""
    again = stored(revisits(pages, least_bytes), "revisits").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", sha1_base32(F.col("payload")))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    is_new = F.col("refers_to").isNull()
    body = F.when(is_new, F.concat(head, F.col("payload"))).otherwise(head)
    fields = [
        (F.lit("WARC-Type"), F.when(is_new, F.lit("response")).otherwise(F.lit("revisit"))),
        (F.lit("WARC-Record-ID"), urn("page_id")),
        (F.lit("WARC-Date"), F.lit(date)),
        (F.lit("WARC-Target-URI"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("digest"))),
        (F.lit("WARC-Refers-To"), F.when(~is_new, urn("refers_to"))),
        (F.lit("WARC-Profile"), F.when(~is_new, F.lit(PROFILE))),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
        (F.lit("Content-Length"), F.octet_length(body).cast("string")),
    ]
    lines = F.concat_ws("\r\n", *(F.concat(name, F.lit(": "), value) for name, value in fields))
    return rows.select(F.concat(F.lit(VERSION), lines, F.lit(END), body).alias("record"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes archives, one per task, to a folder."""
    records(pages, least_bytes).write.option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, piece): what stands between version lines; place orders the pieces of a block."""
    return (
        spark.read.option("lineSep", VERSION)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))
    )


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)
    return F.when(found != "", found)


def parsed(found: DataFrame) -> DataFrame:
    """A piece's header fields, lengths in bytes, and its payload's digest if the piece holds all of the record's block."""
    header = F.substring_index("piece", END, 1)
    found = found.withColumn("header", header).withColumn("bytes", F.octet_length("piece")).withColumn("ahead", F.octet_length("header") + len(END))
    found = found.withColumn("content", F.when(F.col("bytes") >= F.col("ahead"), F.expr("try_cast(regexp_extract(header, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*$', 1) AS bigint)")))
    found = found.withColumn("whole", F.col("content").isNotNull() & (F.col("ahead") + F.col("content") <= F.col("bytes")))
    block = F.substring(F.col("piece").cast("binary"), F.col("ahead") + 1, F.col("content").cast("int"))
    found = found.withColumn("http", F.when(F.col("whole"), F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)))
    payload = F.substring(F.col("piece").cast("binary"), F.col("ahead") + F.col("http") + 1, F.greatest(F.lit(0), F.col("content") - F.col("http")).cast("int"))
    return found.withColumn("payload_bytes", F.when(F.col("whole"), F.greatest(F.lit(0), F.col("content") - F.col("http")))).withColumn("digest", F.when(F.col("whole"), sha1_base32(payload)))


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One small row per piece that follows a version line: where it stands, its successor, and its record's fields."""
    found = parsed(pieces(spark, path))
    small = found.select(
        "file", "block", "place", "bytes", "ahead", "content", "whole", "payload_bytes", "digest",
        _field(F.col("header"), "WARC-Type").alias("type"), _field(F.col("header"), "WARC-Record-ID").alias("id"),
        _field(F.col("header"), "WARC-Refers-To").alias("refers"), _field(F.col("header"), "WARC-Payload-Digest").alias("stated"),
    )
    placed = _running(stored(small, "pieces"), "at", F.sum, F.col("bytes") + len(VERSION), "place", -1).withColumn("at", F.coalesce("at", F.lit(0)) - len(VERSION))
    placed = placed.where("at >= 0")  # what stands before a file's first version line is no record
    return placed.withColumn("next", F.when(F.col("content").isNotNull() & F.col("type").isNotNull(), F.col("at") + len(VERSION) + F.col("ahead") + F.col("content") + len(END)))


def _running(rows: DataFrame, to: str, fold: Callable[[str], Column], value: Column, order: str, end: int = 0) -> DataFrame:
    """rows with the column `to`: fold (F.sum, or F.max of growing values) of a file's rows up to each one, or with end -1 before it; null over none.

    A task folds the rows of one block of a file; the folds of whole blocks, one small row each, are carried along the file.
    """
    rows = rows.withColumn("__value", value)
    upto = Window.partitionBy("file", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(fold("__value").alias("__fold")).select("file", "block", fold("__fold").over(before).alias("__carried"))
    within = rows.withColumn("__within", fold("__value").over(upto)).join(blocks, ["file", "block"])
    both = F.coalesce(F.col("__within") + F.col("__carried"), "__within", "__carried") if fold is F.sum else F.coalesce("__within", "__carried")
    return within.withColumn(to, both).drop("__value", "__within", "__carried")


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates that lead on from the start of their file."""
    nodes = _running(found.select("file", "block", "at", "next"), "last", F.max, F.struct("at", "next"), "at", -1)
    # candidates that several pointers lead to begin runs of their own
    entered = found.where("next IS NOT NULL").groupBy("file", F.col("next").alias("at")).agg(F.count("*").alias("n")).where("n > 1")
    follows = F.coalesce(F.col("last.next") == F.col("at"), F.lit(False))
    heads = stored(nodes.join(stored(entered, "entered"), ["file", "at"], "left").select("file", "block", "at", "next", (~follows | F.col("n").isNotNull()).alias("head")), "heads")
    runs = stored(_running(heads, "run", F.max, F.when(F.col("head"), F.col("at")), "at").select("file", "at", "next", "run"), "runs")
    discard(heads)
    jumps = stored(runs.groupBy("file", "run").agg(F.max_by("next", "at").alias("to")).where("to IS NOT NULL"), "jumps")
    jumps = stored(jumps.join(jumps.select("file", F.col("run").alias("to")), ["file", "to"], "left_semi"), "jumps")
    reached = stored(runs.where("run = 0").select("file", "run").distinct(), "reached")
    n = reached.count()
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = stored(reached.union(ahead).distinct(), "reached")
        n, before = reached.count(), n
        if n == before:
            break
        jumps = stored(jumps.join(jumps.select("file", F.col("run").alias("to"), F.col("to").alias("further")), ["file", "to"]).select("file", "run", F.col("further").alias("to")), "jumps")
    return runs.join(reached, ["file", "run"]).select("file", "at")


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Files read inside are cut alike by every reading: without the setting, the cuts go by the cores that are there at the time."""
    name = "spark.sql.files.minPartitionNum"
    given = spark.conf.get(name, None)
    spark.conf.set(name, given or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, type, refers_to, payload_bytes, digest, stated, file, at) of the archives' records; payload_bytes and digest are of what stands there."""
    with _same_splits(spark):
        found = stored(candidates(spark, path), "candidates")
        real = stored(reachable(found), "reachable")
        rows = stored(found.join(real, ["file", "at"]), "records")
        if not rows.where("NOT whole").isEmpty():
            rows = _mended(spark, path, found, real, rows)
    return rows.select(_page(F.col("id")).alias("page_id"), "type", _page(F.col("refers")).alias("refers_to"), "payload_bytes", "digest", F.regexp_replace("stated", "^sha1:", "").alias("stated"), "file", "at")


def _mended(spark: SparkSession, path: str, found: DataFrame, real: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the payloads of records whose pieces stand apart: pieces inside a record are put together and parsed anew."""
    marks = found.select("file", "block", "place", "at", "whole").join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    owned = _running(marks, "owner", F.max, F.when(F.col("real"), F.struct("at", "whole")), "at")
    torn = stored(owned.where("NOT owner.whole").select("file", "block", "place", "at", F.col("owner.at").alias("own")), "torn")
    parts = pieces(spark, path).join(torn, ["file", "block", "place"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("parts"))
    joined = parsed(parts.select("file", F.col("own").alias("at"), F.array_join("parts.piece", VERSION).alias("piece")))
    mended = stored(joined.select("file", "at", F.col("payload_bytes").alias("__bytes"), F.col("digest").alias("__digest")), "mended")
    return rows.join(mended, ["file", "at"], "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).withColumn("digest", F.coalesce("digest", "__digest"))


def archived_rows(pages: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as the contract of op6 names them: written, then read back."""
    write(pages.select("page_id", "url", "html"), path)
    rows = stored(read(pages.sparkSession, path), "archived")
    new = rows.where("type = 'response'")
    # a revisit has no payload of its own: its response's stands for it, of one id's responses that of the stated digest
    first = stored(new.groupBy("page_id", "digest").agg(F.first("payload_bytes").alias("payload_bytes")).where("page_id IS NOT NULL"), "responses")
    again = rows.where("type = 'revisit'").select("page_id", "refers_to", F.col("stated").alias("digest")).join(first.withColumnRenamed("page_id", "refers_to"), ["refers_to", "digest"], "left")
    shown = lambda df, kind, refers: df.select("page_id", F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(kind).alias("record_type"), refers.alias("refers_to"))
    return shown(new, "response", F.lit(None).cast("long")).union(shown(again, "revisit", F.col("refers_to")))
