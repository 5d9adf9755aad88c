"""Benchmark decontamination with DataFrame functions only.

A benchmark item's windows are its runs of 13 consecutive words (or all its words, if fewer). The scan splits each document's
text into words once and probes a hash set with the hash of every window of the lengths that occur: a hash join whose small
side is broadcast only while its measured size stays below `broadcast_bytes`. Few positions pass; there the windows are
compared word by word, so that no hash decides. Beyond that size only (document, position, hash) is shuffled to the windows,
and what meets fetches its words for the comparison. Verified occurrences are united per document into hit words, and the
caller drops whole documents or cuts the hit spans.

Words: A-Z are lower-cased and the text is cut at every ASCII character that is neither letter nor digit.

Defined results: null and word-less texts have no words and no hits; items without words are never found; equal rows are one
in the counting and each get its result; a null doc_id is a value like others; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 13
#: Measured bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20
#: Fixed value: the ASCII characters that part words, after A-Z have become a-z.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of words; never null. ASCII texts take the cheap way to lower case, which is the same for them."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, PARTS), "")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(key, length, window, items): distinct windows as arrays of words, their hash and number of words, the items."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - n))
    window = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, F.least(F.lit(n), F.size("words"))))).alias("window"))
    window = window.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return window.select(F.xxhash64("window").alias("key"), F.size("window").alias("length"), "window", "items")


def fits(df: DataFrame, row_bytes: Column | int, broadcast_bytes: int) -> bool:
    """Whether the rows of df, of the given sizes, fit into a broadcast."""
    return (df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0) <= broadcast_bytes


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids, spans) of the documents with hits; spans are (first, last) word positions of occurrences.

    text_hash tells apart rows that share a doc_id.
    """
    found = stored(windows(benchmark, n), "windows")
    lengths = [r[0] for r in found.select("length").distinct().orderBy("length").collect()]  # n of them at most
    small = fits(found, F.octet_length(F.to_json("window")) + 16 * F.size("items") + 64, broadcast_bytes)
    placed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    # the outer forms give the same rows here; from the inner ones the planner infers filters that split every text again
    sized = placed.select("*", F.explode_outer(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("length"))
    starts = F.when(F.size("words") >= F.col("length"), F.sequence(F.lit(0), F.size("words") - F.col("length")))
    scanned = sized.select("*", F.explode_outer(starts).alias("first"))
    window = lambda: F.slice(F.col("words"), F.col("first") + 1, F.col("length"))
    scanned = scanned.withColumn("key", F.xxhash64(window()))
    if small:
        met = scanned.join(F.broadcast(found), ["key", "length"])
    else:
        near = scanned.where("first IS NOT NULL").select("doc_id", "text_hash", "length", "first", "key").join(found, ["key", "length"])
        met = stored(near.distinct(), "met").alias("m").join(placed.alias("p"), F.expr("m.doc_id <=> p.doc_id AND m.text_hash = p.text_hash")).select("m.*", "p.words")
    met = met.where(window() == F.col("window")).select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "first", (F.col("first") + F.col("length") - 1).alias("last"), "items")
    per = met.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids")
    )
    # spans come by their first word: each adds what lies behind the furthest word so far
    total = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["end"], x["first"] - 1))).alias("n"), F.greatest(acc["end"], x["last"]).alias("end")),
        lambda acc: acc["n"],
    )
    return per.select("doc_id", "text_hash", "n_words", total.cast("long").alias("n_hit"), "item_ids", "spans")


#: Names of the results beside a document's own columns, under which no table's columns are expected.
RESULTS = {"__n_words": "n_words", "__n_hit": "n_hit", "__items": "item_ids", "__spans": "hit_spans", "__contaminated": "contaminated"}


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, one_in: int) -> DataFrame:
    """docs with the columns RESULTS."""
    found = hits(docs, benchmark, n).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__found"), F.col("n_hit").alias("__n_hit"), F.col("item_ids").alias("__items"), F.col("spans").alias("__spans"))
    out = docs.withColumn("__n_words", F.size(words(F.col("text"))).cast("long")).withColumn("__hash", F.xxhash64("text"))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__found")), "left").drop("__id", "__hash", "__found")
    out = out.withColumn("__n_hit", F.coalesce("__n_hit", F.lit(0).cast("long")))
    return out.withColumn("__contaminated", (F.col("__n_hit") > 0) & (one_in * F.col("__n_hit") >= F.col("__n_words")))


def marked(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, one_in: int = 20) -> DataFrame:
    """docs with n_words, n_hit, item_ids, hit_spans and contaminated (hits in at least one of `one_in` words); columns of these names are replaced."""
    return _judged(docs.drop(*RESULTS.values()), benchmark, n, one_in).withColumnsRenamed(RESULTS)


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, one_in: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the contaminated ones. Texts stay in place while the contaminated ones' keys are measured to fit into a broadcast."""
    found = stored(hits(docs, benchmark, n, broadcast_bytes).where(one_in * F.col("n_hit") >= F.col("n_words")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__found")), "contaminated")
    bad = F.broadcast(found) if fits(found, 64, broadcast_bytes) else found
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__found"))
    return docs.withColumn("__hash", F.xxhash64("text")).join(bad, at, "left_anti").drop("__hash")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the hit words cut from text; what parts the words stays, and texts without hits stay as they are."""
    raw = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    hit = F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["first"], s["last"]))))
    every = F.sequence(F.lit(0), F.col("__n_words").cast("int") - 1)
    # words that stay and gaps in the words' order: neither looks through the spans, of which a text can have one a word
    bound = F.struct(F.regexp_extract_all("text", F.lit(raw), F.lit(0)).alias("words"), hit.alias("hit"), F.array_except(every, hit).alias("kept"))
    at = lambda i, w: F.struct(i.alias("at"), w.alias("word"))
    placed = lambda x: F.array_sort(F.concat(F.transform(x["kept"], lambda i: at(i, F.get(x["words"], i))), F.transform(x["hit"], lambda i: at(i, F.lit("")))))
    left = F.transform(F.get(F.transform(F.array(bound), placed), F.lit(0)), lambda x: x["word"])  # an array of one binds what is used twice
    between = F.split("text", raw)
    whole = F.array_join(F.zip_with(between, F.concat(left, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return _judged(docs, benchmark, n, 20).withColumn("text", F.when(F.col("__n_hit") > 0, whole).otherwise(F.col("text"))).drop(*RESULTS)


def marked_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, as the contract of op7 names them."""
    items = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    ids = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    return marked(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated"
    )
