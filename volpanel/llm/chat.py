"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time one turn longer. Every turn extends a rolling hash of its conversation's
beginning: the exclusive-or of 128-bit hashes of (position, role, content), which a window folds turn by turn. A conversation
is a snapshot if its last hash equals a hash inside a longer one; an anti-join leaves the maximal conversations, of equal
ones the smallest conv_id. Only hashes are joined, after duplicates have met by partial aggregation, so a snapshot that a
third of all conversations share is one row. What remains is rendered in ChatML form.

Defined results: turns go by (turn, role, text), nulls first; equal rows are one turn; a null role is "unknown" and a null
text empty; rows with a null conv_id are one conversation; an empty table gives an empty table; columns besides conv_id,
turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, content): distinct turns in order, positions from 1."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("position"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))


def _hash(half: int) -> Column:
    return F.xxhash64(F.lit(half), "position", F.length("role"), "role", F.octet_length("content"), "content", F.lit(half))


def prefixes(turned: DataFrame) -> DataFrame:
    """(conv_id, position, h1, h2): the rolling hash of each conversation up to each turn."""
    so_far = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    hashed = turned.select("conv_id", "position", _hash(1).alias("a"), _hash(2).alias("b"))
    return hashed.select("conv_id", "position", F.bit_xor("a").over(so_far).alias("h1"), F.bit_xor("b").over(so_far).alias("h2"))


def maximal(turned: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots) of the conversations that begin no longer one; n_snapshots counts equal ones."""
    key = ["position", "h1", "h2"]
    rolled = stored(prefixes(turned), "prefixes")
    last = rolled.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    marked = stored(rolled.join(stored(last, "lengths").withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id"), "marked")
    whole = marked.where("position = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    inside = marked.where("position < n_turns").groupBy(*key).agg(F.count("*").alias("n"))
    return whole.join(inside, key, "left_anti").select("conv_id", F.col("position").alias("n_turns"), "n_snapshots")


def rendered(turned: DataFrame) -> DataFrame:
    """(conv_id, rendered): each conversation as one text."""
    line = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("content"), F.lit(CLOSE + "\n"))
    lines = turned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join("lines.line", "").alias("rendered"))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_snapshots, rendered) of the maximal conversations."""
    turned = stored(turns(conversations), "turns")  # full texts are ordered once
    kept = stored(maximal(turned), "maximal").withColumnRenamed("conv_id", "id")
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    return rendered(turned.join(kept, same, "left_semi")).join(kept, same).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_snapshots", "rendered")
