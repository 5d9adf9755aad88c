"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only.

1. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents by weight. A target
   stops at `most_epochs` times its source's words; what that leaves is shared by weight among the rest. Sorted by the words a
   unit of weight has, the sources that stop are the first ones, so running sums settle all of them at once.
2. A source's documents, in the order of a hash, are one stream of words, cut into blocks of `block_words`. The source's quota
   is its target in words: whole epochs of its blocks, then blocks in a permuted order, the last one cut to the word.
3. The quotas of all sources, in blocks, are dealt to shards down a binary tree: a node's left half gets so many blocks of
   each source as a draw without replacement from the node's blocks would hold, the right half gets the rest. Every number
   follows from the node alone, so the tree grows level by level in parallel and sums stay exact.
4. A leaf's numbers are a range of each source's draws, so that shards are disjoint; a draw's block is the inverse of a
   swap-or-not permutation of the source's blocks, another one in each epoch. A shard's pieces are then shuffled within it.

Running sums over a stream are taken in bins of some BIN_ROWS documents and carried over the bins, one row each, so that no
task holds a source. Equal rows (one id, one text) are counted before they are dealt and count as that many copies.

Defined results: a null text has no words; a null source is a source; a null doc_id is a value like others; documents
without words take nothing; repeated rows each get their result; an empty table gives an empty table; columns besides doc_id,
source and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: A word and the white space behind it.
SPACED = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Documents of a bin on the average.
BIN_ROWS = 4096
#: Rounds of the swap-or-not permutation.
ROUNDS = 32
#: Levels of the tree that one job grows.
LEVELS = 8
#: Standard deviations (and steps) on either side of the mode within which a number of blocks is drawn: all but 1e-30 of the mass.
REACH = 12


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)
    most_epochs: int = 3
    block_words: int = 4096
    blocks_a_shard: int = 64
    seed: int = 13


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """sizes (source, source_size) with number (from 0, by code point, null last) and target: one row a source."""
    every = Window.orderBy(F.col("source").isNull(), "source")  # a row per source
    weights = F.array(*map(F.lit, settings.weights))
    at = F.row_number().over(every) - 1
    rows = sizes.withColumn("number", at).withColumn("weight", F.element_at(weights, (F.col("number") % len(settings.weights) + 1).cast("int")).cast("double"))
    cap = (settings.most_epochs * F.col("source_size")).cast("double")
    first = Window.orderBy(F.col("cap") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("all").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("cap", cap).withColumn("all", F.lit(0))
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(first), F.lit(0.0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(first), F.lit(0.0))
    rows = rows.withColumn("unit", left / weight).withColumn("stops", F.col("unit") * F.col("weight") > F.col("cap"))
    # of those that do not stop, the first one's unit holds for all
    unit = F.min_by(F.when(~F.col("stops"), F.col("unit")), F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("number")))).over(whole)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(unit * F.col("weight"), F.col("cap")))
    return rows.select("source", "number", "source_size", target.alias("target"), *(c for c in sizes.columns if c not in ("source", "source_size")))


def uniform(*parts: Column | int) -> Column:
    """A number between 0 and 1, both excluded, that the parts alone decide."""
    hashed = F.xxhash64(*(F.lit(p) if isinstance(p, int) else p for p in parts))
    return (F.shiftrightunsigned(hashed, 11) + 0.5) / float(1 << 53)


def _walk(steps: Column, ratio: Callable[[Column], Column], goal: Column) -> Column:
    """Weights beside the mode, whose own is 1, multiplied up step by step: their sum, and how many sums stay below goal."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0.0).alias("k"))
    numbers = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, j: Column) -> Column:
        return let(acc["w"] * ratio(j.cast("double")), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s"), (acc["k"] + F.when(acc["s"] + w < goal, 1.0).otherwise(0.0)).alias("k")))

    return F.aggregate(numbers, start, step)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` blocks out of `total` are among the `good` ones: whole doubles, by inversion of u outwards from the mode."""

    def within(v: Column) -> Column:
        n, k, m = v["n"], v["k"], v["m"]
        low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
        mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
        reach = F.ceil(REACH * F.sqrt(m * k * (n - k) * (n - m) / F.greatest(n - 1, F.lit(1.0))) / F.greatest(n, F.lit(1.0))).cast("double") + REACH
        placed = F.struct(mode.alias("at"), F.least(reach, mode - low).alias("down"), F.least(reach, high - mode).alias("up"))
        return let(placed, searched(n, k, m))

    def searched(n: Column, k: Column, m: Column) -> Callable[[Column], Column]:
        def of(p: Column) -> Column:
            up = lambda j: (k - (p["at"] + j - 1)) * (m - (p["at"] + j - 1)) / ((p["at"] + j) * (n - k - m + p["at"] + j))
            down = lambda j: (p["at"] - j + 1) * (n - k - m + p["at"] - j + 1) / ((k - p["at"] + j) * (m - p["at"] + j))
            none = F.lit(0.0)
            sums = F.struct(_walk(p["up"], up, none)["s"].alias("up"), _walk(p["down"], down, none)["s"].alias("down"))

            def chosen(s: Column) -> Column:
                def of_goal(goal: Column) -> Column:
                    above = p["at"] + F.least(p["up"], 1 + _walk(p["up"], up, goal - 1)["k"])
                    below = p["at"] - F.least(p["down"], 1 + _walk(p["down"], down, goal - 1 - s["up"])["k"])
                    return F.when(goal <= 1, p["at"]).when((goal <= 1 + s["up"]) | (p["down"] == 0), above).otherwise(below)

                return let(u * (1 + s["up"] + s["down"]), of_goal)

            return let(sums, chosen)

        return of

    return let(F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("m")), within)


def _halved(nodes: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """Every node of several shards as its two halves. Nodes: (lo, hi, parts), parts being (number, first, n) of each source there."""
    until = lambda k: F.floor(k * F.lit(blocks) / F.lit(shards)).cast("long")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    nodes = nodes.withColumn("middle", middle)
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["n"])
    wanted = (until(F.col("middle")) - until(F.col("lo"))).cast("double")
    start = F.struct(total.alias("rest"), wanted.alias("left"), F.array().cast("array<double>").alias("taken"))

    def draw(acc: Column, x: Column) -> Column:
        here = hypergeometric(acc["rest"], x["n"], acc["left"], uniform(seed, F.col("lo"), F.col("hi"), x["number"]))
        return let(here, lambda v: F.struct((acc["rest"] - x["n"]).alias("rest"), (acc["left"] - v).alias("left"), F.concat(acc["taken"], F.array(v)).alias("taken")))

    nodes = nodes.withColumn("taken", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("parts", start, draw)["taken"]))
    part = lambda x, first, n: F.struct(x["number"].alias("number"), first.cast("long").alias("first"), n.cast("long").alias("n"))
    some = lambda parts: F.filter(parts, lambda x: x["n"] > 0)
    left = some(F.zip_with("parts", "taken", lambda x, t: part(x, x["first"], t)))
    right = some(F.zip_with("parts", "taken", lambda x, t: part(x, x["first"] + t, x["n"] - t)))
    node = lambda lo, hi, parts: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), parts.alias("parts"))
    halves = F.when(F.col("hi") - F.col("lo") > 1, F.array(node("lo", "middle", left), node("middle", "hi", right))).otherwise(F.array(node("lo", "hi", F.col("parts"))))
    return nodes.select(F.explode(halves).alias("node")).select("node.*")


def shards_of(quotas: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """(shard, number, first, n): the range of each source's draws that each shard gets. quotas: (number, quota), `blocks` in all."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("number"), F.lit(0).cast("long").alias("first"), F.col("quota").cast("long").alias("n"))))
    nodes = quotas.where("quota > 0").agg(parts.alias("parts")).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "parts")  # the root: a row
    for level in range((shards - 1).bit_length()):
        if level and level % LEVELS == 0:
            nodes = stored(nodes.repartition(1 << min(level, 10), "lo"), "nodes")
        nodes = _halved(nodes, blocks, shards, seed)
    return nodes.select(F.col("lo").alias("shard"), F.explode("parts").alias("part")).select("shard", "part.*")


def permuted(x: Column, n: Column, *key: Column | int, back: bool = False) -> Column:
    """A permutation of 0 to n - 1, or its inverse, by swap-or-not rounds: in each, x and k - x (mod n) change places or not."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    parts = [F.lit(k) if isinstance(k, int) else k for k in key]

    def one(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit(1), r, *parts), n)
        other = F.pmod(other - at, n)
        return let(other, lambda y: F.when(F.xxhash64(F.lit(2), r, F.greatest(at, y), *parts).bitwiseAND(1) == 1, y).otherwise(at))

    return F.aggregate(rounds, x.cast("long"), one)


@dataclass(frozen=True)
class Mix:
    """sources: (source, number, source_size, target, size_blocks, quota, cut); streams: documents' places in their sources'
    streams (number, doc_id, text_hash, size, copies, start); draws: (shard, number, draw, epoch, block, words)."""

    sources: DataFrame
    streams: DataFrame
    draws: DataFrame
    settings: Settings


def planned(docs: DataFrame, settings: Settings = Settings()) -> Mix:
    """What of each source goes to which shard. docs are read once; from here on only ids, hashes and numbers move."""
    b, seed = settings.block_words, settings.seed
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    groups = stored(rows.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("copies")), "groups")
    sums = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("groups"))
    n, short = F.col("size_blocks"), F.col("source_size") - (F.col("size_blocks") - 1) * b
    sources = targets(sums, settings).withColumn("size_blocks", F.ceil(F.col("source_size") / F.lit(b)).cast("long"))
    want = F.least(F.round("target").cast("long"), settings.most_epochs * F.col("source_size"))
    sources = sources.withColumn("want", want).withColumn("epochs", F.when(n > 0, F.floor(F.col("want") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("want") - F.col("epochs") * F.col("source_size"))
    # in the epoch that is not whole, the stream's last, shorter block stands somewhere among the draws
    sources = sources.withColumn("last_at", F.when(n > 0, permuted(n - 1, n, seed, F.col("number"), F.col("epochs"))))
    before = lambda k: k * b - F.when(k > F.col("last_at"), b - short).otherwise(0)
    least = F.ceil(F.col("rest") / F.lit(b)).cast("long")
    sources = sources.withColumn("some", F.when(F.col("rest") == 0, 0).when(before(least) >= F.col("rest"), least).otherwise(least + 1).cast("long"))
    sources = sources.withColumn("cut", F.when(F.col("some") > 0, F.col("rest") - before(F.col("some") - 1)))
    sources = sources.withColumn("quota", F.coalesce(F.col("epochs") * n + F.col("some"), F.lit(0)).cast("long"))
    sources = stored(sources.select("source", "number", "source_size", "target", "groups", "size_blocks", "quota", "cut"), "sources")

    blocks = sources.agg(F.sum("quota")).first()[0] or 0
    leaves = shards_of(sources.select("number", "quota"), max(1, -(-blocks // settings.blocks_a_shard)), blocks, seed)
    drawn = leaves.select("shard", "number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    drawn = drawn.join(sources.select("number", "size_blocks", "source_size", "quota", "cut"), "number")
    drawn = drawn.withColumn("epoch", F.floor(F.col("draw") / n).cast("long"))
    drawn = drawn.withColumn("block", permuted(F.col("draw") % n, n, seed, F.col("number"), F.col("epoch"), back=True))
    words = F.when((F.col("draw") == F.col("quota") - 1) & F.col("cut").isNotNull(), F.col("cut")).when(F.col("block") == n - 1, short).otherwise(b)
    draws = stored(drawn.select("shard", "number", "draw", "epoch", "block", words.cast("long").alias("words")), "draws")

    binned = groups.alias("g").join(sources.select(F.col("source").alias("of"), "number", F.ceil(F.col("groups") / F.lit(BIN_ROWS)).alias("bins")), F.col("source").eqNullSafe(F.col("of")))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    binned = binned.withColumn("h", hashed).select("number", F.pmod("h", "bins").alias("bin"), "h", "doc_id", "text_hash", "size", "copies")
    span = F.col("size") * F.col("copies")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    carried = binned.groupBy("number", "bin").agg(F.sum(span).alias("words"))
    carried = carried.withColumn("carried", F.sum("words").over(so_far(Window.partitionBy("number").orderBy("bin"))) - F.col("words")).drop("words")
    inside = F.sum(span).over(so_far(Window.partitionBy("number", "bin").orderBy("h", "doc_id", "text_hash", "size"))) - span
    streams = binned.withColumn("start", inside).join(carried, ["number", "bin"])
    return Mix(sources, streams.select("number", "doc_id", "text_hash", "size", "copies", (F.col("start") + F.col("carried")).alias("start")), draws, settings)


def pieces(mix: Mix) -> DataFrame:
    """Every document's copies cut at the borders of blocks: (number, doc_id, text_hash, size, copy, block, first, n, skipped).

    first: words of the document before the piece; skipped: words of the block before it. Documents without words have one row
    with a null block.
    """
    b = mix.settings.block_words
    copies = mix.streams.select("number", "doc_id", "text_hash", "size", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    copies = copies.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    index = lambda word: F.floor(word / F.lit(b)).cast("long")
    touched = F.when(F.col("size") > 0, F.sequence(index(F.col("start")), index(F.col("start") + F.col("size") - 1)))
    cut = copies.select("*", F.explode_outer(touched).alias("block"))
    lo, hi = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return cut.select("number", "doc_id", "text_hash", "size", "copy", "block", (lo - F.col("start")).alias("first"), (hi - lo).alias("n"), (lo - F.col("block") * b).alias("skipped"))


def _met() -> Column:
    """Words of a piece that a draw of its block takes."""
    return F.greatest(F.lit(0), F.least(F.col("n"), F.col("words") - F.col("skipped")))


def taken_rows(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target, taken, as the contract of op13 names them: one row per row of docs."""
    mix = planned(docs, settings)
    # a block is drawn as often as there are epochs, so a row of it holds few numbers
    drawn = mix.draws.groupBy("number", "block").agg(F.collect_list("words").alias("drawn"))
    met = F.aggregate("drawn", F.lit(0).cast("long"), lambda acc, w: acc + F.greatest(F.lit(0), F.least(F.col("n"), w - F.col("skipped"))))
    per = pieces(mix).join(drawn, ["number", "block"], "left").groupBy("number", "doc_id", "text_hash", "size", "copy").agg(F.sum(F.coalesce(met, F.lit(0))).alias("taken"))
    return per.join(mix.sources.select("number", "source_size", "target"), "number").select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: (shard, place, source, doc_id, epoch, first, n, text), text being words first to first + n - 1 with the white space behind each.

    Texts are shuffled once, to the pieces that take them. place is the order within a shard, by a hash.
    """
    mix = planned(docs, settings)
    found = pieces(mix).join(mix.draws, ["number", "block"]).withColumn("n", _met()).where("n > 0")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text").groupBy("id", "hash").agg(F.first("text").alias("text"))
    whole = found.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    text = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("n").cast("int")), "")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(settings.seed), "shard", "number", "draw", "doc_id", "text_hash", "copy"), "number", "draw", "skipped")
    out = whole.withColumn("text", text).withColumn("place", F.row_number().over(order)).join(mix.sources.select("number", "source"), "number")
    return out.select("shard", "place", "source", "doc_id", "epoch", "first", "n", "text")
