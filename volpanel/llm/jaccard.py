"""N-gram Jaccard join by prefix trees.

A document's set is that of its distinct 5-word shingles; documents link when their sets' Jaccard similarity is at least
0.75. Documents of equal sets form a class from the start (one small row each, met by partial aggregation).

1. All classes' shingles are counted over the whole corpus (see jaccard_postings). Shingles of one class only can be in no
   intersection; the rest of each set is kept in one global order, the rarest first. A set of which less than 75 % is shared
   links with nothing.
2. Of sets that link, the rarest quarter (and one) must share a shingle: sets that share one there form a block.
3. Every set joins the set of smallest id with which it shares most blocks. Such a star is cut into bounded chunks, each with
   the centre, and each chunk's ordered sets are stored in a trie: common beginnings are one path, whose overlap with a set
   is counted once for all sets behind it, and a subtree is left as soon as the lengths that remain cannot give the overlap.
4. Blocks whose sets now are in one component are done. The others hold pairs that no star has compared: their sets of
   like size form families (sets that such blocks tie together), and all pairs of a family's bounded chunks are joined by the
   same trie.

A trie join returns only links between sets that earlier links do not already connect, so no group emits all its pairs; yet
every two sets that link end up in one component.

Defined results: null, empty and word-less texts have no shingles and link with nothing; repeated rows are one class and each
gets its result; a null doc_id is no component's name, its row gets the smallest id of its component or null; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import discard, stored
from .jaccard_postings import DOCUMENT, SET, sets_of, shared_shingles

#: Sets, and shingles, of a chunk on the average; a trie join holds two chunks.
CHUNK, CHUNK_SHINGLES = 256, 1 << 19
#: Width of a band of sizes, as a logarithm: a little over that of the ratio 4 / 3 of two linked sets' sizes.
BAND = 0.3


def least_shared(size: str) -> Column:
    """The smallest overlap that a set of this size can have with one it links to."""
    return F.ceil((3 * F.col(size)) / F.lit(4.0)).cast("int")


def ordered_sets(found: DataFrame) -> DataFrame:
    """(set_id, size, tokens): shared shingles in the global order, of the sets that may link."""
    return sets_of(found).where(F.size("tokens") >= least_shared("size"))


class Trie:
    """Ordered token arrays, sorted; a node is a range of them with the stretch of tokens that all have in common there."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[int]) -> None:
        self.order = sorted(range(len(tokens)), key=lambda i: tokens[i].astype(">i8").tobytes())
        self.seqs = [tokens[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order])
        self.lengths = np.array([len(s) for s in self.seqs])
        self.common = np.array([self._shared(a, b) for a, b in zip(self.seqs, self.seqs[1:], strict=False)], np.int64)
        self.root = self._node(0, len(self.seqs), 0)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _node(self, lo: int, hi: int, start: int) -> tuple:
        """(lo, stretch, end, least size, largest size, longest array, children)."""
        end = int(self.common[lo : hi - 1].min()) if hi - lo > 1 else int(self.lengths[lo])
        children = []
        if hi - lo > 1:
            cuts = [lo, *(i + 1 for i in range(lo, hi - 1) if self.common[i] == end), hi]
            children = [self._node(a, b, end) for a, b in zip(cuts, cuts[1:], strict=False)]
        return lo, self.seqs[lo][start:end], end, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.lengths[lo:hi].max()), children

    def links(self, tokens: np.ndarray, size: int) -> Iterator[int]:
        """Numbers of the stored sets that link with the given one (itself included if it is stored)."""
        todo = [(self.root, 0)]
        while todo:
            (lo, stretch, end, least, largest, longest, children), overlap = todo.pop()
            least = max(least, -(-3 * size // 4))
            if least > largest or 3 * largest > 4 * size and 3 * least > 4 * size:
                continue
            left = len(tokens)
            if len(stretch):
                at = np.searchsorted(tokens, stretch)
                overlap += int((tokens[np.minimum(at, len(tokens) - 1)] == stretch).sum())
                left = len(tokens) - int(np.searchsorted(tokens, stretch[-1], "right"))
            if 7 * (overlap + min(left, longest - end)) < 3 * (size + least):
                continue
            if children:
                todo += [(child, overlap) for child in children]
            elif 7 * overlap >= 3 * (size + int(self.sizes[lo])):
                yield self.order[lo]


def trie_links(left: list[int], right: list[int], ids: np.ndarray, sizes: list[int], tokens: list[np.ndarray], groups: list[int]) -> list[tuple[int, int]]:
    """What links between the numbered sets of left and right connect beyond groups and earlier links, as stars (set, smallest set)."""
    parent: dict[int, int] = {}

    def top(g: int) -> int:
        while parent.get(g, g) != g:
            g = parent[g]
        return g

    apart = len({groups[i] for i in (*left, *right)})
    trie = Trie([tokens[i] for i in right], [sizes[i] for i in right])
    linked: dict[int, int] = {}

    def first(i: int) -> int:
        while linked.get(i, i) != i:
            i = linked[i]
        return i

    for i in left:
        if apart < 2:
            break
        for j in trie.links(tokens[i], sizes[i]):
            j = right[j]
            a, b = top(groups[i]), top(groups[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                apart -= 1
                x, y = sorted((first(i), first(j)), key=lambda k: ids[k])
                linked[y] = linked[x] = x
                linked.setdefault(i, x)
                linked.setdefault(j, x)
    return [(int(ids[i]), int(ids[first(i)])) for i in linked]


def _chunk_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Trie join of the rows of side 0 with those of side 1; side 2 stands on both."""
    rows = rows.drop_duplicates(["set_id", "side"]).reset_index(drop=True)
    side, tokens = rows["side"].to_numpy(), rows["tokens"].tolist()
    left, right = np.flatnonzero(side != 1).tolist(), np.flatnonzero(side != 0).tolist()
    found = trie_links(left, right, rows["set_id"].to_numpy(), rows["size"].tolist(), tokens, rows["part"].tolist()) if left and right else []
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def blocks_of(ordered: DataFrame) -> DataFrame:
    """(token, set_id, size): shared shingles among the rarest of each set, of which linked sets have one in common."""
    prefix = F.col("size") - least_shared("size") + 1 - (F.col("size") - F.size("tokens"))
    return ordered.select(F.explode(F.slice("tokens", 1, prefix)).alias("token"), "set_id", "size")


def chunks_of() -> Column:
    """Chunks of a group of (set_id, size), bounded by sets and by shingles."""
    return F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.col("size").cast("long")) / CHUNK_SHINGLES)).alias("chunks")


def star_links(ordered: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (a, b) found around the centres that most blocks suggest."""
    centres = stored(blocks.groupBy("token").agg(F.min("set_id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n"), "centres")
    votes = blocks.join(centres, "token").where("set_id <> centre").groupBy("set_id", "centre").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    best = stored(votes.groupBy("set_id").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"), F.max("size").alias("size")), "best")
    chunks = stored(best.groupBy("centre").agg(chunks_of()), "chunks")
    members = best.join(chunks, "centre").select("set_id", "centre", F.pmod(F.xxhash64("set_id"), F.col("chunks")).alias("chunk"))
    centred = chunks.select(F.col("centre").alias("set_id"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    members = stored(members.union(centred), "members")
    rows = members.join(ordered, "set_id").select("centre", "chunk", "set_id", "size", "tokens", F.lit(2).alias("side"), F.col("set_id").alias("part"))
    links = stored(rows.groupBy("centre", "chunk").applyInPandas(_chunk_links, "a long, b long"), "links")
    discard(centres, best, chunks, members)
    return links


def families(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """(set_id, size, family): sets that may link beyond their parts; a set is in two families at most.

    Sizes fall into bands, so that linked sets are in one band or in neighbouring ones. Layer k holds the bands k - 1 and k; a
    layer's sets are tied by the blocks that hold several parts of it, and families are what ties connect within one layer.
    Thus neither sets of far sizes nor those whose blocks are settled tie others together.
    """
    placed = blocks.join(parts, "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    mixed = stored(placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token"), "mixed")
    band = F.floor(F.ln(F.col("size").cast("double")) / F.lit(BAND)).cast("int")
    layered = placed.join(mixed, "token").withColumn("band", band).select("token", "set_id", "size", "part", "band", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("layer"))
    # two nodes of one number would join two families, which only adds comparisons
    layered = stored(layered.withColumn("node", F.xxhash64("layer", "set_id")), "layered")
    tied = layered.groupBy("token", "layer").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("band").alias("top"), F.min("node").alias("centre"))
    tied = stored(tied.where("lo <> hi AND top = layer").select("token", "layer", "centre"), "tied")  # pairs of the lower band alone are the layer's below
    members = layered.join(tied, ["token", "layer"])
    tops = graph.components(members.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    found = stored(members.select("node", "set_id", "size").distinct().join(tops, "node").select("set_id", "size", F.col("component").alias("family")), "families")
    discard(mixed, layered, tied, tops)
    return found


def family_links(ordered: DataFrame, family: DataFrame, parts: DataFrame) -> DataFrame:
    """Links between sets of one family and different parts (components so far)."""
    chunks = stored(family.groupBy("family").agg(chunks_of()), "chunks")
    placed = family.join(chunks, "family").select("set_id", "family", "chunks", F.pmod(F.xxhash64("set_id"), F.col("chunks")).alias("own"))
    # chunk x meets every chunk y: as the left one where x < y, as the right one where x > y, on both sides where x = y
    dealt = placed.select("set_id", "family", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).select(
        "set_id", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    )
    dealt = stored(dealt, "dealt")
    rows = dealt.join(ordered, "set_id").join(parts, "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    links = stored(rows.select("family", "i", "j", "set_id", "size", "tokens", "side", "part").groupBy("family", "i", "j").applyInPandas(_chunk_links, "a long, b long"), "links")
    discard(chunks, dealt)
    return links


def joined(docs: DataFrame, n: int = 5, mark: Column | None = None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """join_documents, and the stored tables that it reads: all others are deleted."""
    seed, docs = 0, docs.withColumn("mark", F.lit(None).cast("binary") if mark is None else mark)
    while True:  # ids are half of the digests: should two digests share one, others are drawn
        found = stored(shared_shingles(docs, seed, n), "shingles", by="kind")
        rows = found.where(F.col("kind") == DOCUMENT).select("doc_id", "n_shingles", "set_id", "digest", "mark")
        classes = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        classes = stored(classes, "classes")
        if classes.where("lo <> hi").isEmpty():
            break
        discard(found, classes)
        seed += 1
    ordered = stored(ordered_sets(found), "ordered")
    discard(found, part=f"kind={SET}")
    blocks = stored(blocks_of(ordered), "blocks")
    stars = star_links(ordered, blocks)
    part_of = lambda df: df.select(F.col("node").alias("set_id"), F.col("component").alias("part"))
    starred = graph.components(stars)
    family = families(blocks, part_of(starred))
    rest = family_links(ordered, family, part_of(starred))
    discard(ordered, blocks, family, starred)
    linked = graph.components(stars.union(rest))
    named = classes.select("set_id", "doc_id").join(part_of(linked), "set_id", "left").withColumn("part", F.coalesce("part", "set_id"))
    named = stored(named, "named")
    firsts = stored(named.groupBy("part").agg(F.min("doc_id").alias("component_id")), "firsts")
    names = stored(named.join(firsts, "part").select("set_id", "part", "component_id"), "names")
    discard(stars, rest, linked, classes, named, firsts)
    out = rows.join(names, "set_id", "left").select("doc_id", "n_shingles", "set_id", "part", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("mark").alias("digest"))
    return out, (found, names)


def join_documents(docs: DataFrame, n: int = 5, mark: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, set_id, part, component_id, digest), one row per row of docs.

    part is the component's key; component_id is the smallest doc_id reachable by links; digest is what `mark` gave of the row.
    """
    return joined(docs, n, mark)[0]


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, as the contract of op4 names them."""
    return join_documents(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, n: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs with exactly one row of each component: that of the smallest doc_id, of one id's texts that of the smallest digest.

    Null ids come last: a row without an id stays only where no row of its component has one. Of repeated rows of the kept id
    and text one stays, chosen by the hash of all columns. Texts without shingles are in no component: their rows all stay.
    Texts stay where they are while the keys of the rows that go are measured to fit into `broadcast_bytes`; beyond that they
    are shuffled to those keys.
    """
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))
    rows, read = joined(docs.select("doc_id", "text"), n, key)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
    keys = stored(rows.where("set_id IS NOT NULL").groupBy("part", "doc_id", "digest").agg(F.count("*").alias("n")), "keys")
    first = keys.groupBy("part").agg(F.min_by("digest", order).alias("first"))
    judged = stored(keys.join(first, "part").where("n > 1 OR digest <> first").select(F.col("digest").alias("__key"), (F.col("digest") == F.col("first")).alias("again")), "judged")
    discard(keys, *read)
    fits = 64 * judged.count() <= broadcast_bytes
    near = lambda df: F.broadcast(df) if fits else df
    keyed = docs.withColumn("__key", key)
    once = keyed.join(near(judged.select("__key")), "__key", "left_anti").select(docs.columns)
    many = judged.where("again").select("__key")
    if many.isEmpty():
        return once
    row = F.struct(*docs.columns)
    repeated = keyed.join(near(many), "__key", "left_semi").groupBy("__key").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    return once.union(repeated.select("row.*"))
