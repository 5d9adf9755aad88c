"""Embedding near-dedup by product quantisation.

1. Vectors of equal components and label form a class, which goes through the rest once.
2. Coarse centroids, and codewords for the subspaces of residuals, come from a bounded sample (`sample_rows`, 8192 by
   default) by k-means in numpy; every vector is then indexed: its nearest centroid's list, its residual's codes, and how far
   the coded vector lies from the true one.
3. Every vector also queries. Two vectors that link lie at most r = sqrt(2 - 2 threshold) apart, and what tells the list c
   from q's own list o, d(., c)^2 - d(., o)^2, changes by at most 2 r |c - o| over that distance and is not positive for
   members of c. So q probes every list for which it is at most 2 r |c - o| at q, which loses no link at any number of
   lists. No number of probes or candidates is capped. The rule holds seen from either end of a link, so a pair in two cells
   (below) is compared in the lower one only, and counted for both of its vectors.
4. In a list, a query's table of squared distances to all codewords gives its distance to every coded vector by look-ups.
   Less the stored error of the code, that is a lower bound of the true distance, so nothing that links is lost here; what
   stays is ranked by the exact cosine in double precision. Lists of fewer vectors than codewords skip the table.

Vectors travel to cells, runs of neighbouring lists of which a label has as many as its rows fill chunks. A label's cell is
cut into bounded chunks of members and of queries; each pair of chunks is one task's work, which returns each vector's
number of links and a forest of the links, never the links themselves.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, null labels and null ids link
with nothing; vectors of another length than the sample's are compared exactly with those of their own length; equal rows
are one vector and each gets its result; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import stored

#: Members, and queries, of a chunk on the average; members of a label's cell.
CHUNK = 2048
#: Pairs of vectors whose cosines are computed at a time.
PAIRS = 65536


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8192
    rows_a_list: int = 256
    most_lists: int = 1024
    subspaces: int = 8
    codewords: int = 64
    rounds: int = 8
    threshold: float = 0.98
    seed: int = 5


@dataclass
class Index:
    """centroids: lists x dim; order: the lists, neighbours together; words: subspaces x codewords x dim / subspaces."""

    dim: int
    centroids: np.ndarray
    order: np.ndarray
    words: np.ndarray
    settings: Settings

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows padded and cut into subspaces."""
        m, width = self.words.shape[0], self.words.shape[2]
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width)

    def code(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the distances of the coded from the true ones."""
        cut = self.parts(residual)
        codes = np.stack([_nearest(cut[:, j], self.words[j])[0] for j in range(cut.shape[1])], 1).astype(np.uint8)
        coded = np.stack([self.words[j][codes[:, j]] for j in range(cut.shape[1])], 1)
        return codes, np.sqrt(((cut - coded) ** 2).sum((1, 2)))

    @property
    def radius(self) -> float:
        """Two vectors that link lie no further apart."""
        return float(np.sqrt(2 - 2 * self.settings.threshold)) + 1e-6

    def probes(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether vectors of the lists `own` may link with members of the given lists: rows x lists."""
        to_own = ((x - self.centroids[own]) ** 2).sum(1)
        apart = np.sqrt(_nearest(self.centroids, self.centroids[lists])[1])
        return _nearest(x, self.centroids[lists])[1] - to_own[:, None] <= 2 * self.radius * apart[own] + 1e-6

    def cells(self, cells: int) -> np.ndarray:
        """The cell of each list when the lists, in an order that keeps neighbours together, are cut into so many."""
        return np.argsort(self.order) * cells // len(self.order)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, queries x coded vectors, by table look-up."""
        cut, total = self.parts(residual), np.zeros((len(residual), len(codes)))
        for j in range(cut.shape[1]):
            table = ((cut[:, j, None, :] - self.words[j][None]) ** 2).sum(2)
            total += table[:, codes[:, j]]
        return np.sqrt(total)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))
    return d.argmin(1), d


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def _in_order(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """ids of rows, halved again and again across their longest direction."""
    if len(ids) < 2:
        return ids
    y = x[ids] - x[ids].mean(0)
    ids, half = ids[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")], len(ids) // 2
    return np.concatenate([_in_order(x, ids[:half]), _in_order(x, ids[half:])])


def _unit(rows: list) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(classes: DataFrame, rows: int, s: Settings = Settings()) -> Index | None:
    """An index for vectors as long as most of the sample; None without vectors."""
    sample = classes.select("embedding", "class").orderBy(F.xxhash64("class"), "class").limit(s.sample_rows).toPandas()
    if sample.empty:
        return None
    dim = int(sample["embedding"].map(len).mode().iloc[0])
    x, rng = _unit([v for v in sample["embedding"] if len(v) == dim]), np.random.default_rng(s.seed)
    lists = max(1, min(s.most_lists, rows // s.rows_a_list, len(x) // 8))
    centroids = _k_means(x, lists, s.rounds, rng)
    width = -(-dim // s.subspaces)
    order = _in_order(centroids, np.arange(lists))
    index = Index(dim, centroids, order, np.zeros((s.subspaces, 1, width)), s)
    cut = index.parts(x - centroids[_nearest(x, centroids)[0]])
    words = [_k_means(cut[:, j], min(s.codewords, len(x)), s.rounds, rng) for j in range(s.subspaces)]
    return Index(dim, centroids, order, np.stack(words), s)


def usable() -> Column:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _indexed(classes: DataFrame, index: Index) -> DataFrame:
    """Members and queries: (label, cell, list, side, class, n, embedding, codes, error).

    list is the vector's own one; side 0 is a member, 1 its query in its own cell, 2 its query in a lower cell.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            other = batch["embedding"].map(len) != index.dim
            for far, part in batch.groupby(other):
                if far:  # of another length: one list and cell for each length
                    lists = -part["embedding"].map(len).to_numpy(np.int64) - 1
                    for side in (0, 1):
                        yield part.assign(cell=lists, list=lists, side=side, codes=b"", error=0.0)[columns]
                    continue
                for cells, same in part.groupby("cells"):
                    x, cell_of = _unit(same["embedding"].tolist()), index.cells(int(cells))
                    own = _nearest(x, index.centroids)[0]
                    codes, error = index.code(x - index.centroids[own])
                    placed = same.assign(cell=cell_of[own], list=own, codes=b"", error=0.0)
                    yield placed.assign(side=0, codes=[c.tobytes() for c in codes], error=error)[columns]
                    yield placed.assign(side=1)[columns]
                    met = np.zeros((len(x), int(cells)), bool)
                    query, probe = np.nonzero(index.probes(x, own, np.arange(len(cell_of))))
                    met[query, cell_of[probe]] = True
                    query, cell = np.nonzero(met & (np.arange(int(cells)) < cell_of[own][:, None]))
                    yield placed.iloc[query].assign(cell=cell, side=2)[columns]

    columns = ["label", "cell", "list", "side", "class", "n", "embedding", "codes", "error"]
    labels = stored(classes.groupBy("label").agg(F.least(F.lit(len(index.order)), F.ceil(F.count("*") / CHUNK)).cast("long").alias("cells")), "labels")
    return (
        classes.join(labels, "label")
        .select("label", "class", "n", "embedding", "cells")
        .mapInPandas(rows, "label long, cell long, list long, side int, class binary, n long, embedding array<double>, codes binary, error double")
    )


def _links(index: Index, q: np.ndarray, own: np.ndarray, a: np.ndarray, x: np.ndarray, members: pd.DataFrame, b: np.ndarray) -> np.ndarray:
    """Whether queries q, of lists own and classes a, and members x of classes b link: queries x members."""
    link = np.zeros((len(q), len(x)), bool)
    for number, m in members.reset_index(drop=True).groupby("list").indices.items():
        met = np.nonzero(index.probes(q, own, np.array([number]))[:, 0])[0] if number >= 0 else np.arange(len(q))
        coded = number >= 0 and len(m) > index.words.shape[1]
        if coded:
            codes, error = np.frombuffer(b"".join(members["codes"].iloc[m]), np.uint8).reshape(len(m), -1), members["error"].to_numpy()[m]
        step = max(1, PAIRS // len(m))
        for k in range(0, len(met), step):
            some = met[k : k + step]
            if coded:
                maybe = index.distances(q[some] - index.centroids[number], codes) - error <= index.radius
            else:
                maybe = q[some] @ x[m].T >= index.settings.threshold - 1e-9
            i, j = np.nonzero(maybe)
            i, j = some[i], m[j]
            for at in range(0, len(i), PAIRS):
                u, v = i[at : at + PAIRS], j[at : at + PAIRS]
                link[u, v] = (a[u] != b[v]) & (np.einsum("ij,ij->i", q[u], x[v]) >= index.settings.threshold)
    return link


def _lowest(link: np.ndarray, top: np.ndarray, big: int) -> np.ndarray:
    """The smallest top that each row of link leads to."""
    return np.concatenate([np.where(link[k : k + 256], top, np.int32(big)).min(1) for k in range(0, len(link), 256)])


def _chunk_links(index: Index) -> object:
    def found(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        members, queries = rows[rows["side"] == 0], rows[rows["side"] > 0]
        empty = pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "n": pd.Series(dtype=np.int64)})
        if members.empty or queries.empty:
            return empty
        x, q = _unit(members["embedding"].tolist()), _unit(queries["embedding"].tolist())
        a, b = members["class"].to_numpy(), queries["class"].to_numpy()
        link = _links(index, q, queries["list"].to_numpy(), b, x, members, a)
        if not link.any():
            return empty
        # a pair within a cell is met from both ends, one of two cells from the higher one alone
        visits = (queries["side"] == 2).to_numpy()
        n_q, n_x = link @ members["n"].to_numpy(np.int64), queries["n"].to_numpy(np.int64)[visits] @ link[visits]
        # the smallest number that links lead to, over and over, until it stays: a forest of as few edges as there are vectors
        names, numbers = np.unique(np.concatenate([b, a]), return_inverse=True)
        numbers, big = numbers.astype(np.int32), len(names)
        top_q, top_x = numbers[: len(b)], numbers[len(b) :]
        while True:
            low_q = np.minimum(top_q, _lowest(link, top_x, big))
            low_x = np.minimum(top_x, _lowest(link.T, low_q, big))
            if (low_q == top_q).all() and (low_x == top_x).all():
                break
            top_q, top_x = low_q, low_x
        on_q, on_x = link.any(1), link.any(0)
        return pd.DataFrame({"a": np.concatenate([b[on_q], a[on_x]]), "b": names[np.concatenate([top_q[on_q], top_x[on_x]])], "n": np.concatenate([n_q[on_q], n_x[on_x]])})

    return found


def links(classes: DataFrame, index: Index) -> DataFrame:
    """(a, b, n): edges of a forest of the links, and numbers of links to add up by a."""
    rows = stored(_indexed(classes, index), "index")
    is_member = F.col("side") == 0
    count = lambda which: F.ceil(F.count(F.when(which, 1)) / CHUNK)
    sizes = rows.groupBy("label", "cell").agg(count(is_member).alias("members"), count(~is_member).alias("queries")).where("members > 0 AND queries > 0")
    placed = rows.join(stored(sizes, "chunks"), ["label", "cell"])
    own, up_to = F.pmod(F.xxhash64("class"), F.when(is_member, F.col("members")).otherwise(F.col("queries"))), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.when(is_member, up_to("queries")).otherwise(up_to("members"))))
    i, j = F.when(is_member, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(is_member, F.col("other")).otherwise(F.col("own")).alias("j")
    dealt = placed.select("label", "cell", i, j, "list", "side", "class", "n", "embedding", "codes", "error")
    return dealt.groupBy("label", "cell", "i", "j").applyInPandas(_chunk_links(index), "a binary, b binary, n long")


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label)."""
    good = usable()
    key = F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.transform("embedding", lambda v: (v + 0.0).cast("string")))))
    rows = stored(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"), F.when(good, key).alias("class")), "vectors")
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = stored(classes, "classes")
    index = fit(classes, classes.count(), settings)
    if index is None:
        named = rows.select("class", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")).limit(0)
    else:
        found = stored(links(classes, index), "links")
        counts = stored(found.groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "class"), "counts")
        parts = graph.components(found.select("a", "b")).select(F.col("node").alias("class"), F.col("component").alias("part"))
        whole = classes.select("class", "vec_id", "n").join(counts, "class", "left").join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
        whole = stored(whole, "whole")
        firsts = stored(whole.groupBy("part").agg(F.min("vec_id").alias("component_id")), "firsts")
        named = whole.join(firsts, "part").select("class", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    named = stored(named, "named")
    out = rows.select("vec_id", "class").join(named, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
