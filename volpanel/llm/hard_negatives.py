"""Hard-negative mining by summaries of vector segments.

A vector is cut into SEGMENTS runs of components; stored beside it are each run's mean and deviation. For two vectors, a run's
inner product lies within its length times the product of the means, plus or minus the product of the deviations (both taken
over the run and scaled by its length), so the sums over all runs bound the score. Two neighbouring runs' summaries give that
of the run they make together: bounds begin with one run, the whole vector, and are refined run by halves only for rows that some
anchor still needs; what is left is scored exactly.

Anchors are the query set, met in blocks. Rows, packed by label, are dealt into parts and anchors into groups bounded in
number; a unit is a part and a group. A task takes a unit's anchors first and then its rows as a stream, so it holds a group,
a block of rows and the best few of each anchor. Units return the best few, merged by anchor; the number of parts
stops growing where groups begin to multiply, so that what is returned grows with the anchors. Two passes: rows of the anchor's label give
the positives; then rows of other labels give each positive's negatives, where an anchor needs only scores between its least
and largest positive's bounds, and none below the worst that it already holds.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; of several rows of one id
the smallest label and vector counts, also as an anchor; vectors are compared with those of their own length; an empty
table gives an empty table; columns besides vec_id, label and embedding are ignored. Scores are exact integers; those beyond 62 bits
are held at that bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Runs of a vector, a power of two.
SEGMENTS = 8
#: Anchors of a group, rows of a part, on the average; anchors and rows scored at a time.
GROUP, PART, ANCHORS, ROWS = 16_384, 4096, 256, 2048
#: Scores beyond this are held there.
MOST = 1 << 62
#: Relative room that bounds leave for rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    every: int = 100
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this many hundredths of the positive's.
    least_share: int = 80


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, one an id."""
    x = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = embeddings.select("vec_id", "label", x.cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(~F.exists(x, odd))
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next label, as the contract of op11 has it."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int"))


def summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's runs, scaled so that products of means and of deviations add up to scores."""
    width = max(1, -(-values.shape[1] // SEGMENTS))
    runs = np.zeros((len(values), SEGMENTS * width))
    runs[:, : values.shape[1]] = values
    runs = runs.reshape(len(values), SEGMENTS, width)
    means = runs.mean(2)
    return means * np.sqrt(width), np.sqrt(((runs - means[:, :, None]) ** 2).sum(2))


def levels(means: np.ndarray, deviations: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summaries from whole vectors to the stored runs."""
    found = [(means, deviations)]
    while found[-1][0].shape[1] > 1:
        m, d = found[-1]
        a, b = m[:, ::2], m[:, 1::2]
        found.append(((a + b) / np.sqrt(2), np.sqrt(d[:, ::2] ** 2 + d[:, 1::2] ** 2 + (a - b) ** 2 / 2)))
    return found[::-1]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return np.array([[max(-MOST, min(MOST, s)) for s in row] for row in whole(a) @ whole(b).T], np.int64).reshape(len(a), len(b))


class Block:
    """Rows side by side: ids, labels, whole-number components, summaries from coarse to fine."""

    def __init__(self, parts: list[dict[str, np.ndarray]]) -> None:
        for name in parts[0]:
            setattr(self, name, np.concatenate([p[name] for p in parts]))
        self.values = self.values.astype(np.float64)
        self.levels = levels(self.means, self.deviations)

    def __len__(self) -> int:
        return len(self.ids)


def needed(anchors: Block, at: slice, rows: Block, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, mask): rows whose score with some anchor can lie between least and most, and which anchors these are."""
    columns, alive = np.arange(len(rows)), np.ones((len(least), len(rows)), bool)
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True):
        middle, reach = am[at] @ rm[columns].T, ad[at] @ rd[columns].T
        room = SLACK * (np.abs(am[at]) @ np.abs(rm[columns]).T + reach) + 1e-3
        alive = alive & (middle + reach + room >= least[:, None]) & (middle - reach - room <= most[:, None])
        some = alive.any(0)
        columns, alive = columns[some], alive[:, some]
        if not len(columns):
            break
    return columns, alive


class Best:
    """Of numbered groups the few rows of the highest scores, ties by the smaller id."""

    def __init__(self, groups: int, few: int) -> None:
        self.few = few
        self.scores, self.ids = np.full((groups, few), -MOST - 1), np.full((groups, few), np.iinfo(np.int64).max)

    def offer(self, first: int, found: np.ndarray, mask: np.ndarray, ids: np.ndarray, step: int = 1) -> None:
        """found: scores of groups first, first + step ... (rows) with the ids (columns), where mask holds."""
        groups = first + step * np.arange(len(found))
        mask = mask & (found >= self.scores[groups, -1][:, None])
        if mask.sum() > 8 * self.few * len(found) and found.shape[1] > self.few:
            worth = np.where(mask, found, -MOST - 1)
            mask &= found >= np.partition(worth, -self.few, 1)[:, -self.few][:, None]
        r, c = np.nonzero(mask)
        if not len(r):
            return
        touched = np.unique(groups[r])
        g = np.concatenate([groups[r], np.repeat(touched, self.few)])
        s, i = np.concatenate([found[r, c], self.scores[touched].ravel()]), np.concatenate([ids[c], self.ids[touched].ravel()])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        keep = rank < self.few
        self.scores[g[keep], rank[keep]], self.ids[g[keep], rank[keep]] = s[keep], i[keep]

    def of(self, group: int) -> tuple[list[int], list[int]]:
        held = self.scores[group] >= -MOST
        return self.scores[group][held].tolist(), self.ids[group][held].tolist()


_CHUNK = "anchor boolean, dim int, label int, n int, data binary"


def packed(rows: DataFrame, anchor: bool, settings: Settings) -> DataFrame:
    """Chunks of rows of one length and label: ids, whole-number components, summaries; anchors may bring positives and their scores."""
    known = "positives" in rows.columns

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("label").to_pylist(), strict=True))
            out = []
            for dim, label in sorted(set(keys)):
                part = batch.take(pa.array([i for i, k in enumerate(keys) if k == (dim, label)]))
                values = np.floor(256.0 * part.column("embedding").flatten().to_numpy().reshape(part.num_rows, dim))
                means, deviations = summary(values)
                if np.abs(values).max(initial=0) < 1 << 15:
                    values = values.astype(np.int16)
                arrays = {"ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy(), "values": values, "means": means, "deviations": deviations}
                if known:
                    held, ids = (np.full((part.num_rows, settings.positives), x) for x in (-MOST - 1, -1))
                    for i, (s, p) in enumerate(zip(part.column("scores").to_pylist(), part.column("positives").to_pylist(), strict=True)):
                        held[i, : len(s)], ids[i, : len(p)] = s, p
                    arrays |= {"scores": held, "positives": ids}
                out.append((anchor, dim, label, part.num_rows, pickle.dumps(arrays, 5)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["anchor", "dim", "label", "n", "data"])

    return rows.withColumn("dim", F.size("embedding")).mapInArrow(chunks, _CHUNK)


def in_units(chunks: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Chunks of anchors and rows dealt into units, of which each task has the anchors first."""
    both = chunks.union(anchors)
    sizes = both.groupBy(by).agg(F.sum(F.when(F.col("anchor"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("anchor"), 0).otherwise(F.col("n"))).alias("r")).where("a > 0")
    sizes = sizes.withColumn("groups", F.ceil(F.col("a") / GROUP)).withColumn("parts", F.ceil(F.ceil(F.col("r") / PART) / F.col("groups")))
    sizes = stored(sizes.select(*by, "groups", "parts"), "units")
    units = sizes.agg(F.sum(F.col("groups") * F.col("parts"))).first()[0] or 1
    own = lambda n: F.array(F.pmod(F.xxhash64("data"), F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    dealt = both.join(sizes, by)
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("anchor"), every("parts")).otherwise(own("parts"))))
    dealt = dealt.withColumn("group", F.explode(F.when(F.col("anchor"), own("groups")).otherwise(every("groups"))))
    unit = [*by, "part", "group"]
    dealt = dealt.select(F.struct(*unit).alias("unit"), "anchor", "data")
    return dealt.repartition(min(2 * units, 20_000), "unit").sortWithinPartitions("unit", F.col("anchor").desc()).select(F.to_json("unit").alias("unit"), "anchor", "data")


def mined(units: DataFrame, score: Callable[[Block, slice, Block, Best], None], few: int, of: Callable[[Block], int], rows_of: Callable[[Block, Best], list[tuple]], schema: str, kinds: tuple) -> DataFrame:
    """Every unit's best rows: score offers a block of rows to a slice of anchors; rows_of turns what was found into rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, heads, rows, anchors, best = None, [], [], None, None

        def meet() -> None:
            nonlocal anchors, best, heads, rows
            if heads:
                anchors, heads = Block(heads), []
                best = Best(len(anchors) * of(anchors), few)
            if rows and anchors is not None:
                block = Block(rows)
                for i in range(0, len(anchors), ANCHORS):
                    score(anchors, slice(i, min(i + ANCHORS, len(anchors))), block, best)
            rows = []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal anchors
            meet()
            out = rows_of(anchors, best) if anchors is not None else []
            anchors = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for u, anchor, data in zip(*(batch.column(c).to_pylist() for c in ("unit", "anchor", "data")), strict=True):
                if u != unit:
                    yield from done()
                    unit = u
                (heads if anchor else rows).append(pickle.loads(data))
                if sum(len(r["ids"]) for r in rows) >= ROWS:
                    meet()
        yield from done()

    return units.mapInArrow(scan, schema)


_LONGS = pa.list_(pa.int64())


def positives(chunks: DataFrame, anchors: DataFrame, settings: Settings) -> DataFrame:
    """(vec_id, positives, scores) of the anchors that have a positive: rows of their label, the best first."""

    def score(a: Block, at: slice, rows: Block, best: Best) -> None:
        columns, alive = needed(a, at, rows, best.scores[at, -1].astype(np.float64), np.full(at.stop - at.start, np.inf))
        if len(columns):
            best.offer(at.start, scores(a.values[at], rows.values[columns]), alive & (a.ids[at][:, None] != rows.ids[columns]), rows.ids[columns])

    def found(a: Block, best: Best) -> list[tuple]:
        return [(int(x), [-s for s in s_], i_) for k, x in enumerate(a.ids) for s_, i_ in [best.of(k)] if i_]

    best = mined(in_units(chunks, anchors, ["dim", "label"]), score, settings.positives, lambda a: 1, found, "vec_id long, worse array<long>, ids array<long>", (pa.int64(), _LONGS, _LONGS))
    merged = best.groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("worse", "ids")))), 1, settings.positives).alias("best"))
    return merged.select("vec_id", F.col("best.ids").alias("positives"), F.transform("best.worse", lambda x: -x).alias("scores"))


def negatives(chunks: DataFrame, anchors: DataFrame, settings: Settings) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for packed anchors that bring their positives."""
    k_all, share = settings.positives, settings.least_share

    def score(a: Block, at: slice, rows: Block, best: Best) -> None:
        top = a.scores[at]
        some = top >= -MOST
        # floor of share / 100 of a score lies within one of the least score
        low = np.where(some, np.maximum(top * (share / 100) * (1 - 1e-12) - 1, best.scores.reshape(-1, k_all, best.few)[at, :, -1]), np.inf)
        columns, alive = needed(a, at, rows, low.min(1), np.where(some, top, -np.inf).max(1))
        if not len(columns):
            return
        found = scores(a.values[at], rows.values[columns])
        alive &= a.labels[at][:, None] != rows.labels[columns]
        for k in range(k_all):
            t = top[:, k][:, None]
            small = np.abs(t).max(initial=0) < MOST // 128
            enough = 100 * found >= share * t if small and np.abs(found).max(initial=0) < MOST // 128 else found.astype(object) * 100 >= t.astype(object) * share
            best.offer(at.start * k_all + k, found, alive & some[:, k][:, None] & enough.astype(bool) & (found <= t), rows.ids[columns], k_all)

    def rows_of(a: Block, best: Best) -> list[tuple]:
        out = []
        for i, x in enumerate(a.ids):
            for k in range(k_all):
                s, ids = best.of(i * k_all + k)
                if ids:
                    out.append((int(x), int(a.positives[i, k]), int(a.scores[i, k]), [-v for v in s], ids))
        return out

    best = mined(in_units(chunks, anchors, ["dim"]), score, settings.negatives, lambda a: k_all, rows_of, "anchor_id long, positive_id long, positive_score long, worse array<long>, ids array<long>", (pa.int64(), pa.int64(), pa.int64(), _LONGS, _LONGS))
    merged = best.groupBy("anchor_id", "positive_id", "positive_score").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("worse", "ids")))), 1, settings.negatives).alias("best"))
    ranked = merged.select("*", F.posexplode("best").alias("at", "row"))
    return ranked.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.ids").alias("negative_id"), "positive_score", (-F.col("row.worse")).alias("negative_score"))


def mine(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hard negatives of every anchor and positive among rows (vec_id, label, embedding) that take part."""
    heads = rows.where(F.col("vec_id") % settings.every == 0)
    chunks = stored(packed(rows, False, settings), "chunks")
    found = stored(positives(chunks, stored(packed(heads, True, settings), "anchors"), settings), "positives")
    return negatives(chunks, stored(packed(heads.join(found, "vec_id"), True, settings), "anchors"), settings)
