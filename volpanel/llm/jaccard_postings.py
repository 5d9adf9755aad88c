"""Which shingles sets share, from texts that are hashed once and shingles that travel packed.

1. A task hashes its texts and holds the shingles of sets that it has not met, HELD at a time. It sorts what it holds and sends
   every bucket (a range of shingle numbers) one packed row, some 6 bytes a shingle. A shingle that more than FREQUENT of the
   held sets have goes to its bucket as one count.
2. A bucket counts its shingles and answers each holder with one packed row: those shingles of its sets that occur more than
   once, and their counts. A shingle that a third of all sets have loads its bucket with a few entries of each holder.
3. A holder's answers meet what it kept back: each of its sets gets its shared shingles in the global order.

Buckets follow the bytes of the texts. One pass deals to FAN buckets at most; beyond them a second pass cuts the first one's
ranges further, so that packed rows stay long at any size. No group is larger than a bucket or what one holder held.

Numbers of shingles have 48 bits and are not verified: of a set's 1,000 shingles one meets the number of another among 10^9
distinct shingles with a chance of 0.4 %, which moves an overlap by one in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steady
from .jaccard_sets import FACTOR, Words, digest, shingles

#: Bits of a shingle's number; above them stands its count, up to MOST, so that numbers sort in the global order.
BITS, MOST = 48, 32767
#: Shingles that a task holds at once; sets, and documents.
HELD, HELD_ROWS = 1 << 20, 60_000
#: Held sets that may send a shingle one by one.
FREQUENT = 16
#: Bytes of text for each bucket; buckets of one pass.
BUCKET_BYTES, FAN = 8 << 20, 4096
#: Kinds of rows: a document, shingles on their way to a bucket or back, what a holder kept, a set with its shared shingles.
DOCUMENT, SHINGLES, KEPT, SET = range(4)

_ARROW = {"dest": pa.int64(), "home": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "n_shingles": pa.int64(), "set_id": pa.int64(), "digest": pa.binary(), "mark": pa.binary(), "packed": pa.binary(), "tokens": pa.list_(pa.int64())}
_SQL = {"dest": "long", "home": "long", "kind": "int", "doc_id": "long", "n_shingles": "long", "set_id": "long", "digest": "binary", "mark": "binary", "packed": "binary", "tokens": "array<long>"}
#: Columns on the way to buckets, back to the holders, and of the result. home is the holder's number.
TO_BUCKETS = ["dest", "home", "kind", "doc_id", "n_shingles", "set_id", "digest", "mark", "packed"]
TO_HOLDERS = TO_BUCKETS[1:]
RESULT = ["kind", "doc_id", "n_shingles", "set_id", "digest", "mark", "tokens"]


def schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_SQL[n]}" for n in names)


def _rows(names: list[str], kind: int, n: int, **columns: object) -> pa.RecordBatch:
    """A batch of one kind; columns not given are null."""
    given = columns | {"kind": np.full(n, kind, np.int32)}
    arrays = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], _ARROW[c]) if c in given else pa.nulls(n, _ARROW[c]) for c in names]
    return pa.record_batch([a.cast(_ARROW[c]) for a, c in zip(arrays, names, strict=True)], pa.schema([(c, _ARROW[c]) for c in names]))


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    at, found = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(data, np.int64, len(kinds)), strict=True):
        found.append(np.frombuffer(data, kind, n, at))
        at += found[-1].nbytes
    return found


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


class Postings:
    """Shingles with the holders and the numbers of the sets that have them; frequent shingles with holders and counts."""

    KINDS = (np.uint16, np.uint32, np.uint16, np.uint16, np.int64, np.int64, np.uint16, np.int64)

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = self.homes = 0

    def add(self, tokens: np.ndarray, home: np.ndarray, own: np.ndarray, homes: np.ndarray, often: np.ndarray, often_home: np.ndarray, counts: np.ndarray) -> None:
        """home and often_home are places in homes, the holders' numbers."""
        self.parts.append((tokens, home + self.homes, own, homes, often, often_home + self.homes, counts))
        self.n += len(tokens) + len(often)
        self.homes += len(homes)

    def add_packed(self, data: bytes) -> None:
        high, low, home, own, homes, often, often_home, counts = _unpacked(data, *self.KINDS)
        self.add(high.astype(np.int64) << 32 | low, home.astype(np.int64), own, homes, often, often_home.astype(np.int64), counts)

    @property
    def full(self) -> bool:
        return self.n >= HELD or self.homes >= HELD_ROWS

    def taken(self) -> tuple[np.ndarray, ...]:
        """As add() takes them, by shingle. Holds nothing afterwards."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 7
        tokens, home, own, homes, often, often_home, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        order, order_often = np.argsort(tokens), np.argsort(often)
        return tokens[order], home[order], own[order], homes, often[order_often], often_home[order_often], counts[order_often]


def _sent(postings: tuple[np.ndarray, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted postings, one packed row per bucket."""
    tokens, home, own, homes, often, often_home, counts = postings
    to, to_often = ((x >> 24) * buckets >> 24 for x in (tokens, often))
    dests = np.union1d(to, to_often)
    rows = []
    for i, j, k, m in zip(*(np.searchsorted(x, dests, side) for x in (to, to_often) for side in ("left", "right")), strict=True):
        names, place = np.unique(np.append(home[i:j], often_home[k:m]), return_inverse=True) if len(homes) > 1 else (np.zeros(1, np.int64), np.zeros(j - i + m - k, np.int64))
        place = place.astype(np.uint16)
        rows.append(_packed((tokens[i:j] >> 32).astype(np.uint16), tokens[i:j].astype(np.uint32), place[: j - i], own[i:j].astype(np.uint16), homes[names], often[k:m], place[j - i :], counts[k:m]))
    if rows:
        yield _rows(TO_BUCKETS, SHINGLES, len(rows), dest=dests, packed=rows)


def bucket_of(buckets: int, home: np.ndarray, doc_id: np.ndarray | int = 0, set_id: np.ndarray | int = 0) -> np.ndarray:
    """The bucket in which a row that is not packed travels: the row alone decides, so that a task run again sends it where it went before."""
    mixed = np.asarray(home).astype(np.uint64) * FACTOR
    for part in (doc_id, set_id):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ np.asarray(part).astype(np.uint64)) * FACTOR
    return ((mixed >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


def _whole(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


class Holder:
    """What a task holds of its sets until it is sent."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.home = (TaskContext.get().partitionId() << 32) - 1
        self._next()

    def _next(self) -> None:
        self.home += 1
        self.tokens, self.ids, self.sizes, self.n, self.docs = [], [], [], 0, 0

    def add(self, set_id: int, hashes: np.ndarray) -> None:
        self.tokens.append(np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int64)))
        self.ids.append(set_id)
        self.sizes.append(len(hashes))
        self.n += len(self.tokens[-1])

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            tokens = np.concatenate(self.tokens)
            own = np.repeat(np.arange(len(self.ids)), [len(t) for t in self.tokens])
            order = np.argsort(tokens)
            tokens, own = tokens[order], own[order]
            starts = _starts(tokens)
            runs = np.diff(np.append(starts, len(tokens)))
            often = runs > FREQUENT
            back = np.repeat(often, runs)
            kept = _packed(np.array(self.ids, np.int64), np.array(self.sizes, np.int32), own[back].astype(np.uint16), tokens[back])
            yield _rows(TO_BUCKETS, KEPT, 1, dest=bucket_of(self.buckets, np.array([self.home])), home=[self.home], packed=[kept])
            zeros = lambda n: np.zeros(n, np.int64)
            frequent, tokens, own = tokens[starts[often]], tokens[~back], own[~back]
            yield from _sent((tokens, zeros(len(tokens)), own, np.array([self.home]), frequent, zeros(len(frequent)), runs[often]), self.buckets)
        self._next()


def _dealt(docs: DataFrame, seed: int, n: int, buckets: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, holder = Words(), set(), Holder(buckets)
        for batch in batches:
            ids, sizes, digests, homes = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, known, n)
                d = digest(s, seed) if len(s) else None
                i = int.from_bytes(d[:8], "little", signed=True) if d else None
                ids.append(i)
                sizes.append(len(s))
                digests.append(d)
                homes.append(holder.home)
                holder.docs += 1
                if d and d not in met:
                    met.add(d)
                    holder.add(i, s)
                if holder.n >= HELD or holder.docs >= HELD_ROWS:
                    yield from holder.sent()
            dest = bucket_of(buckets, np.array(homes, np.int64), _whole(batch.column("doc_id")), np.array([i or 0 for i in ids], np.int64))
            yield _rows(TO_BUCKETS, DOCUMENT, len(ids), dest=dest, home=homes, doc_id=batch.column("doc_id"), n_shingles=sizes, set_id=ids, digest=digests, mark=batch.column("mark"))
        yield from holder.sent()

    return docs.select(F.col("doc_id").cast("long"), "text", "mark").mapInArrow(rows, schema(TO_BUCKETS))


def _dealt_again(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed rows of wide ranges cut into those of narrower ones."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings()
        for batch in batches:
            is_packed = pc.equal(batch.column("kind"), SHINGLES)
            for data in batch.filter(is_packed).column("packed"):
                held.add_packed(data.as_py())
                if held.full:
                    yield from _sent(held.taken(), buckets)
            rest = batch.filter(pc.invert(is_packed))
            yield rest.set_column(0, "dest", pa.array(bucket_of(buckets, *(_whole(rest.column(c)) for c in ("home", "doc_id", "set_id")))))
        yield from _sent(held.taken(), buckets)

    return rows.repartition("dest").mapInArrow(again, schema(TO_BUCKETS))


def _answered(table: pa.Table) -> pa.Table:
    """A bucket's answers to its holders, and its other rows as they are."""
    is_packed = pc.equal(table["kind"], SHINGLES)
    rest = table.filter(pc.invert(is_packed)).select(TO_HOLDERS)
    held = Postings()
    for data in table.filter(is_packed)["packed"]:
        held.add_packed(data.as_py())
    tokens, home, own, homes, often, often_home, counts = held.taken()
    # entries of both kinds count together
    distinct, at = np.unique(np.append(tokens, often), return_inverse=True)
    total = np.minimum(np.bincount(at, np.append(np.ones(len(tokens)), counts), len(distinct)), MOST).astype(np.uint16)
    n, n_often = total[at[: len(tokens)]], total[at[len(tokens) :]]
    several = n > 1
    tokens, home, own, n = tokens[several], home[several], own[several], n[several]
    order, order_often = np.argsort(home, kind="stable"), np.argsort(often_home, kind="stable")
    tokens, home, own, n = tokens[order], home[order], own[order], n[order]
    often, often_home, n_often = often[order_often], often_home[order_often], n_often[order_often]
    met, rows = np.union1d(home, often_home), []
    for i, j, k, m in zip(*(np.searchsorted(x, met, side) for x in (home, often_home) for side in ("left", "right")), strict=True):
        rows.append(_packed((tokens[i:j] >> 32).astype(np.uint16), tokens[i:j].astype(np.uint32), n[i:j], own[i:j].astype(np.uint16), often[k:m], n_often[k:m]))
    answers = _rows(TO_HOLDERS, SHINGLES, len(rows), home=homes[met] if len(met) else [], packed=rows)
    return pa.concat_tables([rest.cast(answers.schema), pa.Table.from_batches([answers])])


def least_shared(size: np.ndarray) -> np.ndarray:
    """The smallest overlap that sets of these sizes can have with one that they link to."""
    return -(-3 * size // 4)


def _returned(table: pa.Table) -> pa.Table:
    """A holder's sets that may link, with their shared shingles, and its documents."""
    of = lambda kind: table.filter(pc.equal(table["kind"], kind))
    documents = of(DOCUMENT).append_column("tokens", pa.nulls(len(of(DOCUMENT)), _ARROW["tokens"])).select(RESULT)
    parts, often = [], []
    for data in of(SHINGLES)["packed"]:
        high, low, n, own, tokens, totals = _unpacked(data.as_py(), np.uint16, np.uint32, np.uint16, np.uint16, np.int64, np.uint16)
        parts.append((n.astype(np.int64) << BITS | high.astype(np.int64) << 32 | low, own))
        often.append((tokens, totals))
    for data in of(KEPT)["packed"]:
        ids, sizes, own, tokens = _unpacked(data.as_py(), np.int64, np.int32, np.uint16, np.int64)
        if len(tokens):
            names, totals = (np.concatenate(x) for x in zip(*often, strict=True))
            order = np.argsort(names)
            parts.append((totals[order][np.searchsorted(names[order], tokens)].astype(np.int64) << BITS | tokens, own))
    if not parts:
        return documents
    numbers, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    shared = np.bincount(own, minlength=len(ids))
    keep = (shared >= least_shared(sizes))[own]
    numbers, own = numbers[keep], own[keep]
    order = np.lexsort((numbers, own))
    numbers, own = numbers[order], own[order]
    starts = _starts(own)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(numbers)), pa.int32()), pa.array(numbers, pa.int64()))
    found = _rows(RESULT, SET, len(starts), set_id=ids[own[starts]], n_shingles=sizes[own[starts]].astype(np.int64), tokens=lists)
    return pa.concat_tables([documents.cast(found.schema), pa.Table.from_batches([found])])


def shared_shingles(docs: DataFrame, seed: int, n: int) -> DataFrame:
    """Rows of two kinds of docs (doc_id, text, mark): (kind, doc_id, n_shingles, set_id, digest, mark, tokens).

    DOCUMENT: one row per row of docs. SET: a set, of n_shingles, and its shingles that occur more than once, in the global
    order; as often as tasks met that set, and only if these are enough for a link.
    """
    docs = steady(docs)  # holders number their sets in the order of the rows
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    rows = _dealt(docs, seed, n, min(buckets, FAN))
    if buckets > FAN:
        rows = _dealt_again(rows, buckets)
    answered = rows.groupBy("dest").applyInArrow(_answered, schema(TO_HOLDERS))
    return answered.groupBy("home").applyInArrow(_returned, schema(RESULT))


def sets_of(found: DataFrame) -> DataFrame:
    """(set_id, size, tokens): each set once, with the shingles that it shares with another one, in the global order."""
    # a set met by several tasks was counted once for each of them
    per = found.where(F.col("kind") == SET).groupBy("set_id").agg(F.count("*").alias("met"), F.first("n_shingles").cast("int").alias("size"), F.first("tokens").alias("tokens"))
    others = F.filter("tokens", lambda t: (F.shiftright(t, BITS) > F.col("met")) | (F.shiftright(t, BITS) == MOST))
    return per.select("set_id", "size", F.when(F.col("met") > 1, others).otherwise(F.col("tokens")).alias("tokens"))
