"""Conversation structure repair by an auction over an integer-cost lattice.

A conversation should read `(s?(ua)+)?` in its roles' initials. Rows may be kept (0), given the role that the pattern wants
(2), deleted (3; blank and duplicate rows must be), and empty turns of the wanted role may be inserted (2); a truncated row
that stays adds 1. Edits are arcs of a lattice whose nodes are (rows consumed, state of the pattern), with a sink behind it.

Auction shortest paths: every node has a price, at first what the rows behind it cost at the least. A path begins at the
origin. At its end node i the cheapest arc to j by cost + price of j is taken: if that is above i's price, the price rises to it
and the path loses its end; otherwise the path grows by j. Prices stay dual feasible and never pass the true distances, so
when the sink is reached the origin's price is the cheapest cost, and the arcs without slack hold every cheapest path. Among
those that lead to the sink, the letters D, I, K, R are tried in this order node by node: the ASCII-least audit.

Conversations are cut into segments of SEGMENT rows, of which only a code a row is needed. One segment is solved at once. Of a
longer conversation every segment gives its costs from state to state; a fold over these few numbers gives what the states
cost at each segment's end, with which segments are solved anew from every state, and a second fold picks the state in which
each begins. Texts meet their edits in one pass over rows sorted by conversation and position, which holds a segment's edits and
a running digest only; as a SHA-256 runs through a conversation from end to end, this pass and the sort before it
take a conversation's rows in one task, but never hold them.

Defined results: null roles and texts are one space, as are null ids and turns in the damage's key; rows with a null
conv_id are one conversation; null turns come first; rows of one turn go by role and text; equal rows are rows, of which the later
ones are duplicates; roles other than s, u and a can only be replaced or deleted; an empty table gives an empty
table; columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a segment.
SEGMENT = 128
#: Fixed value: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
#: Codes of a row: 0 to 3 for a role that begins with s, u, a or another letter, and what holds of it.
DELETE, TRUNCATED = 4, 8
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The turn that each wants.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What states cost at the end of a conversation.
ENDS = (0, None, None, 0)
#: Costs.
REROLED, DELETED, INSERTED, CUT = 2, 3, 2, 1
#: Edits a worker remembers by codes: most conversations are alike.
REMEMBERED = 20_000


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the contract of op12 damages them."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, fault, illegal, new_turn, code): rows in order, each with its first fault; one hash by conv_id serves all windows."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    at = Window.partitionBy("conv_id").orderBy("position")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("position")) > 1
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    placed = rows.withColumn("position", F.row_number().over(order) - 1).withColumn("again", again).withColumn("first", F.substring("role", 1, 1))
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    pair = F.concat(F.lag("first").over(at), F.col("first"))
    found = placed.withColumn("fault", fault).withColumn("illegal", F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)))
    found = found.withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(at)))
    initial = F.when(F.col("first") == "s", 0).when(F.col("first") == "u", 1).when(F.col("first") == "a", 2).otherwise(3)
    code = initial + F.when(F.col("fault").isin("blank", "duplicate"), DELETE).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    return found.select("conv_id", "position", "turn", "role", "text", "fault", "illegal", "new_turn", code.cast("int").alias("code"))


class Lattice:
    """Arcs (letter, cost, node) of the nodes 4 * rows + state; the sink is the last node. `after` is what each state costs at the end, None where it ends nothing."""

    def __init__(self, codes: list[int], after: list[int | None], last: bool) -> None:
        n = len(codes)
        self.sink = 4 * n + 4
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.sink)]
        self.prices = [min(x for x in after if x is not None)] * self.sink + [0]
        for i in range(n, -1, -1):
            for q in range(4):
                arcs = self.arcs[4 * i + q]
                if i == n:
                    if after[q] is not None:
                        arcs.append(("", after[q], self.sink))
                else:
                    arcs.append(("D", DELETED, 4 * i + 4 + q))
                if i < n or last:
                    arcs.append(("I", INSERTED, 4 * i + WANTED[q]))
                if i < n and not codes[i] & DELETE:
                    role, more = codes[i] & 3, CUT if codes[i] & TRUNCATED else 0
                    if role + 1 == WANTED[q] or role == 0 and q == EMPTY:
                        arcs.append(("K", more, 4 * i + 5 + role))
                    arcs.append(("R", REROLED + more, 4 * i + 4 + WANTED[q]))
            if i < n:
                least = self.prices[4 * i + 4] + (DELETED if codes[i] & DELETE else CUT if codes[i] & TRUNCATED else 0)
                self.prices[4 * i : 4 * i + 4] = [least] * 4

    def cost(self, origin: int) -> int:
        """Cheapest cost from a node to the sink, which must be reachable, by path extension and contraction."""
        arcs, prices, sink = self.arcs, self.prices, self.sink
        path = [origin]
        while path[-1] != sink:
            i = path[-1]
            best, to = None, sink
            for _, c, j in arcs[i]:
                if best is None or c + prices[j] < best:
                    best, to = c + prices[j], j
            if best is None or prices[i] < best:
                prices[i] = 1 << 40 if best is None else best  # a node without arcs leads nowhere
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return prices[origin]

    def tight(self) -> list[list[tuple[str, int]]]:
        """Of every node, the arcs without slack that lead on to the sink, by letter."""
        leads = [False] * self.sink + [True]
        found: list[list[tuple[str, int]]] = [[] for _ in range(self.sink)]
        for i in range(self.sink - 4, -1, -4):
            # two insertions in a row never come back to their state without cost, so twice is enough
            for q in (0, 1, 2, 3, 0, 1, 2, 3):
                node = i + q
                found[node] = sorted((letter, j) for letter, c, j in self.arcs[node] if leads[j] and self.prices[node] == c + self.prices[j])
                leads[node] = bool(found[node])
        return found

    def audit(self, origin: int, tight: list[list[tuple[str, int]]]) -> tuple[str, int]:
        """ASCII-least letters of the cheapest paths, and the state in which they end."""
        letters, node = [], origin
        while True:
            letter, to = tight[node][0]
            if to == self.sink:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def reachable(codes: list[int], start: int, end: int) -> bool:
    """Whether a segment's edits can lead from one state to another: all but system turns can be inserted, and nothing is undone."""
    if start == end or end in ROLES:
        return True
    return end == SYSTEM and start == EMPTY and any(c & 3 == 0 and not c & DELETE for c in codes)


def matrix(codes: list[int]) -> list[int | None]:
    """Costs of a segment that is not the last, from each state (4 rows) to each state; None where there is no way."""
    found: list[int | None] = [None] * 16
    for end in range(4):
        lattice = Lattice(codes, [0 if q == end else None for q in range(4)], False)
        for start in range(4):
            if reachable(codes, start, end):
                found[4 * start + end] = lattice.cost(start)
    return found


def solved(codes: list[int], after: list[int | None], last: bool, starts: range) -> tuple[list[int], list[str], list[int]]:
    """Costs, audits and end states from each of the states `starts`."""
    lattice = Lattice(codes, after, last)
    costs = [lattice.cost(q) for q in starts]
    tight = lattice.tight()
    audits = [lattice.audit(q, tight) for q in starts]
    return costs, [a for a, _ in audits], [q for _, q in audits]


_ID = "conv_id {id}, segment int"
_SOLVED = _ID + ", costs array<long>, audits array<string>, ends array<int>"


def _solve(segments: DataFrame, one: bool) -> DataFrame:
    """(conv_id, segment, costs, audits, ends) of segments (conv_id, segment, codes, after, last). one: whole conversations, from the first state alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            found = []
            for codes, after, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "after", "last")), strict=True):
                key = (bytes(codes), tuple(after), last)
                if key not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[key] = solved(codes, after, last, range(1) if one else range(4))
                found.append(known[key])
            kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["conv_id", "segment", "costs", "audits", "ends"])

    return segments.mapInArrow(rows, _SOLVED.format(id=segments.schema["conv_id"].dataType.simpleString()))


def _priced(segments: DataFrame) -> DataFrame:
    """segments of long conversations with `after` of each: a fold over a few numbers a segment, from the last to the first."""
    id_type = segments.schema["conv_id"].dataType.simpleString()

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if last else matrix(codes) for codes, last in zip(batch.column("codes").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            firsts = [[Lattice(c, list(ENDS), True).cost(q) for q in range(4)] if last else None for c, last in zip(batch.column("codes").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(found, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))], ["conv_id", "segment", "matrix", "whole"])

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by([("segment", "descending")])
        after, out = list(ENDS), []
        for m, whole in zip(table["matrix"].to_pylist(), table["whole"].to_pylist(), strict=True):
            out.append(after)
            if whole is not None:
                after = whole
            else:
                ways = [[m[4 * q + e] + after[e] for e in range(4) if m[4 * q + e] is not None and after[e] is not None] for q in range(4)]
                after = [min(w) if w else None for w in ways]
        return pa.table([table["conv_id"], table["segment"], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "segment", "after"])

    numbers = segments.mapInArrow(costs, _ID.format(id=id_type) + ", matrix array<long>, whole array<long>")
    after = numbers.groupBy("conv_id").applyInArrow(folded, _ID.format(id=id_type) + ", after array<long>").withColumnsRenamed({"conv_id": "of", "segment": "at"})
    return segments.join(after, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at"))).drop("of", "at")


def _chained(found: DataFrame) -> DataFrame:
    """(conv_id, segment, start, cost, audit): the state in which each segment of a conversation begins, and its edits from there."""
    kind = _ID.format(id=found.schema["conv_id"].dataType.simpleString())

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        state, starts = EMPTY, []
        for ends in table["ends"].to_pylist():
            starts.append(state)
            state = ends[state]
        return pa.table([table["conv_id"], table["segment"], pa.array(starts, pa.int32())], names=["conv_id", "segment", "start"])

    starts = found.select("conv_id", "segment", "ends").groupBy("conv_id").applyInArrow(folded, kind + ", start int").withColumnsRenamed({"conv_id": "of", "segment": "at"})
    both = found.join(starts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("segment") == F.col("at")))
    return both.select("conv_id", "segment", "start", F.element_at("costs", F.col("start") + 1).alias("cost"), F.element_at("audits", F.col("start") + 1).alias("audit"))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, start, cost, audit) of judged rows: cost is what the conversation costs from this segment on."""
    code = F.struct("position", "code")
    segments = rows.groupBy("conv_id", F.floor(F.col("position") / SEGMENT).cast("int").alias("segment")).agg(F.array_sort(F.collect_list(code))["code"].alias("codes"))
    segments = stored(segments, "segments")
    lasts = segments.groupBy("conv_id").agg(F.max("segment").alias("to")).withColumnRenamed("conv_id", "of")
    segments = segments.join(lasts, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("last", F.col("segment") == F.col("to")).drop("of")
    ends = F.array(*map(F.lit, ENDS)).cast("array<long>")
    short = _solve(segments.where("to = 0").drop("to").withColumn("after", ends), True)
    short = short.select("conv_id", "segment", F.lit(EMPTY).alias("start"), F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    long = stored(_solve(_priced(segments.where("to > 0").drop("to")), False), "solved")
    return stored(short.union(_chained(long)), "audits")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, segment, position, edit, role, text) of judged rows and their audits: the turns that are left, in order within each task.

    Rows that an edit deletes are gone; inserted turns have the position of the row that they stand before.
    """
    segment = F.floor(F.col("position") / SEGMENT).cast("int").alias("segment")
    none = F.lit(None)
    heads = found.select("conv_id", "segment", F.lit(-1).alias("position"), none.cast("string").alias("role"), none.cast("string").alias("text"), "start", "audit")
    body = rows.select("conv_id", segment, "position", "role", "text", none.cast("int").alias("start"), none.cast("string").alias("audit"))
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "position")
    names = ["conv_id", "segment", "position", "edit", "role", "text"]
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, state = "", 0, EMPTY
        for batch in batches:
            out: list[tuple] = []
            for conv, seg, position, role, text, start, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "position", "role", "text", "start", "audit")), strict=True):
                if position < 0:
                    letters, at, state = audit, 0, start
                else:
                    while letters[at] == "I":
                        state = WANTED[state]
                        out.append((conv, seg, position, "I", ROLES[state], ""))
                        at += 1
                    letter = letters[at]
                    at += 1
                    if letter == "K":
                        state = SYSTEM if state == EMPTY and role[:1] == "s" else WANTED[state]
                        out.append((conv, seg, position, letter, role, text))
                    elif letter == "R":
                        state = WANTED[state]
                        out.append((conv, seg, position, letter, ROLES[state], text))
                    # what is left behind a segment's last row is inserted
                    if letters[at : at + 1] == "I" and not letters[at:].strip("I"):
                        for _ in letters[at:]:
                            state = WANTED[state]
                            out.append((conv, seg, position + 1, "I", ROLES[state], ""))
                        at = len(letters)
            kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return both.mapInArrow(turns, f"conv_id {id_type}, segment int, position int, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns, which stand together and in order in their task: one digest runs along."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, running = None, None
        kind = pa.int64()
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if running is None or conv != here:
                    if running is not None:
                        done.append((here, running.hexdigest()))
                    here, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], kind), pa.array([running.hexdigest()])], ["conv_id", "repaired_sha256"])

    return turns.mapInArrow(digest, f"conv_id {id_type}, repaired_sha256 string")


def repair_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, as the contract of op12 names them: one row per conv_id."""
    rows = stored(judged(damaged(conversations)), "judged")
    n_if = lambda c: F.count_if(c).alias
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps")
    facts = rows.groupBy("conv_id").agg(gaps, *(n_if(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")), n_if(F.col("illegal"))("illegal"))
    found = audits(rows)
    costs = found.groupBy("conv_id").agg(F.max(F.when(F.col("segment") == 0, F.col("cost"))).alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("segment", "audit")))["audit"], "").alias("audit"))
    out = conversations.select("conv_id").distinct()
    for i, table in enumerate((facts, costs, digests(repaired(rows, found)))):
        out = out.join(table.withColumnRenamed("conv_id", f"__{i}"), F.col("conv_id").eqNullSafe(F.col(f"__{i}")), "left").drop(f"__{i}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
