"""Secret scans by one combined deterministic automaton.

All rule regexes are compiled together: parsed, turned into a Thompson automaton over bytes, determinised by subset
construction and minimised into one flat transition array. Because a match's start is what costs most to find, the
combined automaton reads the *reversed* languages and each text is read once from its last byte to its first: reaching an
accepting state at byte i means that some rule has a match beginning at i. Starts are rare, so the end of a match comes
from that rule's own small minimised array, run forward over the bytes of the match alone. Matches are leftmost-longest and
non-overlapping per rule, which for these rules is what a greedy regex search gives.

Defined results: a null or empty text has no spans; invalid rules raise ValueError when the scanner is built; repeated rows
are scanned independently; an empty table gives an empty table; every other column passes through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """head + value is the searched pattern; a match counts if it has min_chars bytes, and its value min_value bytes."""

    kind: str
    head: str
    value: str = ""
    min_chars: int = 0
    min_value: int = 0
    any_case: bool = False


BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", min_value=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a maximal run either has 24 or fails, so the floor can stand in the automaton
)
#: A key's header fields and base64 up to its END line; without that line, the fields and the lines' runs of base64.
PEM_BODY = (
    r"((-?[A-Za-z0-9+/=:,.\\\x09\x0a\x0d\x20])*-----END [A-Z ]*PRIVATE KEY-----"
    r"|([\x0a\x0d]+[A-Za-z-]+:\x20[A-Za-z0-9,.\x20-]*)*([\x0a\x0d]+[A-Za-z0-9+/=]+)*)"
)
#: Kinds beyond the base: they add spans and change none.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_chars=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_chars=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_chars=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + PEM_BODY),
)
DEFAULT_RULES = BASE_RULES + EXTRA_RULES

SPANS = "array<struct<kind:string,start:int,end:int>>"


# ---- regexes to trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", tree, least, most or None)


def parse(pattern: str, any_case: bool = False) -> tuple:
    """The tree of an ASCII pattern made of literals, classes, groups, |, and the quantifiers ? * + {m} {m,} {m,n}."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        if at > len(pattern):
            raise ValueError(f"pattern ends too early: {pattern}")
        return pattern[at - 1]

    def escaped() -> int:
        c = take()
        if c == "x":
            return int(take() + take(), 16)
        if c.isalnum():
            raise ValueError(f"unsupported escape \\{c} in {pattern}")
        return ord(c)

    def folded(values: set[int]) -> frozenset[int]:
        if any_case:
            values |= {v ^ 32 for v in values if chr(v).isascii() and chr(v).isalpha()}
        return frozenset(values)

    def one_of() -> tuple:
        values: set[int] = set()
        inverse = peek() == "^"
        if inverse:
            take()
        while (c := take()) != "]":
            low = escaped() if c == "\\" else ord(c)
            high = low
            if peek() == "-" and at + 1 < len(pattern) and pattern[at + 1] != "]":
                take()
                high = escaped() if (d := take()) == "\\" else ord(d)
            values |= set(range(low, high + 1))
        found = folded(values)
        return ("set", BYTES - found if inverse else found)

    def atom() -> tuple:
        c = take()
        if c == "(":
            inner = choice()
            if take() != ")":
                raise ValueError(f"unbalanced group in {pattern}")
            return inner
        if c == "[":
            return one_of()
        if c == ".":
            return ("set", BYTES - {10})
        value = escaped() if c == "\\" else ord(c)
        if value > 127:
            raise ValueError("patterns are ASCII")
        return ("set", folded({value}))

    def counted() -> tuple:
        tree = atom()
        while peek() and peek() in "?*+{":
            c = take()
            if c == "{":
                body = ""
                while (d := take()) != "}":
                    body += d
                low, comma, high = body.partition(",")
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def chain() -> tuple:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(counted())
        return ("cat", tuple(parts))

    def choice() -> tuple:
        parts = [chain()]
        while peek() == "|":
            take()
            parts.append(chain())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    tree = choice()
    if at != len(pattern):
        raise ValueError(f"unbalanced group in {pattern}")
    return tree


def reverse(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = tuple(reverse(x) for x in tree[1])
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class Nfa:
    """Thompson automaton: byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Builds tree from start; returns its end state."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
        elif tree[0] == "cat":
            end = start
            for part in tree[1]:
                end = self.add(part, end)
        elif tree[0] == "alt":
            end = self.state()
            for part in tree[1]:
                entry = self.state()
                self.empty[start].append(entry)
                self.empty[self.add(part, entry)].append(end)
        else:
            _, inner, least, most = tree
            end = start
            for _ in range(least):
                end = self.add(inner, end)
            if most is None:
                loop = self.state()
                self.empty[end].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                end = self.state()
                self.empty[loop].append(end)
            else:
                out = self.state()
                self.empty[end].append(out)
                for _ in range(most - least):
                    end = self.add(inner, end)
                    self.empty[end].append(out)
                end = out
        return end

    def closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Dfa:
    """Minimised: next state times n_classes = table[state + class of the byte]; states are stored already multiplied.

    States are numbered so that accepting ones are those from `accepting` on; `accepts` gives their rules. `dead` is the
    state that no match leaves, or -1.
    """

    classes: bytes
    n_classes: int
    table: list[int]
    start: int
    accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def determinise(nfa: Nfa, start: int, finals: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction, then minimisation by partition refinement. anywhere: a match may begin at any byte."""
    groups: dict[tuple[int, ...], int] = {}
    edge_sets = sorted({s for edges in nfa.moves for s, _ in edges}, key=sorted)
    classes = bytes(groups.setdefault(tuple(i for i, s in enumerate(edge_sets) if b in s), len(groups)) for b in range(256))
    n = len(groups)
    member = {s: [c for key, c in groups.items() if i in key] for i, s in enumerate(edge_sets)}

    first = nfa.closure({start})
    names, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        targets: list[set[int]] = [set() for _ in range(n)]
        for state in subset:
            for s, to in nfa.moves[state]:
                for c in member[s]:
                    targets[c].add(to)
        row = []
        for reached in targets:
            to = nfa.closure(reached | {start} if anywhere else reached)
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        rows.append(row)
    accepts = [tuple(sorted(finals[s] for s in subset if s in finals)) for subset in todo]

    labels: dict = {}
    block = [labels.setdefault(a, len(labels)) for a in accepts]
    while True:
        labels = {}
        finer = [labels.setdefault((block[i], *(block[t] for t in row)), len(labels)) for i, row in enumerate(rows)]
        if len(labels) == len(set(block)):
            break
        block = finer
    members = {b: i for i, b in reversed(list(enumerate(block)))}
    order = sorted(members, key=lambda b: (bool(accepts[members[b]]), members[b]))
    number = {b: i * n for i, b in enumerate(order)}
    table = [number[block[t]] for b in order for t in rows[members[b]]]
    dead = next((number[b] for b in order if not accepts[members[b]] and all(block[t] == b for t in rows[members[b]])), -1)
    by_state = {number[b]: accepts[members[b]] for b in order if accepts[members[b]]}
    return Dfa(classes, n, table, number[block[0]], min(by_state, default=len(table)), by_state, dead)


class Scanner:
    """The combined reverse automaton of all rules and each rule's forward automata."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT_RULES) -> None:
        self.rules = rules
        nfa, finals = Nfa(), {}
        start = nfa.state()
        for k, rule in enumerate(rules):
            entry = nfa.state()
            nfa.empty[start].append(entry)
            finals[nfa.add(reverse(parse(rule.head + rule.value, rule.any_case)), entry)] = k
        self.starts = determinise(nfa, start, finals, anywhere=True)
        if self.starts.accepts.get(self.starts.start):
            raise ValueError("a rule matches the empty string")
        self.whole = [self._forward(r.head + r.value, r.any_case) for r in rules]
        self.heads = [self._forward(r.head, r.any_case) if r.value else None for r in rules]

    @staticmethod
    def _forward(pattern: str, any_case: bool) -> Dfa:
        nfa = Nfa()
        start = nfa.state()
        return determinise(nfa, start, {nfa.add(parse(pattern, any_case), start): 0}, anywhere=False)

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, at: int) -> int:
        """End of the longest match from `at`, or -1."""
        table, classes, dead, accepting = dfa.table, dfa.classes, dfa.dead, dfa.accepting
        state, end = dfa.start, -1
        for i in range(at, len(data)):
            state = table[state + classes[data[i]]]
            if state >= accepting:
                end = i + 1
            elif state == dead:
                break
        return end

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        dfa = self.starts
        table, accepting, state = dfa.table, dfa.accepting, dfa.start
        hits = []
        left = len(data)
        for c in data.translate(dfa.classes)[::-1]:
            left -= 1
            state = table[state + c]
            if state >= accepting:
                hits.append((left, state))
        if not hits:
            return []
        found, free = [], [0] * len(self.rules)
        for at, state in reversed(hits):
            for k in dfa.accepts[state]:
                if at < free[k]:
                    continue
                end = free[k] = self._longest(self.whole[k], data, at)
                rule = self.rules[k]
                if end - at >= rule.min_chars and (not rule.value or end - self._longest(self.heads[k], data, at) >= rule.min_value):
                    found.append((at, k, end))
        return sorted(found)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then in the order of the rules."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if found and len(data) != len(text):
            edges = sorted({x for s, _, e in found for x in (s, e)})
            place, chars, last = {}, 0, 0
            for x in edges:
                chars += len(data[last:x].decode("utf-8", "surrogatepass"))
                place[x], last = chars, x
            found = [(place[s], k, place[e]) for s, k, e in found]
        return [(self.rules[k].kind, s, e) for s, k, e in found]


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One per process; rules are small, arrays are built where they are used."""
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Column of SPANS for a text column."""

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans = scanner(rules).spans
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in texts], dtype=object)

    return scan(text)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with the column `out` of SPANS."""
    return docs.withColumn(out, secret_spans(F.col(text), rules))


def cut_out(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by [REDACTED:kind], in one pass; of overlapping spans the first wins."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[REDACTED:{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, spans: str = "secrets", text: str = "text") -> DataFrame:
    """Replaces each span of `text` by [REDACTED:kind]; of overlapping spans the first wins. Null texts stay null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or f is None or not len(f) else cut_out(x, [(r["kind"], r["start"], r["end"]) for r in f]) for x, f in zip(texts, found, strict=True)], dtype=object)

    return docs.withColumn(text, cut(F.col(text), F.col(spans)))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, text: str = "text", n: str = "n_secrets") -> DataFrame:
    """docs with its secrets cut out of `text` where they are found, and their number in `n`: texts go to the workers once."""

    @F.pandas_udf("text string, n int")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        spans = scanner(rules).spans
        for texts in batches:
            found = [spans(t) for t in texts]
            yield pd.DataFrame({"text": [cut_out(t, f) if f else t for t, f in zip(texts, found, strict=True)], "n": [len(f) for f in found]})

    return docs.withColumn("__scanned", scan(F.col(text))).withColumn(text, F.col("__scanned.text")).withColumn(n, F.col("__scanned.n")).drop("__scanned")


def digest_rows(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """doc_id, base counts, base_sha256, spans, as the contract of op1 names them."""
    base = [r.kind for r in BASE_RULES]
    found = scan_secrets(docs.select("doc_id", "text"), rules)
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(F.array_join(F.transform(F.filter("secrets", lambda x: x["kind"].isin(base)), shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", shown), ",").alias("spans"),
    )
