"""Operator 12 against a plain search over all edits, and against itself in short segments."""

import hashlib
import random
from zlib import crc32

import pytest

from volpanel.llm import repair

WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract read row by row: (conv_id, turn, role, text) to the result of each conversation, by best audits of all states."""
    out = {}
    for conv in {r[0] for r in rows}:
        hurt = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in hurt} - {None}
        faults, seen = [], set()
        for _, role, text in hurt:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in hurt]
        # states by what the next turn must be; each holds its best (cost, audit, lines)
        best = {"": (0, "", ())}
        name = {"u": "user", "a": "assistant"}
        nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

        def opened(best):
            best = dict(best)
            for _ in range(2):
                for q, (c, a, t) in list(best.items()):
                    w = nxt[q]
                    best[w] = min(best.get(w, (10**9, "", ())), (c + 2, a + "I", (*t, f"{name[w]}:")))
            return best

        for (_, role, text), fault in zip(hurt, faults, strict=True):
            after = {}

            def offer(q, found, after=after):
                after[q] = min(after.get(q, (10**9, "", ())), found)

            for q, (c, a, t) in opened(best).items():
                offer(q, (c + 3, a + "D", t))
                if fault not in ("blank", "duplicate"):
                    more, w = fault == "truncated", nxt[q]
                    if role[:1] == w or role[:1] == "s" and q == "":
                        offer(role[:1], (c + more, a + "K", (*t, f"{role}:{text}")))
                    offer(w, (c + 2 + more, a + "R", (*t, f"{name[w]}:{text}")))
            best = after
        cost, audit, lines = min(x for q, x in opened(best).items() if q in ("", "a"))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, codes string, segment int"


def check(spark, rows):
    found = repair.repair_rows(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == plain(rows) and len(found) == len({r[0] for r in rows})


def conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "u", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(["a.", "b!", "c", "", " \t", None, "é?", "d. ", "e." * 50, f"{turn}."])))
    return rows


@pytest.mark.parametrize("segment", [128, 3, 1])
def test_equals_plain_search(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    check(spark, conversations(random.Random(segment), 60, 12))


def test_nulls_ties_and_one_large_conversation(spark):
    """A null conv_id holds a third of all rows; equal rows; conversations of which nothing is left."""
    rng = random.Random(5)
    rows = conversations(rng, 40, 9)
    rows += [(None, t, rng.choice(["user", "assistant"]), f"text {t}{rng.choice(['.', ''])}") for t in range(400)] + [(None, None, "user", "x.")] * 3
    dropped = [t for t in range(500) if crc32(f"777:{t}".encode()) % 20 == 0][:3]
    rows += [(777, t, "user", "gone.") for t in dropped] + [(778, 1, "system", "long. " * 40_000)]
    check(spark, rows)


def test_empty(spark):
    assert repair.repair_rows(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_prices_stay_feasible():
    """Every arc has a price difference of at most its cost, and the origin's price is the cost of the audit."""
    rng = random.Random(1)
    for _ in range(200):
        codes = [rng.randrange(4) + rng.choice([0, 0, 4, 8]) for _ in range(rng.randint(0, 30))]
        lattice = repair.Lattice(codes, list(repair.ENDS), True)
        cost = lattice.cost(0)
        assert all(lattice.prices[i] <= c + lattice.prices[j] for i, arcs in enumerate(lattice.arcs) for _, c, j in arcs)
        letters, node, paid = lattice.audit(0, lattice.tight())[0], 0, 0
        for x in letters:
            _, c, node = next(arc for arc in lattice.arcs[node] if arc[0] == x)
            paid += c
        assert paid == cost and node % 4 in (repair.EMPTY, repair.ASSISTANT)


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "a."), (1, 2, "system", "b."), (1, 3, "user", "c.")], "conv_id long, turn long, role string, text string")
    judged = repair.judged(rows)
    found = repair.repaired(judged, repair.audits(judged)).collect()
    assert [(r.edit, r.role, r.text) for r in found] == [("K", "system", "b."), ("K", "user", "c."), ("I", "assistant", "")]
