"""Repairs of conversations against a search from the last row to the first, and awkward rows."""

import hashlib
import random
import zlib

import pytest

from meterline.llm import repair as R

AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string, audit string, at string"


def least(rows, faults):
    """The least (cost, edits) of a conversation, by a table over rows and states."""
    best = {0: (0, "", ()), 3: (0, "", ())}

    def closed(found):
        for _ in range(3):
            for s, step in AFTER.items():
                for put, to in step.items():
                    if put != "s" and to in found:
                        c, a, t = found[to]
                        way = (c + 3, "I" + a, (({"u": "user", "a": "assistant"}[put], ""), *t))
                        found[s] = min(found.get(s, way), way)
        return found

    best = closed(best)
    for (role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for s in AFTER:
            ways = []
            if s in best:
                c, a, t = best[s]
                ways.append((c + 4, "D" + a, t))
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                for put, to in AFTER[s].items():
                    if to in best:
                        c, a, t = best[to]
                        if role[:1] == put:
                            ways.append((c + extra, "K" + a, ((role, text), *t)))
                        if put != "s":
                            ways.append((c + extra + 3, "R" + a, (({"u": "user", "a": "assistant"}[put], text), *t)))
            if ways:
                now[s] = min(ways)
        best = closed(now)
    return best[0]


def expected(rows):
    """``rows``: turn, role, text of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    cost, audit, kept = least([r[1:] for r in rows], faults)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (1, 2, 3)),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()), kept


@pytest.mark.parametrize("seed", range(300))
def test_auction_finds_the_least_path(seed):
    draw = random.Random(seed)
    codes = [4 * draw.choice((0, 0, 0, 1, 2, 3)) + draw.randrange(4) for _ in range(draw.randrange(1, 12))]
    rows = [(("system", "user", "assistant", "tool")[c % 4], "x") for c in codes]
    cost, audit, _ = least(rows, [c // 4 for c in codes])
    auction = R.Auction(codes, (0, None, None, 0), True)
    assert auction.reach(0) == cost
    assert "".join(e[::2] for e in auction.traced(0)[1]) == audit


def random_rows(seed, n):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.choice(("user", "assistant", "system", "tool", "")),
             draw.choice(("Yes.", "no", "Why? ", " \n", "", f"{i}!"))) for i in range(n)]


def test_long_and_short_conversations(spark):
    given = {k: random_rows(k, n) for k, n in enumerate((1, 2, 5, 9, 63, 64, 65, 200, 700))}
    given[50] = [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(400)]
    given[51] = [(1, "user", "same.")] * 300
    table = spark.createDataFrame([(k, *r, "extra", "extra") for k, rows in given.items() for r in rows], SCHEMA).repartition(5)
    made = R.repair(table)
    got = {r.conv_id: tuple(r)[1:] for r in R.report(made).collect()}
    lines = R.repaired_rows(made).orderBy("at", "place").collect()
    assert set(got) == set(given)
    for key, rows in given.items():
        wanted, kept = expected(rows)
        assert got[key] == wanted, key
        assert [(r.role, r.text) for r in lines if r.conv_id == key] == list(kept), key


def test_awkward_rows(spark):
    table = spark.createDataFrame([
        (None, None, None, None, "x", "x"), (None, 3, "user", "Hello.", "x", "x"), (None, None, "assistant", "Hi.", "x", "x"),
        (1, 5, "user", "q" * 300_000 + ".", "x", "x"), (1, 9, "assistant", "", "x", "x"),
        (2, 1, "user", "Ünï 漢字 🙂!", "x", "x"), (2, 1, "user", "Ünï 漢字 🙂!", "x", "x"), (2, 2, "assistant", "end\v.\f", "x", "x")], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in R.report(R.repair(table)).collect()}
    assert got[None] == expected([(None, " ", " "), (3, "user", "Hello."), (None, "assistant", "Hi.")])[0]
    assert got[1] == expected([(5, "user", "q" * 300_000 + "."), (9, "assistant", "")])[0]
    assert got[2] == expected([(1, "user", "Ünï 漢字 🙂!")] * 2 + [(2, "assistant", "end\v.\f")])[0]
    assert R.report(R.repair(table.limit(0))).count() == 0


def test_damage(spark):
    table = spark.createDataFrame([(k, t, "assistant", "A. b?", "x", "x") for k in range(40) for t in (0, None)], SCHEMA)
    got = {}
    for r in R.damage(table).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    plain = ("assistant", "A. b?", False)
    for (conv, turn), rows in got.items():
        fate = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        assert rows == {0: [("assistant", "", True)], 1: [("assistant", "", False)], 2: [("assistant", "A b", False)],
                        3: [plain, plain], 4: [("user", "A. b?", False)]}.get(fate, [plain])
    only_gone = spark.createDataFrame([(7, 1, "user", "x.", "x", "x")], SCHEMA)
    row = R.report(R.repair(only_gone, only_gone["conv_id"] == 7)).first()
    assert tuple(row) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
