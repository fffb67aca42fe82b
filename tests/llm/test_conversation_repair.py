"""Conversation repair against a search over all edits, whole and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from graphloom.llm import conversation_repair as cr

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """Least (cost, audit) by Dijkstra over (rows done, initials' state); rows are (role, text, lost, truncated)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        made = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, made[0], (*out, (made, ""))))
        if i < len(rows):
            role, text, lost, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if not lost:
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, role[0], (*out, (role, text))))
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, made[0], (*out, (made, text))))
    raise AssertionError


def expected(table, damage=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, judged = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, repaired = cheapest(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ("assistant" if turn % 2 else "user")
            role = "system" if turn == 0 and rng.random() < 0.3 else rng.choice(["tool", "", None, "s", "User"]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "No!", "why", "", "  \n", None, " ", "end.  \t", f"It is {conv} and {turn}.", f"open {turn}", "x" * 3000 + "?"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (7000, None, "user", "A."), (7000, None, "assistant", "B.")]
    rows += [r for r in rows if r[0] == 3]
    rows += [(9000, t, "assistant" if t % 3 else "user", f"Turn {t // 2}." if t % 7 else f"turn {t}") for t in range(700)]
    dropped = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")]


def result(rows):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    out = {r.conv: tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("damage", [True, False])
def test_repairs_equal_a_search_over_all_edits(spark, table, damage):
    df = spark.createDataFrame([(*r, "clash", 1) for r in table], "conv_id long, turn long, role string, text string, conv string, code int").repartition(3)
    got = cr.repair(df, damage=damage).collect()
    want = expected(table, damage)
    assert result(got) == want
    for r in got:
        joined = "\n".join(f"{x.role}:{x.text}" for x in r.repaired or [])
        assert hashlib.sha256(joined.encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in r.repaired or []))


def test_segments_give_the_same_repairs(spark, table, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 5)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(3)
    assert result(cr.repair(df, damage=True, long=4).collect()) == expected(table)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(df, damage=True).collect() == []
