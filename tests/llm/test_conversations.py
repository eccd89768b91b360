"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from talentlake.llm import conversations
from talentlake.llm.queries import QUERIES

ORDER = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Cheapest, then ASCII-least letters by a uniform-cost search over whole prefixes."""
    solid = lambda t: re.findall(r"[^\x20\x09-\x0D]", t)
    kinds = ["blank" if not solid(t) else "duplicate" if (r, t) in rows[:i] else "truncated" if solid(t)[-1] not in ".!?" else "" for i, (r, t) in enumerate(rows)]
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and ORDER.fullmatch(roles):
            return kinds, cost, audit
        state = (i, roles[-2:] if len(roles) > 1 else roles)
        if state in done:
            continue
        done.add(state)
        good = lambda x: any(ORDER.fullmatch(x + y) for y in ("", "a", "ua"))
        grow = [("I", 2, i, r) for r in "ua"]
        if i < len(rows):
            grow.append(("D", 3, i + 1, ""))
            if kinds[i] not in ("blank", "duplicate"):
                add = kinds[i] == "truncated"
                grow += [("K", add, i + 1, rows[i][0][:1] or "?")] + [("R", 2 + add, i + 1, r) for r in "ua"]
        for letter, more, j, r in grow:
            if good(roles + r):
                heapq.heappush(heap, (cost + more, audit + letter, j, roles + r))


def replay(rows, audit):
    out, ahead = [], iter(rows)
    follow = lambda: "assistant" if out and out[-1][0][:1] == "u" else "user"
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(ahead)
        if letter != "D":
            out.append((role if letter == "K" else follow(), text))
    return out


def some_rows(r, n):
    texts = ["Yes.", "No!", "cut off", "", " \t", "why?", "x. ", "  end"] + [f"t{k}." for k in range(20)]
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts)) for _ in range(n)]


def test_small_conversations():
    r = random.Random(3)
    for _ in range(1500):
        rows = some_rows(r, r.randint(0, 9))
        kinds, cost, audit = brute(rows)
        got = conversations.repair_rows(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert [(x["role"], x["text"]) for x in got["repaired"]] == replay(rows, audit)
        assert [got[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks_give_the_same_audit(monkeypatch, size):
    r = random.Random(size)
    for _ in range(300):
        rows = some_rows(r, r.randint(0, 12))
        want = conversations.repair_rows(rows)
        with monkeypatch.context() as m:
            m.setattr(conversations, "BLOCK", size)
            assert conversations.repair_rows(rows) == want


def test_long_conversation():
    r = random.Random(9)
    rows = [(role, f"text {k} {'.' if r.random() < 0.9 else ''}") for k, (role, _) in enumerate(some_rows(r, 5000))]
    got = conversations.repair_rows(rows)
    assert ORDER.fullmatch("".join(x["role"][0] for x in got["repaired"])) and len(got["audit"]) - got["audit"].count("I") == 5000


def test_operator_on_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo."), (2, None, None, None), (2, 5, "user", "x"), (2, 2, "assistant", "y."), (2, 5, "user", "x"), (None, 1, "user", "Q?"), (3, 1, "", "long. " * 50000)]
    rows = spark.createDataFrame([(*x, "c", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, row int")
    everyone = spark.createDataFrame([(1,), (9,), (None,), (9,)], "conv_id long")
    got = {r.conv_id: r for r in conversations.repair(rows, everyone).collect()}
    assert set(got) == {1, 2, 3, 9, None} and got[1].audit == "KK" and got[1].gaps == 0
    odd = [(" ", " "), ("assistant", "y."), ("user", "x"), ("user", "x")]
    assert (got[2].audit, got[2].cost, got[2].gaps) == (brute(odd)[2], brute(odd)[1], 2)
    assert (got[2].blank, got[2].duplicate, got[2].truncated, got[2].illegal) == (1, 1, 1, 2)
    assert got[9][1:] == (0, 0, 0, 0, 0, 0, "", []) and got[None].audit == "KI"
    assert conversations.repair(rows.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held = {c: [] for c, *_ in source}
    for c, turn, role, text in source:
        mode = zlib.crc32(f"{c}:{turn}".encode()) % 20
        row = (turn, "user" if mode == 4 else role, "" if mode == 1 else re.sub("[.!?]", "", text) if mode == 2 else text)
        held[c] += [] if mode == 0 else [row, row] if mode == 3 else [row]
    want = []
    for c, rows in held.items():
        rows.sort()
        turns, plain = [t for t, *_ in rows], [x[1:] for x in rows]
        kinds, cost, audit = brute(plain)
        text = "\n".join(":".join(x) for x in replay(plain, audit))
        initials = [x[0][:1] for x in plain]
        want.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op13_conversation_repair"](spark, folder).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
