"""Repair of conversation structure by iterative-deepening A*.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Edits, each written as one letter:
``K`` keep a row (0), ``R`` give it the role that must come next (2), ``D`` delete it (3), ``I`` insert an empty row of the
role that must come next (2). Blank and duplicate rows must be deleted; a truncated row that stays adds 1. The next role
follows from what was written before, so the letters (the audit) determine the repaired conversation.

The search runs depth first in the ASCII order of the letters under a cost bound. A table of failed states holds, per
(row, last role), the least cost that is still needed; a state is cut where that exceeds what is left of the bound. The
bound then grows to the least cost of the start, so the first path that ends is the cheapest and the ASCII-least one of
its cost. A conversation longer than ``BLOCK`` rows is searched block by block: the costs from each border to the end are
searched first, back to front, then each block ends at the border cost that is best. Paths through a block have no insert
behind its last row, so none is a prefix of another and the order of whole audits is that of the blocks.

Rows are gathered per conversation, which is the unit of the result (its repaired rows are one value). Rows of one turn
are ordered by role, then text. Defined results: null roles and texts count as one blank; null turns come first; rows with
a null id form one conversation; an id without rows (see ``everyone``) gives zeros, an empty audit and no rows; repeated
rows are duplicates of each other. Other columns of the input do not matter and are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
DELETE, INSERT, REROLE = 3, 2, 2
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
DOOMED = 2  # weight of a row that must go; 0 and 1 are what a kept row adds
ENDS = {START: 0, SYSTEM: math.inf, USER: math.inf, ASSISTANT: 0}

SPACE = " \t\n\x0b\x0c\r"
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """The first fault of each row, or an empty string."""
    seen, out = set(), []
    for row in rows:
        last = row[1].rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if row in seen else "" if last in ".!?" else "truncated")
        seen.add(row)
    return out


def search(weights: list[int], initials: list[str], start: int, ends: dict[int, float], inserts_last: bool) -> tuple[int, str, int]:
    """Cost, letters and end state of the best path from ``start`` over all rows; ``ends`` are the costs behind them."""
    n, least = len(weights), min(ends.values())
    rest = [0] * (n + 1)  # what the rows ahead cost at least
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if weights[i] == DOOMED else weights[i])
    failed: dict[tuple[int, int], float] = {}

    def needed(i: int, s: int) -> float:
        return failed.get((i, s), rest[i] + least)

    def edits(i: int, s: int) -> list[tuple[str, int, int, int]]:
        out = []
        if i < n:
            out.append(("D", DELETE, i + 1, s))
        if i < n or inserts_last:
            out.append(("I", INSERT, i, NEXT[s]))
        if i < n and weights[i] != DOOMED:
            if (s, initials[i]) in KEEPS:
                out.append(("K", weights[i], i + 1, KEEPS[s, initials[i]]))
            out.append(("R", REROLE + weights[i], i + 1, NEXT[s]))
        return out

    while True:
        bound = needed(0, start)
        path = [[0, start, 0, iter(edits(0, start)), ends[start] if not n else math.inf, ""]]
        while path:
            i, s, spent, moves, lack, _ = top = path[-1]
            if i == n and spent + ends[s] <= bound:
                return int(spent + ends[s]), "".join(x[5] for x in path), s
            for letter, cost, j, t in moves:
                more = cost + needed(j, t)
                if spent + more <= bound:
                    path.append([j, t, spent + cost, iter(edits(j, t)), ends[t] if j == n else math.inf, letter])
                    break
                top[4] = min(top[4], more)
            else:
                path.pop()
                failed[i, s] = max(needed(i, s), top[4])
                if path:  # the parent learns what this child needs
                    path[-1][4] = min(path[-1][4], spent - path[-1][2] + failed[i, s])


def repair_rows(rows: list[tuple[str, str]]) -> dict:
    """Faults, audit, cost and repaired rows of one conversation in order."""
    kinds = faults(rows)
    weights = [{"": 0, "truncated": 1}.get(k, DOOMED) for k in kinds]
    initials = [role[:1] for role, _ in rows]
    cuts = range(0, max(len(rows), 1), BLOCK)
    border = {cuts[-1] + BLOCK: ENDS}
    span = lambda at: (weights[at : at + BLOCK], initials[at : at + BLOCK])
    for at in reversed(cuts[1:]):
        border[at] = {s: search(*span(at), s, border[at + BLOCK], at == cuts[-1])[0] for s in ENDS}
    audit, state, cost = "", START, None
    for at in cuts:
        all_in, letters, state = search(*span(at), state, border[at + BLOCK], at == cuts[-1])
        audit, cost = audit + letters, all_in if cost is None else cost
    repaired, ahead, state = [], iter(rows), START
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            repaired.append((NAMES[state], ""))
            continue
        role, text = next(ahead)
        if letter != "D":
            state = KEEPS[state, role[:1]] if letter == "K" else NEXT[state]
            repaired.append((role if letter == "K" else NAMES[state], text))
    return {
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}, "cost": cost, "audit": audit,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "repaired": [{"role": r, "text": t} for r, t in repaired],
    }


def repair(conversations: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row per conv_id of both tables: gaps, counts of faults, cost, audit and the repaired rows."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), value("role"), value("text")).alias("row"))
    if everyone is not None:
        rows = rows.unionByName(everyone.select("conv_id", F.lit(None).cast(rows.schema["row"].dataType).alias("row")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = F.filter(F.col("rows")["turn"], lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0).cast("long"))
    whole = whole.select("conv_id", gaps.alias("gaps"), F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))
    kind = whole.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"audit": pa.string(), "repaired": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                out = [repair_rows([(r["role"], r["text"]) for r in rows]) for rows in part.column("rows").to_pylist()]
                made = [part.column("gaps") if n == "gaps" else pa.array([x[n] for x in out], types.get(n, pa.int64())) for n in names]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), *made], ["conv_id", *names])

    return whole.mapInArrow(run, f"conv_id {kind}, {FIELDS}")

