"""Line removal against plain dictionaries, and the perfect hash."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talentlake.llm import line_dedup
from talentlake.llm.perfect_hash import PerfectHash


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    order = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or order(i) == min(holders[key(x)])]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def some_rows():
    r = np.random.default_rng(5)
    lines = [f"line number {k}" for k in range(60)] + ["  LINE Number 7\t", "Line number 8\r", "short", "exactly 10", "nine char", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "ééééé", "日本語日本語日本語日", "", "  ", " padded line here ", "padded line here"]
    rows = [(k, "\n".join(lines[j] for j in r.integers(0, len(lines), r.integers(0, 9)))) for k in range(150)]
    rows += [(k, f"a hot line of many\nown {k} and only own") for k in range(150, 260)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "again and again\nagain and again"), (3, rows[3][1]), (3, "another row of three"), (304, "x" * 3_000_000 + "\nline number 1"), (305, "x" * 3_000_000)]
    return rows + [(None, "only without an id"), (None, "only without an id\nLine Number 2")]


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": -1}, {"broadcast_bytes": -1, "shard_keys": 5, "shard_lines": 40}, {"shard_keys": 3}])
def test_lines_equal_brute_force(spark, limits):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "r") for i, t in rows], "doc_id long, text string, n_lines int, h1 int, at int, row string")
    got = line_dedup.remove_repeats(docs, **limits)
    assert sorted(got.columns) == sorted(docs.columns + ["n_dropped"])
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect() if (r.h1, r.at, r.row) == (2, 3, "r")) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert line_dedup.remove_repeats(docs).count() == line_dedup.remove_repeats(docs, broadcast_bytes=-1).count() == 0
    assert line_dedup.remove_repeats(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()[0] == (1, "", 1, 0)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash(keys, others):
    keys = np.array(sorted(keys), np.uint64)
    built, rest = PerfectHash.build(keys)
    again = PerfectHash.from_bytes(built.to_bytes())
    assert not len(rest) and sorted(again.number(keys)) == list(range(len(keys)))
    assert (again.number(np.array(others, np.uint64)) < len(keys)).all()


def test_equal_first_hashes():
    h1, h2 = np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard(h1, h2, np.array([2, 2, 2]), np.array([10, 20, 30])).to_bytes())
    ask = np.array([7, 7, 7, 9, 9, 8], np.uint64), np.array([1, 2, 3, 3, 4, 3], np.uint64)
    assert shard.first_documents(*ask).tolist() == [10, 20, line_dedup.LAST, 30, line_dedup.LAST, line_dedup.LAST]


def test_large_shard_is_compact():
    keys = np.random.default_rng(0).integers(0, 2**63, 200_000).astype(np.uint64)
    built, rest = PerfectHash.build(np.unique(keys))
    assert not len(rest) and 8 * len(built.to_bytes()) < 4 * len(keys)
