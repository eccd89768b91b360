"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from talentlake.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Smallest index reachable through steps of at most two bits."""
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    for i in range(len(values)):
        while root[root[i]] != root[i]:
            root[i] = root[root[i]]
    return root


@pytest.mark.parametrize("limit", [4096, 8])
def test_components_equal_all_pairs(spark, limit):
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(150)] + [0, 1, 3, 2**63, 2**64 - 1]
    for start in (r.getrandbits(64), 5):  # chains of single and double flips
        for _ in range(60):
            values.append(start)
            start ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
    centre = r.getrandbits(64)
    values += [centre ^ (1 << b) for b in range(64)]
    values = sorted(set(values), key=lambda v: np.uint64(v).view(np.int64))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), limit)
    found = {row.node: row.root for row in simhash.components(edges).collect()}
    want = groups(values)
    assert [found.get(v, v) for v in signed] == [signed[k] for k in want]


def test_bit_planes():
    r = np.random.default_rng(0)
    values = np.unique(np.concatenate([r.integers(0, 2**63, 200, dtype=np.uint64), np.uint64(9) ^ (np.uint64(1) << r.integers(0, 64, 90, dtype=np.uint64))]))
    bits = np.unpackbits(simhash.within(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")[:, : len(values)]
    assert (bits.astype(bool) == (np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)).all()


def test_texts(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (4, base + " tail"), (1, None), (2, ""), (7, " \n"), (8, "One Two"), (9, "one two"), (None, "one two"), (6, "É é"), (6, "É é"), (10, "É é É é")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, fp int, component int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            assert np.int64(by[i].fp).view(np.uint64) == np.uint64(plain(t)), i
    assert by[5].component_id == by[3].component_id == 3 and by[9].component_id == by[8].component_id == 8
    assert by[1].component_id == by[2].component_id == by[7].component_id == 1
    assert next(r for r in got if r.doc_id is None).component_id == 8
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component for r in got})
    assert {r.doc_id for r in kept.collect()} >= {1, 3, 8}


def test_only_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert simhash.representatives(docs).count() == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


def test_blocks_are_abandoned(monkeypatch):
    """Random values lie far apart: whole blocks go before all planes are read, and links are still found."""
    r = np.random.default_rng(1)
    values = r.integers(0, 2**63, 3000, dtype=np.uint64)
    values[2000] = values[5] ^ np.uint64(3)
    read = []
    monkeypatch.setattr(simhash, "planes_of", lambda v, f=simhash.planes_of: CountedPlanes(f(v), read))
    found = simhash.within(values)
    near = [(a, b) for a, b in zip(*np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little"))) if a != b]
    assert near == [(5, 2000), (2000, 5)]
    blocks = -(-3000 // 256) * -(-found.shape[1] // simhash.LANE_WORDS)
    assert len(read) < 0.7 * 64 * blocks


class CountedPlanes:
    def __init__(self, planes, read):
        self.planes, self.read, self.shape = planes, read, planes.shape

    def __iter__(self):
        return iter(self.planes)

    def __getitem__(self, at):
        self.read.append(at)
        return self.planes[at]


def test_small_groups_leave_stars():
    values = np.array([0, 1, 3, 7, 15, 1 << 40, 8, 8 + (7 << 50)], np.uint64)
    far, root = simhash.small_groups(values, np.array([0, 6]), np.array([6, 2]))
    assert list(zip(far, root)) == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0)]
