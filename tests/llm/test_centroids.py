"""Centroid clustering against plain arithmetic over all distances."""

import hashlib
import math

import numpy as np
import pytest

from talentlake.llm import centroids
from talentlake.llm.queries import QUERIES


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), c in zip(kept, found) if c == j]
            at[j] = [sum(x) // len(own) for x in zip(*own)] if own else at[j]
    last = [near(v) for _, v in kept]
    inertia = lambda j: sum(d for d, c in last if c == j)
    return sorted((str(i), c, d, inertia(c), sum(x for x, _ in last), ",".join(map(str, at[c]))) for (i, _), (d, c) in zip(kept, last))


def found(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, ",".join(map(str, r.centroid))) for r in df.collect())


@pytest.mark.parametrize("k, spread", [(1, 3), (5, 1), (16, 2), (40, 50)])
def test_threshold_walk_equals_all_distances(k, spread):
    r = np.random.default_rng(k)
    at, x = r.integers(-spread, spread + 1, (k, 6)), r.integers(-spread, spread + 1, (3000, 6))  # many ties
    number, best = centroids.Lists(at).nearest(x)
    d = ((x[:, None] - at[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()


def test_walk_stops_early():
    at, seen = np.arange(0, 1000, 10)[:, None] * np.ones((1, 4), int), []
    lists = centroids.Lists(at)
    lists.order = CountedOrder(lists.order, seen)
    number, _ = lists.nearest(at[50:51] + 1)
    assert number[0] == 50 and len(seen) <= 2


class CountedOrder:
    def __init__(self, order, seen):
        self.order, self.seen, self.shape = order, seen, order.shape

    def __getitem__(self, at):
        self.seen.append(1)
        return self.order[at]


def test_odd_vectors(spark):
    r = np.random.default_rng(1)
    v = lambda: [float(x) for x in r.normal(0, 0.2, 64)]
    same = v()
    rows = [(i, v()) for i in range(60)] + [(i, same) for i in range(60, 100)] + [(7, same), (7, same), (None, v()), (200, None), (201, []), (202, v()[:63]), (203, v() + [0.0])]
    rows += [(204, v()[:63] + [None]), (205, v()[:63] + [float("nan")]), (206, v()[:63] + [float("-inf")])]
    docs = spark.createDataFrame([(i, x, 1, "a", 2) for i, x in rows], "vec_id long, embedding array<float>, cluster int, v string, id int")
    exact = [(i, x and [y if y is None else float(np.float32(y)) for y in x]) for i, x in rows]
    assert found(centroids.cluster(docs)) == brute(exact)
    assert found(centroids.cluster(docs.limit(5))) == brute([(r.vec_id, r.embedding) for r in docs.limit(5).collect()])
    assert centroids.cluster(docs.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    assert [x.distance for x in centroids.cluster(huge).collect()] == [0, 0]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()])
    got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in QUERIES["op11_centroids"](spark, folder).collect())
    assert got == [(*x[:5], hashlib.sha256(x[5].encode()).hexdigest()) for x in want]
