"""The partitioned vector index against all cosines."""

import numpy as np
import pytest

from talentlake.operators import joins as jn
from talentlake.operators import vector_index


def vectors(seed, n, dims=8):
    r = np.random.default_rng(seed)
    at = r.normal(size=(12, dims))
    out = at[r.integers(0, 12, n)] + 0.2 * r.normal(size=(n, dims))
    out[: n // 4] = at[0]  # a quarter of all rows is one vector
    out[n // 4 : n // 4 + 3] = 0
    out[n // 4 + 3] = -at[0]
    return out.round(3)


def frame(spark, rows, key):
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in rows], f"{key} long, vector array<double>")


def cosines(q, c):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return np.clip(np.round(unit(q) @ unit(c).T, 6), 0, 1)


@pytest.mark.parametrize("k, cells, chunk, least", [(5, None, 8192, 0.0), (3, 30, 16, 0.0), (1, 7, 50, 0.9), (400, 4, 64, 0.0)])
def test_search_equals_all_cosines(spark, k, cells, chunk, least):
    v = vectors(k, 300)
    rows = [*enumerate(v)]
    queries = [x for x in rows if x[0] % 9 == 0] + [(78, v[78])]
    got = jn.top_k_similar(frame(spark, queries, "query_id"), frame(spark, rows, "item_id"), k, corpus_block=chunk, n_cells=cells, least=least, skip_same=True, query_block=4)
    sims = cosines(np.array([x for _, x in queries]), v)
    want = set()
    for (q, _), row in zip(queries, sims):
        best = sorted((-s, i) for i, s in enumerate(row.tolist()) if i != q and s >= least)[:k]
        want |= {(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.item_id, r.similarity, r["rank"]) for r in got.collect()} == want


def test_owners_equal_all_cosines(spark):
    v = vectors(4, 300)
    rows, queries = [*enumerate(v)], [(k, v[k]) for k in range(0, 300, 11)]
    corpus = frame(spark, rows, "item_id").selectExpr("*", "item_id % 7 AS owner")
    got = jn.best_per_owner(frame(spark, queries, "query_id"), corpus, "owner", 0.8, skip_same=True, n_cells=9)
    want = {}
    for (q, _), row in zip(queries, cosines(np.array([x for _, x in queries]), v)):
        for i, s in enumerate(row.tolist()):
            if i != q and s >= 0.8:
                want[q, i % 7] = max(want.get((q, i % 7), 0), s)
    assert {(r.query_id, r.owner): r.similarity for r in got.collect()} == want


def test_far_cells_are_not_visited(spark):
    r = np.random.default_rng(3)
    at = np.eye(8)
    v = at[np.arange(400) % 8] + 0.02 * r.normal(size=(400, 8))
    index = vector_index.build_index(frame(spark, enumerate(v), "item_id"), "item_id", "vector", n_cells=8)
    queries = vector_index.as_queries(frame(spark, [(k, v[k]) for k in range(80)], "query_id"), "query_id", "vector")
    seen = vector_index.visits(queries, index, lambda ids, sims: -np.sort(-sims, 1)[:, 4]).count()
    assert seen < 0.5 * 80 * (index.chunks > 0).sum()


def test_empty_sides(spark):
    some, none = frame(spark, [(1, [1.0, 0.0])], "item_id"), frame(spark, [], "item_id")
    asked = frame(spark, [(1, [1.0, 0.0])], "query_id")
    assert jn.top_k_similar(asked, none, 2).count() == 0 and jn.top_k_similar(asked.limit(0), some, 2).count() == 0
    assert jn.top_k_similar(asked, some, 2).collect()[0].similarity == 1.0
