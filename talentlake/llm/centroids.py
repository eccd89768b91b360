"""Centroid clustering in exact integers; nearest centroids by a threshold algorithm.

Every dimension holds the centroids sorted by their value there. For a vector the lists are walked outward from its own
value, one step in every dimension a round; each centroid met for the first time gets its exact distance. A centroid not
met yet lies beyond the frontier in every dimension, so its squared distance is at least the sum of the squared frontier
gaps: the walk of a vector stops when that sum strictly exceeds its best distance (strictly, because a centroid at the
same distance with a smaller number wins).

A round is one pass: tasks assign Arrow slices and return one row of partial sums per centroid, which are then combined;
only the centroids (``k`` rows) reach the driver and go to every task. Sums and distances are 64-bit integers.

Defined results: vectors of another length, null vectors and vectors with a null or non-finite component are left out;
scaled components beyond ``LARGEST`` are set to it, which keeps every distance in 64 bits; repeated rows count one by one;
rows without an id are clustered but never start a centroid before rows with one; with fewer vectors than ``k`` there are
as many centroids as vectors, with none the result is empty. Other columns do not matter and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LARGEST = 2**27  # 64 squared differences of up to 2^28 stay below 2^63
SLICE = 2048
PAIRS = 1 << 15


def scaled(vector: Column, scale: float) -> Column:
    """Integer components floor(scale * x), x as double."""
    whole = lambda x: F.floor(F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST))))
    return F.transform(vector, whole)


def usable(vector: Column, dims: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return (F.size(vector) == dims) & ~F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True)))


class Lists:
    """Per dimension the centroids in the order of their values there."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable").T  # dims x k
        self.values = np.take_along_axis(self.centroids.T, self.order, 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector."""
        n, (dims, k) = len(vectors), self.order.shape
        number, best = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max)
        seen = np.zeros((n, k), bool)
        right = np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in range(dims)], 1)
        left = right - 1
        live, every = np.arange(n), np.arange(dims)
        far = np.iinfo(np.int32).max
        gaps = lambda x, l, r: (
            np.where(l >= 0, x - self.values[every, np.maximum(l, 0)], far), np.where(r < k, self.values[every, np.minimum(r, k - 1)] - x, far))
        below, above = gaps(vectors, left, right)
        while len(live):
            down = below <= above
            met = self.order[every, np.where(down, left, right).clip(0, k - 1)]
            new = np.zeros((len(live), k), bool)
            np.put_along_axis(new, met, True, 1)
            new &= ~seen[live]
            seen[live] |= new
            rows, found = np.nonzero(new)  # in the order of the centroids' numbers within a row
            for at in range(0, len(rows), PAIRS):
                part, c = rows[at : at + PAIRS], found[at : at + PAIRS]
                step = vectors[live[part]] - self.centroids[c]
                exact = np.einsum("ij,ij->i", step, step)
                order = np.lexsort((c, exact, part))
                first = order[np.unique(part[order], return_index=True)[1]]
                at_row, d, c = live[part[first]], exact[first], c[first]
                better = (d < best[at_row]) | (d == best[at_row]) & (c < number[at_row])
                best[at_row[better]], number[at_row[better]] = d[better], c[better]
            left, right = left - down, right + ~down
            below, above = gaps(vectors[live], left, right)
            frontier = np.minimum(below, above)
            done = (frontier == far).any(1)  # a list walked to its end has shown every centroid
            going = ~done & (np.einsum("ij,ij->i", frontier, frontier, dtype=np.float64) <= best[live].astype(np.float64) * (1 + 1e-9))
            exact_sum = np.zeros(len(live), np.int64)
            exact_sum[going] = (frontier[going] ** 2).sum(1)
            going &= exact_sum <= best[live]
            live, left, right, below, above = live[going], left[going], right[going], below[going], above[going]
        return number, best


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sums(vectors: DataFrame, lists: Lists) -> DataFrame:
    """Per centroid the number of its vectors and the sums of their components."""
    k, dims = lists.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = matrix(batch.slice(at, SLICE).column("v"), dims)
                number, _ = lists.nearest(x)
                np.add.at(total, number, x)
                count += np.bincount(number, minlength=k)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, n long, total array<long>")
    counts = parts.groupBy("cluster").agg(F.sum("n").alias("n"))
    each = parts.select("cluster", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
    return each.join(counts, "cluster")


def fit(vectors: DataFrame, k: int, rounds: int, seed: str) -> np.ndarray:
    """Centroids after the rounds; ``vectors`` has an id and the integer components ``v``."""
    hashed = vectors.select("v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"))
    first = hashed.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for r in sums(vectors, Lists(centroids)).collect():  # k x dims rows
            moved[r.cluster, r.d] = r.x // r.n
        centroids = moved
    return centroids


def cluster(
    table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, id_column: str = "vec_id",
    vector_column: str = "embedding", seed: str = "1:",
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia and the cluster's centroid."""
    spark = table.sparkSession
    vector = F.col(vector_column)
    vectors = stored(table.filter(usable(vector, dims)).select(F.col(id_column).alias("id"), scaled(vector, scale).alias("v")), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    lists = Lists(centroids) if len(centroids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                number, distance = lists.nearest(matrix(part.column("v"), dims))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    kind = vectors.schema["id"].dataType.simpleString()
    assigned = stored(vectors.mapInArrow(run, f"id {kind}, cluster int, distance long"), "assigned")
    per_cluster = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(per_cluster.values())
    rows = [(c, s, total, [int(x) for x in centroids[c]]) for c, s in sorted(per_cluster.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")  # k rows
    return assigned.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """Lowercase hex sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)

