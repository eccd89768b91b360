"""Exact similarity search through a partitioned vector index.

The corpus is cut into cells around coarse centroids, fitted on a bounded sample. A cell knows its radius, the largest
angle between its centroid and one of its vectors, so a query at angle a from the centroid has no cosine above
cos(a - radius) in it. A query starts with its k-th best cosine in the sample and visits only the cells that can hold
something as good: the result is that of all pairs. Large cells are cut into chunks of bounded size. Each corpus vector
goes to one task, once; a task holds one chunk at a time and streams the queries that visit it past it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage

SAMPLE_ROWS = 8192
MOST_CELLS = 256
CHUNK_ROWS = 8192
QUERY_ROWS = 1024
SLACK = 2e-6  # covers the rounding of cosines to six decimals and of angles


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def shown(sims: np.ndarray) -> np.ndarray:
    """Cosines as they are shown: six decimals, 0 to 1."""
    np.round(sims, 6, out=sims)
    return np.clip(sims, 0.0, 1.0, out=sims)


def first_per_row(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest values of each row, ties by column: a partial selection finds the k-th value, and
    only what reaches it is ordered."""
    k = min(k, sims.shape[1])
    rows, cols = [], []
    for at in range(0, len(sims), 64):
        part = sims[at : at + 64]
        least = -np.partition(-part, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(part >= least[:, None])
        order = np.lexsort((c, -part[r, c], r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + at)
        cols.append(c[place < k])
    return np.concatenate(rows), np.concatenate(cols)


def coarse_centroids(sample: np.ndarray, n_cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample of unit vectors by spherical k-means; always the same for the same sample."""
    near = sample[np.random.default_rng(7).permutation(len(sample))[:n_cells]].copy()
    for _ in range(rounds):
        owner = (sample @ near.T).argmax(1)
        total = np.zeros_like(near)
        np.add.at(total, owner, sample)
        held = np.linalg.norm(total, axis=1) > 1e-9
        near[held] = unit(total[held])
    return near


@dataclass(frozen=True)
class Index:
    """A corpus in cells. Everything but ``rows`` is of bounded size. The last cell holds vectors without a direction."""

    rows: DataFrame  # cell, item, owner, vector
    centroids: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray
    sample_items: np.ndarray
    sample: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.centroids.T, -1.0, 1.0))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Upper bounds of the shown cosines of unit vectors with the vectors of each cell; -1 for empty cells."""
        most = np.cos(np.maximum(self.angles(vectors) - self.radius[:-1] - SLACK, 0.0))
        most = np.concatenate([np.maximum(most, 0.0), np.zeros((len(vectors), 1))], 1)
        return np.where(self.chunks > 0, np.minimum(most + SLACK, 1.0), -1.0)


def build_index(
    corpus: DataFrame, item: str, vector: str, owner: str | None = None, n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> Index:
    """Cells of all rows of the corpus that have a vector. About ``sample_rows`` rows (chosen by a hash of the id) fit the
    centroids; ``n_cells`` defaults to the square root of the rows, up to MOST_CELLS."""
    rows = corpus.filter(F.col(vector).isNotNull()).select(
        F.col(item).alias("item"), (F.col(owner) if owner else F.lit(None).cast("int")).alias("owner"), F.col(vector).cast("array<double>").alias("vector"))
    count = rows.count()
    share = min(1.0, sample_rows / max(count, 1))
    picked = rows.filter(F.pmod(F.xxhash64("item", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("item", "vector").limit(2 * sample_rows).toPandas()
    sample = unit(np.array(picked["vector"].tolist(), np.float64)) if len(picked) else np.zeros((0, 1))
    pointed = sample[np.abs(sample).sum(1) > 0] if len(sample) else sample
    wanted = n_cells or min(MOST_CELLS, max(1, round(count**0.5)))
    centroids = coarse_centroids(pointed, min(wanted, max(1, len(pointed)))) if len(pointed) else np.zeros((0, max(1, sample.shape[1])))
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            vectors = unit(matrix(batch.column("vector")))
            cell, angle = np.full(len(vectors), len(near), np.int32), np.zeros(len(vectors))
            pointed = np.flatnonzero(np.abs(vectors).sum(1) > 0) if len(near) else np.zeros(0, int)
            if len(pointed):
                cosines = vectors[pointed] @ near.T
                cell[pointed] = cosines.argmax(1)
                angle[pointed] = np.arccos(np.clip(cosines.max(1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    placed = cut_lineage(rows.mapInArrow(place, schema))
    size, radius = np.zeros(len(centroids) + 1, np.int64), np.zeros(len(centroids) + 1)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("a")).collect():  # a row a cell
        size[r["cell"]], radius[r["cell"]] = r["n"], r["a"]
    return Index(placed.drop("angle"), centroids, radius, -(-size // chunk_rows), picked["item"].to_numpy(), sample)


Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def visits(queries: DataFrame, index: Index, least: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, vector, cell, chunk) of every chunk a query has to see; ``least`` gives the cosine that still matters for
    a batch (its ids and its cosines with the sample)."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius, index.chunks, index.sample_items, index.sample))
    arrow = to_arrow_type(queries.schema["query"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(None, *shared.value)
        for batch in batches if known.chunks.any() else ():
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                vectors = unit(matrix(part.column("vector")))
                enough = least(part.column("query").to_numpy(zero_copy_only=False), shown(vectors @ known.sample.T))
                row, cell = np.nonzero(known.bounds(vectors) >= enough[:, None])
                times = known.chunks[cell]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                yield pa.RecordBatch.from_arrays(
                    [part.column("query").take(pa.array(row)).cast(arrow), part.column("vector").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(chunk)],
                    names=["query", "vector", "cell", "chunk"])

    schema = StructType([queries.schema["query"], StructField("vector", ArrayType(DoubleType())), StructField("cell", IntegerType()), StructField("chunk", LongType())])
    return queries.mapInArrow(run, schema)


def compare(queries: DataFrame, index: Index, least, reduce: Reduce, out: StructField, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query, ``out``, similarity) that ``reduce`` keeps of the cosines of a block of queries with a chunk."""
    counts = queries.sparkSession.createDataFrame([(c, int(n)) for c, n in enumerate(index.chunks) if n], "cell int, n long")
    item, owner = index.rows.schema["item"].dataType, index.rows.schema["owner"].dataType
    query = queries.schema["query"].dataType
    corpus = index.rows.join(F.broadcast(counts), "cell").select(
        "cell", F.pmod(F.xxhash64("item"), F.col("n")).alias("chunk"), F.lit(0).alias("side"), F.lit(None).cast(query).alias("query"), "item", "owner", "vector")
    asked = visits(queries, index, least).select(
        "cell", "chunk", F.lit(1).alias("side"), "query", F.lit(None).cast(item).alias("item"), F.lit(None).cast(owner).alias("owner"), "vector")
    rows = corpus.unionByName(asked).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "side", "owner", "item")
    types = [to_arrow_type(query), to_arrow_type(out.dataType), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, owners, held, ready = None, [], [], [], None
        for batch in batches:
            cell, chunk, side = (batch.column(c).to_numpy() for c in ("cell", "chunk", "side"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                if a == b:
                    continue
                if key != (cell[a], chunk[a]):
                    key, items, owners, held, ready = (cell[a], chunk[a]), [], [], [], None
                part = batch.slice(a, b - a)
                if not side[a]:
                    items.append(part.column("item").to_numpy(zero_copy_only=False))
                    owners.append(part.column("owner").to_numpy(zero_copy_only=False))
                    held.append(unit(matrix(part.column("vector"))))
                    continue
                if held and ready is None:
                    ready = np.concatenate(items), np.concatenate(owners), np.concatenate(held).T
                for at in range(0, b - a if held else 0, query_rows):
                    block = part.slice(at, query_rows)
                    ids = block.column("query").to_numpy(zero_copy_only=False)
                    sims = shown(unit(matrix(block.column("vector"))) @ ready[2])
                    found, what, value = reduce(sims, ids, ready)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found], types[0]), pa.array(what, types[1]), pa.array(value, types[2])], names=["query", out.name, "similarity"])

    return rows.mapInArrow(run, StructType([queries.schema["query"], out, StructField("similarity", DoubleType())]))


def as_queries(queries: DataFrame, query: str, vector: str) -> DataFrame:
    return queries.filter(F.col(vector).isNotNull()).select(F.col(query).alias("query"), F.col(vector).cast("array<double>").alias("vector"))


def nearest(queries: DataFrame, index: Index, k: int, least: float = 0.0, query: str = "query_id", item: str = "item_id", vector: str = "vector",
            skip_same: bool = False, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Up to k items per query and chunk among which are the k nearest of all with a cosine of at least ``least``;
    ``skip_same`` leaves out the item with the query's own id."""
    mine = index.sample_items

    def worth(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        if skip_same:
            sims = np.where(ids[:, None] == mine[None, :], -1.0, sims)
        if sims.shape[1] < k:
            return np.full(len(ids), least)
        return np.maximum(np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k], least)

    def reduce(sims: np.ndarray, ids: np.ndarray, chunk: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if skip_same:
            sims = np.where(ids[:, None] == chunk[0][None, :], -1.0, sims)
        order = np.argsort(chunk[0], kind="stable")
        rows, cols = first_per_row(sims[:, order], k)
        value = sims[rows, order[cols]]
        good = value >= least
        return rows[good], chunk[0][order[cols[good]]], value[good]

    found = compare(as_queries(queries, query, vector), index, worth, reduce, StructField("item", index.rows.schema["item"].dataType), query_rows)
    return found.select(F.col("query").alias(query), F.col("item").alias(item), "similarity")


def best_owners(queries: DataFrame, index: Index, least: float, query: str = "query_id", owner: str = "owner", vector: str = "vector", skip_same: bool = False) -> DataFrame:
    """Best cosine of every (query, owner of items) that reaches ``least`` (above 0)."""

    def reduce(sims: np.ndarray, ids: np.ndarray, chunk: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if skip_same:
            sims = np.where(ids[:, None] == chunk[0][None, :], -1.0, sims)
        owners, starts = np.unique(chunk[1], return_index=True)  # a chunk is in the order of its owners
        best = np.maximum.reduceat(sims, starts, axis=1)
        rows, cols = np.nonzero(best >= least)
        return rows, owners[cols], best[rows, cols]

    worth = lambda ids, sims: np.full(len(ids), least)
    found = compare(as_queries(queries, query, vector), index, worth, reduce, StructField("owner", index.rows.schema["owner"].dataType))
    return found.groupBy(F.col("query").alias(query), F.col("owner").alias(owner)).agg(F.max("similarity").alias("similarity"))
