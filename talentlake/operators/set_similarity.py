"""Groups of similar records: an exact set-similarity join by prefix filtering.

Records are sets of tokens, similar from a Jaccard similarity on. Two sets of similarity t share a token among the first
n - ceil(t n) + 1 of each in any common order of all tokens, and if they share two tokens at all, two among the first
n - ceil(t n) + 2. So records meet by pairs of prefix tokens, which far fewer records hold than one token. Sets of more than
``PAIRED`` tokens, and those that need share one token only, meet by single prefix tokens. The order puts rare tokens first:
it ranks tokens by the count of their hash bucket (a table of fixed size), then by hash.

Equal sets are joined first and enter once. A key (the hash of a token or of a pair) of many sets is dealt into pairs of blocks, each a cell of a
bounded number of sets; a cell is compared in one task and leaves one link per set to the first of its group, never its
pairs. Cells of a few sets are compared together and leave their similar pairs. The links' connected components are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.graph import connected_groups
from ..plans.skew import salted_join
from ..session import cut_lineage

RANK_BUCKETS = 1 << 14  # counts that order the tokens
CELL_SETS = 512  # sets of a block; a cell holds two blocks at most
PAIRED = 64  # tokens of the largest set that meets by pairs of tokens
FEW = 8  # sets of a cell that is compared pair by pair
SLACK = 1e-9


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(RANK_BUCKETS))


def in_rank_order(sets: DataFrame) -> Column:
    """The tokens of a row of ``sets`` (column ``_tokens``), rare ones first."""
    counts = sets.select(F.explode(F.transform("_tokens", bucket_of)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    held = np.zeros(RANK_BUCKETS, np.int64)
    for bucket, n in counts.collect():  # RANK_BUCKETS rows at most
        held[bucket] = n
    ranks = np.argsort(np.argsort(held, kind="stable")).astype(">u2").tobytes()
    rank = lambda t: F.substring(F.lit(bytearray(ranks)), bucket_of(t).cast("int") * 2 + 1, F.lit(2))
    placed = F.transform("_tokens", lambda t: F.struct(rank(t).alias("n"), F.xxhash64(t).alias("h"), t.alias("t")))
    return F.array_sort(placed)["t"]


def meeting_keys(sets: DataFrame, threshold: float, paired: int = PAIRED) -> Column:
    """Of a row of ``sets`` the keys by which it meets every set that reaches the threshold.

    Two sets that must share two tokens (one of them needs as many) hold a pair in common if both have at most ``paired``
    tokens. If one has more, the other has at least ``threshold * paired``: both then have single keys, as have two sets
    that may share one token only.
    """
    size = F.size("_tokens")
    need = F.ceil(size * F.lit(threshold) - SLACK)
    first = lambda ordered, more: F.slice(ordered, F.lit(1), (size - need + more).cast("int"))
    none = F.array().cast("array<bigint>")

    def keys(ordered: Column) -> Column:
        one = F.transform(first(ordered, 1), lambda t: F.xxhash64(t))
        two = let(first(ordered, 2), lambda p: F.flatten(F.transform(p, lambda t, i: F.transform(
            F.slice(p, i + 2, F.size(p)), lambda u: F.xxhash64(t, F.lit("\x00"), u)))))
        return F.concat(F.when((need < 2) | (size >= threshold * paired - SLACK), one).otherwise(none), F.when((size <= paired) & (size > 1), two).otherwise(none))

    return let(in_rank_order(sets), keys)


def similar_links(sets: DataFrame, threshold: float, cell_sets: int = CELL_SETS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b), b below a, between the nodes of ``sets`` (node, _tokens; distinct sets) whose connected groups are
    those of all pairs with a Jaccard similarity of at least ``threshold`` (above 0)."""
    keyed = sets.filter(F.size("_tokens") > 0).select("node", "_tokens", F.explode(meeting_keys(sets, threshold, paired)).alias("token"))
    shared = keyed.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "token", F.ceil(F.col("n") / cell_sets).cast("int").alias("blocks"))
    met = salted_join(keyed, shared, ["token"], F.col("node"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, mine) * F.col("blocks") + F.greatest(o, mine))
    dealt = met.select("token", F.explode(cells).alias("cell"), "node", "_tokens")
    rows = dealt.repartition("token", "cell").sortWithinPartitions("token", "cell", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, edges in whole_cells(batches):
            left, right = pair_links(cells.column("node").to_numpy(), cells.column("_tokens"), edges, threshold)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])
            for at, end in zip(edges[:-1], edges[1:]):
                if end - at > FEW:
                    cell = cells.slice(at, end - at)
                    left, right = star_links(cell.column("node").to_numpy(), cell.column("_tokens"), threshold)
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return rows.select("token", "cell", "node", "_tokens").mapInArrow(run, "a long, b long").distinct()


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of complete cells with the edges of the runs of one (token, cell)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        token, cell = held.column("token").to_numpy(), held.column("cell").to_numpy()
        cuts = np.flatnonzero((token[1:] != token[:-1]) | (cell[1:] != cell[:-1])) + 1
        if len(cuts):
            yield held.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def pair_links(nodes: np.ndarray, tokens: pa.ChunkedArray, edges: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The similar pairs of all cells of at most ``FEW`` sets at once; a pair that meets in several cells is compared once."""
    starts, sizes = edges[:-1], np.diff(edges)
    one, two = [], []
    for n in range(2, FEW + 1):
        i, j = np.triu_indices(n, 1)
        at = starts[sizes == n][:, None]
        one.append((at + i).ravel())
        two.append((at + j).ravel())
    one, two = np.concatenate(one), np.concatenate(two)
    if not len(one):
        return nodes[:0], nodes[:0]
    place = np.unique(nodes, return_inverse=True)[1]
    first = np.unique(place[one] * len(nodes) + place[two], return_index=True)[1]
    one, two = one[first], two[first]
    lists = pa.concat_arrays(tokens.chunks)
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    held = lists.value_lengths().to_numpy().astype(np.int64)
    begin, bound = np.cumsum(held) - held, ids.max() + 1

    def keys(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = held[row]
        pair = np.repeat(np.arange(len(row)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pair, pair * bound + ids[np.repeat(begin[row], n) + inside]

    pair, mine = keys(one)
    shared = np.bincount(pair[np.isin(mine, keys(two)[1], assume_unique=True)], minlength=len(one))
    near = shared >= threshold * (held[one] + held[two] - shared) - SLACK
    return nodes[two[near]], nodes[one[near]]


def star_links(nodes: np.ndarray, tokens: pa.ChunkedArray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a cell that is similar to an earlier one, directly or over others, the first set of its group."""
    lists = pa.concat_arrays(tokens.chunks)
    ids = lists.flatten().dictionary_encode().indices.to_numpy()
    ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    root, open_ = np.full(len(nodes), -1, np.int64), np.ones(len(nodes), bool)
    for first in range(len(nodes)):
        if not open_[first]:
            continue
        open_[first], wave = False, [first]
        root[first] = first
        while wave and open_.any():
            i = wave.pop()
            mark = np.zeros(ids.max() + 1, bool)
            mark[ids[ends[i] : ends[i + 1]]] = True
            shared = np.bincount(owner[mark[ids]], minlength=len(nodes))
            near = open_ & (shared >= threshold * (sizes + sizes[i] - shared) - SLACK)
            root[near], open_[near] = first, False
            wave.extend(np.flatnonzero(near).tolist())
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def similar_groups(records: DataFrame, key: str, tokens: Column, threshold: float, cell_sets: int = CELL_SETS, paired: int = PAIRED) -> DataFrame:
    """(key, group): the smallest key of each record's group; ``key`` is a unique integer.

    Records link at a Jaccard similarity of at least ``threshold``; a null or empty set is similar to other empty sets only.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and is at most 1")
    clean = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(tokens, F.array().cast("array<string>")))))
    marked = records.select(F.col(key), clean.alias("_tokens"))
    sets = cut_lineage(marked.groupBy("_tokens").agg(F.min(F.col(key).cast("long")).alias("node")))
    roots = connected_groups(similar_links(sets, threshold, cell_sets, paired))
    grouped = sets.join(roots, "node", "left").select("_tokens", F.coalesce("root", "node").alias("group"))
    return salted_join(marked, grouped, ["_tokens"], F.col(key)).select(key, "group")
