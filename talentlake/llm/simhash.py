"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints of whole texts are reduced to distinct values. Two values within two bits agree in at least two of four
16-bit blocks, so each value enters six buckets, one per pair of blocks. Inside a bucket the values stand vertically, as
bit planes; the distances of many values are kept in carry-save counters that are updated plane by plane, and a block of
comparisons is abandoned once all its lanes exceed the radius. A bucket leaves a star of links per group of linked values,
never its pairs. A bucket above the limit is dealt into pairs of blocks. Stars are joined to components by alternating
minimum steps on stored tables.

Defined results: texts without words (null included) have fingerprint zero and link like any other; texts of fewer than
three words are one shingle; repeated rows fall together; a component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import slices, stored

RADIUS = 2
BLOCKS = 4
SHINGLE = 3
SEED = 42
LANE_WORDS = 16  # a block of 1024 values, abandoned as one
LIMIT = 4096


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (64 bits as a signed long) and a hash of the whole text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            found = np.array([simhash(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_hash")], names=["doc_id", "fp", "text_hash"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, text_hash long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): plane b holds bit b of every value, 64 values to a word."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(values: np.ndarray, radius: int = RADIUS, rows: int = 256) -> np.ndarray:
    """Adjacency bits (n, words) of values at most ``radius`` (0 to 2) bits apart."""
    planes = planes_of(values)
    ones = np.array([np.bitwise_count(p).sum() for p in planes], np.int64)
    order = [b for b in np.argsort(-np.minimum(ones, len(values) - ones), kind="stable") if 0 < ones[b] < len(values)]
    out = np.zeros((len(values), planes.shape[1]), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    lanes = np.packbits(np.arange(planes.shape[1] * 64) < len(values), bitorder="little").view(np.uint64)
    for at, first in product(range(0, len(values), rows), range(0, planes.shape[1], LANE_WORDS)):
        alive = np.arange(at, min(at + rows, len(values)))
        block = slice(first, first + LANE_WORDS)
        over = np.broadcast_to(~lanes[block], (len(alive), len(lanes[block]))).copy()
        own = (alive >> 6) - first  # a value's own lane never exceeds the radius, so it counts as exceeded
        here = np.flatnonzero((own >= 0) & (own < over.shape[1]))
        over[here, own[here]] |= np.uint64(1) << (alive[here] & 63).astype(np.uint64)
        one, two = np.zeros_like(over), np.zeros_like(over)
        for step, b in enumerate(order):
            mine = ((values[alive] >> np.uint64(b)) & np.uint64(1)) * full
            differ = planes[b][None, block] ^ mine[:, None]
            carry = one & differ
            one ^= differ
            over |= two & carry
            two |= carry
            over |= (one & two) if radius == 2 else (two if radius == 1 else one | two)
            if step % 6 == 5:
                going = ~(over == full).all(axis=1)
                if not going.all():  # every lane exceeds the radius: the block is abandoned for these values
                    alive, one, two, over = alive[going], one[going], two[going], over[going]
                    if not len(alive):
                        break
        if len(alive):
            out[alive, block] = ~over
    each = np.arange(len(values))
    out[each, each >> 6] |= np.uint64(1) << (each & 63).astype(np.uint64)
    return out


def small_groups(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars (index, first index of its connected group) inside many small groups: each pair of values is one lane of the
    counters, and of its links only the stars leave."""
    left, right = [], []
    for size in np.unique(sizes):
        at = starts[sizes == size]
        a, b = np.triu_indices(int(size), 1)
        left.append((at[:, None] + a).ravel())
        right.append((at[:, None] + b).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    keep_left, keep_right = [], []
    for k in range(0, len(left), 1 << 18):
        x, y = left[k : k + (1 << 18)], right[k : k + (1 << 18)]
        planes = planes_of(values[x] ^ values[y])
        one = np.zeros(planes.shape[1], np.uint64)
        two, over = one.copy(), one.copy()
        for differ in planes:
            carry = one & differ
            one ^= differ
            over |= two & carry
            two |= carry
            over |= (one & two) if radius == 2 else (two if radius == 1 else one | two)
        near = np.unpackbits((~over).view(np.uint8), bitorder="little")[: len(x)].astype(bool)
        keep_left.append(x[near])
        keep_right.append(y[near])
    left, right = np.concatenate(keep_left), np.concatenate(keep_right)
    root = np.arange(int(starts.max() + sizes.max())) if len(starts) else np.zeros(0, np.int64)
    while (root[left] != root[right]).any():
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
    far = np.unique(np.concatenate([left, right]))
    far = far[root[far] != far]
    return far, root[far]


def stars(adjacent: np.ndarray) -> np.ndarray:
    """For every value the first value of its connected group."""
    n = len(adjacent)
    root = np.full(n, -1, np.int64)
    unseen = np.packbits(np.arange(adjacent.shape[1] * 64) < n, bitorder="little").view(np.uint64).copy()
    for first in range(n):
        if root[first] >= 0:
            continue
        wave = [first]
        unseen[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        while wave:
            i = wave.pop()
            root[i] = first
            found = adjacent[i] & unseen
            if found.any():
                unseen &= ~found
                wave.extend(np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist())
    return root


def links(values: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b), b below a as signed numbers, whose connected groups are those of all pairs within the radius."""
    width = 64 // BLOCKS
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    block = lambda i: F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))
    keys = F.array(*[F.xxhash64(F.lit(t), *[block(i) for i in blocks]) for t, blocks in enumerate(tables)])
    keyed = values.select("fp", F.explode(keys).alias("key"))
    parts = keyed.groupBy("key").count().filter(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("n"))
    # A bucket above the limit: every value goes to the pairs of blocks that hold its own block.
    mine = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("n")).cast("int")
    meets = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.least(o, mine) * F.col("n") + F.greatest(o, mine)))
    dealt = keyed.join(parts, "key", "left").select("key", "fp", F.explode(meets).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, fp, cell = (table.column(c).to_numpy() for c in ("key", "fp", "cell"))
        order = np.lexsort((fp, cell, key))
        key, fp, cell = key[order], fp[order], cell[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        unsigned = fp.view(np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        few = (sizes > 1) & (sizes <= 24)
        if few.any():
            a, b = small_groups(unsigned, starts[few], sizes[few])
            left.append(fp[a])
            right.append(fp[b])
        for at, size in zip(starts[sizes > 24], sizes[sizes > 24]):
            own = np.ascontiguousarray(unsigned[at : at + size])
            root = stars(within(own))
            far = np.flatnonzero(root != np.arange(size))
            left.append(fp[at + far])
            right.append(fp[at + root[far]])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.repartition("key", "cell").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): every node that has an edge (a > b) with the smallest node of its component. Alternates large-star
    and small-star steps; minima are pre-aggregated, so no neighbourhood is ever gathered."""
    edges = stored(edges.select("a", "b"), name)
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if (state["n"], state["x"]) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        seen = (state["n"], state["x"])
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)


def grouped(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds to ``prints`` (doc_id, fp, text_hash) the component of every row, given the roots of linked values of fp."""
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", F.col("root").alias("component"), "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "text_hash", "component", "component_id")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, fp, text_hash, component (its smallest fingerprint) and component_id (its smallest doc_id) of every row."""
    prints = stored(fingerprints(docs), "simhash")
    return grouped(prints, components(links(prints.select("fp").distinct(), limit), "simhash-links"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of ``groups``: that with the smallest doc_id (null last, ties by a hash of
    the text)."""
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    name = lambda d, h: F.struct(F.coalesce(d.cast("string"), F.lit("")).alias("id"), d.isNull().alias("none"), h.alias("text"))
    kept = groups.groupBy("component").agg(F.min(rank).alias("r")).select(name(F.col("r.doc_id"), F.col("r.text_hash")).alias("name"))
    keyed = docs.select(F.struct("*").alias("row"), name(F.col("doc_id"), F.xxhash64("text")).alias("name"))
    return keyed.join(kept, "name", "left_semi").dropDuplicates(["name"]).select("row.*")


def representatives(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates."""
    return one_of_each(docs, near_duplicates(docs, limit))
