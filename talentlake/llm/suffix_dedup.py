"""Removal of repeated byte strings with a suffix order of many short strings.

Windows of 50 bytes that are equal meet in one bucket (see ``windows``), where the distinct segments form a collection of
strings. Its Burrows-Wheeler transform is built column by column: every round inserts one symbol of each string, walking
from its end, and updates the transform and the common prefixes, both kept in files that are read and written once from
front to back. A symbol is a block of eight bytes and a segment enters eight times, shifted by one byte each, which gives
the same order of all suffixes in an eighth of the rounds. The order of the transform's symbols grows with it: a round
sorts its own symbols alone and merges them. Neighbours whose common prefix reaches 50 are equal windows; the smallest doc_id of each such
group is the document that keeps the string.

Defined results: a null text is empty; texts under 50 bytes and strings repeated inside one document stay; repeated
rows with one doc_id keep their text; a null doc_id sorts last; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import BYTES, Text, mark_repeats


PACK = 4, 8  # bytes of a symbol: the least, and what buckets are indexed with
LOWER = np.uint64(0xFFFFFFFF)


class Columns:
    """Strings of blocks aligned at their ends; column j holds the number of the j-th block from the end, 0 past the start.

    A block is ``pack`` bytes (4 or 8; zeros fill the last one) and the symbol of the transform, so a string enters once for
    each of its first ``pack`` places. Numbers follow the order of the blocks and fit 16 bits unless a bucket has more blocks.
    """

    def __init__(self, strings: list[bytes], pack: int = PACK[0]):
        self.pack = pack
        lengths = np.array([len(s) for s in strings], np.int64)
        longest = int(lengths.max()) + 2 * pack
        raw = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in strings), np.uint8).reshape(len(strings), longest)
        self.owner = np.repeat(np.arange(len(strings)), pack)
        self.shift = np.tile(np.arange(pack), len(strings))
        self.lengths = np.maximum(-(-(lengths[self.owner] - self.shift) // pack), 0)  # in blocks
        width = int(self.lengths.max())
        blocks = np.empty((len(strings), pack, width), f"u{pack}")
        for a in range(pack):
            blocks[:, a] = np.ascontiguousarray(raw[:, a : a + width * pack]).view(f">u{pack}")
        blocks = blocks.reshape(len(self.owner), width)
        column = self.lengths[:, None] - 1 - np.arange(width)[None, :]
        inside = column >= 0
        flat = blocks[np.arange(len(self.owner))[:, None], np.maximum(column, 0)]
        self.blocks, number = np.unique(flat[inside], return_inverse=True)
        self.symbols = np.zeros((width, len(self.owner)), np.uint16 if len(self.blocks) < 65535 else np.uint32)
        self.symbols.T[inside] = number + 1

    def column(self, j: int) -> np.ndarray:
        return self.symbols[j] if j < len(self.symbols) else np.zeros(len(self.owner), self.symbols.dtype)

    def common_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Leading bytes that two different blocks share."""
        x = self.blocks[a.astype(np.int64) - 1] ^ self.blocks[b.astype(np.int64) - 1]
        shared = np.zeros(len(x), np.int32)
        if self.pack == 8:  # half a block at a time: a double holds 32 bits exactly
            upper = x >> np.uint64(32)
            shared[upper == 0] = 4
            x = np.where(upper == 0, x, upper)
        return (shared + (32 - np.frexp(x.astype(np.float64))[1] >> 3)).astype(np.uint8)


def range_minima(values: np.ndarray, start: np.ndarray, stop: np.ndarray, block: int = 64) -> np.ndarray:
    """min(values[start:stop]) of every non-empty range. Tables of doubled ranges cover up to a block; a longer range is its
    first and last block and, between them, whole blocks."""
    if len(values) < 2 * block:
        values = np.concatenate([values, np.full(2 * block - len(values), np.iinfo(values.dtype).max, values.dtype)])
    size = stop - start
    out = doubled(values, block.bit_length(), start, stop, np.minimum(size, block))
    long = np.flatnonzero(size > block)
    if len(long):
        first, last = -(-start[long] // block), stop[long] // block
        inner = last > first
        whole = values[: len(values) // block * block].reshape(-1, block).min(1)
        some, first, last = long[inner], first[inner], last[inner]
        if len(some):
            size = last - first
            out[some] = np.minimum(out[some], doubled(whole, int(size.max()).bit_length(), first, last, size))
    return out


def doubled(values: np.ndarray, levels: int, start: np.ndarray, stop: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Minima of the first and the last 2^k values of every range, 2^k its ``size`` rounded down to a power of two."""
    table = np.empty((levels, len(values)), values.dtype)
    table[0] = values
    for k in range(1, levels):
        half, n = 1 << (k - 1), len(values) - (1 << k) + 1
        np.minimum(table[k - 1, :n], table[k - 1, half : half + n], out=table[k, :n])  # places behind n are never read
    level = np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1
    row, flat = level * len(values), table.ravel()
    return np.minimum(flat[row + start], flat[row + stop - np.left_shift(1, level)])


class Column:
    """An array in a file that is written and read from front to back; it stays in memory up to a bound."""

    def __init__(self, kind: np.dtype, bound: int = 16 << 20):
        self.file, self.kind = tempfile.SpooledTemporaryFile(bound), kind

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(memoryview(np.ascontiguousarray(values)).cast("B"))
        self.file.truncate()

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)


def suffix_order(columns: Columns, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the collection (block numbers, 0 at a string's start) and the common prefix in bytes,
    up to ``cap``, of each suffix with the one before it. The empty suffixes come first, in the order of the strings."""
    symbols, common, _ = transform(columns, cap)
    return symbols, common


def transform(columns: Columns, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``suffix_order`` and the places of the transform in the order of their symbols: suffixes led by a symbol stand in the
    order of that symbol in the transform."""
    n, kind = len(columns.owner), columns.symbols.dtype
    bwt, lcp = Column(kind), Column(np.dtype(np.uint8))
    bwt.write(columns.column(0))
    lcp.write(np.zeros(n, np.uint8))
    place = np.arange(n)  # where the newest suffix of each string stands
    active = np.arange(n)
    led = merged_places(np.zeros(0, np.uint64), columns.column(0), place)
    for j in range(1, int(columns.lengths.max()) + 1):
        symbols, common = bwt.read(), lcp.read()
        active = active[columns.lengths[active] >= j]
        order = places(led)
        fresh = ranks(order, len(symbols))[place[active]]
        # New common prefixes: of each new suffix with the one before it, and of the one behind it.
        touched = np.zeros(len(order) + 1, bool)
        touched[fresh] = True
        touched[fresh + 1] = True
        touched[0] = touched[-1] = False  # nothing but the empty suffixes stands before the first
        touched = np.flatnonzero(touched)
        before, after = order[touched - 1], order[touched]
        x, y = symbols[before], symbols[after]
        same, other = np.flatnonzero(x == y), np.flatnonzero(x != y)
        value = np.empty(len(touched), np.uint8)
        value[same] = np.minimum(range_minima(common, before[same] + 1, after[same] + 1) + columns.pack, cap)
        value[other] = columns.common_bytes(x[other], y[other])
        place[active] = n + fresh
        old = np.ones(n + len(order), bool)
        old[place[active]] = False
        kept, column = np.flatnonzero(old), columns.column(j)[active]
        merged, shared = np.empty(len(old), kind), np.zeros(len(old), np.uint8)
        merged[kept], shared[kept] = symbols, common
        merged[place[active]] = column
        if len(order):
            shared[n] = 0
        shared[n + touched] = value
        led = merged_places((led & ~LOWER) | kept.astype(np.uint32)[order], column, place[active])
        bwt.write(merged)
        lcp.write(shared)
    return bwt.read(), lcp.read(), places(led)


def merged_places(led: np.ndarray, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``led``, numbers of a symbol (upper half) and its place (lower half) in ascending order, with more symbols but 0."""
    some = np.flatnonzero(symbols)
    more = (symbols[some].astype(np.uint64) << np.uint64(32)) | place[some].astype(np.uint64)
    more.sort()
    both = np.concatenate([led, more])
    both.sort(kind="stable")  # finds the two ascending parts and merges them
    return both


def places(led: np.ndarray) -> np.ndarray:
    return (led & LOWER).astype(np.int32)


def ranks(order: np.ndarray, size: int) -> np.ndarray:
    """Each place's position in ``order``."""
    rank = np.empty(size, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank


def first_documents(strings: list[bytes], first: np.ndarray, window: int = BYTES.window, pack: int = PACK[1]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, first window, last window, document): the smallest document of each window of the strings."""
    columns = Columns(strings, pack)
    symbols, common, order = transform(columns, window)
    n = len(columns.owner)
    sizes = np.array([len(s) for s in strings], np.int64)
    rank = ranks(order, len(symbols))
    owner, start = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
    place, active = np.arange(n), np.arange(n)
    for j in range(1, int(columns.lengths.max()) + 1):
        active = active[columns.lengths[active] >= j]
        place[active] = n + rank[place[active]]
        at = columns.shift[active] + pack * (columns.lengths[active] - j)
        whole = at + window <= sizes[columns.owner[active]]
        owner[place[active[whole]]] = columns.owner[active[whole]]
        start[place[active[whole]]] = at[whole]
    whole = np.flatnonzero(owner >= 0)
    group = np.cumsum(common < window)[whole]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(first[owner[whole]], heads)
    document = np.repeat(least, np.diff(np.concatenate([heads, [len(whole)]])))
    return as_runs(owner[whole], start[whole], document)


def as_runs(owner: np.ndarray, start: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of a string with one document as a run, in the order of the strings. Each window from 0 to a
    string's last one is there once."""
    count = np.bincount(owner)
    base = np.cumsum(count) - count
    in_place = np.empty(len(document), np.int64)
    in_place[base[owner] + start] = document
    owner, document = np.repeat(np.arange(len(count)), count), in_place
    start = np.arange(len(document)) - base[owner]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (document[1:] != document[:-1])]))
    stop = np.concatenate([new[1:], [len(owner)]]) - 1
    return owner[new], start[new], start[stop], document[new]


def remove_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; left out without ``text``), kept_sha256."""

    def finish(texts: Text, covered: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        data = np.frombuffer(texts.buffer, np.uint8)
        rows = []
        for a, b in zip(texts.first.tolist(), texts.last.tolist()):
            gone = covered[a:b]
            n_gone = int(np.count_nonzero(gone))
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if n_gone else 0
            kept = data[a:b][~gone].tobytes() if n_gone else texts.buffer[a:b]
            rows.append((b - a, n_gone, spans, kept if text else None, hashlib.sha256(kept).hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    out = mark_repeats(docs.select("doc_id", "text"), BYTES, first_documents, finish, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out if text else out.drop("kept")
