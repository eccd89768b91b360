"""Packing of token sequences with bounded space.

Every partition keeps a fixed number of open windows. Whole windows of a long document leave at once; its rest goes to
the open window that it fills best. When none can hold it, the fullest one is emitted: as it is if little room is left,
else filled up with the head of the rest. Windows still open at the end of a partition are stored as leftovers; groups
of partitions then lay their leftovers end to end. The last sequence of such a group is cut into power-of-two lengths,
which need no padding. No step holds more than the open windows of a bounded number of partitions.

Defined results: null and empty texts are one piece holding the end id; equal rows are packed each for itself; a null
doc_id is kept as it is; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import slices, stored

LENGTH = 1024
OPEN = 64
SLACK = 16
FAN_IN = 32

# The split pattern of byte-level BPE for texts in ASCII and the Latin-1 letters, where Python's classes agree with it.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
OTHER = re.compile(f"[^\\t-\\r\\x20-\\x7e{LATIN}]")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\\s{LATIN}0-9]+|\\s+(?!\\S)|\\s+")


class ByteBpe(dict):
    """Ids of the given tokenizer as little-endian bytes. Parts of common texts are kept in a bounded table; texts with
    other characters go through the rank file, texts naming a special token through the tokenizer itself."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str, limit: int = 400_000):
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(tokenizer), limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __missing__(self, part: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        ids = self[part] = np.array(self.fast.encode_ordinary(part), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if "<" in text and any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if OTHER.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


class Packer:
    """Open windows of one partition: each is a list of pieces (doc_id, start, ids, doc_tokens) and the room it has left."""

    def __init__(self, length: int, windows: int, slack: int):
        self.length, self.windows, self.slack = length, windows, slack
        self.room: list[int] = []
        self.held: list[list[tuple]] = []

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        """Packs a document (ids of four bytes); yields the sequences that became ready."""
        n, start = len(ids) // 4, 0
        while n - start >= self.length:
            yield [(doc_id, start, ids[4 * start : 4 * (start + self.length)], n)]
            start += self.length
        while start < n:
            size = n - start
            fits = [r for r in self.room if r >= size]
            if fits:
                k = self.room.index(min(fits))
            elif len(self.room) < self.windows:
                k = len(self.room)
                self.room.append(self.length)
                self.held.append([])
            else:
                k = self.room.index(min(self.room))
                if self.room[k] <= self.slack:
                    yield self.held[k]
                    self.room[k], self.held[k] = self.length, []
            size = min(size, self.room[k])
            self.held[k].append((doc_id, start, ids[4 * start : 4 * (start + size)], n))
            self.room[k] -= size
            start += size
            if not self.room[k]:
                yield self.held[k]
                self.room[k], self.held[k] = self.length, []


def end_to_end(pieces: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Sequences from pieces laid end to end; the last is cut into powers of two."""
    left = sum(len(p[2]) // 4 for p in pieces)
    room, held = 0, []
    for doc_id, start, ids, n in pieces:
        at = 0
        while at < len(ids) // 4:
            if not room:
                if held:
                    yield held
                target = length if left >= length else 1 << (left.bit_length() - 1)
                room, held = target, []
                left -= target
            size = min(room, len(ids) // 4 - at)
            held.append((doc_id, start + at, ids[4 * at : 4 * (at + size)], n))
            at, room = at + size, room - size
    if held:
        yield held


COLUMNS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "group"]


class Rows:
    """Collects sequences as rows and hands them out as Arrow batches."""

    def __init__(self, key: pa.DataType):
        self.types, self.rows, self.held = [key, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], [], 0

    def put(self, sequence: list[tuple], sequence_id: int | None, group: int | None) -> None:
        offset = 0
        for doc_id, start, ids, n in sequence:
            self.rows.append((doc_id, start, ids, n, sequence_id, offset, group))
            offset += len(ids) // 4
            self.held += len(ids)

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            columns = zip(*self.rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], names=COLUMNS)
            self.rows, self.held = [], 0


def pack(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, end_id: int = 0, length: int = LENGTH, windows: int = OPEN,
    slack: int = SLACK, fan_in: int = FAN_IN,
) -> DataFrame:
    """Pieces: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, start long, ids binary, doc_tokens long, sequence_id long, offset long, group long"
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        bpe, packer, rows, count = ByteBpe(tokenizer, ranks, pattern), Packer(length, windows, slack), None, 0
        for batch in slices(batches, 2 << 20):
            rows = rows or Rows(batch.schema.field("doc_id").type)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for sequence in packer.add(doc_id, (bpe.encode(text) if text else b"") + end):
                    rows.put(sequence, (partition << 32) + count, None)
                    count += 1
            yield from rows.take(1 << 20)
        for held in packer.held:
            rows.put(held, None, partition // fan_in)
        if rows:
            yield from rows.take(0)

    def rest(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        pieces = list(zip(*[table.column(c).to_pylist() for c in COLUMNS[:4]]))
        group = table.column("group")[0].as_py()
        rows = Rows(table.schema.field("doc_id").type)
        for k, sequence in enumerate(end_to_end(pieces, length)):
            rows.put(sequence, -1 - (group << 32) - k, None)  # negative: never an id of the first step
        return pa.Table.from_batches(rows.take(0))

    packed = stored(docs.select("doc_id", "text").mapInArrow(first, schema), "packed")
    leftovers = packed.filter("sequence_id IS NULL").groupBy("group").applyInArrow(rest, schema)
    return packed.filter("sequence_id IS NOT NULL").unionByName(leftovers).drop("group").withColumn("length", (F.length("ids") / 4).cast("long"))
