"""Removal of lines that several documents hold, through sharded minimal perfect hashes.

The key of a line is its text without white space at both ends and with A-Z lower-cased. Two 64-bit hashes stand for a
key. Counts of all lines are combined per key (partial sums before the shuffle); keys of one document only are no longer
needed. The other keys are dealt by their hash into shards of a bounded number of keys. One task builds a shard: a minimal
perfect hash over the first hashes gives each key a number that indexes flat arrays of fingerprints (the second hash),
document counts and first documents. Documents hash their lines, look the numbers up and compare fingerprints; lines are
not joined, and their texts never leave their document.

The shards go to every task while their size, measured first, is within ``broadcast_bytes``. Beyond it each shard stays in
one task and the hashes of each document's lines are dealt to it; the answers come back by document. Keys that make up
more than one in ``HOT`` line occurrences (fewer than ``HOT`` keys by counting) go to every task in that form too, so that
no shard receives a hot key. Both forms look lines up with the same arrays and give the same rows.

Defined results: null and empty texts are one empty line and stay as they are (null texts come back empty); rows with the
same id are one document, and a line repeated within one document alone stays; rows without an id are one document behind
all others; ids must be integers. Other columns are passed on; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import slices, stored
from .perfect_hash import PerfectHash

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LEAST_CHARS = 10
SEEDS = (0x51AB, 0xC0DE)
SHARD_KEYS = 1 << 18  # keys of one shard
SHARD_LINES = 1 << 22  # line occurrences that one shard answers in the dealt form
BROADCAST_BYTES = 64 << 20
HOT = 4096
LAST = 2**63 - 1  # stands for a null id
SLICE_BYTES = 4 << 20
RESULT_TYPE = "struct<text:string,n_lines:bigint,n_dropped:bigint>"


def hashes(line: bytes) -> tuple[int, int] | None:
    """Both hashes of the key of a line, or nothing for a short key."""
    key = line.strip(SPACE)
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode("utf-8", "replace")) < LEAST_CHARS:
        return None
    key = key.translate(LOWER)
    return xxhash.xxh64_intdigest(key, SEEDS[0]), xxhash.xxh64_intdigest(key, SEEDS[1])


def text_bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def line_hashes(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc) of the keys of each row, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_BYTES):
            found, owner = [], []
            for text, doc in zip(text_bytes(batch.column("text")), batch.column("doc").to_pylist()):
                own = {h for line in text.split(b"\n") if (h := hashes(line))}
                found += own
                owner += [doc] * len(own)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(owner, pa.int64())], ["h1", "h2", "doc"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long")


class Shard:
    """Arrays over the keys of a shard, indexed by a minimal perfect hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, first: np.ndarray):
        self.hash, rest = PerfectHash.build(h1)
        number = self.hash.number(h1)
        held = np.ones(len(h1), bool)
        held[rest] = False
        number = number[held]
        self.fingerprints, self.counts, self.first = np.empty(len(number), np.uint64), np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        self.fingerprints[number], self.counts[number], self.first[number] = h2[held], count[held], first[held]
        # Keys whose first hashes are equal: a handful in a trillion, kept as they are.
        self.rest = {(int(h1[i]), int(h2[i])): int(first[i]) for i in rest}

    def first_documents(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """First document of each key, LAST where the shard does not hold it."""
        number = self.hash.number(h1)
        hit = (number >= 0) & (number < len(self.fingerprints))
        hit[hit] = self.fingerprints[number[hit]] == h2[hit]
        first = np.full(len(h1), LAST)
        first[hit] = self.first[number[hit]]
        for i in np.flatnonzero(~hit) if self.rest else ():
            first[i] = self.rest.get((int(h1[i]), int(h2[i])), LAST)
        return first

    def to_bytes(self) -> bytes:
        index = self.hash.to_bytes()
        rest = np.array([(a, b, c % 2**64) for (a, b), c in self.rest.items()], np.uint64).reshape(-1, 3)
        sizes = np.array([len(index), len(self.counts), len(rest)], "<i8")
        return b"".join([sizes.tobytes(), index, self.fingerprints.tobytes(), self.counts.tobytes(), self.first.tobytes(), rest.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        size, n, n_rest = (int(x) for x in np.frombuffer(data, "<i8", 3))
        out, at = cls.__new__(cls), 24 + size
        out.hash = PerfectHash.from_bytes(data[24:at])
        out.fingerprints, out.counts, out.first = (np.frombuffer(data, t, n, at + 8 * n * k) for k, t in enumerate(("<u8", "<i8", "<i8")))
        rest = np.frombuffer(data, "<u8", 3 * n_rest, at + 24 * n).reshape(-1, 3)
        out.rest = {(int(a), int(b)): int(c.astype(np.int64)) for a, b, c in rest}
        return out


def shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return h1.view(np.int64) % n_shards


def first_documents(shards: dict[int, Shard], n_shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """First document of each key, LAST where no two documents hold it."""
    out, home = np.full(len(h1), LAST), shard_of(h1, n_shards)
    for k in np.unique(home):
        if int(k) in shards:
            at = np.flatnonzero(home == k)
            out[at] = shards[int(k)].first_documents(h1[at], h2[at])
    return out


def repeated_keys(rows: DataFrame) -> tuple[DataFrame, int]:
    """Keys that at least two documents hold (with the number of rows that hold them and the first document), stored; and
    the number of pairs of a row and one of its keys."""
    seen = Observation()  # for sizes only
    keys = line_hashes(rows).groupBy("h1", "h2").agg(F.count("*").alias("count"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    keys = keys.observe(seen, F.sum("count").alias("lines"))
    repeated = stored(keys.filter(F.col("first") < F.col("last")).drop("last"), "repeated-lines")
    return repeated, seen.get["lines"] or 0


def build_shards(repeated: DataFrame, n_shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        h1, h2, count, first = (table.column(c).to_numpy() for c in ("h1", "h2", "count", "first"))
        shard = Shard(h1.view(np.uint64), h2.view(np.uint64), count, first)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "data": [shard.to_bytes()]})

    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(n_shards).cast("long")))
    return stored(dealt.groupBy("shard").applyInArrow(build, "shard long, data binary"), "line-shards")


Decide = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def cleaned(batch: pa.RecordBatch, decide: Decide) -> pa.StructArray:
    """Text without the lines that ``decide`` (h1, h2, document, row of the batch) drops, and counts."""
    docs = batch.column("doc").to_numpy()
    texts = [t.split(b"\n") for t in text_bytes(batch.column("text"))]
    found = [(i, k, *h) for i, lines in enumerate(texts) for k, line in enumerate(lines) if (h := hashes(line))]
    row, h1, h2 = (np.array([x[c] for x in found], t) for c, t in ((0, np.int64), (2, np.uint64), (3, np.uint64)))
    gone: dict[int, set[int]] = {}
    for at in np.flatnonzero(decide(h1, h2, docs[row], row)):
        gone.setdefault(found[at][0], set()).add(found[at][1])
    none: set[int] = set()
    kept = [b"\n".join(line for k, line in enumerate(lines) if k not in drop) if (drop := gone.get(i, none)) else b"\n".join(lines) for i, lines in enumerate(texts)]
    counts = [pa.array([len(x) for x in texts], pa.int64()), pa.array([len(gone.get(i, none)) for i in range(len(texts))], pa.int64())]
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), *counts], ["text", "n_lines", "n_dropped"])


def per_slice(columns: Iterator[tuple[pa.Array, ...]], names: list[str], work: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.Array]:
    for arrays in columns:
        batch = pa.RecordBatch.from_arrays(list(arrays), names)
        yield pa.concat_arrays([work(x) for x in slices(iter([batch]), SLICE_BYTES)])


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_keys: int = SHARD_KEYS, shard_lines: int = SHARD_LINES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents without their repeated lines, with n_lines (before) and n_dropped."""
    sc = docs.sparkSession.sparkContext
    doc = F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc")
    whole = docs.select(F.struct("*").alias("row"), doc, F.col(text_column).alias("text"))
    repeated, n_lines = repeated_keys(whole.select("doc", "text"))
    n_repeated = repeated.count()
    n_shards = max(1, -(-n_repeated // shard_keys), -(-n_lines // shard_lines))
    shards = build_shards(repeated, n_shards)
    size = shards.agg(F.sum(F.length("data"))).first()[0] or 0
    if size <= broadcast_bytes:
        sent = sc.broadcast({r.shard: r.data for r in shards.collect()})

        @arrow_udf(RESULT_TYPE)
        def clean(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            own = {k: Shard.from_bytes(v) for k, v in sent.value.items()}
            decide = lambda h1, h2, doc, row: first_documents(own, n_shards, h1, h2) < doc
            yield from per_slice(columns, ["text", "doc"], lambda x: cleaned(x, decide))

        done = whole.select("row", clean("text", "doc").alias("out"))
    else:
        done = dealt(whole, repeated, n_lines, shards, n_shards)
    others = [F.col("row")[c].alias(c) if c != text_column else F.col("out")["text"].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*others, F.col("out")["n_lines"].alias("n_lines"), F.col("out")["n_dropped"].alias("n_dropped"))


def dealt(whole: DataFrame, repeated: DataFrame, n_lines: int, shards: DataFrame, n_shards: int) -> DataFrame:
    """Each shard stays in one task; hashes of lines come to it, answers go back to their rows."""
    sc = whole.sparkSession.sparkContext
    often = repeated.filter(F.col("count") > n_lines / HOT).toPandas()  # fewer than HOT keys
    hot = sc.broadcast(Shard(*(often[c].to_numpy().view(t) for c, t in (("h1", np.uint64), ("h2", np.uint64), ("count", np.int64), ("first", np.int64)))).to_bytes())
    rows = stored(whole.withColumn("at", F.monotonically_increasing_id()), "numbered-documents")

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shard.from_bytes(hot.value)
        for batch in slices(batches, SLICE_BYTES):
            for text, doc, at in zip(text_bytes(batch.column("text")), batch.column("doc").to_pylist(), batch.column("at").to_pylist()):
                both = np.array([*{h for line in text.split(b"\n") if (h := hashes(line))}], np.uint64).reshape(-1, 2)
                both = both[known.first_documents(both[:, 0], both[:, 1]) == LAST]
                if n := len(both):
                    h1, h2 = both[:, 0].view(np.int64).copy(), both[:, 1].view(np.int64).copy()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard_of(h1, n_shards), h1, h2, np.full(n, doc), np.full(n, at))], ["shard", "h1", "h2", "doc", "at"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        if asked.num_rows and own.num_rows:
            shard = Shard.from_bytes(own.column("data")[0].as_py())
            h1, h2 = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            return asked.select(["at", "h1", "h2"]).filter(pa.array(shard.first_documents(h1, h2) < asked.column("doc").to_numpy()))
        return asked.select(["at", "h1", "h2"]).slice(0, 0)

    asked = rows.select("text", "doc", "at").mapInArrow(questions, "shard long, h1 long, h2 long, doc long, at long")
    told = asked.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(answer, "at long, h1 long, h2 long")
    told = told.groupBy("at").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))  # at most the distinct lines of a row

    @arrow_udf(RESULT_TYPE)
    def clean(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = Shard.from_bytes(hot.value)

        def work(batch: pa.RecordBatch) -> pa.Array:
            told = [{(x["h1"], x["h2"]) for x in own or ()} for own in batch.column("gone").to_pylist()]
            given = lambda h1, h2, row: np.fromiter(((a, b) in told[i] for a, b, i in zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), row)), bool, len(h1))
            return cleaned(batch, lambda h1, h2, doc, row: (known.first_documents(h1, h2) < doc) | given(h1, h2, row))

        yield from per_slice(columns, ["text", "doc", "gone"], work)

    return rows.join(told, "at", "left").select("row", clean("text", "doc", "gone").alias("out"))
