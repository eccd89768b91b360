"""Exchange that brings equal windows of 50 symbols together, shared by the two substring operators.

A symbol is a byte or a word. The key of a window is the smallest hash among its k-grams, so equal windows have equal
keys, and neighbouring windows mostly share theirs: a run of such windows travels as one short segment. Three steps:

1. Keys are counted over all documents. Those of a single document cannot repeat; the others fill a filter whose size is
   capped (a full filter only lets more segments through). Keys that hold a large share of all occurrences are hot.
2. Documents are dealt into chunks. A chunk sends every distinct segment once, with its first document, to the bucket of
   its key. Segments of a hot key are cut further and dealt by the part that all their windows share.
3. A bucket indexes its distinct segments with the operator's own method, finds the first document of every window, and
   answers each chunk by segment number. The chunk marks the windows that start in an earlier document.

No step gathers the occurrences of a key: a chunk stands for all its own. Results depend on the text alone, so lost
tasks can be repeated. doc_id null sorts behind all others and is never an earlier document; equal ids never match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import shuffle_partitions, slices, stored
from .text_hash import BYTE_VALUE, mix, span_hashes, word_spans

LAST = np.iinfo(np.int64).max
MAX_FILTER_BITS = 1 << 30
GROUP = 5  # windows of a hot key that travel together
SLICE = 4 << 20
BLOCK = 1 << 16  # symbols handled at once
FINE = 8  # parts of a bucket that are indexed one after the other
LEAST_HOT = 1000  # occurrences below which a key is never hot


@dataclass(frozen=True)
class Unit:
    """What a symbol is: bytes, or words (texts then have single blanks between words)."""

    words: bool
    window: int
    gram: int

    @property
    def span(self) -> int:
        """k-grams in a window."""
        return self.window - self.gram + 1


BYTES = Unit(False, 50, 16)
WORDS = Unit(True, 50, 8)
ROLL = np.uint64(0xD6E8FEB86659FD93)


class Text:
    """Symbols of several texts in one buffer."""

    def __init__(self, texts: list[str | None], unit: Unit):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        if unit.words:
            raw = [b" ".join(t.split()) for t in raw]
        self.buffer = b"\n".join([*raw, b""])
        data = np.frombuffer(self.buffer, np.uint8)
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in raw], out=bounds[1:])
        if unit.words:
            self.starts, self.ends = word_spans(data)
            first = np.searchsorted(self.starts, bounds)
            self.first, self.last = first[:-1], first[1:]
            self.length = len(self.starts)
        else:
            self.starts, self.ends = None, None
            self.first, self.last = bounds[:-1], bounds[1:] - 1
            self.length = len(data)
        self.unit, self.data = unit, data

    def symbols(self, a: int, b: int) -> np.ndarray:
        """Hashes of the symbols a to b - 1."""
        if not self.unit.words:
            return BYTE_VALUE[self.data[a:b]]
        if b <= a:
            return np.zeros(0, np.uint64)
        start = int(self.starts[a])
        return span_hashes(self.data[start : int(self.ends[b - 1])], self.starts[a:b] - start, self.ends[a:b] - start)

    def grams(self, a: int, b: int) -> np.ndarray:
        """Hashes of the k-grams inside the symbols a to b - 1."""
        found, size, factor = self.symbols(a, b), 1, int(ROLL)
        while size < self.unit.gram:  # a power of two
            found, factor, size = found[:-size] * np.uint64(factor) + found[size:], factor * factor % 2**64, 2 * size
        return mix(found)

    def content(self, a: int, b: int) -> bytes:
        """Text of the symbols a to b - 1."""
        return self.buffer[self.starts[a] : self.ends[b - 1]] if self.unit.words else self.buffer[a:b]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one key inside a text: first window, number of windows, key, text."""
        parts, low_text = [], 0
        while low_text < len(self.first):  # some texts at a time bound the memory
            high = max(low_text + 1, int(np.searchsorted(self.last, self.first[low_text] + BLOCK)))
            parts.append(self.runs_of(low_text, high))
            low_text = high
        return tuple(np.concatenate(x) for x in zip(*parts))

    def runs_of(self, low_text: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        unit, base = self.unit, int(self.first[low_text])
        first, last = self.first[low_text:high], self.last[low_text:high]
        count = np.maximum(last - first - unit.window + 1, 0)
        text = np.repeat(np.arange(len(count)), count)
        if not len(text):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none
        keys, size = self.grams(base, int(last[-1])), 1
        while 2 * size <= unit.span:
            keys, size = np.minimum(keys[:-size], keys[size:]), 2 * size
        if size < unit.span:
            keys = np.minimum(keys[: size - unit.span], keys[unit.span - size :])
        at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        key = keys[at - base]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
        start = np.flatnonzero(new)
        inside = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))
        start = np.flatnonzero(inside % unit.span == 0)  # long runs (repeating text) are cut
        return at[start], np.diff(np.concatenate([start, [len(at)]])), key[start], text[start] + low_text

def scaled(h: np.ndarray, n: int) -> np.ndarray:
    """The upper half of a hash as a number below n."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Filter:
    """Bits of the repeated keys by bucket, and the hot keys."""

    buckets: int
    slots: int
    bits: np.ndarray
    hot: np.ndarray

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        place = scaled(keys, self.buckets) * self.slots + (low(keys) % np.uint32(self.slots)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def is_hot(self, keys: np.ndarray) -> np.ndarray:
        return np.isin((scaled(keys, self.buckets).astype(np.uint64) << np.uint64(32)) | low(keys), self.hot)


def key_filter(docs: DataFrame, unit: Unit, buckets: int) -> Filter:
    """Counts keys over all documents; the driver gets a filter of capped size and at most 8 hot keys a bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            _, _, key, text = Text(batch.column("text").to_pylist(), unit).runs()
            if not len(key):
                continue
            order = np.lexsort((text, key))
            key, text = key[order], text[order]
            other = np.concatenate([[True], key[1:] != key[:-1]])
            fresh = other | np.concatenate([[True], text[1:] != text[:-1]])
            key = key[fresh]  # a key once per document
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([start, [len(key)]])).astype(np.uint32)
            key = key[start]
            bucket = scaled(key, buckets)  # ascending, as keys are
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            rest, single = low(key), count == 1
            ones, more, counts = [], [], []
            for b in full:
                part = slice(edges[b], edges[b + 1])
                lone = single[part]
                ones.append(rest[part][lone].tobytes())
                more.append(rest[part][~lone].tobytes())
                counts.append(count[part][~lone].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(x, pa.binary()) for x in (ones, more, counts)]], names=["bucket", "ones", "more", "counts"])

    def count(table: pa.Table) -> pa.Table:
        ones, more, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32) for c in ("ones", "more", "counts"))
        rest = np.concatenate([ones, more])
        times = np.concatenate([np.ones(len(ones), np.int64), counts.astype(np.int64)])
        order = np.argsort(rest, kind="stable")
        rest, times = rest[order], times[order]
        start = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) if len(rest) else np.zeros(0, np.int64)
        total = np.add.reduceat(times, start) if len(start) else times
        keep = total > 1
        return pa.table({"bucket": table.column("bucket")[:1], "n": pa.array([int(keep.sum())]), "occurrences": pa.array([int(total[keep].sum())]),
                         "keys": pa.array([rest[start][keep].tobytes()], pa.binary()), "counts": pa.array([total[keep].astype(np.uint32).tobytes()], pa.binary())})

    sent = docs.select("text").mapInArrow(send, "bucket int, ones binary, more binary, counts binary")
    found = stored(sent.groupBy("bucket").applyInArrow(count, "bucket int, n long, occurrences long, keys binary, counts binary"), "window-keys")
    sums = found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences")).first()
    slots = max(64, min(1 << (16 * sums["n"]).bit_length(), MAX_FILTER_BITS // buckets // 8 * 8))
    least = max(LEAST_HOT, sums["occurrences"] // (8 * buckets))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.frombuffer(row["keys"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                bits = np.zeros(slots, bool)
                bits[keys % np.uint32(slots)] = True
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()]), pa.array([keys[counts > least].tobytes()])], names=["bucket", "bits", "hot"])

    bits, hot = np.zeros(buckets * slots // 8, np.uint8), [np.zeros(0, np.uint64)]
    for row in found.mapInArrow(fill, "bucket int, bits binary, hot binary").toLocalIterator():
        bits[row["bucket"] * slots // 8 : (row["bucket"] + 1) * slots // 8] = np.frombuffer(row["bits"], np.uint8)
        hot.append((np.uint64(row["bucket"]) << np.uint64(32)) | np.frombuffer(row["hot"], np.uint32))
    return Filter(buckets, slots, bits, np.sort(np.concatenate(hot)))


class Segments:
    """Distinct segments of a chunk by bucket, and where each occurs."""

    def __init__(self, texts: list[str | None], ids: np.ndarray, unit: Unit, known: Filter, buckets: int):
        self.text = Text(texts, unit)
        at, count, key, doc = self.text.runs()
        keep = known.repeated(key)
        at, count, key, doc = at[keep], count[keep], key[keep], doc[keep]
        hot = known.is_hot(key)
        bucket = scaled(mix(key), FINE * buckets)
        if hot.any():
            finer = [self.split(a, c, k, d, buckets) for a, c, k, d in zip(at[hot], count[hot], key[hot], doc[hot])]
            extra = np.concatenate(finer) if finer else np.zeros((0, 4), np.int64)
            at, count, doc, bucket = (np.concatenate([x[~hot], extra[:, i]]) for i, x in enumerate((at, count, doc, bucket)))
        order = np.lexsort((at, bucket))
        self.at, self.count, self.doc, self.bucket = at[order], count[order], doc[order], bucket[order]
        window, content = unit.window, self.text.content
        seen: dict[tuple[int, bytes], int] = {}
        self.segment = np.array([seen.setdefault((b, content(a, a + c + window - 1)), len(seen)) for b, a, c in zip(self.bucket.tolist(), self.at.tolist(), self.count.tolist())], np.int64)
        self.contents = [c for _, c in seen]
        self.buckets = np.array([b for b, _ in seen], np.int64)
        own = ids[self.doc]
        self.first = np.full(len(seen), LAST)
        np.minimum.at(self.first, self.segment, own)
        most = np.full(len(seen), np.iinfo(np.int64).min)
        np.maximum.at(most, self.segment, own)
        self.several = (most > self.first).astype(np.uint8)

    def split(self, at: int, count: int, key: int, doc: int, buckets: int) -> np.ndarray:
        """Segments of a hot key by the place of the key in the window, dealt by what their windows share."""
        unit = self.text.unit
        places = at + np.flatnonzero(self.text.grams(at, at + count + unit.window - 1) == key)
        starts = np.arange(at, at + count)
        place = places[np.searchsorted(places, starts)]
        group = (place - starts) // GROUP
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (group[1:] != group[:-1])]))
        out = []
        for a, n in zip(new, np.diff(np.concatenate([new, [count]]))):
            core = int(place[a] - GROUP * group[a])
            h = xxh64_intdigest(self.text.content(core, core - GROUP + 1 + unit.window), int(group[a]))
            out.append((at + a, n, doc, h % (FINE * buckets)))
        return np.array(out, np.int64).reshape(-1, 4)

    def edges(self, buckets: int) -> np.ndarray:
        """Segments of bucket b are edges[b] to edges[b + 1]."""
        return np.searchsorted(self.buckets, FINE * np.arange(buckets + 1))


Engine = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
Finish = Callable[[Text, np.ndarray, list], pa.RecordBatch]


def order_ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def in_order(table: pa.Table) -> pa.Table:
    """Rows in an order that depends on their values alone."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def mark_repeats(docs: DataFrame, unit: Unit, engine: Engine, finish: Finish, schema: str) -> DataFrame:
    """Applies ``finish(text, covered, table)`` to every chunk of ``docs`` (all its columns, and the chunk); ``covered`` flags the symbols that lie in a window which
    also starts in an earlier document. ``engine(contents, first)`` gives for distinct segments the first document of
    every window as runs (segment, first window, last window, document)."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    # Segments of bytes are many and short: fewer chunks and buckets keep the messages between them large.
    chunks = buckets = (4 if unit.words else 2) * partitions
    known = spark.sparkContext.broadcast(key_filter(docs.select("text"), unit, buckets))
    name = "_chunk"
    while name in docs.columns:  # a column of the input keeps its name and its values
        name += "_"
    dealt = docs.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(partitions, name)
    window = unit.window

    def segments_of(table: pa.Table) -> Segments:
        return Segments(table.column("text").to_pylist(), order_ids(table.column("doc_id")), unit, known.value, buckets)

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column(name)[0].as_py()
        own = segments_of(in_order(table))
        edges = own.edges(buckets)
        full = np.flatnonzero(np.diff(edges))
        parts = [slice(edges[b], edges[b + 1]) for b in full]
        lengths = np.array([len(c) for c in own.contents], np.uint32)
        packer = zstandard.ZstdCompressor(level=1)
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()),
            "lengths": pa.array([lengths[p].tobytes() for p in parts], pa.binary()), "body": pa.array([packer.compress(b"".join(own.contents[p])) for p in parts], pa.binary()),
            "fine": pa.array([(own.buckets[p] % FINE).astype(np.uint8).tobytes() for p in parts], pa.binary()),
            "first": pa.array([own.first[p].tobytes() for p in parts], pa.binary()), "several": pa.array([own.several[p].tobytes() for p in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, bytes], int] = {}
        numbers, firsts, several = [], [], []
        for row in table.to_pylist():
            ends = np.cumsum(np.frombuffer(row["lengths"], np.uint32)).tolist()
            body = zstandard.ZstdDecompressor().decompress(row["body"])
            numbers.append(np.array([seen.setdefault((f, body[a:b]), len(seen)) for f, a, b in zip(row["fine"], [0, *ends[:-1]], ends)], np.int64))
            firsts.append(np.frombuffer(row["first"], np.int64))
            several.append(np.frombuffer(row["several"], np.uint8))
        first = np.full(len(seen), LAST)
        np.minimum.at(first, np.concatenate(numbers), np.concatenate(firsts))
        part = np.array([f for f, _ in seen])
        found = []
        for f in np.unique(part):  # windows of different parts are never equal
            own = np.flatnonzero(part == f)
            segment, *runs = engine([c for k, c in seen if k == f], first[own])
            found.append((own[segment], *runs))
        segment, a, b, doc = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(segment, kind="stable")
        segment, a, b, doc = segment[order], a[order], b[order], doc[order]
        edges = np.searchsorted(segment, np.arange(len(seen) + 1))
        out = []
        for number, own_first, own_several in zip(numbers, firsts, several):
            size = edges[number + 1] - edges[number]
            mine = np.repeat(np.arange(len(number)), size)
            run = np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[number], size)
            useful = (doc[run] < own_first[mine]) | (own_several[mine] > 0)
            mine, run = mine[useful], run[useful]
            out.append((mine.astype(np.uint32).tobytes(), a[run].astype(np.uint8).tobytes(), b[run].astype(np.uint8).tobytes(), doc[run].tobytes()))
        columns = [pa.array(c, pa.binary()) for c in zip(*out)]
        return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), *columns], names=["chunk", "bucket", "segment", "a", "b", "doc"])

    def close(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        own = segments_of(table)
        ids = order_ids(table.column("doc_id"))
        step = np.zeros(own.text.length + 1, np.int32)
        if answers.num_rows:
            edges = own.edges(buckets)
            replies = answers.to_pylist()
            segment = np.concatenate([np.frombuffer(r["segment"], np.uint32).astype(np.int64) + edges[r["bucket"]] for r in replies])
            a, b = (np.concatenate([np.frombuffer(r[c], np.uint8).astype(np.int64) for r in replies]) for c in ("a", "b"))
            doc = np.concatenate([np.frombuffer(r["doc"], np.int64) for r in replies])
            order = np.argsort(own.segment, kind="stable")
            edges = np.searchsorted(own.segment[order], np.arange(len(own.contents) + 1))
            size = edges[segment + 1] - edges[segment]
            reply = np.repeat(np.arange(len(segment)), size)
            place = order[np.arange(len(reply)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edges[segment], size)]
            later = ids[own.doc[place]] > doc[reply]
            reply, place = reply[later], place[later]
            np.add.at(step, own.at[place] + a[reply], 1)
            np.add.at(step, own.at[place] + b[reply] + window, -1)
        return pa.Table.from_batches([finish(own.text, np.cumsum(step[:-1]) > 0, table)])

    sent = dealt.groupBy(name).applyInArrow(send, "bucket int, chunk int, lengths binary, body binary, fine binary, first binary, several binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, segment binary, a binary, b binary, doc binary")
    return dealt.groupBy(name).cogroup(replies.groupBy("chunk")).applyInArrow(close, schema)
