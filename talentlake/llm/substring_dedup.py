"""Removal of repeated passages of 50 words with suffix automata.

The reference of a document is every earlier document, so it grows with the corpus and cannot be broadcast whole. It is
cut into shards by window key (see ``windows``); the part of a document that can match a shard meets that shard in one
task, and no other shard is needed there. A shard's distinct segments build one suffix automaton whose states carry the
first document they occur in; the segments are then streamed through it, and the state of the last 50 words tells the
first document of that window. ``remove_reference`` is the plain form for a reference of bounded size: automata of its
shards are broadcast and whole documents stream through them.

Defined results: words are compared unchanged; null texts have none; passages repeated inside one document stay; repeated
rows with one doc_id keep their words; a null doc_id sorts last; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

from .common import slices
from .suffix_dedup import as_runs
from .windows import LAST, WORDS, Text, mark_repeats


class Automaton:
    """Suffix automaton of several sequences; every state knows the smallest document among its ends."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [LAST]

    def add(self, sequence: list[int], document: int) -> None:
        follow, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for symbol in sequence:
            known = follow[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                last = known
            else:
                if known is None:
                    fresh = len(follow)
                    follow.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    first.append(LAST)
                    p = last
                    while p >= 0 and symbol not in follow[p]:
                        follow[p][symbol] = fresh
                        p = link[p]
                    q = follow[p][symbol] if p >= 0 else 0
                    base, top = fresh, p
                else:
                    base, top, q = None, last, known
                if top >= 0 and length[q] != length[top] + 1:
                    clone = len(follow)
                    follow.append(follow[q].copy())
                    link.append(link[q])
                    length.append(length[top] + 1)
                    first.append(LAST)
                    link[q] = clone
                    p = top
                    while p >= 0 and follow[p].get(symbol) == q:
                        follow[p][symbol] = clone
                        p = link[p]
                    q = clone
                if base is None:
                    last = q
                else:
                    link[base] = q
                    last = base
            if document < first[last]:
                first[last] = document

    def close(self) -> Automaton:
        """Hands first documents up the suffix links."""
        first, link = self.first, self.link
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if first[state] < first[up]:
                first[up] = first[state]
        return self

    def windows(self, sequence: list[int], window: int) -> Iterator[tuple[int, int]]:
        """(start, first document) of every window of the sequence that occurs in the automaton."""
        follow, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if matched >= window:
                yield end - window, first[state]


def remove_reference(docs: DataFrame, reference: list[str], shard_words: int = 200_000, window: int = WORDS.window) -> DataFrame:
    """``docs`` with the column ``kept``: its words (one blank between them) without those in a window that a reference text
    holds. The reference is bounded by the caller; each of its shards is broadcast as an automaton of its own."""
    table: dict[str, int] = {}
    shards, held = [Automaton()], 0
    for text in reference:
        words = [table.setdefault(w.decode(), len(table)) for w in text.encode().split()]
        if held and held + len(words) > shard_words:
            shards, held = [*shards, Automaton()], 0
        shards[-1].add(words, 0)
        held += len(words)
    known = docs.sparkSession.sparkContext.broadcast((table, [s.close() for s in shards]))
    own = [c for c in docs.columns if c != "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, automata = known.value
        for batch in slices(batches, 1 << 20):
            kept = []
            for text in batch.column("text").to_pylist():
                words = [w.decode() for w in (text or "").encode().split()]
                sequence = [numbers.get(w, -1) for w in words]
                gone = np.zeros(len(words) + 1, np.int32)
                for automaton in automata:
                    for start, _ in automaton.windows(sequence, window):
                        gone[start] += 1
                        gone[start + window] -= 1
                kept.append(" ".join(w for w, g in zip(words, np.cumsum(gone)) if not g))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], names=[*batch.schema.names, "kept"])

    rows = docs.select(*own)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("kept", StringType())]))


def numbered(contents: list[bytes]) -> list[list[int]]:
    table: dict[bytes, int] = {}
    return [[table.setdefault(w, len(table)) for w in c.split(b" ")] for c in contents]


def first_documents(contents: list[bytes], first: np.ndarray, window: int = WORDS.window) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first window, last window, document): the smallest document of each window of the segments."""
    sequences = numbered(contents)
    automaton = Automaton()
    for sequence, document in zip(sequences, first.tolist()):
        automaton.add(sequence, document)
    automaton.close()
    found = [(k, start, document) for k, s in enumerate(sequences) for start, document in automaton.windows(s, window)]
    owner, start, document = np.array(found, np.int64).reshape(-1, 3).T
    return as_runs(owner, start, document)


def kept_words(texts: Text, covered: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, remaining words joined by a blank) of each text."""
    for a, b in zip(texts.first.tolist(), texts.last.tolist()):
        whole = texts.content(a, b) if b > a else b""
        gone = covered[a:b]
        n_gone = int(np.count_nonzero(gone))
        yield b - a, n_gone, b" ".join([w for w, g in zip(whole.split(b" "), gone.tolist()) if not g]) if n_gone else whole


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; rows that lose all their words go, untouched texts stay as they are."""
    names = docs.columns

    def finish(texts: Text, covered: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        old = table.column("text").to_pylist()
        found = list(kept_words(texts, covered))
        new = pa.array([kept.decode() if gone else t for t, (_, gone, kept) in zip(old, found)], pa.string())
        left = pa.array([not gone or gone < n for n, gone, _ in found])
        table = table.set_column(table.schema.get_field_index("text"), "text", new).filter(left).select(names)
        return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)

    return mark_repeats(docs, WORDS, first_documents, finish, docs.schema)


def remove_repeats(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by a blank; left out without ``text``), kept_sha256."""

    def finish(texts: Text, covered: np.ndarray, table: pa.Table) -> pa.RecordBatch:
        rows = [(n, gone, kept.decode() if text else None, hashlib.sha256(kept).hexdigest()) for n, gone, kept in kept_words(texts, covered)]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), *columns], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    out = mark_repeats(docs.select("doc_id", "text"), WORDS, first_documents, finish, f"doc_id {key}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out if text else out.drop("kept")
