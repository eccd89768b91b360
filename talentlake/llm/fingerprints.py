"""Bottom-k sketches of word shingles.

A fingerprint holds the k smallest 64-bit hashes of the five-word shingles of a text. Two sketches estimate
resemblance and containment, one alone the number of distinct shingles; sketches of parts merge into the sketch of the
whole by keeping the k smallest of both.

Defined results: a text of fewer than five words is one shingle; a text without words (null included) has the empty
sketch, which resembles only another empty one; equal texts have equal sketches. For the edited texts documents are
ordered by doc_id, null first, equal ids by their text; a lone document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import shuffle_partitions, slices
from .text_hash import joined, mix, span_hashes, word_spans

K = 128
WORDS = 5
FACTORS = np.random.default_rng(99).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(texts: list[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Sorted bottom-k hashes of each text."""
    buffer, bounds = joined([t.encode("utf-8", "replace") for t in texts])
    starts, ends = word_spans(buffer)
    hashes = span_hashes(buffer, starts, ends)
    first = np.searchsorted(starts, bounds)  # first word of each text
    rolled = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for j in range(words):
        rolled += hashes[j : j + len(rolled)] * FACTORS[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1])[:k])
        elif b > a:
            out.append(mix((hashes[a:b] * FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    n = min(k, len(both) - int(twice.sum()))
    if not n:
        return 1.0
    # Distinct values in order; of the n smallest, those held by both sketches.
    fresh = np.concatenate([[True], ~twice])
    seen = np.cumsum(fresh)
    return float((seen[1:][twice] <= n).sum()) / n


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / distinct(a, k))


def as_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, distinct_shingles of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 19):
            own = sketches([t or "" for t in batch.column("text").to_pylist()], k, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([as_text(a) for a in own]), pa.array([distinct(a, k) for a in own])],
                names=["doc_id", "fingerprint", "distinct_shingles"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, fingerprint string, distinct_shingles double")


def merge_by(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """Sketch (array of unsigned hashes as decimals) of each group of fingerprints; a group is cut to its k smallest
    hashes in every task before anything is moved."""
    raw = F.unbase64("fingerprint")
    places = F.sequence(F.lit(0), F.floor(F.length(raw) / 8).cast("int") - 1)
    hashes = F.when(F.length(raw) > 0, F.transform(places, lambda i: F.substring(raw, i * 8 + 1, F.lit(8))))
    rows = prints.select(key, F.explode(hashes).alias("_hash")).distinct()
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_hash"))).filter(F.col("_rank") <= k)
    return ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.conv(F.hex("_hash"), 16, 10).cast("decimal(20,0)"))).alias("sketch"))


def with_successor(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, halo, doc_id, text), every bucket whole in one partition and in order. Behind the last row of a
    bucket stands, marked as halo, the first row of the next bucket (of the first, behind the last)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    probes = [i / buckets for i in range(1, buckets)]
    cuts = sorted({float(c) for c in rows.agg(F.percentile_approx("doc_id", probes, 20_000)).first()[0] or []})
    value = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    placed = rows.withColumn("_value", value)
    if cuts:
        split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_value", outputCol="_bucket")
        placed = split.transform(placed).withColumn("bucket", F.col("_bucket").cast("int"))
    else:
        placed = placed.withColumn("bucket", F.lit(0))
    # At most one row a bucket reaches the driver, and one is broadcast.
    firsts = placed.groupBy("bucket").agg(F.min("_value").alias("first")).orderBy("bucket").collect()
    heads = [(r["bucket"], r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(heads, "bucket int, _value double, _to int")
    placed = placed.join(F.broadcast(heads), ["bucket", "_value"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    copies = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("halo"))))
    dealt = placed.select("doc_id", "text", F.explode(copies).alias("_at")).select("_at.bucket", "_at.halo", "doc_id", "text")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """(doc_id, text, next text) in order, some MB at a time."""
        last, out = None, []
        for batch in slices(batches, 1 << 19):
            for row in zip(*[batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")]):
                if last is not None and row[0] == last[0]:
                    out.append((last[2], last[3], row[3]))
                last = None if row[1] else row
            yield out
            out = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pairs(batches):
            if not rows:
                continue
            texts = [r[1] for r in rows]
            edits = [edited_text(t, n) for _, t, n in rows]
            # In a run of documents the next text is the next row's own; only ends of runs are sketched besides.
            ends = [i for i in range(len(rows)) if i + 1 == len(rows) or rows[i + 1][1] is not rows[i][2]]
            found = sketches([*texts, *edits, *[rows[i][2] for i in ends]], k, words)
            own, edited = found[: len(rows)], found[len(rows) : 2 * len(rows)]
            following = dict(zip(ends, found[2 * len(rows) :]))
            nexts = [following[i] if i in following else own[i + 1] for i in range(len(rows))]
            columns = [
                [r[0] for r in rows], [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edits],
                [as_text(a) for a in own], [as_text(a) for a in edited],
                [resemblance(a, b, k) for a, b in zip(own, edited)], [resemblance(a, b, k) for a, b in zip(own, nexts)],
                [containment(a, b, k) for a, b in zip(own, edited)], [distinct(a, k) for a in own],
            ]
            yield pa.RecordBatch.from_pydict(dict(zip(names, columns)), schema=arrow)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edit", "distinct_shingles"]
    key = docs.schema["doc_id"].dataType.simpleString()
    arrow = pa.schema(list(zip(names, [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4])))
    schema = f"doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edit double, distinct_shingles double"
    ordered = with_successor(docs, buckets or 2 * shuffle_partitions(docs.sparkSession))
    return ordered.mapInArrow(run, schema)
