"""Language identification by a byte convolutional network.

A text is cut into windows of 128 UTF-8 bytes. Filters two, three and four bytes wide slide over one-hot bytes; the
maximum of each filter over the window feeds a softmax over the languages. Training runs in numpy on a bounded sample
of labelled texts; prediction covers every window of every text, in batches, and averages the window probabilities by
the bytes a window holds.

Defined results: null texts and texts without a letter get ``und`` with score 0; without labelled rows every text gets
``und``; rows with a null label teach nothing; equal texts get equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class ByteCnn:
    """``filters[k]`` has shape (width, 256, FILTERS): the weight of each byte at each place of a filter."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def training_windows(docs: DataFrame, per_language: int, windows: int) -> DataFrame:
    """Up to ``windows`` windows of at most ``per_language`` texts a language (those with the smallest hash of doc_id)."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64)).alias("_part"))
    # The choice is made on ids alone: first in parts of a language, then among at most 64 times the bound.
    for group in (["lang", "_part"], ["lang"]):
        known = known.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rank") <= per_language)
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).join(F.broadcast(known.select("doc_id", "lang").distinct()), "doc_id")
    windows_of = F.array(*[
        F.substring("raw", (F.greatest(F.length("raw") - WINDOW, F.lit(0)) * k / max(windows - 1, 1)).cast("int") + 1, F.lit(WINDOW))
        for k in range(windows)])
    return raw.select("doc_id", "lang", F.explode(F.array_distinct(windows_of)).alias("window")).filter(F.col("window").isNotNull())


def window_matrix(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts (zero-padded), and how many each text has."""
    counts = np.array([-(-len(x) // WINDOW) for x in raw], dtype=np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    at = 0
    for x, n in zip(raw, counts):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
        at += int(n) * WINDOW
    return flat.reshape(-1, WINDOW), counts


def fit(windows: np.ndarray, classes: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, seed: int = 7) -> ByteCnn:
    """Adam on the cross entropy. Only the place of each maximum gets a gradient, so filter updates are sparse."""
    rng = np.random.default_rng(seed)
    n_out = len(languages)
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params = [*filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_out)).astype(np.float32), np.zeros(n_out, np.float32)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step, columns = 0, np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y = windows[pick], classes[pick]
            pooled, places = [], []
            for f, w in zip(params, WIDTHS):
                conv = sum(f[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                place = conv.argmax(1)
                places.append(place)
                pooled.append(np.take_along_axis(conv, place[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + params[3]
            hidden = np.maximum(raw, 0)
            logits = hidden @ params[4] + params[5]
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            d_hidden = (p @ params[4].T) * (raw > 0)
            grads = [np.zeros_like(f) for f in params[:3]]
            for k, w in enumerate(WIDTHS):
                d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    hit = np.take_along_axis(x, places[k] + j, 1)
                    np.add.at(grads[k][j], (hit, columns[None, :]), d)
            grads += [d_hidden.sum(0), hidden.T @ p, p.sum(0)]
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for value, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return ByteCnn(languages, params[:3], params[3], params[4], params[5])


def train(docs: DataFrame, per_language: int = 1500, windows: int = 4, epochs: int = 5) -> ByteCnn | None:
    """Fits on at most ``per_language`` x ``windows`` windows of each language; None without labelled rows."""
    rows = training_windows(docs, per_language, windows).toArrow().sort_by([("doc_id", "ascending"), ("window", "ascending")])
    found = [(lang, w) for lang, w in zip(rows.column("lang").to_pylist(), rows.column("window").to_pylist()) if w]
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    matrix, _ = window_matrix([w for _, w in found])
    return fit(matrix, np.array([languages.index(lang) for lang, _ in found]), languages, epochs)


class Scorer:
    """Window probabilities with one table look-up per pair of bytes."""

    def __init__(self, model: ByteCnn):
        self.model = model
        two, three, four = model.filters
        left = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        alone = np.repeat(three[2], 256, axis=0)  # the third byte of width three: first byte of the second pair
        self.head = np.concatenate([left(two[0], two[1]), left(three[0], three[1]), left(four[0], four[1])], 1)
        self.tail = np.concatenate([alone, left(four[2], four[3])], 1)

    def probabilities(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty((len(windows), len(self.model.languages)), np.float32)
        for at in range(0, len(windows), block):
            x = windows[at : at + block].astype(np.int32)
            pairs = (x[:, :-1] << 8) | x[:, 1:]
            conv = self.head[pairs]  # (n, WINDOW - 1, 3 * FILTERS)
            last = x[:, -1] << 8  # width three ends one byte after the last whole second pair
            conv[:, : WINDOW - 3, FILTERS:] += self.tail[pairs[:, 2:]]
            conv[:, WINDOW - 3, FILTERS : 2 * FILTERS] += self.tail[last, :FILTERS]
            pooled = np.concatenate([
                conv[:, :, :FILTERS].max(1), conv[:, : WINDOW - 2, FILTERS : 2 * FILTERS].max(1), conv[:, : WINDOW - 3, 2 * FILTERS :].max(1)], 1)
            logits = np.maximum(pooled + self.model.bias, 0) @ self.model.dense + self.model.dense_bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            out[at : at + block] = p / p.sum(1, keepdims=True)
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def predict(texts: list[str | None], scorer: Scorer) -> tuple[list[str], list[float]]:
    known = [has_letter(t) for t in texts]
    raw = [t.encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known)]
    windows, counts = window_matrix(raw)
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not len(windows):
        return languages, scores
    p = scorer.probabilities(windows)
    ends = np.cumsum(counts)
    for i, (k, n) in enumerate(zip(known, counts)):
        if k:
            weights = np.full(n, WINDOW, np.float64)
            weights[-1] = len(raw[i]) - (n - 1) * WINDOW
            mean = weights @ p[ends[i] - n : ends[i]] / len(raw[i])
            best = int(mean.argmax())
            languages[i], scores[i] = scorer.model.languages[best], float(min(1.0, mean[best]))
    return languages, scores


def identify(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (columns of these names are replaced)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    rows = docs.select(*own)
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in slices(batches, 4 << 20):
            texts = batch.column("text").to_pylist()
            languages, scores = predict(texts, scorer) if scorer else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id):
    """True where crc32 of the id as text leaves remainder 1 by 3: never used for learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
