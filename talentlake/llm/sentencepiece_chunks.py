"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a white space marker behind another character, so merges never cross from a word into the
next marker. A text is cut at those places into chunks (markers and the word behind them); each distinct chunk is
segmented once by the library and the ids are joined back by position. The table lives in the task that uses it and is
cleared when it reaches its bound. A model without that property is encoded text by text.

Defined results: null and empty texts give the end id alone; a marker character in the text acts as a blank, as in the
library; repeated rows are encoded alike; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable(dict):
    """Chunk to its ids (four little-endian bytes each); at most ``limit`` entries."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, limit: int):
        super().__init__()
        self.model, self.limit = model, limit

    def ids(self, chunks: list[list[str]]) -> list[bytes]:
        if len(self) > self.limit:
            self.clear()
        missing = list(set(chain.from_iterable(chunks)).difference(self))
        if MARK in missing:  # a blank that ends a text; the library gives an empty text no marker
            missing.remove(MARK)
            self[MARK] = np.array([self.model.piece_to_id(MARK)], "<i4").tobytes()
        # The library puts a marker in front of every text: that is the first marker of the chunk.
        for chunk, ids in zip(missing, self.model.encode([c[1:] for c in missing], num_threads=1)):
            self[chunk] = np.array(ids, "<i4").tobytes()
        get = self.__getitem__
        return [b"".join(map(get, c)) for c in chunks]


def splittable(model: sentencepiece.SentencePieceProcessor) -> bool:
    """True if chunks can be segmented alone: markers only lead pieces, and a probe shows that text is not rewritten."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    probe = "  a éﬁ　 b  "
    return not any(MARK in p.lstrip(MARK) for p in pieces) and model.decode(model.encode(probe)) == probe


def encode_texts(texts: list[str], model: sentencepiece.SentencePieceProcessor, table: ChunkTable | None) -> list[np.ndarray]:
    end = np.array([model.eos_id()], "<i4")
    if table is None:
        return [np.array(ids, "<i4") for ids in model.encode(texts, add_eos=True, num_threads=1)]
    chunks = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    return [np.concatenate([np.frombuffer(b, "<i4"), end]) for b in table.ids(chunks)]


def encode(docs: DataFrame, model_path: str, decode: bool = True, table_limit: int = 400_000) -> DataFrame:
    """doc_id, ids (with the end id) and, if asked for, the text that the library decodes from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        table = ChunkTable(model, table_limit) if splittable(model) else None
        for batch in slices(batches, 2 << 20):
            ids = encode_texts([t or "" for t in batch.column("text").to_pylist()], model, table)
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
            if decode:
                columns.append(pa.array(model.decode([x.tolist() for x in ids], num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode
    return docs.select("doc_id", "text").mapInArrow(run, schema)
