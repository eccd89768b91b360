"""WARC archives written and read as a table of chunks.

A payload is cut into rows (record, chunk number, bytes) before it leaves the JVM, so neither writer nor reader holds a
whole record: both stream chunks through a running digest and a gzip member per record. Of records with equal payloads
the one with the smallest page_id is the response; the others are revisits that carry digest and length only.

Archives are files below the given folder, any store that pyarrow can open. A task writes under names of its own attempt;
the stored manifest names the files of the attempts that succeeded, and only those are read.

Defined results: a null html is an empty payload; a null url is left out; payloads under the least length are always
responses; rows that repeat page_id and payload of a response are responses too; a null page_id never serves as a
target while another exists, and refers_to is null if it does; a damaged archive raises an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CHUNK = 64 << 10
LEAST = 100
ROTATE = 128 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, chunk_no long, is_last boolean, chunk binary, digest string"
NAMES = [f.strip().split()[0] for f in RECORDS.split(",")]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def chunk_rows(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """One row per chunk with the record's type; chunks of a record follow one another."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = raw.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("target"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "target", F.lit(True).alias("is_shared"))
    typed = rows.join(shared, "digest", "left").withColumn("is_revisit", F.coalesce(F.col("is_shared") & ~F.col("page_id").eqNullSafe(F.col("target")), F.lit(False)))
    last = F.when(F.col("is_revisit"), F.lit(0)).otherwise(F.ceil(F.greatest(F.col("payload_bytes"), F.lit(1)) / chunk).cast("int") - 1)
    cut = typed.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.when(~F.col("is_revisit"), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return cut.select("page_id", "url", "payload_bytes", "digest", "is_revisit", F.when(F.col("is_revisit"), F.col("target")).alias("refers_to"), "chunk_no", piece.alias("chunk"))


def head_of(row: dict) -> bytes:
    """WARC and HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    length = len(http) + (0 if row["is_revisit"] else row["payload_bytes"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['is_revisit'] else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'], row['digest'])}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {row['url']}"] if row["url"] is not None else []), *([f"X-Page-ID: {row['page_id']}"] if row["page_id"] is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}"] if row["is_revisit"] else []),
        *([f"X-Refers-To-Page: {row['refers_to']}"] if row["refers_to"] is not None else []),
        f"WARC-Payload-Digest: sha256:{row['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(line.replace("\r", "%0D").replace("\n", "%0A") for line in lines).encode() + http


def write(pages: DataFrame, folder: str, chunk: int = CHUNK, least: int = LEAST, rotate: int = ROTATE, level: int = 1) -> DataFrame:
    """Writes the archives; returns the stored manifest (archive, n_records, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        archives, out, packer, running, row = [], None, None, None, None

        def close_record():
            if running is not None and not row["is_revisit"] and running.hexdigest() != row["digest"]:
                raise ValueError(f"chunks of page {row['page_id']} are incomplete")
            return packer.compress(b"\r\n\r\n") + packer.flush()

        for batch in batches:
            for row_now in batch.to_pylist():
                if row_now["chunk_no"] == 0:
                    if packer is not None:
                        archives[-1][2] += out.write(close_record())
                    if out is None or archives[-1][2] >= rotate:
                        if out is not None:
                            out.close()
                        path = f"{name}-{len(archives):04d}.warc.gz"
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                        archives.append([f"{folder}/{path}", 0, 0])
                    packer, running = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha256()
                    archives[-1][1] += 1
                    archives[-1][2] += out.write(packer.compress(head_of(row_now)))
                row = row_now
                if row["chunk"]:
                    running.update(row["chunk"])
                    archives[-1][2] += out.write(packer.compress(row["chunk"]))
        if out is not None:
            archives[-1][2] += out.write(close_record())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*archives) if archives else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return stored(chunk_rows(pages, chunk, least).mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-manifest")


def inflated(source, block: int = 1 << 18) -> Iterator[tuple[bytes, bool]]:
    """Pieces of the gzip members of a stream, and whether a piece ends its member."""
    unpack = zlib.decompressobj(31)
    while data := source.read(block):
        while data:
            piece = unpack.decompress(data, block)
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
                yield piece, True
            else:
                yield piece, False
                if not data and not piece:
                    break


def read_stream(source, chunk: int = CHUNK, payload: bool = True) -> Iterator[tuple]:
    """Chunk rows of an archive in the order of RECORDS; ``digest`` runs over the chunks and is whole on the last one."""
    head, body, fields, number, running = bytearray(), bytearray(), None, 0, hashlib.sha256()
    left = 0

    def emit(last: bool, size: int):
        nonlocal number
        part = bytes(body[:size])
        del body[:size]
        running.update(part)
        full = fields["type"] == "response"
        digest = running.hexdigest() if full else fields["digest"]
        if last and digest != fields["digest"]:
            raise ValueError(f"payload of page {fields['page']} does not match its digest")
        row = (fields["page"], fields["url"], fields["type"], fields["refers"], fields["bytes"], number, last, part if payload else None, digest)
        number += 1
        return row

    for piece, ended in inflated(source):
        if fields is None:
            head += piece
            end = head.find(b"\r\n\r\n")
            stop = head.find(b"\r\n\r\n", end + 4) if end >= 0 else -1
            if stop >= 0:
                lines = dict(line.split(": ", 1) for line in head[:end].decode().split("\r\n")[1:])
                http = dict(line.split(": ", 1) for line in head[end + 4 : stop].decode().split("\r\n")[1:])
                page, refers = lines.get("X-Page-ID"), lines.get("X-Refers-To-Page")
                fields = {"page": int(page) if page else None, "url": lines.get("WARC-Target-URI"), "type": lines["WARC-Type"], "refers": int(refers) if refers else None,
                          "bytes": int(http["Content-Length"]), "digest": lines["WARC-Payload-Digest"].removeprefix("sha256:")}
                left = int(lines["Content-Length"]) - (stop - end)
                piece = bytes(head[stop + 4 :])
            else:
                piece = b""
        if fields is not None:
            taken = piece[:left]
            left -= len(taken)
            body += taken
            while len(body) > chunk:
                yield emit(False, chunk)
        if ended:
            if fields is None or left:
                raise ValueError("a record is cut off")
            yield emit(True, len(body))
            head, fields, number, running = bytearray(), None, 0, hashlib.sha256()
    if fields is not None or head:
        raise ValueError("the archive is cut off")


def read(manifest: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of all archives of a manifest; without ``payload`` only the last row of each record, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = open_store(uri)
                with store.open_input_stream(path, compression=None) as source:
                    for row in read_stream(source, chunk, payload):
                        if payload or row[6]:
                            rows.append(row)
                            held += len(row[7] or b"") + 100
                        if held >= 8 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
        if rows:
            yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    archives = manifest.select("archive").distinct()
    # A task for each archive: with a count, small manifest rows are not merged into one task.
    return archives.repartition(max(1, archives.count())).mapInArrow(run, RECORDS)
