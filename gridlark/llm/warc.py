"""WARC archives: written from, and read as, a chunked record table.

A payload is a run of rows (record id, chunk number, bytes) with at most
`chunk_bytes` bytes each, so that neither the writer nor the reader holds a
whole record: both carry a running SHA-256 and byte count from chunk to chunk.
Archives are written record by record as gzip members (WARC/1.1) to the folder
that all executors share, each task to files of its own under a new name; the
table of written files is staged, so that files of lost or repeated tasks are
never read.

Payload duplicates: of records with equal payloads of at least `least` bytes the
one with the smallest id is a response, the others revisit it. The digest table
holds one row per digest that occurs more than once; it is joined by digest, and
Spark splits a digest that many rows have.

Nulls: a null payload is empty; a null url is an empty target; a row with a null
id keeps its null id and never is what others refer to. Equal ids: each row is a
record of its own, told apart by its payload only. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import new_path, staged

CHUNK_BYTES = 64 * 1024
LEAST = 100
ARCHIVE_BYTES = 256 * 1024 * 1024
READ_BYTES = 1 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of this URI and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def with_record_types(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST) -> DataFrame:
    """record_id, target, payload (binary), payload_bytes, payload_digest, record_type, refers_to."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("record_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("target"), body.alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.where((F.col("payload_bytes") >= least) & F.col("record_id").isNotNull())
    firsts = large.groupBy("payload_digest").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(firsts, "payload_digest", "left")
    revisits = F.col("first").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("record_id").eqNullSafe(F.col("first"))
    return joined.select(
        "record_id", "target", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of with_record_types(): one row per chunk, in order, record by record; revisits have one empty chunk."""
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / F.lit(chunk_bytes)).cast("int") - 1)
    rows = records.withColumn("payload", stored).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(
        "record_id", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "chunk_no", last.alias("last_chunk"),
        F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"),
    )


def _header(row: dict) -> bytes:
    kind = row["record_type"]
    name = lambda i: "<urn:gridlark:null>" if i is None else f"<urn:gridlark:{i}>"
    stored = row["payload_bytes"] if kind == "response" else 0
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(row['record_id'])}",
        "WARC-Target-URI: " + row["target"].replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
        *([f"WARC-Refers-To: {name(row['refers_to'])}"] if kind == "revisit" else []),
        "Content-Type: application/octet-stream", f"Content-Length: {stored}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the chunked record table; returns the staged table (file, records, bytes) of the archives that count.

    A chunk whose running digest doesn't end at the record's digest stops the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        part = 0
        out = path = gz = sha = None
        records = size = left = 0
        done: list[tuple[str, int, int]] = []

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is None:
                        path = f"{root}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{part:04d}.warc.gz"
                        out, records, size = store.open_output_stream(path, compression=None), 0, 0
                    gz, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256()
                    left = row["payload_bytes"] if row["record_type"] == "response" else 0
                    put(gz.compress(_header(row)))
                put(gz.compress(row["chunk"]))
                sha.update(row["chunk"])
                left -= len(row["chunk"])
                if row["chunk_no"] == row["last_chunk"]:
                    if left or (row["record_type"] == "response" and sha.hexdigest() != row["payload_digest"]):
                        raise ValueError(f"record {row['record_id']}: chunks don't add up to the payload")
                    put(gz.compress(b"\r\n\r\n") + gz.flush())
                    records += 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path.rsplit("/", 1)[1], records, size))
                        out, part = None, part + 1
        if out is not None:
            out.close()
            done.append((path.rsplit("/", 1)[1], records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "bytes"])

    return staged(chunks.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-files")


class _Members:
    """The bytes of an archive, decompressed as they are asked for."""

    def __init__(self, stream):
        self.stream, self.gz, self.rest, self.ready = stream, None, b"", b""

    def more(self) -> bool:
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
            if not self.rest:
                return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.ready += self.gz.decompress(self.rest, READ_BYTES)
        if self.gz.eof:
            self.rest, self.gz = self.gz.unused_data, None
        else:
            self.rest = self.gz.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out, self.ready = self.ready[:at], self.ready[at + 2 :]
        return out

    def take(self, most: int) -> bytes:
        while not self.ready:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def _number(value: str) -> int | None:
    text = value.removeprefix("<urn:gridlark:").removesuffix(">")
    return None if text == "null" else int(text)


CHUNK_SCHEMA = (
    "record_id bigint, target string, record_type string, refers_to bigint, payload_bytes bigint, header_digest string, "
    "chunk_no int, is_last boolean, bytes_so_far bigint, digest_so_far string, chunk binary"
)


def read_archives(files: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named by column `file`; digest_so_far and bytes_so_far run from chunk to chunk.

    with_data=False leaves the chunks out and only the last row of each record in.
    """
    schema = pa.schema([
        ("record_id", pa.int64()), ("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("header_digest", pa.string()),
        ("chunk_no", pa.int32()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("chunk", pa.binary()),
    ])

    def rows(path: str, store: fs.FileSystem) -> Iterator[dict]:
        with store.open_input_stream(path, compression=None) as stream:
            members = _Members(stream)
            while (first := members.line()) is not None:
                if not first:
                    continue
                head = {}
                while line := members.line():
                    name, _, value = line.decode().partition(": ")
                    head[name] = value
                left, n, seen, sha = int(head["Content-Length"]), 0, 0, hashlib.sha256()
                base = {
                    "record_id": _number(head["WARC-Record-ID"]), "target": head["WARC-Target-URI"], "record_type": head["WARC-Type"],
                    "refers_to": _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
                    "payload_bytes": int(head["X-Payload-Length"]), "header_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"),
                }
                while True:
                    parts, want = [], min(left, chunk_bytes)
                    while want:
                        parts.append(members.take(want))
                        want -= len(parts[-1])
                    chunk = b"".join(parts)
                    sha.update(chunk)
                    left, seen = left - len(chunk), seen + len(chunk)
                    if with_data or not left:
                        yield base | {"chunk_no": n, "is_last": not left, "bytes_so_far": seen, "digest_so_far": sha.hexdigest(), "chunk": chunk if with_data else None}
                    n += 1
                    if not left:
                        break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                block, held = [], 0
                for row in rows(f"{root}/{name}", store):
                    block.append(row)
                    held += len(row["chunk"] or b"") + 300
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(block, schema)
                        block, held = [], 0
                if block:
                    yield pa.RecordBatch.from_pylist(block, schema)

    names = files.select("file")
    n = max(1, files.count())
    return names.repartition(n).mapInArrow(run, CHUNK_SCHEMA)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write one record per row; returns the table of archives and their folder."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return write_archives(chunked(with_record_types(pages, key, url, payload)), folder), folder
