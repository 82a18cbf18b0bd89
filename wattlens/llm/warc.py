"""WARC archives: a Spark writer, and a sequential reader.

``write`` makes archives of one gzip member per record in a shared folder; each task writes files of
its own and rolls them at ``FILE_BYTES``. The manifest table (path, records, bytes), which Spark
commits, names the files of the attempts that succeeded, so a lost executor's half-written files
are never read. ``read`` deals the manifest's files to tasks. A task reads its file front to back in
``CHUNK`` bytes: incremental zlib decompression, one member per record, the block framed by
Content-Length, SHA-256 digests of block and payload verified; what doesn't fit raises ``WarcError``.

Of pages with equal payloads of at least ``REVISIT_BYTES``, that with the smallest id is written as a
response and the others as revisits that refer to it (no payload again; the HTTP header keeps its
length). Equality is by SHA-256.

Defined results: a null payload is empty; a null id gets no id header and is never the response that
others refer to if its group has an id; where no row of a group has an id all are responses; rows with
one id and payload get the same record type; an empty table gives no archive and no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
#: Compressed bytes after which a task starts another file.
FILE_BYTES = 64 << 20
CHUNK = 1 << 18
#: Rows written or read at once.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20
LEVEL = 3

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"


class WarcError(ValueError):
    """The archive isn't what its headers say."""


class Record(NamedTuple):
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def record_bytes(page_id: Any, url: str | None, payload: bytes, digest: str, refers_to: Any = None) -> bytes:
    """One record, not yet compressed."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{digest}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own, the same for the same data."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


class _Archive:
    """The files that one task attempt writes."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        self.folder, self.name = folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        self.number, self.out, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.path = posixpath.join(self.folder, f"{self.name}-{self.number:04d}.warc.gz")
            fs, place = _filesystem(self.path)
            fs.create_dir(posixpath.dirname(place), recursive=True)
            self.out, self.records, self.bytes = fs.open_output_stream(place, compression=None), 0, 0
        self.out.write(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.bytes))
            self.out, self.number = None, self.number + 1


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    revisits = (keys.join(groups, "digest").where("page_id IS NULL OR page_id > first_id")
                .groupBy(F.col("digest").alias("_digest"), F.col("page_id").alias("_id")).agg(F.first("first_id").alias("refers_to")))
    # by id and digest, so that neither a hot payload nor many null ids meet in one task
    return rows.join(revisits, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left").drop("_digest", "_id", "n")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write every row as a record under ``folder`` (shared storage) and return the manifest, stored beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(posixpath.join(folder, "archives"))
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                archive.add(member(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())))
        archive.close()
        if archive.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*archive.done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             names=["path", "records", "bytes"])

    path = posixpath.join(folder, "manifest")
    rows = with_revisits(pages, id_col, payload_col, url_col).select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(run, _MANIFEST).write.parquet(path)
    return pages.sparkSession.read.schema(_MANIFEST).parquet(path)


class _Member:
    """The uncompressed bytes of the gzip members of a file, one member after the other."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.unpack = source, b"", None

    def next(self) -> bool:
        """Go to the next member, if there is one."""
        if not self.raw:
            self.raw = self.source.read(CHUNK)
        self.unpack = zlib.decompressobj(31) if self.raw else None
        self.ready = b""
        return self.unpack is not None

    def more(self) -> bytes:
        """Some more of this member; empty at its end."""
        if self.ready:
            out, self.ready = self.ready, b""
            return out
        while not self.unpack.eof:
            try:
                out = self.unpack.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out
            if not self.unpack.eof and not self.raw:
                self.raw = self.source.read(CHUNK)
                if not self.raw:
                    raise WarcError("the file ends within a record")
        return b""

    def head(self) -> bytes:
        """All up to the next empty line."""
        got = bytearray()
        while (end := got.find(b"\r\n\r\n")) < 0:
            more = self.more()
            if not more:
                raise WarcError("a header has no end")
            got += more
        self.ready = bytes(got[end + 4:]) + self.ready
        return bytes(got[:end])

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            more = self.more()
            if not more:
                raise WarcError("a block is shorter than its Content-Length")
            self.ready = more[n:]
            yield more[:n]
            n -= min(n, len(more))


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(source: BinaryIO, payload: bool = True) -> Iterator[Record]:
    """All records of an archive, front to back. Memory: one chunk, and the payload if it is wanted."""
    file = _Member(source)
    while file.next():
        version, headers = _headers(file.head())
        if not version.startswith("WARC/1."):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without Content-Length") from e
        block, body, http, kept, head = hashlib.sha256(), hashlib.sha256(), None, [], b""
        size = 0
        for piece in file.exactly(length):
            block.update(piece)
            if http is None:
                head += piece
                if (end := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece = _headers(head[:end])[1], head[end + 4:]
            body.update(piece)
            size += len(piece)
            if payload:
                kept.append(piece)
        rest = b"".join(iter(file.more, b""))
        if rest != b"\r\n\r\n":
            raise WarcError("a record doesn't end after its block")
        if headers.get("warc-block-digest") != f"sha256:{block.hexdigest()}":
            raise WarcError(f"wrong block digest in {headers.get('warc-record-id')}")
        digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
        revisit = headers.get("warc-type") == "revisit"
        if not revisit and digest != body.hexdigest():
            raise WarcError(f"wrong payload digest in {headers.get('warc-record-id')}")
        http = http or {}
        yield Record(headers, http, int(http.get("content-length", 0)) if revisit else size, digest, b"".join(kept) if payload and not revisit else None)


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload of responses if wanted."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for files in batches:
            for path, count in zip(files.column("path").to_pylist(), files.column("records").to_pylist(), strict=True):
                fs, place = _filesystem(path)
                found = 0
                with fs.open_input_stream(place, compression=None) as source:
                    for r in records(source, payload):
                        page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), r.headers.get("warc-target-uri"), r.payload_bytes, r.payload_digest,
                                     r.headers.get("warc-type"), None if refers is None else int(refers), *[r.payload] * payload))
                        found, size = found + 1, size + len(r.payload or b"")
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if found != count:
                    raise WarcError(f"{path} holds {found} records, not {count}")
        if rows:
            yield batch(rows)

    files = manifest.agg(F.count("*")).first()[0]
    return manifest.repartition(max(files, 1)).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Write the archives and read them back."""
    return read(write(pages, folder), payload)
