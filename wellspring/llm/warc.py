"""WARC archives: one gzip member per record, and a sequential reader.

*Writing*: every page becomes a ``response`` record (HTTP header and payload), or a
``revisit`` of the page with the smallest id that has the same payload of at least
``SMALL`` bytes. Who revisits whom is decided on digests alone: a partial minimum per
digest and a join that adaptive execution can split, so a payload shared by a third of
all pages meets in no single task, and payloads move once at most. Each task writes one archive into the shared
folder under a hidden name and renames it, so a task run again replaces its own file.

*Reading*: a file is read in blocks of fixed size; an incremental decompressor takes
one member after the other, Content-Length frames the block, and the block and payload
digests are verified while the bytes stream by. A broken record raises ``ValueError``.

Edges: a null payload is empty; equal rows each get a record; of equal payloads the
smallest page_id answers, and further rows with that same id are responses too; a null
page_id is written as an empty id and never answers for others; an empty table makes
no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm.tables import shared_dir, stored

SMALL = 100
BLOCK = 1 << 16
NO_ID = -(1 << 63)
DATE = "2026-01-01T00:00:00Z"

READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
    " archive string, position long"
)


def record_uri(page_id: int | None) -> str:
    return f"<urn:wellspring:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return int(name) if name else None


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = http.encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(url.splitlines())}"] if url else []),
        *([f"WARC-Refers-To: {record_uri(refers_to)}"] if revisit else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines) + "\r\n\r\n"
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, archive: _Archive) -> None:
        self.archive, self.inflate, self.ready = archive, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.archive.take()
        made = self.inflate.decompress(data, BLOCK)
        if not data and not made and not self.inflate.eof:
            raise ValueError("the archive ends inside a record")
        self.ready += made
        if self.inflate.eof:
            self.archive.give_back(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise ValueError("a header without end")
        head, _, self.ready = self.ready.partition(mark)
        return head

    def chunks(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.ready and not self.more():
                raise ValueError("a block is shorter than its Content-Length")
            part, self.ready = self.ready[:length], self.ready[length:]
            length -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.ready


class _Archive:
    def __init__(self, source: BinaryIO) -> None:
        self.source, self.spare, self.read = source, b"", 0

    def take(self) -> bytes:
        if self.spare:
            data, self.spare = self.spare, b""
        else:
            data = self.source.read(BLOCK)
        self.read += len(data)
        return data

    def give_back(self, data: bytes) -> None:
        self.spare = data + self.spare
        self.read -= len(data)


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(source: BinaryIO) -> Iterator[dict]:
    """The records of an archive in order, with digests verified."""
    archive = _Archive(source)
    while True:
        position = archive.read
        first = archive.take()
        if not first:
            return
        archive.give_back(first)
        yield _record(_Member(archive)) | {"position": position}


def _record(m: _Member) -> dict:
    version, *lines = m.until(b"\r\n\r\n").decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = _fields(lines)
    block, payload = hashlib.sha1(), hashlib.sha256()
    held, http, size = b"", None, 0
    for part in m.chunks(int(field["content-length"])):
        block.update(part)
        if http is None:
            held += part
            if b"\r\n\r\n" not in held:
                continue
            head, _, part = held.partition(b"\r\n\r\n")
            http = _fields(head.decode().split("\r\n")[1:])
        payload.update(part)
        size += len(part)
    if m.rest() != b"\r\n\r\n":
        raise ValueError("a record does not end behind its block")
    if field["warc-block-digest"] != f"sha1:{base64.b32encode(block.digest()).decode()}":
        raise ValueError("block digest differs")
    digest = field["warc-payload-digest"].removeprefix("sha256:")
    revisit = field["warc-type"] == "revisit"
    full = int((http or {}).get("content-length", size))
    if not revisit and (digest != payload.hexdigest() or full != size):
        raise ValueError("payload digest or length differs")
    return {
        "page_id": page_of(field["warc-record-id"]),
        "url": field.get("warc-target-uri"),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": field["warc-type"],
        "refers_to": page_of(field["warc-refers-to"]) if revisit else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        hidden = f"{path}/.{uuid.uuid4().hex}"
        out, n = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(hidden, compression=None)
                payload = row["payload"] or b""
                out.write(member(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
                n += 1
        if out:
            out.close()
            store.move(hidden, name)
            yield pa.RecordBatch.from_pydict({"archive": [name.rpartition("/")[2]], "n_records": [n]})

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages as archives into ``folder``; returns the archives and their numbers of records."""
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), data.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    large = rows.where(F.octet_length("payload") >= SMALL).select("page_id", "digest")
    answers = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    revisits = large.join(answers.where("n > 1").drop("n"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = stored(revisits.select(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "digest", "refers_to").distinct())
    told = rows.withColumn("id", F.coalesce("page_id", F.lit(NO_ID))).join(revisits, ["id", "digest"], "left")
    folder = as_uri(folder)
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    ordered = told.select("page_id", "url", "payload", "digest", "refers_to").sortWithinPartitions("page_id", "url", "digest")
    return stored(ordered.mapInArrow(_write(folder), "archive string, n_records long"))


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("position", pa.int64())]
        )
        for batch in batches:
            for name in batch["archive"].to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    rows = []
                    for record in read_records(source):
                        rows.append(record | {"archive": name})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """All records of the named archives: an archive is read by one task from its first to its last byte."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(n, "archive").mapInArrow(_read(as_uri(folder)), READ)


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark)
