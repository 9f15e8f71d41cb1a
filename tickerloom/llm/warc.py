"""WARC archives: records written and read as rows of chunks, never as whole payloads.

A payload is a run of rows (record_id, chunk_no, data) with the digest of what came so far.  Writer and reader
keep one chunk at a time.  Archives are written by the tasks through Arrow's file systems, which take the
address of any shared folder.  A file's name holds the task attempt, and the table that the writing job returns
lists the files of the attempts that counted, so that files of lost tasks are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.store import folder, kept

CHUNK = 256 * 1024
ROLL = 1 << 30
LEAST_SHARED = 100
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, digest, refers_to): pages whose payload is that of a page with a smaller id, at ``least`` bytes long."""
    slim = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return slim.join(shared, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def name_of(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def chunk_rows(payload: bytes, size: int = CHUNK) -> Iterator[tuple[int, memoryview]]:
    """Number and bytes of each chunk; an empty payload is one empty chunk."""
    whole = memoryview(payload)
    for k in range(max(1, -(-len(whole) // size))):
        yield k, whole[k * size:(k + 1) * size]


@dataclass
class Archive:
    """An archive file being written, one gzip member for each record."""

    base: str
    count: int = 0
    size: int = 0
    path: str = ""
    stream: object = None
    files: list[tuple[str, int]] = field(default_factory=list)

    def begin(self) -> None:
        if self.stream is not None and self.size < ROLL:
            return
        self.close()
        where, root = pafs.FileSystem.from_uri(self.base)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        self.path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(self.files)}-{uuid.uuid4().hex[:8]}.warc.gz"
        self.stream, self.size = where.open_output_stream(f"{root}/{self.path}", compression=None), 0

    def write(self, headers: list[tuple[str, str]], length: int, parts: Iterator) -> None:
        self.begin()
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(length))])
        for part in self.whole(head, parts):
            self.put(pack.compress(part))
        self.put(pack.flush())
        self.count += 1

    @staticmethod
    def whole(head: str, parts: Iterator) -> Iterator:
        yield f"WARC/1.0\r\n{head}\r\n".encode()
        yield from parts
        yield b"\r\n\r\n"

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.files.append((self.path, self.count))
            self.stream, self.count = None, 0


def write_records(batches: Iterator[pa.RecordBatch], base: str, date: str, chunk: int) -> Iterator[pa.RecordBatch]:
    archive = Archive(base)
    for batch in batches:
        for i in range(batch.num_rows):
            page, url, digest, refers = (batch.column(c)[i].as_py() for c in ("page_id", "url", "digest", "refers_to"))
            payload = batch.column("html")[i].as_buffer()
            headers = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", name_of(page))]
            headers += [("WARC-Target-URI", clean(url))] if url is not None else []
            headers += [("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
            if refers is None:
                archive.write(headers, len(HTTP) + len(payload), chain([HTTP], (data for _, data in chunk_rows(payload, chunk))))
            else:
                headers += [("WARC-Refers-To", name_of(refers)), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(payload)))]
                archive.write(headers, len(HTTP), (HTTP,))
    archive.close()
    yield pa.RecordBatch.from_pydict({"file": pa.array([f for f, _ in archive.files], pa.string()), "records": pa.array([n for _, n in archive.files], pa.int64())})


def write_archives(pages: DataFrame, base: str | None = None, date: str = DATE, chunk: int = CHUNK) -> tuple[str, DataFrame]:
    """Write a record for every row of ``pages`` (page_id, url, html); the folder, and (file, records).

    A missing html is empty, a missing url has no target.  Of equal payloads of ``LEAST_SHARED`` bytes
    or more, that with the smallest page_id is a response and the others revisit it; rows that repeat this
    id, and rows without an id, are responses.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    revisits = kept(record_types(rows), "revisits")
    base = base or folder(pages.sparkSession, "warc")
    typed = rows.withColumn("digest", F.sha2("html", 256)).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "digest", "refers_to", "html")
    return base, kept(typed.mapInArrow(lambda it: write_records(it, base, date, chunk), "file string, records long"), "archives")


def read_head(stream) -> dict[str, str] | None:
    """The headers of the next record, or nothing at the end of the file."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        key, _, value = line.decode().partition(":")
        head[key.strip().lower()] = value.strip()
    return head


def record_chunks(stream, chunk: int) -> Iterator[tuple]:
    """(headers, chunk number, data, bytes so far, digest so far, last) of every payload in an open archive."""
    while (head := read_head(stream)) is not None:
        left = int(head["content-length"])
        while left:  # the HTTP headers
            line = stream.readline(left)
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        done, k, digest = 0, 0, hashlib.sha256()
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise EOFError(f"{head['warc-record-id']}: {left} bytes are missing")
            left -= len(data)
            done += len(data)
            digest.update(data)
            yield head, k, data, done, digest.hexdigest(), left == 0
            k += 1
            if not left:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{head['warc-record-id']} doesn't end where its length says")


CHUNKS = "record_id string, record_type string, url string, refers_to string, stated_digest string, stated_bytes long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def read_files(batches: Iterator[pa.RecordBatch], base: str, chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()),
                        ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
    where, root = pafs.FileSystem.from_uri(base)
    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows, held = [], 0
            with where.open_input_stream(f"{root}/{file}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                for head, k, data, done, digest, last in record_chunks(stream, chunk):
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha256:"),
                                 int(head["x-payload-length"]) if "x-payload-length" in head else None, k, data if with_data else None, done, digest, last))
                    held += len(data) * with_data
                    if len(rows) >= 2000 or held >= 16 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(base: str, files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the listed files: a row for each chunk of each payload, with running digest and size.

    A file is streamed by one task, and the files are dealt over all tasks.  Where a payload ends, the running digest is that of the whole payload.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as a list of names alone would be brought into one task
    return files.select("file").repartition(n, "file").mapInArrow(lambda it: read_files(it, base, chunk, with_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the last chunk of each: what was read of responses, what revisits state."""
    revisit = F.col("record_type") == "revisit"
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit(""))
    return chunks.where("last").select(
        number("record_id").alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", number(F.coalesce("refers_to", F.lit(""))).alias("refers_to"))
