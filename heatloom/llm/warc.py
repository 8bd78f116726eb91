"""WARC archives as a table of chunks.

A record's bytes are rows (record, chunk, chunks, data) of at most `chunk_bytes` each, in Parquet, so that any store can hold them and no
task ever holds a whole record. Payloads are cut in the scan and pass the digests chunk by chunk: their state is carried
over the rows of a record, and the last row gets the result. Only ids and digests are grouped to find equal payloads. Heads
and chunks then meet by record, sorted by chunk number, and become the archive; the payloads of revisits are left out.
Reading parses chunk by chunk as well; only records of several chunks are shuffled for that.
`export_files` and `import_files` turn the table into .warc.gz files of a folder that all tasks can open, and back.

Defined results: a null or empty payload is one of 0 bytes; payloads are equal if length, SHA-1 and a second digest are; the response of equal
payloads is the one with the largest id (null ids last), of equal ids the first one read; rows that repeat an id are
records of their own; a null url gives no target; control characters and blanks of urls are percent-encoded in headers; extra columns do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, join_hot, remove, whole_numbers, write_cut

CHUNK_BYTES = 1 << 16
#: Bytes of a batch between Spark and a task's Python.
BATCH_BYTES = 1 << 25
ARCHIVE = "record long, chunk int, chunks int, data binary"
RECORD = "record long, id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs inside send at most BATCH_BYTES at a time to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def cut_payloads(pages: DataFrame, id_col: str, payload_col: str, url_col: str, chunk_bytes: int) -> DataFrame:
    """record, id, url, chunk, data; on a record's last row also its bytes, sha1 and check (a second digest)."""
    payload = F.coalesce(column(payload_col).cast("binary"), F.lit(bytearray()))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), column(id_col).cast("long").alias("id"), column(url_col).cast("string").alias("url"), payload.alias("payload"))
    last = F.greatest(F.lit(0), F.ceil(F.length("payload") / chunk_bytes) - 1).cast("int")
    rows = rows.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
    rows = rows.select("record", "id", "url", "chunk", (F.col("chunk") == F.col("last")).alias("ends"), F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha1, check, size = hashlib.sha1(), hashlib.blake2b(digest_size=16), 0
        for batch in batches:
            found = []
            for ends, data in zip(batch.column(4).to_pylist(), batch.column(5), strict=True):
                data = data.as_py()
                sha1.update(data)
                check.update(data)
                size += len(data)
                found.append((size, sha1.digest(), check.digest()) if ends else (None, None, None))
                if ends:
                    sha1, check, size = hashlib.sha1(), hashlib.blake2b(digest_size=16), 0
            sizes, sha1s, checks = zip(*found, strict=True) if found else ((), (), ())
            own = [batch.column(i) for i in (0, 1, 2, 3, 5)] + [pa.array(sizes, pa.int64()), pa.array(sha1s, pa.binary()), pa.array(checks, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, ["record", "id", "url", "chunk", "data", "bytes", "sha1", "check"])

    return rows.mapInArrow(digest, "record long, id long, url string, chunk int, data binary, bytes long, sha1 binary, check binary")


def record_urn(record: int, id_: int | None) -> str:
    return f"<urn:x-record:{record}:{'' if id_ is None else id_}>"


def urn_id(urn: str | None) -> int | None:
    """The id in a record_urn; None for other names."""
    parts = (urn or "").strip("<>").split(":")
    return int(parts[3]) if parts[:2] == ["urn", "x-record"] and len(parts) == 4 and parts[3] else None


def header_url(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def record_head(h: dict, date: str) -> bytes:
    """All of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {h['bytes']}\r\n\r\n".encode()
    again = h["first_record"] is not None and h["first_record"] != h["record"]
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_urn(h["record"], h["id"])), ("WARC-Date", date)]
    if h["url"] is not None:
        fields.append(("WARC-Target-URI", header_url(h["url"])))
    fields.append(("WARC-Payload-Digest", "sha1:" + digest_text(h["sha1"])))
    if again:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(h["first_record"], h["first_id"]))]
        if h["first_url"] is not None:
            fields.append(("WARC-Refers-To-Target-URI", header_url(h["first_url"])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (0 if again else h["bytes"])))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + http


class Rows:
    """Rows of one record from its bytes as they come."""

    def __init__(self, record: int, total: int, chunk_bytes: int) -> None:
        self.record, self.size, self.chunks = record, chunk_bytes, -(-total // chunk_bytes)
        self.held, self.chunk = bytearray(), 0

    def add(self, data: bytes, ends: bool = False) -> Iterator[tuple]:
        self.held += data
        while len(self.held) >= self.size or (ends and self.held):
            yield self.record, self.chunk, self.chunks, bytes(self.held[: self.size])
            del self.held[: self.size]
            self.chunk += 1


def in_batches(rows: Iterator[tuple], schema: pa.Schema, data_at: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[data_at]) if data_at is not None else 0)
        if size >= BATCH_BYTES // 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


ARCHIVE_ARROW = pa.schema([("record", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.binary())])
RECORD_ARROW = pa.schema([("record", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record for each row to the archive table at path. Of equal payloads of at least min_bytes one is the response, the
    others revisit it."""
    whole_numbers(pages, id_col)
    spark = pages.sparkSession
    with small_batches(spark):
        chunks, path1 = write_cut(cut_payloads(pages, id_col, payload_col, url_col, chunk_bytes))
        heads = chunks.where("bytes is not null").select("record", "id", "url", "bytes", "sha1", "check")
        first = F.max(F.struct("id", (-F.col("record")).alias("minus"), "url"))
        same = heads.where(F.col("bytes") >= min_bytes).groupBy("sha1", "check", "bytes").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
        same, path2 = write_cut(same.select("sha1", "check", "bytes", F.col("first.id").alias("first_id"), (-F.col("first.minus")).alias("first_record"), F.col("first.url").alias("first_url")))
        heads = join_hot(heads, same, ["sha1", "check", "bytes"], "left")
        names = ["id", "url", "bytes", "sha1", "first_id", "first_record", "first_url"]
        both = heads.select("record", F.lit(-1).alias("chunk"), F.struct(*names).alias("head"), F.lit(None).cast("binary").alias("data"))
        both = both.unionByName(chunks.select("record", "chunk", "data"), allowMissingColumns=True)

        def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                own, again, left = None, False, 0
                for batch in batches:
                    for record, chunk, head, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                        if chunk.as_py() < 0:
                            h = {"record": record.as_py(), **head.as_py()}
                            text = record_head(h, date)
                            again = h["first_record"] is not None and h["first_record"] != h["record"]
                            left = 0 if again else h["bytes"]
                            own = Rows(h["record"], len(text) + left + len(END), chunk_bytes)
                            yield from own.add(text + (b"" if left else END), ends=not left)
                        elif left:
                            data = data.as_py()
                            left -= len(data)
                            yield from own.add(data if left else data + END, ends=not left)

            return in_batches(rows(), ARCHIVE_ARROW, 3)

        both = both.repartition("record").sortWithinPartitions("record", "chunk")
        both.mapInArrow(assemble, ARCHIVE).write.option("compression", "zstd").parquet(path)
    for p in (path1, path2):
        remove(spark, p)


class Parser:
    """One record's bytes, as they come; never held whole. `out` gets the payload's pieces."""

    def __init__(self, out=None) -> None:
        self.held, self.fields, self.http, self.left, self.payload, self.sha1, self.out = b"", None, None, 0, 0, hashlib.sha1(), out

    def add(self, data: bytes) -> None:
        if self.fields is None:
            self.held += data
            if END not in self.held:
                return
            head, data = self.held.split(END, 1)
            version, *lines = head.decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("no WARC record")
            self.fields, self.held = fields_of(lines), b""
            self.left = int(self.fields.get("content-length", 0))
            self.http = {} if not self.fields.get("content-type", "").startswith("application/http") else None
        data = data[: self.left]
        self.left -= len(data)
        if self.http is None:
            self.held += data
            if END not in self.held:
                return
            head, data = self.held.split(END, 1)
            self.http, self.held = fields_of(head.decode("utf-8", "replace").split("\r\n")[1:]), b""
        self.payload += len(data)
        self.sha1.update(data)
        if self.out is not None and data:
            self.out(data)

    def row(self, record: int) -> tuple:
        f = self.fields or {}
        kind, said = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        digest, size, whole = digest_text(self.sha1.digest()), self.payload, self.fields is not None and self.left == 0
        if kind == "revisit":
            told = (self.http or {}).get("content-length")
            digest, size = said, None if told is None else int(told)
        return record, urn_id(f.get("warc-record-id")), f.get("warc-target-uri"), kind, size, digest, urn_id(f.get("warc-refers-to")), whole and said in (None, digest)


def fields_of(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parsed(archive: DataFrame, run, schema: str) -> DataFrame:
    """run over the rows of whole records: those of one row where they are, the others by record and chunk."""
    one = archive.where("chunks = 1").mapInArrow(run, schema)
    return one.unionByName(archive.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(run, schema))


def read_records(archive: DataFrame) -> DataFrame:
    """One row a record. payload_digest is of the payload read; a revisit has those of its headers, and refers_to the id of its response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            own = Parser()
            for batch in batches:
                for record, chunk, chunks, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                    own.add(data.as_py())
                    if chunk.as_py() + 1 == chunks.as_py():
                        yield own.row(record.as_py())
                        own = Parser()

        return in_batches(rows(), RECORD_ARROW)

    return parsed(archive.select("record", "chunk", "chunks", "data"), run, RECORD)


def read_payloads(archive: DataFrame) -> DataFrame:
    """record, id, chunk, data: the payloads in pieces; none for a payload of 0 bytes."""
    schema = pa.schema([("record", pa.int64()), ("id", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            pieces: list[bytes] = []
            own, n = Parser(pieces.append), 0
            for batch in batches:
                for record, chunk, chunks, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                    own.add(data.as_py())
                    while pieces:
                        yield record.as_py(), urn_id(own.fields.get("warc-record-id")), n, pieces.pop(0)
                        n += 1
                    if chunk.as_py() + 1 == chunks.as_py():
                        own, n = Parser(pieces.append), 0

        return in_batches(rows(), schema, 3)

    return parsed(archive.select("record", "chunk", "chunks", "data"), run, "record long, id long, chunk int, data binary")


def export_files(archive: DataFrame, folder: str) -> list[str]:
    """Write .warc.gz files, one a partition and one gzip member a record, to a folder that all tasks can open; gives their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        path, n, member = f"{folder}/{name}.{uuid.uuid4().hex}", 0, None
        with open(path, "wb") as raw:
            for batch in batches:
                for chunk, chunks, data in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                    member = member or gzip.GzipFile(fileobj=raw, mode="wb", mtime=0, filename="")
                    member.write(data.as_py())
                    if chunk.as_py() + 1 == chunks.as_py():
                        member.close()
                        member, n = None, n + 1
        if not n:
            os.unlink(path)
            return
        os.replace(path, f"{folder}/{name}")  # a task that runs again writes the same file
        yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = archive.select("record", "chunk", "chunks", "data").repartition("record").sortWithinPartitions("record", "chunk")
    return sorted(r.name for r in rows.mapInArrow(run, "name string").collect())  # one short row a file


def import_files(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archive table of .warc and .warc.gz files, one task a file, each streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    record = number << 40
                    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
                        while line := f.readline():
                            if not line.strip():
                                continue
                            head, size = bytearray(line), 0
                            while (line := f.readline()).strip():
                                head += line
                                if line.lower().startswith(b"content-length:"):
                                    size = int(line.split(b":", 1)[1])
                            own, left = Rows(record, len(head) + 2 + size + len(END), chunk_bytes), size
                            yield from own.add(bytes(head) + b"\r\n")
                            while left and (data := f.read(min(left, chunk_bytes))):
                                left -= len(data)
                                yield from own.add(data)
                            if left:
                                raise ValueError(f"{path} ends inside a record")
                            yield from own.add(END, ends=True)
                            record += 1

        return in_batches(rows(), ARCHIVE_ARROW, 3)

    files = spark.createDataFrame(list(enumerate(paths)), "number long, path string").repartition(max(1, len(paths)), "number")
    return files.mapInArrow(run, ARCHIVE)
