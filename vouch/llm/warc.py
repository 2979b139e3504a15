"""WARC archives: written whole, normalised record by record, read back by offset.

Three Spark jobs, each a partition-wise pass over files in a shared folder:

* `write_archives` turns rows into .warc.gz files that are one gzip stream each
  (the monolithic form some crawlers leave behind);
* `normalise` inflates each such stream once, front to back, rewrites every
  record as a gzip member of its own, and writes beside each archive a sidecar
  index (offset, length and headers of each record), as JSON lines;
* `read_records` opens the archives at the offsets of the index.

Files are opened with pyarrow.fs by URI, so the folder may be on any shared
store that pyarrow knows. A task writes under a name of its own attempt and
reports the name in its result, so that a retried or speculative task never
meets half a file of another; only reported files are read on.

Records whose payloads are equal and have at least `least` bytes are stored
once: the row with the smallest id is the response, the others are revisit
records that name it (rows that repeat this id are all responses). Null
payloads count as empty; null ids come last and are never referred to while
another id is there. Rows that repeat are records each, further columns are not
looked at, whatever their names, and an empty table gives no archive. Memory is
bounded by one record, of whatever length, not by one archive, however strongly
it is compressed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm.common import fresh, shared_folder, table, written

#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
FILES = "archive string, records long"
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def store(uri: str):
    """The file system of a folder's URI, and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(record: str | None) -> int | None:
    number = (record or "")[10:-1]
    return int(number) if number else None


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record that keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def revisits(rows: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """rows with the column refers_to: the smallest id among equal payloads, null for that row itself.

    Equal payloads are found by SHA-1 and length. The digests are counted
    before anything is shuffled by them, so a payload that a third of the rows
    share is one row of the side that is joined, and Spark's skew join splits
    the other side.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    sha1, size, h, s, first = (fresh(name, rows.columns) for name in ("_sha1", "_size", "_h", "_s", "_first"))
    rows = rows.withColumns({sha1: F.sha1(F.encode(body, "utf-8")), size: F.octet_length(body)})
    groups = rows.where(F.col(size) >= least).groupBy(F.col(sha1).alias(h), F.col(size).alias(s)).agg(F.min(key).alias(first), F.count("*").alias("n"))
    many = groups.where("n > 1").select(h, s, first)
    joined = rows.join(many, (F.col(sha1) == F.col(h)) & (F.col(size) == F.col(s)), "left")
    other = F.col(first).isNotNull() & ~F.col(key).eqNullSafe(F.col(first))
    return joined.withColumn("refers_to", F.when(other, F.col(first))).drop(sha1, size, h, s, first)


class Archive:
    """One output file of a task, under a name that no other attempt has."""

    def __init__(self, folder: str, suffix: str):
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        self.name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}{suffix}"
        self.out, self.size, self.records = fs.open_output_stream(f"{path}/{self.name}", compression=None), 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def write_archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write rows (page_id, url, html, refers_to) as archives of one gzip stream each; returns the files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, archive, packer, size = [], None, None, 0

        def close():
            archive.write(packer.flush())
            archive.close()
            made.append((archive.name, archive.records))

        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    archive, packer, size = Archive(folder, ".warc.gz"), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = record_bytes(page, url, payload, digest, refers, refers is not None)
                archive.write(packer.compress(data))
                archive.records += 1
                size += len(data)
                if size >= most:
                    close()
                    archive = None
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"]
        )

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(each, FILES)


class Records:
    """The records of a gzip stream of any number of members, read in blocks and cut by Content-Length."""

    def __init__(self, stream):
        self.stream, self.held = stream, bytearray()
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Append some inflated bytes to what is held; False at the end."""
        while True:
            rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            data = rest or self.stream.read(BLOCK)
            if not data:
                return False
            got = self.inflate.decompress(data, BLOCK)
            if got:
                self.held += got
                return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, the whole record)"""
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self.more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            head = headers(bytes(self.held[:end]))
            whole = end + 4 + int(head["Content-Length"]) + 4
            while len(self.held) < whole:
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            record = bytes(self.held[:whole])
            del self.held[:whole]
            yield head, record


def normalise(files: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite each archive with a gzip member a record and a sidecar index; returns the index."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, index = Archive(folder, ".warc.gz"), []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, record in Records(stream):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        index.append((out.name, out.size, len(member), head["WARC-Record-ID"], head["WARC-Type"]))
                        out.write(member)
                out.close()
                names = ("archive", "offset", "length", "record_id", "record_type")
                to, where = store(folder)
                with to.open_output_stream(f"{where}/{out.name}.idx", compression=None) as sidecar:
                    for x in index:
                        sidecar.write(json.dumps(dict(zip(names, x, strict=True))).encode() + b"\n")
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in index], t) for i, t in enumerate(kinds)], names=list(names)
                )

    return files.mapInArrow(each, INDEX)


def spread(files: DataFrame) -> DataFrame:
    """Archive names dealt out one a task, as far as there are tasks."""
    return files.repartition(max(1, min(files.count(), 100_000)))


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at the index's offsets, each read and parsed on its own.

    Entries are brought together by archive and offset range, so each task
    seeks forward through its part of one archive; a single archive may be
    shared by many tasks. Without payloads they are read and checked, but not
    returned.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        name, stream = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    name, stream = archive, fs.open_input_file(f"{path}/{archive}")
                record = zlib.decompress(stream.read_at(length, offset), 31)
                head, _, block = record.partition(b"\r\n\r\n")
                head = headers(head)
                http, _, payload = block[: int(head["Content-Length"])].partition(b"\r\n\r\n")
                kind = head["WARC-Type"]
                if kind == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if "sha1:" + digest != head["WARC-Payload-Digest"]:
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't have its digest")
                size = int(headers(http)["Content-Length"])
                rows.append((page_of(head["WARC-Record-ID"]), size, head["WARC-Payload-Digest"][5:], kind,
                             page_of(head.get("WARC-Refers-To")), head["WARC-Target-URI"], payload if payloads and kind == "response" else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    ranges = index.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ranges.select("archive", "offset", "length").mapInArrow(each, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    whole, single = shared_folder(spark, "warc-whole"), shared_folder(spark, "warc")
    files = written(write_archives(revisits(pages, "page_id", "html"), whole), "warc-files")
    index = written(normalise(spread(files), whole, single), "warc-index")
    return read_records(index, single, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    # Base32 of 40 hex digits: eight groups of 5 digits, each 4 letters.
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
five as (select page_id, html, h, list_transform(range(0, 8), lambda i: cast('0x' || substr(h, 5 * i + 1, 5) as bigint)) as n from p)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  list_aggregate(list_transform(n, lambda x: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((x >> s) & 31 as bigint) + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = min(page_id) over (partition by html) then 'response' else 'revisit' end as record_type,
  case when page_id <> min(page_id) over (partition by html) then min(page_id) over (partition by html) end as refers_to
from five
"""
}
