"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and its writer.

Each record is a gzip member of its own whose extra field ``sl`` holds the member's length, so a
reader can step over a record without inflating it. Reading plans a task for each file. Of every
record the headers come first; the filters that Spark pushes down (record type, ids, digest, URI)
are tested on them, and the payloads of other records are neither read nor inflated. Archives of
other writers, without the extra field or without compression between members, are read too, only
that their members must be inflated to find their ends.

``archive`` writes pages so that of several equal payloads one is stored: the row with the largest
page id as ``response``, the others as ``revisit`` records that name it.

Defined results: a null payload counts as empty. A null page id is the smallest; where all ids of a
payload are null, and among rows that repeat the largest id, each row is a response. A null URL
leaves its header out; blanks and control characters in URLs are percent-encoded. Empty tables give
no records. Payloads below ``min_bytes`` are all responses. A digest that does not fit its payload
stops the reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from wayloom.llm.common import pages
from wayloom.llm.storage import committed, opened
from wayloom.session import scratch_path, stage

SCHEMA = (
    "record_type string, record_id string, page_id long, target_uri string, payload_digest string, "
    "refers_to long, payload_bytes long, payload binary"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Columns that the headers alone decide.
FROM_HEADERS = ("record_type", "record_id", "page_id", "target_uri", "payload_digest", "refers_to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SUFFIX = ".warc.gz"
LEVEL = 1
READ_AHEAD = 1 << 20
BATCH = 4 << 20


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member whose extra field holds its own length and that of its contents."""
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = engine.compress(data) + engine.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_size(head: bytes) -> int | None:
    """The member's length by its extra field, None if it has no such field."""
    if len(head) < 24 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        name, size = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and size == 8:
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def safe_uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(row: dict) -> bytes:
    """One record, from the columns that :func:`archive` prepares."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", page_urn(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + len(payload))),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", safe_uri(row["url"])))
    if revisit:
        fields += [("WARC-Refers-To", page_urn(row["refers_to"])), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return b"".join((head.encode(), http.encode(), payload, b"\r\n\r\n"))


class _Window:
    """Bytes of a file by position, read ahead."""

    def __init__(self, source):
        self.source, self.start, self.held = source, 0, b""

    def at(self, position: int, size: int) -> bytes:
        if not (self.start <= position and position + size <= self.start + len(self.held)):
            self.source.seek(position)
            self.start, self.held = position, self.source.read(max(size, READ_AHEAD))
        begin = position - self.start
        return self.held[begin : begin + size]


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def from_headers(fields: dict[str, str]) -> dict:
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "page_id": page_of(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": page_of(fields.get("warc-refers-to")),
    }


def records(source, size: int, wanted, payload: str) -> Iterator[dict]:
    """The records of an archive whose headers are wanted.

    ``payload``: ``bytes`` gives the payloads, ``digest`` tests their digest and drops them,
    ``none`` skips them.
    """
    window, position, step = _Window(source), 0, 4096
    while position < size:
        chunk = window.at(position, step)
        length = member_size(chunk)
        engine = zlib.decompressobj(31)
        fed, text = len(chunk), engine.decompress(chunk)

        def more() -> bytes:
            nonlocal fed
            part = window.at(position + fed, 16 * step if length is None else max(1, length - fed))
            if not part:
                raise ValueError("a record is cut off")
            fed += len(part)
            return engine.decompress(part)

        while (end := text.find(b"\r\n\r\n")) < 0:
            text += more()
        fields = header_fields(text[:end])
        row = from_headers(fields)
        take = wanted(row)
        if not (take and payload != "none") and length is not None:
            body = text[end + 4 : end + 4 + 4096]
        else:
            parts = [text]
            while not engine.eof:
                parts.append(more())
            text = b"".join(parts)
            body = text[end + 4 : end + 4 + int(fields.get("content-length", 0))]
        position += length if length is not None else fed - len(engine.unused_data)
        if not take:
            continue
        http, _, content = body.partition(b"\r\n\r\n")
        found = header_fields(http).get("content-length")
        row["payload_bytes"] = int(found) if found else len(content)
        row["payload"] = None
        if row["record_type"] == "response" and payload != "none":
            digest = digest_text(content)
            if row["payload_digest"] not in (None, digest) or row["payload_bytes"] != len(content):
                raise ValueError(f"payload and headers of {row['record_id']} differ")
            row["payload_digest"] = digest
            row["payload"] = content if payload == "bytes" else None
        yield row


class _File(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        for item in filters:
            name = item.attribute[0] if isinstance(item, (EqualTo, In)) else None
            if name in FROM_HEADERS and len(item.attribute) == 1:
                values = item.value if isinstance(item, In) else (item.value,)
                self.tests.append((name, frozenset(values)))
            else:
                yield item

    def partitions(self):
        files, name = opened(self.path)
        found = files.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        # The URI's scheme and host stay in front of what the listing gives.
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        listed = [x for x in found if x.path.endswith((".warc.gz", ".warc"))]
        return [_File(prefix + x.path, x.size) for x in listed] or [_File("", 0)]

    def wanted(self, row: dict) -> bool:
        return all(row[name] in values for name, values in self.tests)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, name = opened(partition.path)
        schema = pa.schema(
            [
                (c, {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}.get(c, pa.string()))
                for c in COLUMNS
            ]
        )
        rows, size = [], 0
        with files.open_input_file(name) as source:
            for row in records(source, partition.size, self.wanted, self.payload):
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class _Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class WarcWriter(DataSourceArrowWriter):
    """One archive for each task; it gets its name when it is complete."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return _Written(None)
        file = f"{self.path}/part-{TaskContext.get().partitionId():06d}{SUFFIX}"
        with committed(file) as out:
            while first is not None:
                for row in first.to_pylist():
                    out.write(member(record(row)))
                first = next(batches, None)
        return _Written(file)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for message in messages:
            if message is not None and message.file:
                files, name = opened(message.file)
                files.delete_file(name)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def archive(
    table: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Write a record for each row below ``path``.

    Only payloads that occur more than once are joined back, on their digest; that table has at
    most half as many rows as the input, and adaptive execution splits a hot digest.
    """
    spark = table.sparkSession
    spark.dataSource.register(WarcSource)
    rows = table.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    copies = stage(
        large.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    ).select("sha1", "first_id")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)
    (
        rows.join(copies, "sha1", "left")
        .select(
            F.when(revisit, "revisit").otherwise("response").alias("record_type"),
            "page_id",
            "url",
            "sha1",
            F.when(revisit, F.col("first_id")).alias("refers_to"),
            "payload_bytes",
            F.when(~revisit, F.col("payload")).alias("payload"),
        )
        .write.format("warc")
        .mode("append")
        .save(path)
    )


def read(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    """The records below ``path``; filters on header columns are tested before payloads are read."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archive(pages(spark, folder), path)
    return read(spark, path, payload="digest").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
