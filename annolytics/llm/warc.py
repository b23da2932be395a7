"""WARC archives: a writer with revisit records, and a reader that splits compressed files by bytes."""

from __future__ import annotations

import base64
import gzip
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm.prefix import partitions_for
from annolytics.session import settle

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that a header may hold as they are.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: local, HDFS or S3, from the driver and from tasks alike."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# ---------------------------------------------------------------- writing


def record_member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [b"WARC/1.1", *(f"{name}: {value}".encode() for name, value in headers), b"Content-Length: %d" % len(block)]
    return gzip.compress(END.join(lines) + END + END + block + END + END, mtime=0)


def _page_member(row: dict, date: str) -> bytes:
    payload, revisit = row["_payload"], row["_refers"] is not None
    head = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + END + END
    digest = base64.b32encode(bytes.fromhex(row["_digest"])).decode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{row['_urn']}>"), ("WARC-Date", date)]
    if row["_url"] is not None:
        headers.append(("WARC-Target-URI", quote(row["_url"], safe=PRINTABLE)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        headers += [("WARC-Refers-To", f"<{row['_refers']}>"), ("WARC-Profile", PROFILE)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return record_member(headers, head if revisit else head + payload)


def _write_part(folder: str, date: str, file_bytes: int):
    """Write the rows of a partition as archives; give name, size and number of records of each.

    Names are new for every attempt, so a task that is repeated leaves a file that nobody lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        context, out, found, size, n = TaskContext.get(), None, [], 0, 0
        path = ""
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if out is None:
                    name = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.warc.gz"
                    path, size, n = os.path.join(folder, name), 0, 0
                    out = store.open_output_stream(os.path.join(root, name), compression=None)
                    info = record_member(
                        [
                            ("WARC-Type", "warcinfo"),
                            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                            ("WARC-Date", date),
                            ("Content-Type", "application/warc-fields"),
                        ],
                        b"format: WARC File Format 1.1" + END,
                    )
                    size += out.write(info)
                size += out.write(_page_member(row, date))
                n += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    found.append((path, size, n))
        if out is not None:
            out.close()
            found.append((path, size, n))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)], ["path", "bytes", "records"])

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 1000,
    file_bytes: int = 1 << 30,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each row and give the list of archives ``(path, bytes, records)``.

    The payload is the html in UTF-8, of a null an empty one. Of rows with equal payloads of at
    least ``least_bytes`` the one with the largest id is a response and the others are revisits of it; ids that are null
    count as smallest, and of rows with equal ids one is chosen. Equality is that of length,
    SHA-1 and a second hash. The rows are stored once with these, so that a payload seen by a
    third of all rows costs one row per task in the search for it, and only repeated payloads
    are joined back. Record ids are ``urn:page:<id>:<row>``. An empty table gives an empty list.
    """
    payload = F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), payload.alias("_payload")
    ).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumns({"_digest": F.sha1("_payload"), "_bytes": F.octet_length("_payload"), "_check": F.xxhash64("_payload")})
    rows = settle(rows, "warc-rows")
    key = ["_digest", "_bytes", "_check"]
    order = F.struct(F.col("_id").isNotNull(), F.col("_id"), F.col("_row"))
    repeated = rows.where(F.col("_bytes") >= least_bytes).groupBy(*key).agg(F.max(order).alias("_first"), F.count("*").alias("_n"))
    repeated = settle(repeated.where("_n > 1").select(*key, "_first"), "warc-repeated")
    urn = lambda i, row: F.concat(F.lit("urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), row.cast("string"))
    refers = F.when(F.col("_first._row") != F.col("_row"), urn(F.col("_first._id"), F.col("_first._row")))
    ready = rows.join(repeated, key, "left").select(
        urn(F.col("_id"), F.col("_row")).alias("_urn"), "_url", "_payload", "_digest", refers.alias("_refers")
    )
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    return settle(ready.mapInArrow(_write_part(folder, date, file_bytes), "path string, bytes bigint, records bigint"), "warc-files")


# ---------------------------------------------------------------- reading


class Member(NamedTuple):
    """A record found at a place of a file."""

    offset: int
    end: int
    headers: dict[str, str]
    block: bytes


class _Window:
    """Bytes of a file from any place, read ``step`` bytes at a time; only what is in use is held."""

    def __init__(self, file: pa.NativeFile, step: int = 1 << 20):
        self.file, self.size, self.step, self.at, self.data = file, file.size(), step, 0, b""

    def tail(self, offset: int, least: int) -> bytes:
        """The bytes from ``offset`` on that are held, ``least`` of them unless the file ends."""
        if not self.at <= offset <= self.at + len(self.data):
            self.at, self.data = offset, b""
        while self.at + len(self.data) < min(offset + least, self.size):
            more = self.file.read_at(min(self.step, self.size - self.at - len(self.data)), self.at + len(self.data))
            kept = offset - self.at
            self.at, self.data = offset, self.data[kept:] + more
        return self.data[offset - self.at :]

    def find(self, offset: int, end: int) -> int:
        """The first gzip magic that starts in ``offset .. end - 1``, or -1."""
        while offset < end:
            data = self.tail(offset, min(self.step, end - offset + len(MAGIC) - 1))
            found = data.find(MAGIC)
            if found >= 0:
                return offset + found if offset + found < end else -1
            offset += max(1, len(data) - len(MAGIC) + 1)
        return -1

    def is_edge(self, offset: int) -> bool:
        """Whether a member may end here: at the end of the file or where the next begins."""
        return offset >= self.size or self.tail(offset, len(MAGIC))[: len(MAGIC)] == MAGIC

    def member(self, offset: int) -> Member | None:
        """The record whose member starts at ``offset``; None if what is there is none."""
        inflate, text, place = zlib.decompressobj(wbits=31), b"", offset
        parts = []
        while not inflate.eof:
            data = self.tail(place, 1)[: 1 << 16]
            if not data:
                return None
            try:
                parts.append(inflate.decompress(data))
            except zlib.error:
                return None
            place += len(data)
            if len(text) < 5:
                text = b"".join(parts)
                if not b"WARC/".startswith(text[:5]):
                    return None
        place -= len(inflate.unused_data)
        return _record(offset, place, b"".join(parts))


def _record(offset: int, end: int, data: bytes) -> Member | None:
    head, found, rest = data.partition(END + END)
    lines = head.split(END)
    if not found or not lines[0].startswith(b"WARC/"):
        return None
    headers = {}
    for line in lines[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return Member(offset, end, headers, rest[: int(length)])


def members_in(file: pa.NativeFile, start: int, end: int) -> Iterator[Member]:
    """The records that start in ``start .. end - 1`` of an archive.

    A range that starts within the file first looks for a place to begin: a gzip magic whose
    member inflates to a record and is followed by another member or the end of the file. Compressed data that
    happens to look like a member fails one of these, also where a page has an archive inside.
    From there members follow each other; after damage the search begins again.
    """
    window, at, in_step = _Window(file), start, start == 0
    while at < end:
        found = window.find(at, end)
        if found < 0:
            return
        member = window.member(found)
        in_step = in_step and found == at
        if member is None or not (in_step or window.is_edge(member.end)):
            at, in_step = found + 1, False
            continue
        yield member
        at, in_step = member.end, True


READ = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length bigint, payload binary, path string, offset bigint"


def _digest_hex(value: str | None) -> str | None:
    algorithm, _, digest = (value or "").partition(":")
    return base64.b32decode(digest).hex() if algorithm == "sha1" and len(digest) == 32 else digest or None


def _http_length(head: bytes) -> int | None:
    for line in head.split(END)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in READ.split(", ")]
    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            store, place = open_store(path)
            rows, size = [], 0
            with store.open_input_file(place) as file:
                for member in members_in(file, start, end):
                    h = member.headers
                    head, _, payload = member.block.partition(END + END)
                    is_http = h.get("content-type", "").startswith("application/http")
                    unwrapped = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
                    rows.append(
                        (
                            unwrapped(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), unwrapped(h.get("warc-refers-to")),
                            _digest_hex(h.get("warc-payload-digest")), _http_length(head) if is_http else None,
                            payload if is_http else member.block, path, member.offset,
                        )
                    )
                    size += len(member.block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 64 << 20) -> DataFrame:
    """The records of the archives ``files (path, bytes)``, in no order.

    Every file is cut into ranges of ``split_bytes`` and a task owns the records that start in
    its ranges, reading past the end for the last. ``payload`` is what follows the HTTP head;
    of a revisit it is empty and ``http_length`` tells how long it was. Empty files give nothing.
    """
    ranges = files.where("bytes > 0").select(
        "path", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"), "bytes"
    )
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    return ranges.repartition(partitions_for(spark)).mapInArrow(_read_ranges, READ)


def page_id_of(urn: Column) -> Column:
    """The page id in a record id made by ``write_warc``."""
    return F.nullif(F.regexp_extract(urn, "^urn:page:(-?[0-9]*):", 1), F.lit("")).cast("bigint")
