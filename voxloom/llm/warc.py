"""WARC archives: writing, normalising whole-file gzip, and reading by index.

Archives that were compressed as one gzip stream cannot be split or entered at
a record.  The normaliser inflates such a file once, front to back in bounded
memory, writes every record again as a gzip member of its own, and beside it a
sidecar index with the offset and length of each member.  Files appear under
their final name only when complete, under names fixed by the input, so a task
that runs again does no harm.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.storage import materialize

LEAST_PAYLOAD = 100  # bytes from which equal payloads are written once
ROTATE = 1 << 30  # bytes of records after which a writer starts another archive
READ = 1 << 20
LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "urn:page:"
NO_ID = "null"  # stands for a null page_id, which no number does

INDEX = "page_id long, record_type string, refers_to long, archive string, offset long, length long"
FILES_A_TASK = 4


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Gzip:
    """Writes one gzip stream, or a member a record, to an open file."""

    def __init__(self, sink: BinaryIO) -> None:
        self.sink, self.at, self.packer = sink, 0, None

    def write(self, data: bytes) -> None:
        self.packer = self.packer or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(self.packer.compress(data))

    def end_member(self) -> None:
        if self.packer is not None:
            self._put(self.packer.flush())
            self.packer = None

    def _put(self, data: bytes) -> None:
        if data:
            self.sink.write(data)
            self.at += len(data)


class _Published:
    """A file under a passing name until it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(posixpath.dirname(self.path), recursive=True)
        self.passing = f"{self.path}.{uuid.uuid4().hex}.part"
        self.sink = self.fs.open_output_stream(self.passing)

    def publish(self) -> None:
        self.sink.close()
        self.fs.move(self.passing, self.path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the response's headers only.

    They give the length of the payload that the record stands for.
    """
    page_id = NO_ID if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c > " ") or f"{PAGE_ID}{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PAGE_ID}{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        *([f"WARC-Refers-To: <{PAGE_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): equal payloads of LEAST_PAYLOAD bytes or more refer to the least page_id.

    Only digests and ids are grouped; the html moves once, dealt by page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256))
    slim = rows.where((F.octet_length("html") >= LEAST_PAYLOAD) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last <> refers_to").drop("last")
    again = slim.join(first, "digest").where("page_id <> refers_to").distinct()
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to")
    return rows.join(again, (rows.page_id == again.p) & (rows.digest == again.d), "left").drop("p", "d", "digest")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, refers_to) as whole-file gzip archives; returns their (archive, records).

    One archive or more a partition, a new one after ROTATE bytes; a record is
    in memory at a time.  A null page_id is written as ``urn:page:null`` and read back as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done, number, file, n, size = [], 0, None, 0, 0
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in range(4))):
                if file is None:
                    name = f"{folder}/pages-{part:05d}-{number:03d}.warc.gz"
                    file, n, size = _Published(name), 0, 0
                    packed = _Gzip(file.sink)
                data = record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py())
                packed.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROTATE:
                    packed.end_member()
                    file.publish()
                    done.append((name, n))
                    file, number = None, number + 1
        if file is not None:
            packed.end_member()
            file.publish()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=pa.string()), pa.array([d[1] for d in done], type=pa.int64())], names=["archive", "records"])

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records long")


class _Inflated:
    """Lines and blocks of a gzip file of any number of members, inflated as they are asked for."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.held, self.unpacker = source, bytearray(), None
        self.input, self.ended = b"", False

    def _more(self) -> bool:
        while True:
            if not self.input:
                self.input = self.source.read(READ)
                if not self.input:
                    if self.unpacker is not None and not self.unpacker.eof:
                        raise EOFError("the gzip stream is cut off")
                    return False
            if self.unpacker is None or self.unpacker.eof:
                self.unpacker = zlib.decompressobj(31)
            data = self.unpacker.decompress(self.input, READ)
            self.input = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if data:
                self.held += data
                return True

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                end = len(self.held) - 1
                break
        out = bytes(self.held[: end + 1])
        del self.held[: end + 1]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise EOFError("a record is cut off")
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            yield piece


def _head(stream: _Inflated) -> tuple[list[bytes], dict[str, str]] | None:
    """The next record's header lines and fields; None at the end."""
    line = stream.line()
    while line in (b"\r\n", b"\n"):
        line = stream.line()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:20]!r}")
    lines, fields = [line], {}
    while (line := stream.line()) not in (b"\r\n", b"\n", b""):
        lines.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return lines, fields


def _id(field: str | None) -> int | None:
    name = field.strip("<>").removeprefix(PAGE_ID) if field else NO_ID
    return None if name == NO_ID else int(name)


def normalize_one(archive: str, folder: str) -> tuple[str, str, int]:
    """Rewrite one archive with a member a record; (archive, sidecar, records)."""
    base = f"{folder}/{posixpath.basename(archive).removesuffix('.warc.gz')}"
    out, side = _Published(f"{base}.warc.gz"), _Published(f"{base}.index.jsonl")
    packed, n = _Gzip(out.sink), 0
    fs, path = file_system(archive)
    with fs.open_input_stream(path, compression=None) as source:
        stream = _Inflated(source)
        while (head := _head(stream)) is not None:
            lines, fields = head
            start = packed.at
            packed.write(b"".join(lines) + b"\r\n")
            for piece in stream.take(int(fields["content-length"])):
                packed.write(piece)
            packed.write(b"\r\n\r\n")
            packed.end_member()
            entry = {
                "page_id": _id(fields.get("warc-record-id")),
                "record_type": fields.get("warc-type"),
                "refers_to": _id(fields.get("warc-refers-to")),
                "archive": f"{base}.warc.gz",
                "offset": start,
                "length": packed.at - start,
            }
            side.sink.write(json.dumps(entry).encode() + b"\n")
            n += 1
    out.publish()
    side.publish()
    return f"{base}.warc.gz", f"{base}.index.jsonl", n


def normalize(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise every file named in ``archive``: (archive, sidecar, records).

    A file is one unit of work, as its stream can only be read from the front;
    files are dealt over as many tasks as there are files, up to the shuffle
    partitions or FILES_A_TASK files each.  An empty file has no records; one
    that is cut off raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalize_one(name, folder) for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "sidecar", "records"])

    named = archives.select("archive").where("archive is not null").distinct()
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = named.count()
    # a given number of partitions is kept as it is, however small the names are
    dealt = named.repartitionByRange(max(1, min(files, max(parts, files // FILES_A_TASK))), "archive")
    return dealt.mapInArrow(run, "archive string, sidecar string, records long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder as one table."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.jsonl").json(folder)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _member(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Fields and payload of a record from its own gzip member, and the payload's length by the HTTP headers."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, payload, int(_fields(http).get("content-length", len(payload)))


def read_records(index: DataFrame) -> DataFrame:
    """Read the members that the index names: its page_id, record_type, refers_to, and url, payload, declared_digest, declared_bytes.

    A revisit's payload is null; what it stands for is declared in its headers.  The rows are dealt by archive and offset, so
    large archives are read by many tasks, each from front to back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
                names = ["page_id", "record_type", "refers_to", "url", "payload", "declared_digest", "declared_bytes"]
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    fs, path = file_system(archive)
                    name, source = archive, fs.open_input_file(path)
                source.seek(offset)
                fields, payload, declared = _member(source.read(length))
                revisit = fields["warc-type"] == "revisit"
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                rows.append((_id(fields["warc-record-id"]), fields["warc-type"], _id(fields.get("warc-refers-to")), fields["warc-target-uri"], None if revisit else payload, digest, declared))
                size += len(payload)
                if size > READ:
                    yield flush()
                    rows, size = [], 0
            if rows:
                yield flush()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a given number is kept as it is: index rows are small, what they stand for is not
    dealt = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id long, record_type string, refers_to long, url string, payload binary, declared_digest string, declared_bytes long"
    return dealt.mapInArrow(run, schema)


def checked(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, digest_holds) of records read back.

    A response's size and digest are those of the payload that was read.  A
    revisit's are the declared ones; they hold if the record that it refers to
    has a payload of that digest and size.  Revisits are checked by what they
    claim, one row a claim, and joined with nothing unless a claim is false.
    """
    kept = ["page_id", "record_type", "refers_to", "declared_digest", "declared_bytes"]
    back = materialize(records.select(*kept, F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest")), "records")
    claims = back.where("record_type = 'revisit'").select(F.col("refers_to").alias("c"), F.col("declared_digest").alias("d"), F.col("declared_bytes").alias("b")).distinct()
    true = back.where("record_type = 'response'").select(F.col("page_id").alias("c"), F.col("digest").alias("d"), F.col("n").alias("b"))
    false = materialize(claims.join(true, ["c", "d", "b"], "left_anti"), "false-claims")
    if false.isEmpty():
        claimed = back.withColumn("claim", F.lit(True))
    else:
        on = F.col("refers_to").eqNullSafe(F.col("c")) & F.col("declared_digest").eqNullSafe(F.col("d")) & F.col("declared_bytes").eqNullSafe(F.col("b"))
        claimed = back.join(false, on, "left").withColumn("claim", F.col("d").isNull()).drop("c", "d", "b")
    revisit = F.col("record_type") == "revisit"
    return claimed.select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(revisit, F.col("claim")).otherwise(F.col("digest") == F.col("declared_digest")).alias("digest_holds"),
    )
