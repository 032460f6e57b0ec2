"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about FRAME bytes; each frame is compressed on its own, and
a skippable frame at the end of the file holds the seek table (Zstandard's seekable format), so
a reader opens a bundle at any frame. The index maps each record to its bundle, frame, and
offset and length inside the unpacked frame.

Equal payloads are stored once: of the pages that share a digest the one with the smallest
page_id is a response, the others are revisits that refer to it. Digests are reduced by a
map-side combined aggregation; pages meet them in a join that AQE can split.

Bundles are written by the tasks through the file system of the output path, under a name of
the attempt's own and moved into place when whole. The index lists the bundles of the attempts
that Spark committed; a bundle of a lost attempt is in no index and never read.

Defined results: a null html is the empty payload; payloads under `least` bytes are always
responses; rows that repeat the smallest page_id of a payload are all responses; a null page_id
is a response only if the payload has no other; a null url leaves the target out; line ends
in a url are escaped; an empty table gives an empty index and no bundle; extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import settle, ship

FRAME, BUNDLE, LEVEL = 1 << 20, 256 << 20, 3
# Fixed values of the Zstandard seekable format: magic of its skippable frame, magic at the file's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame int, offset int, length int"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {''.join(f'%{ord(c):02X}' if c < ' ' or c == '\x7f' else c for c in url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header fields and block of the record at a place, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    size = int(fields["Content-Length"])
    return fields, data[begin : begin + size], begin + size + 4


class Bundle:
    """Writes records into a file of independent frames with a seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME, level: int = LEVEL):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.open_bytes = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in the unpacked frame and length of the record."""
        if self.open_bytes and self.open_bytes + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.open_bytes, len(data)
        self.parts.append(data)
        self.open_bytes += len(data)
        return place

    def flush(self) -> None:
        if self.parts:
            packed = self.packer.compress(b"".join(self.parts))
            self.sink.write(packed)
            self.frames.append((len(packed), self.open_bytes))
            self.written += len(packed)
            self.parts, self.open_bytes = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.sink.close()


class Reader:
    """Reads frames of a bundle, in any order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("the file has no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - count * width)
        table = source.read(count * width)
        self.frames, at = [], 0
        for n in range(count):
            packed, plain = struct.unpack_from("<II", table, n * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        self.source.seek(at)
        return self.unpacker.decompress(self.source.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for n in range(len(self.frames)):
            data, at = self.frame(n), 0
            while at < len(data):
                fields, block, at = parse(data, at)
                yield fields, block


def write(pages: DataFrame, path: str, least: int = 0, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages under path (bundles/ and index/); returns the index."""
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"))
    first = settle(first, "first")  # as a table, both sides of the join are plain shuffles, and AQE can split a frequent payload
    joined = rows.join(first.hint("merge"), "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    decided = joined.select("page_id", "url", "payload", "digest", "first", revisit.alias("revisit"))

    def run(batches):
        system, root = pafs.FileSystem.from_uri(path)
        system.create_dir(f"{root}/bundles", recursive=True)
        task, number, bundle, rows = TaskContext.get(), 0, None, []
        name = ""
        for batch in batches:
            for page_id, url, payload, digest, first_id, again in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "first", "revisit"))):
                if bundle is None:
                    name = f"{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex[:12]}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{root}/bundles/.{name}", compression=None), frame_bytes)
                page = page_id.as_py()
                place = bundle.add(record(page, url.as_py(), payload.as_py(), base64.b32encode(digest.as_py()).decode(), first_id.as_py(), again.as_py(), date))
                rows.append((record_id(page), page, name, *place))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    system.move(f"{root}/bundles/.{name}", f"{root}/bundles/{name}")
                    yield _batch(rows)
                    bundle, rows, number = None, [], number + 1
        if bundle is not None:
            bundle.close()
            system.move(f"{root}/bundles/.{name}", f"{root}/bundles/{name}")
            yield _batch(rows)

    decided.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return index(spark, path)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["record_id", "page_id", "bundle", "frame", "offset", "length"])


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    end = block.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in block[:end].decode().split("\r\n")[1:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[end + 4 :] if kind == "response" else None
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
    refers = fields.get("WARC-Refers-To")
    size = int(http["Content-Length"]) if payload is None else len(payload)
    return _page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload, size, digest, kind, refers and _page_of(refers)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles that the index lists, a task for each bundle; a revisit has no payload of its own."""
    ship(spark)
    bundles = settle(index(spark, path).select("bundle").distinct(), "bundles")
    place = F.row_number().over(Window.orderBy("bundle")) - 1  # a row for each bundle
    bundles = bundles.withColumn("place", place).repartitionById(max(1, bundles.count()), F.col("place")).select("bundle")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        system, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                rows, size = [], 0
                with system.open_input_file(f"{root}/bundles/{name}") as source:
                    for fields, block in Reader(source).records():
                        row = _row(fields, block)
                        rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        size += len(block) if payloads else 100
                        if size > 8 << 20:
                            yield _records(rows, names, kinds)
                            rows, size = [], 0
                if rows:
                    yield _records(rows, names, kinds)

    return bundles.mapInArrow(run, RECORDS)


def _records(rows: list, names: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of the wanted page_ids, through the index: each bundle is opened once, and of its frames only those are unpacked, once each, that hold one.

    A wanted id that several records share gives all of them; null, and ids that there aren't, give none;
    an id that is wanted twice is given once.
    """
    ship(spark)
    places = index(spark, path).join(wanted.select("page_id").distinct(), "page_id")
    places = places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        system, root = pafs.FileSystem.from_uri(path)
        at, reader, data = (None, None), None, b""
        for batch in batches:
            for name, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                if name != at[0]:
                    reader = Reader(system.open_input_file(f"{root}/bundles/{name}"))
                if (name, frame) != at:
                    at, data = (name, frame), reader.frame(frame)
                yield _records([_row(*parse(data, offset)[:2])], names, kinds)

    return places.mapInArrow(run, RECORDS)
