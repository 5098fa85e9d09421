"""WARC archives as seekable Zstandard bundles.

Records are packed, in the order of the rows, into frames that decompress on their own, and frames into bundles, a file each.
After the data a bundle holds a skippable frame that maps record identifiers to (frame, offset in the frame, length), and at
its end the seek table of the public seekable format, in a skippable frame too: any Zstandard reader still reads
the records as one stream. Spark's text writer puts a bundle's bytes down as they are, so files go through the
committer of whatever store the folder is in, and a lost task leaves nothing behind.

Pages with equal payloads of at least ``MIN_BYTES`` are stored once: the one with the smallest id is a response, the others
revisit it. Rows that share that smallest id are all responses. A row without an id is never referred to: it revisits a page
with an id, if there is one with its payload, and is a response otherwise. A null html is an empty payload; a null url is
``about:blank``. An empty table makes no bundle. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, look_up, small_batches

MIN_BYTES = 100
#: Record bytes that close a frame, and compressed bytes that close a bundle. A longer record has a frame to itself.
FRAME_BYTES, BUNDLE_BYTES = 512 * 1024, 32 * 1024 * 1024
LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"

#: Fixed values of the Zstandard and seekable formats; the map of records has a magic number of its own among the skippable ones.
SKIPPABLE_TABLE, SKIPPABLE_MAP, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CHECKSUMS = 0x80
#: The last four bytes of a bundle are what the text writer ends a row with.
END = struct.pack("<I", SEEKABLE)
#: Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLACES = "record_id string, frame int, offset long, length long"
RECORDS = "record_id string, page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan(pages: DataFrame, most: int = BROADCAST_ROWS, id_col: str = "page_id") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each record is; refers_to is null for a response, and revisits carry no payload but its length.

    Payloads are hashed twice and shuffled only where the groups of copies are too many to broadcast.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.make_valid_utf8(F.col("url").cast("string")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("n_bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    found = checkpointed(first.where("n > 1 AND first_id IS NOT NULL"))
    out = look_up(rows, found, "digest", "first_id", ["page_id", "url"], most)
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "n_bytes", "digest", F.when(revisits, F.col("first_id")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none:' + digest if page_id is None else page_id}>"


def _page_of(record: str) -> int | None:
    tail = record.removeprefix("<urn:page:").removesuffix(">")
    return None if tail.startswith("none:") else int(tail)


def _header_value(text: str) -> str:
    """A header ends at a line break, so control characters and spaces are percent-encoded, and the sign of encoding too."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in text)


def _plain_value(text: str) -> str:
    parts = text.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def make_record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, captured: str = CAPTURED) -> bytes:
    """One WARC record: an HTTP response, or a revisit that holds the response's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {captured}",
            f"WARC-Target-URI: {_header_value(url) if url is not None else 'about:blank'}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record that starts at ``at`` as a row of ``RECORDS``, and where the next one starts. A payload that differs from its digest is an error."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(head["Content-Length"])
    split = data.index(b"\r\n\r\n", start) + 4
    http = dict(x.split(": ", 1) for x in data[start : split - 4].decode().split("\r\n")[1:])
    digest, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
    payload = None if refers else data[split : start + n]
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its digest says")
    uri = _plain_value(head["WARC-Target-URI"])
    row = (head["WARC-Record-ID"], _page_of(head["WARC-Record-ID"]), uri, head["WARC-Type"], _page_of(refers) if refers else None, int(http["Content-Length"]), digest, payload)
    return row, start + n + 4


class Bundle:
    """Packs records; ``close`` gives the file's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.out, self.frame, self.sizes, self.places = io.BytesIO(), bytearray(), [], []

    def add(self, name: str, record: bytes) -> None:
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self._end_frame()
        self.places.append(f"{name}\t{len(self.sizes)}\t{len(self.frame)}\t{len(record)}")
        self.frame += record

    def _end_frame(self) -> None:
        raw = bytes(self.frame)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frame = bytearray()

    def size(self) -> int:
        return self.out.tell()

    def close(self) -> bytes:
        if self.frame:
            self._end_frame()
        record_map = self.packer.compress("\n".join(self.places).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_MAP, len(record_map)) + record_map)
        entries = [*self.sizes, (8 + len(record_map), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IB", len(entries), CHECKSUMS) + END
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        return self.out.getvalue()


def seek_table(content: bytes) -> list[tuple[int, int, int, int]]:
    """(start, packed bytes, plain bytes, checksum) of each frame, read from the end of the file; the last is the map of records."""
    if content[-4:] != END:
        raise ValueError("no seek table at the end")
    n, kind = struct.unpack("<IB", content[-9:-4])
    if kind != CHECKSUMS:
        raise ValueError("a seek table without checksums")
    at, out = 0, []
    first = len(content) - 9 - 12 * n
    for packed, plain, check in struct.iter_unpack("<III", content[first : first + 12 * n]):
        out.append((at, packed, plain, check))
        at += packed
    return out


def frame(content: bytes, table: list[tuple[int, int, int, int]], number: int) -> bytes:
    at, packed, plain, check = table[number]
    raw = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)
    if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError(f"frame {number} is damaged")
    return raw


def places(content: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(record_id, frame, offset, length) from the map of records; no data frame is decompressed."""
    at, packed, _, _ = seek_table(content)[-1]
    for line in zstandard.ZstdDecompressor().decompress(content[at + 8 : at + packed]).decode().split("\n"):
        name, *where = line.split("\t")
        yield name, *map(int, where)


def write(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, captured: str = CAPTURED) -> None:
    """Writes the records of a ``plan`` as bundles, each a file of its own in ``folder``; a task makes its bundles one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closed = lambda b: pa.RecordBatch.from_arrays([pa.array([b.close()[: -len(END)]], pa.binary())], names=["content"])
        bundle = None
        for batch in batches:
            for page, url, payload, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(frame_bytes)
                bundle.add(record_id(page, digest), make_record(page, url, payload, n, digest, refers, captured))
                if bundle.size() >= bundle_bytes:
                    yield closed(bundle)
                    bundle = None
        if bundle:
            yield closed(bundle)

    small_batches(rows.sparkSession)
    made = rows.select("page_id", "url", "payload", "n_bytes", "digest", "refers_to").mapInArrow(pack, "content binary")
    # Latin-1 stands for bytes here: the end of a row is the end of the bundle, and a file has one row.
    made.select(F.col("content").cast("string")).write.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).mode("overwrite").text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the bundles."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``RECORDS`` of every bundle, frame by frame; every payload is held against its digest, and left out of the rows without ``payloads``."""
    schema = RECORDS if payloads else RECORDS.rsplit(", ", 1)[0]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_py()
                table = seek_table(content)
                for number in range(len(table) - 1):
                    raw, at, out = frame(content, table, number), 0, []
                    while at < len(raw):
                        row, at = parse_record(raw, at)
                        out.append(row if payloads else row[:-1])
                    yield _batch(out, schema)

    return files(spark, folder).mapInArrow(unpack, schema)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, record_id, frame, offset, length) of every record, from the maps of the bundles."""
    schema = f"path string, {PLACES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield _batch([(path.as_py(), *p) for p in places(content.as_py())], schema)

    return files(spark, folder).mapInArrow(run, schema)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``RECORDS`` of the record ids in ``wanted`` (record_id): only frames that hold one are decompressed, and read at the record's offset."""
    at = index(spark, folder).join(wanted.select("record_id").distinct(), "record_id")
    by_file = at.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame", "offset"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, found in zip(batch.column("content"), batch.column("at"), strict=True):
                content = content.as_py()
                table = seek_table(content)
                for number, own in groupby(found.as_py(), lambda p: p["frame"]):
                    raw = frame(content, table, number)
                    yield _batch([parse_record(raw, p["offset"])[0] for p in own], RECORDS)

    return files(spark, folder).join(by_file, "path").select("content", "at").mapInArrow(run, RECORDS)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of ``pages``, reads them back, and tells what each record is."""
    write(plan(pages), folder)
    return read(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
