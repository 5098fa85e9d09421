"""Line dedup over the whole corpus by range-partitioned line hashes.

Lines become (hash, document, positions) and leave their text behind. Rows are range-partitioned
by hash and document together, so that a line which a third of all documents hold spreads over
many partitions, and sorted by hash, document and position. Each partition is streamed once:
the first document of a hash keeps its lines, later ones lose theirs. A hash whose rows began in an
earlier partition is settled from the partitions' edges, at most two rows each. What comes
back to a document is a compressed bitmap of the lines it keeps.

Defined cases: a null or empty text is one empty line; all rows with a null doc_id count as one document that
sorts last; rows that share a doc_id are one document, and each keeps its own bitmap; identical
rows stay; an empty table gives no rows; other columns travel along untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, ascii_lower, checkpointed, row_key, small_batches
from .labelled import BROADCAST_ROWS

MIN_POINTS = 10
#: Bytes of bitmaps that are broadcast at most.
BROADCAST_BYTES = 1 << 25
#: Hashed lines of a range partition, about, where the session's number of partitions would give more.
PARTITION_ROWS = 1 << 23
_STRIP = " \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, __id, __text_key, at): 128 bits of each key of at least ten code points, with its positions in the row."""
    key = ascii_lower(F.trim(F.col("line"), F.lit(_STRIP)))
    lines = docs.select(*row_key(id_col, text_col), F.posexplode_outer(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.select("__id", "__text_key", "pos", key.alias("key")).where(F.length("key") >= MIN_POINTS)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "__id", "__text_key", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows of a sorted partition: 0 first document of its hash, 1 later one, 2 hash that runs in from before, perhaps.

    ``edge`` is true on the first row of the first hash and of the last hash.
    """
    names = ["h1", "h2", "__id", "__text_key", "pos", "state", "edge"]
    lead, owner, held = None, None, None

    def marked(cols: list, state: np.ndarray, *edges: int) -> pa.RecordBatch:
        edge = np.zeros(len(state), bool)
        edge[list(edges)] = True
        return pa.RecordBatch.from_arrays([*cols, pa.array(state), pa.array(edge)], names=names)

    for b in batches:
        if b.num_rows == 0:
            continue
        h1, h2, ids = (b.column(i).to_numpy() for i in range(3))
        n = len(h1)
        new = np.empty(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = owner is None or (h1[0], h2[0]) != owner[:2]
        # Where the hash of each row began: in this batch, or (-1) before it.
        began = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        head = np.where(began >= 0, ids[began], owner[2] if owner else 0)
        state = (ids != head).astype(np.int8)
        opening = lead is None
        lead = lead or (h1[0], h2[0])
        state[(h1 == lead[0]) & (h2 == lead[1])] = 2
        owner = (h1[-1], h2[-1], head[-1])
        edges = [0] if opening else []
        if began[-1] < 0:
            yield marked(b.columns[:5], state, *edges)
            continue
        # The last hash that began may be the partition's last: its batch waits until another begins.
        if held:
            yield marked(*held[:2], *held[2])
        held = (b.columns[:5], state, edges, int(began[-1]))
    if held:
        yield marked(*held[:2], *held[2], held[3])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(__id, __text_key, pos) of each line to drop."""
    spark = docs.sparkSession
    # Written first: the partition bounds are sampled from the hashes, and texts are split and hashed once.
    rows = checkpointed(line_hashes(docs, id_col, text_col))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // PARTITION_ROWS)
    order = ["h1", "h2", "__id", "__text_key", "pos"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = checkpointed(dealt.mapInArrow(_stream, "h1 long, h2 long, __id long, __text_key long, pos int, state byte, edge boolean"))
    # At most two rows a partition, whatever the input.
    owners = seen.where("edge").groupBy("h1", "h2").agg(F.min("__id").alias("owner"))
    unsure = seen.where("state = 2").join(F.broadcast(owners), ["h1", "h2"]).where("__id > owner")
    return seen.where("state = 1").select("__id", "__text_key", "pos").unionByName(unsure.select("__id", "__text_key", "pos"))


def _pack(at: list[int]) -> bytes:
    bits = np.ones(8 * (max(at) // 8 + 1), np.uint8)  # whole bytes: lines past the last dropped one are kept
    bits[at] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(__id, __text_key, bitmap): a zlib-packed bitmap for each row that loses lines; bits past its end are ones.

    What is gathered for a row is the positions in its own text.
    """
    packed = F.pandas_udf(lambda s: s.map(lambda at: _pack(list(at))), "binary")
    d = decisions(docs, id_col, text_col, partitions)
    return d.groupBy("__id", "__text_key").agg(F.collect_set("pos").alias("at")).select("__id", "__text_key", packed("at").alias("bitmap"))


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, partitions: int | None) -> DataFrame:
    # A table of its own: packing and unpacking then never need two Python workers for one task.
    small_batches(docs.sparkSession)
    maps = checkpointed(keep_bitmaps(docs, id_col, text_col, partitions))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"), *row_key(id_col, text_col))
    # Few bitmaps go to the texts; many meet them by key.
    n, size = maps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("bitmap")), F.lit(0))).first()
    few = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return row.join(F.broadcast(maps) if few else maps, ["__id", "__text_key"], "left").select("row", "text", "bitmap")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; a row for each row of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text, bitmap in zip(b.column("text"), b.column("bitmap"), strict=True):
                lines = (text.as_py() or "").split("\n")
                keep = _unpack(bitmap.as_py(), len(lines))
                kept = "\n".join(lines if keep.all() else [x for x, k in zip(lines, keep, strict=True) if k])
                out[0].append(len(lines))
                out[1].append(int(len(lines) - keep.sum()))
                out[2].append(hashlib.sha256(kept.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    j = _with_bitmaps(docs, id_col, text_col, partitions).select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "text", "bitmap")
    return j.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, count_col: str | None = None) -> DataFrame:
    """The table with the kept lines as its texts (a null text stays null), all other columns as they were.

    ``count_col``: a column that holds the text's code points and follows it.
    """

    def kept(text: str | None, bitmap: bytes | None) -> str | None:
        if bitmap is None or text is None:
            return text
        lines = text.split("\n")
        return "\n".join(x for x, k in zip(lines, _unpack(bitmap, len(lines)), strict=True) if k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [kept(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    j = _with_bitmaps(docs, id_col, text_col, partitions)
    out = j.mapInArrow(run, T.StructType([j.schema["row"], T.StructField("text", T.StringType())]))
    new = {text_col: F.col("text")}
    if count_col in docs.columns:
        new[count_col] = F.length("text").cast(docs.schema[count_col].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
