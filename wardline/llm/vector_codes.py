"""Compression of vectors to codes: a codebook for each of 16 parts, fitted in rounds over all vectors.

In each round the codebooks go to the tasks as kd-trees. A task looks up the nearest entry of each part by
branch and bound, vectors of a batch together: a node is left out for a vector only if its box lies strictly farther than the best
entry so far, so nodes at the same distance are visited and the lower index wins a tie. Tasks return integer sums by entry,
at most 1,024 rows each, which are added up in the cluster; the driver holds codebooks only.

Rows whose vector is null or holds a null, NaN or infinite component go. Components become floor(256 * x), all arithmetic is on integers.
The vectors that are left must have one length that 16 divides, and components within 131,072 (sums of squares
then stay exact in 64 bits): anything else is an error that says so. Rows without a vec_id are coded like all others and come last among those that
start the codebooks; rows with one vec_id come in the order of their vectors. Fewer than 64 rows make smaller codebooks, an empty table no row.
Rows without a label are one label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, look_up

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest scaled component: 16 parts of squared differences of this size fit 64 bits for vectors of 1,024 components.
LIMIT = 2**25
LEAF = 8
#: Vectors that are looked up together.
BLOCK = 8_192


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): scaled vectors of the rows that stay."""
    x = F.col("x")
    finite = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("x")).where(finite)
    scaled = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    too_large = F.exists("v", lambda c: F.abs(c) > LIMIT)
    uneven = F.size("v") % PARTS != 0
    stop = lambda why: F.raise_error(F.lit(why)).cast("array<bigint>")
    checked = F.when(too_large, stop(f"a component is larger than {LIMIT // SCALE}")).when(uneven, stop(f"the length of a vector is no multiple of {PARTS}")).otherwise(F.col("v"))
    return scaled.select("vec_id", "label", checked.alias("v"))


def first_codebooks(rows: DataFrame) -> np.ndarray:
    """(parts, entries, width): the parts of the smallest vec_ids."""
    seeds = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    if len({len(s) for s in seeds}) > 1:
        raise ValueError("vectors differ in length")
    width = len(seeds[0]) // PARTS if seeds else 0
    return np.array(seeds, dtype=np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2)


@dataclass
class Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None  # of a leaf, ascending
    children: tuple[Node, Node] | None = None


def tree(points: np.ndarray, ids: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """A kd-tree over the rows of ``points``: halves at the median of the widest component; boxes are those of the points within."""
    ids = np.arange(len(points)) if ids is None else ids
    own = points[ids]
    node = Node(own.min(axis=0), own.max(axis=0))
    spread = node.high - node.low
    if len(ids) <= leaf or not spread.any():
        node.entries = np.sort(ids)
        return node
    order = ids[np.argsort(own[:, int(spread.argmax())], kind="stable")]
    half = len(order) // 2
    node.children = (tree(points, order[:half], leaf), tree(points, order[half:], leaf))
    return node


def nearest(points: np.ndarray, root: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest point and squared distance of each query; ties go to the lower index."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    index = np.zeros(len(queries), dtype=np.int64)

    def bound(node: Node, who: np.ndarray) -> np.ndarray:
        q = queries[who]
        outside = np.maximum(node.low - q, 0) + np.maximum(q - node.high, 0)
        return np.einsum("ij,ij->i", outside, outside)

    def visit(node: Node, who: np.ndarray, at: np.ndarray) -> None:
        who = who[at <= best[who]]
        if not len(who):
            return
        if node.entries is not None:
            diff = queries[who][:, None, :] - points[node.entries]
            far = np.einsum("ijk,ijk->ij", diff, diff)
            k = far.argmin(axis=1)  # the first of equal ones, and entries ascend
            d, i = far[np.arange(len(who)), k], node.entries[k]
            better = (d < best[who]) | ((d == best[who]) & (i < index[who]))
            best[who[better]], index[who[better]] = d[better], i[better]
            return
        left, right = node.children
        to_left, to_right = bound(left, who), bound(right, who)
        near = to_left <= to_right
        visit(left, who[near], to_left[near])
        visit(right, who[~near], to_right[~near])
        visit(right, who[near], to_right[near])
        visit(left, who[~near], to_left[~near])

    everyone = np.arange(len(queries))
    if len(points) and len(queries):
        visit(root, everyone, bound(root, everyone))
    return index, best


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches as tables of at least ``BLOCK`` rows, but for the last, with their vectors."""
    held, n = [], 0

    def joined() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("v").combine_chunks() if t.num_rows else None
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        if not (np.diff(lists.offsets.to_numpy()) == dim).all():
            raise ValueError("vectors differ in length")
        return t, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield joined()
            held, n = [], 0
    if n:
        yield joined()


def _assigned(books: np.ndarray, trees: list[Node], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) codes and distances."""
    parts = vectors.reshape(len(vectors), PARTS, -1)
    found = [nearest(books[p], trees[p], np.ascontiguousarray(parts[:, p])) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def improved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries move to the floored mean of the parts nearest to them; unused ones stay."""
    sent = rows.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books]))
    dim = PARTS * books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = sent.value
        total, n = np.zeros_like(own), np.zeros(own.shape[:2], dtype=np.int64)
        for _, vectors in _blocks(batches, dim):
            codes, _ = _assigned(own, trees, vectors)
            parts = vectors.reshape(len(vectors), PARTS, -1)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=own.shape[1])
                np.add.at(total[p], codes[:, p], parts[:, p])
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    per_task = rows.select("v").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    width = books.shape[2]
    added = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)])
    out = books.copy()
    for r in added.collect():  # an entry a row
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    sent.unpersist()
    return out


def fit(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    books = first_codebooks(rows)
    if books.shape[1]:
        for _ in range(rounds):
            books = improved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of scaled vectors."""
    sent = rows.sparkSession.sparkContext.broadcast((books, [tree(b) for b in books] if books.shape[1] else []))
    dim = PARTS * books.shape[2]
    hex_of = np.array([f"{i:02x}" for i in range(ENTRIES)])
    names = ["vec_id", "label", "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = sent.value
        for t, vectors in _blocks(batches, dim):
            codes, far = _assigned(own, trees, vectors)
            code = ["".join(c) for c in hex_of[codes]]
            out = pa.table([t.column("vec_id"), t.column("label"), pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=names)
            yield from out.combine_chunks().to_batches()

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Adds ``approximation``: the vector that a code stands for, scaled back."""
    entries = coded.sparkSession.createDataFrame([([[[float(x) / SCALE for x in e] for e in b] for b in books],)], "books array<array<array<double>>>")
    at = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.col("books")[p][F.conv(F.substring("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int")])
    return coded.crossJoin(F.broadcast(entries)).withColumn("approximation", F.flatten(at)).drop("books")


def compress(vectors: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)"""
    rows = kept(vectors)
    books = fit(rows)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label_key")
    coded = checkpointed(encode(rows, books).select("vec_id", key, "code", "error"))
    by_label = checkpointed(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    out = look_up(coded, by_label, "label_key", "label_error", ["vec_id", "code"], most)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
