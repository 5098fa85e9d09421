"""SimHash near-dedup: 64-bit fingerprints, bit-sliced comparison, connected components.

Distinct fingerprints are cut into seven blocks of bits. Two that differ in at most four bits agree
in at least three whole blocks, so each fingerprint goes to the 35 buckets of its triples of blocks, and every link
is met in some bucket. Buckets stand side by side in vertical bit planes, one word for 64 fingerprints, small ones sharing words. A shift of the planes by d
lanes sets every fingerprint against the one d places on, for all buckets at once; the distances are updated plane by plane in
carry-save counters, and a word is abandoned once all its lanes have passed the radius, are of two buckets, or are known to be
connected. So a large group of near copies costs little more than its size, and
a bucket yields one edge a fingerprint, never its pairs. Buckets too large for a task are cut into tiles, and pairs of tiles are dealt out.

Components come from label contraction over checkpointed edge tables; no edge, label or fingerprint is
collected to the driver.

Defined cases: a null or empty text has no shingles and fingerprint zero, linked like any other; fewer than four words
are one shingle; repeated rows stay; a null doc_id never names a component unless all its
members' ids are null (in ``dedup`` one row of each such component stays); an empty table gives no rows; other columns are not read, and travel along in ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, checkpointed, map_texts, row_key
from .labelled import join_checked

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (first bit, bits) of the blocks; two near fingerprints agree in all but RADIUS of them.
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
#: Fingerprints of a bucket that one task compares at once, and those of many buckets that share planes.
TILE, TOGETHER = 4_096, 65_536
#: Planes between two looks at which words are left.
STEP = 8
_LANES, _ALL = 64, np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The contract's fingerprint of one text, unsigned."""
    # Bytes are lower-cased and split by ASCII alone, as the contract has it.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    # Each shingle is a slice of the words joined by single spaces.
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 0x20)
    begin = np.concatenate([[0], gaps + 1])[: len(words) - SHINGLE + 1].tolist()
    end = np.concatenate([gaps, [len(joined)]])[SHINGLE - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table's rows (``row``) with ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, [T.StructField("fp", T.LongType())], make, text_col)


class Sliced:
    """Fingerprints as 64 bit planes; bit j of word i of a plane belongs to fingerprint 64 i + j."""

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        padded = np.zeros(-(-n // _LANES) * _LANES, np.uint64)
        padded[:n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # row: fingerprint, column: bit
        self.planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
        self.n = n
        self.compared = 0  # lanes of the words that went into counters

    def near(self, d: int, live: np.ndarray) -> np.ndarray:
        """The lanes i among ``live`` (ascending) whose fingerprint is at most RADIUS bits from that of lane i + d.

        Counters of three bits hold up to seven differences; ``far`` keeps lanes that have passed four. Every few planes, words
        with all lanes far are left out of what follows.
        """
        n_words = self.planes.shape[1]
        far = np.full(n_words, _ALL, np.uint64)
        np.bitwise_and.at(far, live // _LANES, ~(np.uint64(1) << (live % _LANES).astype(np.uint64)))
        words = np.flatnonzero(far != _ALL)
        self.compared += len(words) * _LANES
        far = far[words]
        c0, c1, c2 = (np.zeros(len(words), np.uint64) for _ in range(3))
        skip, low = d // _LANES, np.uint64(d % _LANES)
        high = np.uint64(_LANES) - low
        planes = np.concatenate([self.planes, np.zeros((64, skip + 2), np.uint64)], axis=1) if len(words) and words[-1] + skip + 1 >= n_words else self.planes
        for b in range(64):
            plane = planes[b]
            other = plane[words + skip]
            if low:
                other = other >> low | plane[words + skip + 1] << high
            diff = plane[words] ^ other
            # carry-save add of one bit
            carry = c0 & diff
            c0 = c0 ^ diff
            over = c1 & carry
            c1 = c1 ^ carry
            far |= c2 & over  # would reach eight
            c2 = c2 | over
            far |= c2 & (c0 | c1)  # five or more
            if b % STEP == STEP - 1:
                left = far != _ALL
                if not left.all():
                    words, far, c0, c1, c2 = (x[left] for x in (words, far, c0, c1, c2))
                    if not len(words):
                        break
        lanes = np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        return (words[:, None] * _LANES + np.arange(_LANES))[lanes]


class Union:
    """Union-find over node ids; a root is the smallest id of its set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, top = self.up, x
        while (p := up.get(top, top)) != top:
            top = p
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link(bucket: np.ndarray, side: np.ndarray, fps: np.ndarray, nodes: np.ndarray, sets: Union) -> Sliced:
    """Unites the nodes of a bucket whose fingerprints link. Rows of a bucket stand together, and side 0 before side 1.

    A bucket with both sides compares those of one with those of the other; the tiles' own pairs are another's.
    """
    planes = Sliced(fps)
    roots = np.array([sets.find(x) for x in nodes.tolist()], np.int64)
    new = np.ones(len(bucket), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    start = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    end = np.append(start[1:], len(bucket))
    two = np.maximum.reduceat(side, start) > 0  # of each bucket
    apart = side != side[start][of] if two.any() else None
    lanes = np.arange(len(bucket))
    d = 0
    while True:
        d += 1
        lanes = lanes[lanes + d < end[of[lanes]]]  # the others have met all that follow
        if not len(lanes):
            return planes
        if d & (d - 1) == 0:  # a bucket that is one component already has nothing left
            own = of[lanes]
            mixed = np.maximum.reduceat(roots, start) != np.minimum.reduceat(roots, start)
            lanes = lanes[mixed[own]]
        live = lanes[roots[lanes] != roots[lanes + d]]
        if apart is not None:
            live = live[~two[of[live]] | (apart[live] != apart[live + d])]
        if not len(live):
            continue
        hit = planes.near(d, live)
        if not len(hit):
            continue
        for x, y in zip(roots[hit].tolist(), roots[hit + d].tolist(), strict=True):
            sets.join(x, y)
        old = np.unique(np.concatenate([roots[hit], roots[hit + d]]))
        top = np.array([sets.find(x) for x in old.tolist()], np.int64)
        at = np.minimum(np.searchsorted(old, roots), len(old) - 1)
        roots = np.where(old[at] == roots, top[at], roots)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of (bucket, part, side, fp, node), sorted by the first three, to edges (a, b) with a > b."""
    sets, held, n = Union(), [], 0

    def flush() -> None:
        keys, side, fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        number = np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))
        link(number, side, fps.view(np.uint64), nodes, sets)

    for b in batches:
        if not len(b):
            continue
        rows = (b[["bucket", "part"]].to_numpy(), b["side"].to_numpy(), b["fp"].to_numpy(), b["node"].to_numpy())
        # Whole buckets only: the last one may go on in the next batch.
        cut = np.flatnonzero((rows[0] != rows[0][-1]).any(axis=1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if held and (held[-1][0][-1] != rows[0][0]).any() and n >= TOGETHER:
            flush()
            n = 0
        if cut:
            held.append(tuple(x[:cut] for x in rows))
            n += cut
            if n >= TOGETHER:
                flush()
                n = 0
        held.append(tuple(x[cut:] for x in rows))
        n += len(b) - cut
        if len(sets.up) > 1_000_000:
            yield _edges(sets)
            sets.up.clear()
    if held:
        flush()
    yield _edges(sets)


def _edges(sets: Union) -> pd.DataFrame:
    keys = list(sets.up)
    return pd.DataFrame({"a": np.array(keys, np.int64), "b": np.array([sets.find(x) for x in keys], np.int64)})


def edges(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(node, fp), fingerprints distinct, to edges (a, b) that connect exactly what links connect.

    The edges of a bucket are as many as its connected fingerprints at most.
    """
    pairs = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))

    def bits(block: tuple[int, int]):
        return F.shiftrightunsigned("fp", block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))

    keys = []
    for no, pair in enumerate(pairs):
        key = F.lit(no).cast("long")
        for block in pair:
            key = F.shiftleft(key, BLOCKS[block][1]).bitwiseOR(bits(BLOCKS[block]))
        keys.append(key)
    dealt = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("bucket"))
    # How large each bucket is; those of one fingerprint link nothing. As a table, so that a hot bucket's rows can be split in the join.
    sizes = checkpointed(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    rows = join_checked(dealt, sizes, "bucket")
    n_tiles = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int")
    rows = rows.withColumn("n_tiles", n_tiles).withColumn("t", mine)
    # Tile pair (i, j), i <= j, is part i * n_tiles + j; a row of tile t is in all pairs that hold t.
    part = F.transform(
        F.sequence(F.lit(0), F.col("n_tiles") - 1),
        lambda u: F.struct(
            (F.least("t", u).cast("long") * F.col("n_tiles") + F.greatest("t", u)).alias("part"),
            F.when(u < F.col("t"), 1).otherwise(0).cast("byte").alias("side"),
        ),
    )
    rows = rows.select("bucket", "fp", "node", F.inline(part)).select("bucket", "part", "side", "fp", "node")
    ordered = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")
    return ordered.mapInPandas(_compare, "a long, b long").distinct()


def components(edge: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable, for each node that occurs in (a, b).

    Each round every node points at the smallest node around it, pointers are followed to their roots, edges are
    rewritten to roots, and those within a root go. Only nodes without a smaller neighbour are left. Tables are checkpointed each round.
    """
    live = checkpointed(edge)
    found = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("p"))
        up = _to_roots(checkpointed(up))
        # The first round meets every node; later ones only labels.
        found = up if found is None else checkpointed(_relabel(found, up, "p"))
        nxt = _relabel(_relabel(live, up, "a"), up, "b")
        live = checkpointed(nxt.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return found.select("node", F.col("p").alias("comp"))


def _to_roots(up: DataFrame) -> DataFrame:
    """(node, p) with each p followed to where it ends; the distance doubles each time, so a chain of n takes log n steps."""
    moved = True
    while moved:
        over = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        up = checkpointed(up.join(over, "p").select("node", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
    return up


def _relabel(df: DataFrame, up: DataFrame, col: str) -> DataFrame:
    to = up.select(F.col("node").alias(col), F.col("p").alias("__to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("__to", col)).drop("__to").select(*df.columns)


def classes(fps: DataFrame, id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of (doc_id, fp)."""
    return _classes(fps, id_col, tile).select("fp", "component_id")


def _classes(fps: DataFrame, id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """(fp, component_id, comp): ``comp``, the smallest fingerprint of the component, is never null."""
    rep = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    comp = checkpointed(components(edges(rep.select(F.col("fp").alias("node"), "fp"), tile)).select(F.col("node").alias("fp"), "comp"))
    # Only linked fingerprints need a name from elsewhere.
    linked = rep.join(comp, "fp")
    named = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = comp.join(named, "comp").select("fp", "component_id", "comp")
    joined = rep.join(named.withColumn("linked", F.lit(True)), "fp", "left")
    return joined.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"), F.coalesce("comp", "fp").alias("comp"))


def _with_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    fps = checkpointed(fingerprints(base).select("row.doc_id", "row.text_key", "fp"))
    # Both sides are plain tables, so that the join of a fingerprint which a third of all rows share can be split.
    return fps.join(checkpointed(_classes(fps)), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id; a row for each row of the table."""
    return _with_components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with one row of each component: the one of the smallest id, null ids last, and of these the first by hash of text."""
    rows = _with_components(docs, id_col, text_col)
    # Members without any id name no component; its smallest fingerprint does.
    first = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("comp"))).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_key").alias("key"))).alias("f"))
    one = first.select(F.col("f.id").alias("__id"), F.col("f.key").alias("__text_key"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    kept = keyed.join(one, ["__id", "__text_key"], "left_semi").dropDuplicates(["__id", "__text_key"])
    return kept.select("row.*")
