"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is the text of some Arrow batches of a task. Its words become symbols; words that no benchmark
item holds become breaks, and a stretch between breaks that is shorter than the shortest window is
left out, since no window can stand there. All windows of the benchmark are searched backwards at
once, occurrences are located by sampled suffix positions, and the words they cover are merged into
removal spans. The documents never move: the whole operator is a map.

The benchmark is a query set, whose blocks of bounded size are built in tasks and sent to tasks. A task goes through the blocks for each of its shards and holds one of them at
a time, so a larger benchmark takes more time and no more memory.

Defined cases: a null or empty text has no words, no hits, and the digest of an empty list; an item
without words is never found; items of one id are one item, and so are all without an id, written as
``null`` after the others; rows of documents that repeat stay; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, map_texts, unpack_row
from .fm_index import FMIndex

N = 13
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: For UTF-8: A-Z to lower case, and all of ASCII but letters and digits to spaces.
_TO_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Symbols of a shard; one document alone may be larger.
SHARD_WORDS = 2_000_000
#: Characters of benchmark text in a block.
BLOCK_CHARS = 8_000_000
#: Occurrences located at once.
LOCATE = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    return _spaced(text).split()


def _spaced(text: str | None) -> bytes:
    return (text or "").encode().translate(_TO_WORDS)


def _symbols(words: list[bytes], vocab: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((vocab.get(x, 1) for x in words), np.int32, len(words))


class Windows:
    """The windows of a block of items, each once, with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int = N):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for name, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 2) for w in words]  # 0 ends the text, 1 is a break
            for i in range(max(1, len(ids) - n + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + n]), set()).add(name)
        self.owners = [list(x) for x in owners.values()]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.shortest = int(self.lengths.min(initial=n))
        self.patterns = np.zeros((len(owners), n), np.int64)
        for row, w in enumerate(owners):
            self.patterns[row, : len(w)] = w


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[Windows]:
    """Items dealt to blocks by hash, repeats once. Tasks build the windows, and the driver passes one block on at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, -(-chars // block_chars)))))

    def build(items: pa.Table) -> pa.Table:
        w = Windows([(i, words_of(t)) for i, t in zip(items.column("i").to_pylist(), items.column("t").to_pylist(), strict=True)])
        return pa.table([pa.array([pickle.dumps(w)], pa.binary())], names=["windows"])

    for r in dealt.groupBy("block").applyInArrow(build, "windows binary").toLocalIterator():
        yield pickle.loads(r["windows"])


def _find(docs: list[np.ndarray], w: Windows) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document of a shard, given as symbols: word ranges of occurrences, and the items found."""
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
    if not len(w.lengths) or not docs:
        return out
    lens = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.concatenate([[0], np.cumsum(lens)])
    ids = np.concatenate(docs).astype(np.int64)
    # Stretches of known words within a document, at least as long as the shortest window.
    known = np.concatenate([[False], ids != 1, [False]])
    opens = known[1:] & ~known[:-1]
    opens[starts[:-1][lens > 0]] |= known[1:][starts[:-1][lens > 0]]
    begin = np.flatnonzero(opens[:-1])
    if not len(begin):
        return out
    breaks = np.append(np.flatnonzero(ids == 1), len(ids))
    edge = np.minimum(breaks[np.searchsorted(breaks, begin)], starts[np.searchsorted(starts, begin, side="right")])
    keep = edge - begin >= w.shortest
    begin, edge = begin[keep], edge[keep]
    if not len(begin):
        return out
    # Stretches side by side, a break after each; where[i]: word number of symbol i.
    size = edge - begin + 1
    offset = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(offset[-1]) - np.repeat(offset[:-1] - begin, size)
    text = np.where(where < np.repeat(edge, size), ids[np.minimum(where, len(ids) - 1)], 1)
    fm = FMIndex(text, len(w.vocab) + 2)
    lo, hi = fm.search(w.patterns, w.lengths)
    found = np.flatnonzero(hi > lo)
    for part in _parts(found, hi - lo):
        count = (hi - lo)[part]
        which = np.repeat(part, count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        word = where[fm.locate(rows)]
        doc = np.searchsorted(starts, word, side="right") - 1
        for d, p, k in zip(doc.tolist(), (word - starts[doc]).tolist(), which.tolist(), strict=True):
            out[d][0].append((p, p + int(w.lengths[k])))
            out[d][1].update(w.owners[k])
    return out


def _parts(found: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
    """Patterns in groups of a bounded number of occurrences (a single pattern may have more)."""
    if len(found):
        group = np.cumsum(count[found]) // LOCATE
        for cut in np.split(found, np.flatnonzero(np.diff(group)) + 1):
            yield cut


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _searcher(blocks: list) -> callable:
    """``blocks``: broadcast Windows."""

    def search(shard: list[np.ndarray], texts: list[bytes]) -> list[tuple[list[tuple[int, int]], set[str | None]]]:
        """``shard``: symbols of the only block; with more blocks each makes its own from ``texts``."""
        out: list[tuple[list[tuple[int, int]], set[str | None]]] = [([], set()) for _ in shard]
        for held in blocks:
            w = held.value
            for (spans, items), (s, i) in zip(out, _find([_symbols(t.split(), w.vocab) for t in texts] if texts else shard, w), strict=True):
                spans += s
                items |= i
            if len(blocks) > 1:
                vars(held).pop("_value", None)  # one block at a time; it is read again from the worker's disk
        return out

    def work(texts: list[str | None]) -> list:
        spans, items, n_words = [], [], []
        shard: list[np.ndarray] = []
        spaced: list[bytes] = []
        size = 0
        vocab = blocks[0].value.vocab if len(blocks) == 1 else {}

        def flush() -> None:
            for s, i in search(shard, spaced):
                spans.append([{"first": a, "last": b - 1} for a, b in merge(s)])
                items.append(sorted(i, key=lambda x: (x is None, x)))
            shard.clear(), spaced.clear()

        for t in texts:
            raw = _spaced(t)
            words = raw.split()
            n_words.append(len(words))
            if shard and size + len(words) > SHARD_WORDS:
                flush()
                size = 0
            shard.append(_symbols(words, vocab))
            if len(blocks) > 1:
                spaced.append(raw)
            size += len(words)
        flush()
        return [n_words, spans, items]

    return lambda: work


_SPANS = "array<struct<first:int,last:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The table's rows (``row``), with n_words, merged word ranges ``spans`` to remove, and ``items`` found.

    Word numbers start at 0, and ``last`` is included.
    """
    sc = docs.sparkSession.sparkContext
    state = T._parse_datatype_string(f"n_words long, spans {_SPANS}, items array<string>")
    blocks = [sc.broadcast(block) for block in _blocks(benchmark, item_id, item_text, block_chars)]
    return map_texts(docs, state.fields, _searcher(blocks), text_col)


def digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, benchmark, id_col, text_col, **kw)
    names = F.array_sort("items")
    return c.select(
        F.col(f"row.`{id_col}`").cast("long").alias("doc_id"),
        "n_words",
        covered().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",", "null"), 256).alias("items_sha256"),
    ).withColumn("contaminated", verdict())


def covered():
    """Words in ``spans``, which are merged."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] + 1 - s["first"])


def verdict():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The table without contaminated documents; others are not touched."""
    c = contamination(docs, benchmark, id_col, text_col, **kw)
    return unpack_row(c.withColumn("n_hit", covered()).where(~verdict()))


def cut(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The table with removal spans cut out of its texts."""
    c = contamination(docs, benchmark, id_col, text_col, **kw)

    def without(text: str | None, spans: list) -> str | None:
        if text is None or not spans:
            return text
        at = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER))]
        out, upto = [], 0
        for a, b in merge([(s["first"], s["last"] + 1) for s in spans]):
            out.append(text[upto : at[a][0]])
            upto = at[b - 1][1]
        return "".join([*out, text[upto:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rows = c.select("row", F.col(f"row.`{text_col}`").alias("text"), "spans")
    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("text").alias(text_col) if x == text_col else F.col(f"row.`{x}`").alias(x) for x in docs.columns])


