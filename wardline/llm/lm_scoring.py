"""Cross-entropy difference with matched target and background bigram models.

Both models share one vocabulary and one smoothing. Every word and every bigram of the corpus has its counts,
once for the target part and once for the whole; the mass of unseen bigrams goes to the unigrams, so that each model's
probabilities add up to 1: p(w) = (n(w) + ALPHA) / (n + ALPHA * (distinct words + 1)) and
p(w | v) = (n(v w) + MU * p(w)) / (n(v) + MU), where v is the word before, or the start of the document.

No table of words or bigrams is ever in one place. Documents are cut into blocks of about a million tokens, written once as numbers
of the block's own words. Each block sends its distinct words and bigrams, with their counts, to be summed in parts, which are ranges of a
hash, as many as the corpus asks for, and gets the sums back in the order sent. A block sends to ``FAN`` ranges at most: for more parts than that, the
blocks of a group are first merged range by range, in cells, and what is merged sends on to the parts of its range, in as many levels as it takes. Ranges are
evened out over the levels, and there are at least twice as many cells as parts on each, so a cell receives about half a part's keys, and a
row holds a hundred keys or more at any size of the corpus; what travels grows with the corpus times the levels (two up to 16 million parts). Bigrams travel as 80 bits of
two sums of word hashes, sorted, as the gaps between them: among 10^10 of them any two agree with a chance below 10^-4, and such a pair would only share
its counts.

Words are runs of other than ASCII white space, with A-Z lower-cased. A document's score is the mean over its tokens of the target
model's loss minus the background model's, in nats: the lower, the more like the target.

Defined cases: null and empty texts have no tokens, null losses and score 0; rows without an id are background; repeated rows count each time;
without a target the target model is the uniform one over the shared vocabulary; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, small_batches
from .labelled import join_checked

#: A block ends with the document that brings it to one of these.
BLOCK_TOKENS, BLOCK_CHARS, BLOCK_DOCS = 1 << 20, 1 << 24, 100_000
#: Keys that a part of the sums receives, about.
PART_KEYS = 1 << 21
#: Ranges that a block, or what was merged of some, sends to at most, and blocks that are merged, about.
FAN = 4096
ALPHA, MU = 0.5, 20.0
#: No word is a line break: it stands for the start of a document.
START = b"\n"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    """The words in UTF-8; ``bytes`` lower-cases and splits by ASCII alone."""
    return (text or "").encode().lower().split()


def with_target(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, target: whether the id is among ``targets``."""
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    return join_checked(id_and_text(docs, id_col, text_col), ids, "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes: the high planes of small numbers are zeros and cost nothing."""
    return _squeeze(np.ascontiguousarray(numbers.reshape(-1, 1).view(np.uint8).T).tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_expand(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_BLOCK = pa.schema(
    [("block", pa.int64()), ("tokens", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("target", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("words", pa.binary()), ("counts", pa.binary()),
     *((c, pa.int64()) for c in ("n_words", "n_t", "n_b", "start_t", "start_b"))]
)
_BLOCK_SQL = "block long, tokens binary, doc_id array<long>, target array<boolean>, length array<int>, words binary, counts binary, n_words long, n_t long, n_b long, start_t long, start_b long"


def _before(ids: np.ndarray, length: np.ndarray, start: int) -> np.ndarray:
    """The word before each token; ``start`` where a document begins."""
    out = np.concatenate([[start], ids[:-1]]).astype(np.int64)[: len(ids)]
    at = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
    out[at[: len(length)][length > 0]] = start
    return out


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: tokens as numbers of the block's words, frequent ones first, and each word's counts, as a word and as a context."""
    no = TaskContext.get().partitionId() << 32
    vocab: defaultdict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    docs, held, n, chars = [], [], 0, 0

    def out() -> pa.RecordBatch:
        size = len(vocab)
        ids = np.concatenate([np.zeros(0, np.int32), *held])
        order = np.argsort(-np.bincount(ids, minlength=size), kind="stable")
        rank = np.empty(size, np.int32)
        rank[order] = np.arange(size)
        ids = rank[ids]
        words = list(vocab)
        length = np.array([len(h) for h in held], np.int64)
        mark = np.array([t for _, t in docs], bool)
        own = np.repeat(mark, length)
        before = _before(ids, length, size)
        counts = np.array([np.bincount(x, minlength=size + 1) for x in (ids[own], ids, before[own], before)], np.int64)
        row = [no, _pack(ids), [d for d, _ in docs], mark.tolist(), length.tolist(), _squeeze(b"\n".join(words[i] for i in order.tolist())), _pack(counts[:, :size].ravel())]
        row += [size, int(own.sum()), len(ids), int(counts[2, size]), int(counts[3, size])]
        vocab.clear(), docs.clear(), held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    for b in batches:
        for doc, text, target in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True):
            words = tokens(text)
            docs.append((doc, target))
            held.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
            n, chars = n + len(words), chars + len(text or "")
            if n >= block_tokens or chars >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                yield out()
                no, n, chars = no + 1, 0, 0
    if docs:
        yield out()


def _words(row: dict) -> list[bytes]:
    return _expand(row["words"]).split(b"\n") if row["n_words"] else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal ranges of 64 bits a hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(part: np.ndarray) -> list[slice]:
    """Runs of one part in sorted ``part``."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class _Pairs:
    """The distinct bigrams of a block in the order of their keys, and for each token the number of its bigram."""

    def __init__(self, row: dict, hashes: np.ndarray):
        self.ids, self.length = _unpack(row["tokens"], np.int32), np.array(row["length"], np.int64)
        h = np.concatenate([hashes, _hashes([START])])
        self.before = _before(self.ids, self.length, len(hashes))
        k1 = h[self.before, 0] * _ODD[0] + h[self.ids, 1]
        k2 = ((h[self.before, 1] * _ODD[1] + h[self.ids, 0]) >> np.uint64(48)).astype(np.uint16)
        self.order = np.argsort(k1, kind="stable")
        k1, k2 = k1[self.order], k2[self.order]
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        self.first = np.flatnonzero(new)
        self.of = np.empty(len(k1), np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.k1, self.k2 = k1[self.first], k2[self.first]


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMS = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("counts", pa.binary()), ("distinct", pa.int64())])


def _divisors(parts: int, fan: int) -> list[int]:
    """How many parts a range spans on each level, down to one."""
    out = [1]
    while parts > out[0] * fan:
        out.insert(0, out[0] * fan)
    return out


def _spans(parts: int, fan: int) -> list[int]:
    """Those of the least fan with as many levels as ``fan``: with a range or two on the first level, cells would be as large as blocks are."""
    levels = len(_divisors(parts, fan))
    least = max(2, int(parts ** (1 / levels)) - 1)
    return _divisors(parts, next(f for f in range(least, max(fan, least) + 1) if len(_divisors(parts, f)) <= levels))


def _word_order(hashes: np.ndarray, n_words: int, span: int) -> list[tuple[int, np.ndarray]]:
    """(range of parts, numbers of the block's words in it); words go to ranges below zero, bigrams to the others."""
    part = -1 - _part(hashes[:, 0], n_words) // span
    order = np.argsort(part, kind="stable")
    return [(int(part[order[s.start]]), order[s]) for s in _slices(part[order])]


def _packed_words(words: list[bytes]) -> bytes:
    return _squeeze(b"\n".join(words))


def _packed_pairs(k1: np.ndarray, k2: np.ndarray) -> bytes:
    """Sorted keys as gaps."""
    return _pack(np.diff(k1, prepend=np.uint64(0))) + k2.tobytes()


def _send(batches: Iterator[pa.RecordBatch], n_words: int, n_pairs: int, word_span: int, pair_span: int) -> Iterator[pa.RecordBatch]:
    """Blocks to a row for each range of parts: the block's words or bigrams there, with their counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            words = _words(row)
            hashes = _hashes(words)
            by_word = _unpack(row["counts"], np.int64).reshape(4, -1)
            rows = [(p, row["block"], _packed_words([words[j] for j in at.tolist()]), _pack(by_word[:, at].ravel())) for p, at in _word_order(hashes, n_words, word_span)]
            pairs = _Pairs(row, hashes)
            if len(pairs.k1):
                own = np.repeat(np.array(row["target"], bool), pairs.length)[pairs.order]
                n = np.diff(np.append(pairs.first, len(own)))
                t = np.add.reduceat(own.astype(np.int64), pairs.first)
                part = _part(pairs.k1, n_pairs) // pair_span
                for s in _slices(part):
                    rows.append((int(part[s.start]), row["block"], _packed_pairs(pairs.k1[s], pairs.k2[s]), _pack(np.concatenate([t[s], n[s]]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


class _Merged:
    """The keys of some rows, each once: in the order of the keys where ``sort`` is asked for (bigrams always), with sums of their counts."""

    def __init__(self, sent: pa.Table, sort: bool = False):
        self.of_words = sent.column("part")[0].as_py() < 0
        counts = [_unpack(x, np.int64).reshape(4 if self.of_words else 2, -1) for x in sent.column("counts").to_pylist()]
        self.sizes = [c.shape[1] for c in counts]
        blobs = sent.column("keys").to_pylist()
        if self.of_words:
            each = [_expand(w).split(b"\n") for w in blobs]
            ids: defaultdict[bytes, int] = defaultdict()
            ids.default_factory = ids.__len__
            if sort:
                ids.update((w, i) for i, w in enumerate(sorted(set().union(*each))))
            self.key = np.concatenate([np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in each])
            self.words, self.distinct = list(ids), len(ids)
        else:
            k1, k2 = [], []
            for raw, n in zip(blobs, self.sizes, strict=True):
                k1.append(np.cumsum(_unpack(raw[: -2 * n], np.uint64), dtype=np.uint64))
                k2.append(np.frombuffer(raw[-2 * n :], np.uint16))
            k1, k2 = np.concatenate(k1), np.concatenate(k2)
            order = np.lexsort((k2, k1))
            k1, k2 = k1[order], k2[order]
            new = np.ones(len(order), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            self.key = np.empty(len(order), np.int64)
            self.key[order] = np.cumsum(new) - 1
            self.k1, self.k2, self.distinct = k1[new], k2[new], int(new.sum())
        self.sums = np.array([np.bincount(self.key, c, self.distinct) for c in np.concatenate(counts, axis=1)]).astype(np.int64)

    def ranges(self, parts: int, span: int) -> list[tuple[int, np.ndarray]]:
        """(range of parts, numbers of the keys in it)"""
        if self.of_words:
            return _word_order(_hashes(self.words), parts, span)
        part = _part(self.k1, parts) // span
        return [(int(part[s.start]), np.arange(s.start, s.stop)) for s in _slices(part)]

    def back(self, sent: pa.Table, sums: np.ndarray, distinct: int) -> pa.Table:
        """``sums`` of all keys as each row asked for them."""
        packed = [_pack(sums[:, k].ravel()) for k in np.split(self.key, np.cumsum(self.sizes)[:-1])]
        return pa.Table.from_arrays([sent.column("block"), sent.column("part"), pa.array(packed, pa.binary()), pa.array([distinct] + [0] * (len(packed) - 1), pa.int64())], schema=_SUMS)


def _sum(sent: pa.Table) -> pa.Table:
    """The rows of a part to the sums of its keys, for each block in the order in which that sent them."""
    m = _Merged(sent)
    return m.back(sent, m.sums, m.distinct)


_SENT_SQL, _SUMS_SQL = "part long, block long, keys binary, counts binary", "block long, part long, counts binary, distinct long"


def _totals(sent: DataFrame, parts: int, spans: list[int], units: int, fan: int) -> DataFrame:
    """Rows of ``_SENT`` to ``_SUMS``. On all levels but the last, units are merged range by range to cells, which are units of the next level."""
    if len(spans) == 1:
        return sent.groupBy("part").applyInArrow(_sum, _SUMS_SQL)
    # A range has the keys of ``spans[0]`` parts: in twice as many cells, those that get more units than others still hold about a part's keys.
    groups = max(2 * spans[0], -(-units // fan))
    cells = sent.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(groups)) * (1 << 32) + F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")))

    def merged(rows: pa.Table) -> pa.Table:
        m, cell = _Merged(rows, sort=True), rows.column("cell")[0].as_py()
        out = []
        for part, at in m.ranges(parts, spans[1]):
            keys = _packed_words([m.words[j] for j in at.tolist()]) if m.of_words else _packed_pairs(m.k1[at], m.k2[at])
            out.append((part, cell, keys, _pack(m.sums[:, at].ravel())))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _SENT, strict=True)], schema=_SENT)

    def given_back(rows: pa.Table, sums: pa.Table) -> pa.Table:
        m = _Merged(rows, sort=True)
        got = dict(zip(sums.column("part").to_pylist(), sums.column("counts").to_pylist(), strict=True))
        total = np.zeros_like(m.sums)
        for part, at in m.ranges(parts, spans[1]):
            total[:, at] = _unpack(got[part], np.int64).reshape(len(total), -1)
        return m.back(rows, total, sum(sums.column("distinct").to_pylist()))

    up = checkpointed(cells.groupBy("cell").applyInArrow(merged, _SENT_SQL))
    sums = _totals(up, parts, spans[1:], groups, fan)
    return cells.groupBy("cell").cogroup(sums.groupBy("block")).applyInArrow(given_back, _SUMS_SQL)


def score_corpus(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS, fan: int = FAN) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of the documents by models of all their words and bigrams."""
    small_batches(docs.sparkSession)
    blocks = checkpointed(with_target(docs, targets, id_col, text_col).mapInArrow(lambda batches: _blocks(batches, block_tokens), _BLOCK_SQL))
    n_t, n_b, start_t, start_b, held, n_blocks = (x or 0 for x in blocks.agg(*(F.sum(c) for c in ("n_t", "n_b", "start_t", "start_b", "n_words")), F.count(F.lit(1))).first())
    # A distinct word costs a part more than a bigram does.
    n_words, n_pairs = 1 + held * 4 // part_keys, 1 + n_b // part_keys
    word_spans, pair_spans = _spans(n_words, fan), _spans(n_pairs, fan)
    sent = blocks.select("block", "tokens", "target", "length", "words", "n_words", "counts").mapInArrow(lambda batches: _send(batches, n_words, n_pairs, word_spans[0], pair_spans[0]), _SENT_SQL)
    if len(word_spans) == len(pair_spans) == 1:
        sums = checkpointed(sent.groupBy("part").applyInArrow(_sum, _SUMS_SQL))
    else:
        sent = checkpointed(sent)
        of_words = _totals(sent.where("part < 0"), n_words, word_spans, n_blocks, fan)
        sums = checkpointed(of_words.unionByName(_totals(sent.where("part >= 0"), n_pairs, pair_spans, n_blocks, fan)))
    mass = ALPHA * ((sums.where("part < 0").agg(F.sum("distinct")).first()[0] or 0) + 1)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        got = dict(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), strict=True))
        hashes = _hashes(_words(row))
        pairs = _Pairs(row, hashes)
        by_word, by_pair = np.zeros((4, len(hashes))), np.zeros((2, len(pairs.k1)))
        for part, at in _word_order(hashes, n_words, word_spans[0]):
            by_word[:, at] = _unpack(got[part], np.int64).reshape(4, -1)
        part = _part(pairs.k1, n_pairs) // pair_spans[0]
        for s in _slices(part):
            by_pair[:, s] = _unpack(got[int(part[s.start])], np.int64).reshape(2, -1)
        length = pairs.length
        doc = np.repeat(np.arange(len(length)), length)
        losses = []
        for pair, own, context, n, start in zip(by_pair, by_word[:2], by_word[2:], (n_t, n_b), (start_t, start_b), strict=True):
            one, context = (own + ALPHA) / (n + mass), np.append(context, start)
            loss = -np.log((pair[pairs.of] + MU * one[pairs.ids]) / (context[pairs.before] + MU))
            losses.append(np.bincount(doc, loss, len(length)) / np.maximum(length, 1))
        empty = length == 0
        return pa.table(
            [pa.array(row["doc_id"], pa.int64()), pa.array(length), *(pa.array(x, mask=empty) for x in losses), pa.array(np.where(empty, 0.0, losses[0] - losses[1]))],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    base = blocks.select("block", "tokens", "doc_id", "length", "words", "n_words")
    return base.groupBy("block").cogroup(sums.select("block", "part", "counts").groupBy("block")).applyInArrow(judge, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
