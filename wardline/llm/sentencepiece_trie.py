"""SentencePiece encoding and decoding over a trie of distinct words.

A text is cut into marked words (a run of space marks and what follows, up to another class of characters) at places no piece
of the vocabulary spans. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order, and one dynamic program runs over it: the state of a prefix is computed once and kept on the stack
for all words that share it.

The state of a prefix is its best score and the piece that ends its best path (Viterbi). The best path and its score are part of the result. **Deviation:** the
public vocabulary is a BPE model, and for such a model the path with the best sum of scores is not the encoding, so it cannot give right ids. For such a model the state
of a prefix holds, beside the best path, the last piece of its encoding, found in the same pass over the same candidates. A piece may follow another
exactly if the two stand side by side when the merges run on their concatenation, and exactly one piece can end each prefix; so the forward pass gives the
merge result. Texts and ids agree with the library's own encoder, and with merges run over the whole text. For a unigram model the best path is the encoding.
A character without a piece counts ten less than the worst piece, as in the library.

What the model file says of normalisation is checked: a space mark ahead of the text, every space as a mark, no other change. Another setting is an error.

Defined cases: a null text has null ids and a null decoded text; an empty text has no ids; repeated rows stay; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, id_and_text, small_batches

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Words and piece pairs a worker remembers; beyond, it starts anew.
MAX_WORDS, MAX_PAIRS = 400_000, 400_000


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """Encodes and decodes with the pieces of a model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_id = {}
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score: list[float] = [sp.get_score(i) for i in range(n)]
        self.control = {i for i in range(n) if sp.is_control(i) or sp.is_unused(i)}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        self.unk = sp.unk_id()
        spec = _settings(model)
        self.unigram = spec["kind"] == 1
        if not (spec["prefix"] and spec["marks"]) or spec["squeezes"] or spec["suffix"] or spec["mapping"]:
            raise ValueError(f"normalisation of this kind is not supported: {spec}")
        # By the last three characters, and by the last two where no longer piece ends in the three: how long pieces that end so are, the longest first,
        # and 1 for the character alone.
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) == 2:
                sizes[p] = {2, 1}
        for p in self.ids:
            if len(p) > 2:
                sizes.setdefault(p[-3:], {1} | sizes.get(p[-2:], {1})).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        # Characters that stand side by side in a piece, and so on, are of one class (letters, say): no piece goes from one class to another.
        class_of: dict[str, set[str]] = {}
        for p in self.ids:
            bare = p.lstrip(MARK)
            if len(p) > 1 and bare:
                whole = set(bare).union(*(class_of.get(c, ()) for c in bare))
                class_of.update(dict.fromkeys(whole, whole))
        classes = {id(x): x for x in class_of.values()}.values()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character; words are not independent")
        runs = "|".join(f"[{''.join(map(re.escape, sorted(x)))}]+" for x in sorted(classes, key=len, reverse=True))
        # marks and characters of one class, or marks alone, or one character that stands alone
        self.cut = re.compile(f"(?s){MARK}*(?:{runs})|{MARK}+|." if runs else f"(?s){MARK}+|.")
        self.words: dict[str, bytes] = {}  # ids as 32-bit integers
        self.best: dict[str, tuple[bytes, float]] = {}  # the best path and its score
        self.unknown = min(self.score, default=0.0) - 10.0
        # Ids whose text depends on their neighbours, or that have none: bytes of longer characters, and control pieces. An ASCII byte is its character.
        # What pieces decode to, and after them what they decode to at the start of a text.
        spelling = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.spelling = pa.array(spelling + [p.removeprefix(" ") for p in spelling], pa.string())
        self.odd = np.zeros(n, bool)
        self.odd[[*(i for i, b in self.byte_of.items() if b > 127), *self.control]] = True
        self.pairs: dict[int, bool] = {}
        self.span = n + 0x110000

    def _merge(self, s: str) -> list[str]:
        """The merges as the model defines them: the best-scored adjacent pair, leftmost first."""
        parts = list(s)
        ids, score = self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or score[k] > best):
                    best, at = score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        x, y = self._text(a), self._text(b)
        ok = self.pairs[a * self.span + b] = self._merge(x + y) == [x, y]
        return ok

    def _text(self, k: int) -> str:
        return self.pieces[k] if k < len(self.pieces) else chr(k - len(self.pieces))

    def _learn(self, words: list[str]) -> None:
        """Depth-first over the trie of sorted ``words``: both states of each prefix of the current word stand on stacks.

        A character without a piece of its own stands in as its code point after the pieces.
        """
        grow = self._states()
        last, size, best_last, best_size, score = next(grow)
        for w, shared in zip(words, _shared(words), strict=True):
            for stack in (last, size, best_last, best_size, score):
                del stack[shared + 1 :]
            grow.send(w)
            self.best[w] = self._path(best_last, best_size, len(w)), score[len(w)]
            self.words[w] = self.best[w][0] if self.unigram else self._path(last, size, len(w))

    def _path(self, last: list[int], size: list[int], end: int) -> bytes:
        """The ids that lead to a prefix."""
        out, n = [], len(self.pieces)
        while end:
            out.append(last[end])
            end -= size[end]
        out.reverse()
        if out and max(out) >= n:
            spelled = [[k] if k < n else [self.bytes_id[b] for b in chr(k - n).encode()] if self.bytes_id else [self.unk] for k in out]
            out = [x for part in spelled for x in part]
        return array("i", out).tobytes()

    def _states(self):
        """The states of a prefix: after merges, the last piece, the longest that may follow the state where it begins; and by Viterbi, the
        piece that ends the best path, the longest of equal ones, and its score.

        A generator: gives the five lists of the stack, then extends them for each word sent.
        """
        ids, ends, follows, pairs, one, span, n = self.ids.get, self.ends.get, self._follows, self.pairs, (1,), self.span, len(self.pieces)
        score, unknown, unigram = self.score, self.unknown, self.unigram
        last, size, best_last, best_size, best = [-1], [0], [-1], [0], [0.0]
        w = yield last, size, best_last, best_size, best
        while True:
            for end in range(len(last), len(w) + 1):
                top, merged = None, -1
                for k in (end > 2 and ends(w[end - 3 : end])) or (end > 1 and ends(w[end - 2 : end])) or one:
                    if k > end:
                        continue
                    piece = ids(w[end - k : end])
                    if piece is None:
                        if k > 1:
                            continue
                        piece = n + ord(w[end - 1])
                        total = best[end - k] + unknown
                    else:
                        total = best[end - k] + score[piece]
                    if top is None or total > top:
                        top, ending, long = total, piece, k
                    if merged < 0 and not unigram:
                        left = last[end - k]
                        if left >= 0:
                            ok = pairs.get(left * span + piece)
                            if not (follows(left, piece) if ok is None else ok):
                                continue
                        merged, merged_long = piece, k
                last.append(ending if unigram else merged)
                size.append(long if unigram else merged_long)
                best_last.append(ending)
                best_size.append(long)
                best.append(top)
            w = yield

    def best_paths(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of the path with the best sum of scores (Viterbi), whatever the model's kind."""
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in self.encode_both(texts)[1]]

    def encode_batch(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if x is None else np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Each text's ids as 32-bit integers."""
        return self.encode_both(texts)[0]

    def encode_both(self, texts: list[str | None]) -> tuple[list[bytes | None], list[bytes | None], list[float | None]]:
        """Each text's ids, and its best path and that path's score: both are put together from those of its words, since no piece spans two."""
        parts = [None if t is None else self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known, best = self.words, self.best
        met = set(chain.from_iterable(p for p in parts if p))
        new = met.difference(known)
        if len(known) + len(new) > MAX_WORDS:
            known.clear(), best.clear()
            new = met
        self._learn(sorted(new))
        ids = [None if p is None else b"".join(map(known.__getitem__, p)) for p in parts]
        paths = [None if p is None else list(map(best.__getitem__, p)) for p in parts]
        return ids, [None if p is None else b"".join([x for x, _ in p]) for p in paths], [None if p is None else sum([s for _, s in p], 0.0) for p in paths]

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids without nulls: pieces joined by Arrow, and one by one where ``odd`` ids occur."""
        flat, upto = ids.values.to_numpy(), ids.offsets.to_numpy()
        which = flat.copy()
        which[upto[:-1][upto[1:] > upto[:-1]]] += len(self.pieces)
        text = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spelling.take(pa.array(which))), "")
        odd = np.append(0, np.cumsum(self.odd[flat]))[upto]
        at = np.flatnonzero(odd[1:] > odd[:-1])
        if not len(at):
            return text
        own = pa.array([self.decode(flat[upto[i] : upto[i + 1]].tolist()) for i in at.tolist()], pa.string())
        mask = np.zeros(len(text), bool)
        mask[at] = True
        return pc.replace_with_mask(text, pa.array(mask), own)

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        out, raw = [], bytearray()
        pieces, byte_of, control = self.pieces, self.byte_of, self.control
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in control:
                out.append(pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


#: Characters of two words that are compared at once.
WIDE = 24


def _shared(words: list[str]) -> Iterator[int]:
    """How many characters each of the sorted words shares with the one before it."""
    if not words:
        return
    head = np.array(words, f"<U{WIDE}").view(np.uint32).reshape(-1, WIDE)
    # A shorter word is padded with zeros, which may stand for equal ends or for a null character: cut at the shorter one.
    same = np.logical_and.accumulate(head[1:] == head[:-1], axis=1).sum(axis=1).tolist()
    yield 0
    for before, w, n in zip(words, words[1:], same, strict=False):
        n = min(n, len(before), len(w))
        if n == WIDE:
            for x, y in zip(before[WIDE:], w[WIDE:], strict=False):
                if x != y:
                    break
                n += 1
        yield n


def _settings(model: bytes) -> dict:
    """Of the model file: its kind (1 unigram, 2 BPE) and how it normalises texts."""

    def fields(buf: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                b = buf[at]
                at += 1
                n |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return n

        while at < len(buf):
            tag = number()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, number()
            elif kind == 2:
                size = number()
                yield tag >> 3, buf[at : at + size]
                at += size
            else:
                size = 8 if kind == 1 else 4
                yield tag >> 3, buf[at : at + size]
                at += size

    parts = dict(fields(model))
    trainer, normalizer = (dict(fields(parts.get(no, b""))) for no in (2, 3))
    return {
        "kind": trainer.get(3, 1), "suffix": bool(trainer.get(24, 0)), "mapping": bool(normalizer.get(2, b"")),
        "prefix": bool(normalizer.get(3, 1)), "squeezes": bool(normalizer.get(4, 1)), "marks": bool(normalizer.get(5, 1)),
    }


_CODERS: dict[int, Coder] = {}


def _coder(model: bytes) -> Coder:
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def encode(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, n_chars, round_trip (decoding gives the text back), best_ids and best_score (the Viterbi path); a row for each row of the table.

    A space mark in the text itself decodes to a space, as in the library, and then round_trip is false.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or model_bytes())
    small_batches(docs.sparkSession)

    def lists(packed: list[bytes | None], null: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(lists without nulls, with nulls, lengths)"""
        size = np.array([len(x or b"") // 4 for x in packed], np.int64)
        flat, upto = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32)), np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(upto), flat), pa.ListArray.from_arrays(pa.array(upto, mask=np.append(null, False)), flat), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value)
        gc.disable()  # a batch makes millions of objects and no cycles
        try:
            for b in batches:
                for at in range(0, b.num_rows, BATCH_ROWS):
                    part = b.slice(at, BATCH_ROWS)
                    packed, best, score = coder.encode_both(part.column("text").to_pylist())
                    null = np.array([x is None for x in packed], bool)
                    whole, ids, size = lists(packed, null)
                    back = coder.decode_batch(whole)
                    cols = [
                        part.column("doc_id"),
                        ids,
                        pa.array(size, mask=null),
                        pc.utf8_length(part.column("text")).cast(pa.int64()),
                        pc.equal(back, part.column("text")),  # null for a null text
                        lists(best, null)[1],
                        pa.array(score, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "n_chars", "round_trip", "best_ids", "best_score"])
        finally:
            gc.enable()
            coder.words.clear(), coder.best.clear()  # the worker goes on to other tasks; most words are rare and would not be met again

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_chars long, round_trip boolean, best_ids array<int>, best_score double")


def decode(coded: DataFrame, model: bytes | None = None, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text: the inverse of ``encode``."""
    held = coded.sparkSession.sparkContext.broadcast(model or model_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value)
        for b in batches:
            texts = [coder.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


