"""Line dedup, SimHash and decontamination: brute force over odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import prose, same

from wardline.llm import decontaminate, line_dedup, simhash
from wardline.llm.fm_index import FMIndex

NO_ID = 2**63 - 1
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def first_lines(rows):
    """(id, kept lines)"""
    first = {}
    key = lambda x: ascii_lower(x.strip(STRIP))
    for i, t in rows:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), NO_ID), NO_ID if i is None else i)
    return [(i, [x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] >= (NO_ID if i is None else i)]) for i, t in rows]


def dedup_of(rows):
    out = []
    for (i, t), (_, kept) in zip(rows, first_lines(rows), strict=True):
        n = (t or "").count("\n") + 1
        out.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_lines(edge, edge_rows, partitions):
    want = dedup_of([(r[0], r[1]) for r in edge_rows])
    same(line_dedup.digest(edge, partitions=partitions), want, "doc_id", "n_lines", "n_dropped", "kept_sha256")


@pytest.mark.parametrize("bytes_", [line_dedup.BROADCAST_BYTES, 0])
def test_common_line_spans_partitions(spark, monkeypatch, bytes_):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bytes_)
    rows = [(i, f"a very common line\nown line number {i % 60}\nshort") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(line_dedup.digest(d, partitions=9), dedup_of(rows), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_rewrite(edge, edge_rows, empty):
    out = line_dedup.rewrite(edge, count_col="n_chars")
    assert out.columns == edge.columns and out.schema["n_chars"].dataType == edge.schema["n_chars"].dataType
    got = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.where("doc_id IS NOT NULL").collect())
    assert got == sorted((w[0], w[3]) for w in dedup_of([(r[0], r[1]) for r in edge_rows]) if w[0] is not None)
    assert out.where("text IS NULL").count() == 1 and not out.where("n_chars <> length(text)").count()
    assert line_dedup.digest(empty).count() == 0 and line_dedup.rewrite(empty).count() == 0


def print_of(t):
    w = re.findall("[^\x20\x09-\x0d]+", ascii_lower(t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(rows):
    fps = [(i, print_of(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    name = {}
    for i, f in fps:
        if i is not None:
            name[find(f)] = min(name.get(find(f), i), i)
    return [(i, f"{f:016x}", name.get(find(f))) for i, f in fps]


def test_simhash(edge, edge_rows, empty, spark):
    same(simhash.near_duplicates(edge), components_of([(r[0], r[1]) for r in edge_rows]), "doc_id", "fingerprint", "component_id")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.dedup(empty).count() == 0
    kept = simhash.dedup(edge)
    assert kept.columns == edge.columns
    want = {c for _, _, c in components_of([(r[0], r[1]) for r in edge_rows])} - {None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want)


def test_dedup_keeps_one_row_of_each_component_without_ids(spark):
    texts = [prose(i, 60) for i in range(4)]
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0]), (7, texts[2]), (8, texts[3])]
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept, key=repr) == sorted([(7, texts[2]), (8, texts[3]), (None, texts[0]), (None, texts[1])], key=repr)


def near(r, fp, bits):
    for b in r.sample(range(64), bits):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("tile", [8, 50, 16_384])
def test_links_lose_nothing(spark, tile):
    """Chains and clouds at distances up to five, in tiles of several sizes."""
    r = random.Random(tile)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(40):
            x = near(r, x, r.randint(1, 5))
            fps.add(x)
    hub = r.getrandbits(64)
    fps |= {near(r, hub, r.randint(1, 4)) for _ in range(200)} | {hub}
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    got = {(x["fp"], x["component_id"]) for x in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), tile=tile).collect()}
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert got == {(f, find(i)) for i, f in rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=300), st.integers(1, 299), st.integers(0, 2**32))
def test_bit_planes(fps, d, seed):
    """Lanes against the lanes d places on, some of them near, some of them left out."""
    r = random.Random(seed)
    d = d % (len(fps) - 1) + 1
    for i in range(len(fps) - d):
        if r.random() < 0.5:
            fps[i + d] = near(r, fps[i], r.randint(0, 6))
    live = np.array([i for i in range(len(fps) - d) if r.random() < 0.8], np.int64)
    got = simhash.Sliced(np.array(fps, np.uint64)).near(d, live)
    assert got.tolist() == [i for i in live.tolist() if (fps[i] ^ fps[i + d]).bit_count() <= 4]


def test_all_comparisons_go_through_the_planes():
    """Buckets of many sizes side by side: the links are those of brute force, and only counters have told them."""
    r = random.Random(5)
    bucket, side, fps = [], [], []
    for k, size in enumerate([2, 3, 2, 70, 1, 130, 5, 64, 2]):
        hub = r.getrandbits(64)
        for i in range(size):
            bucket.append(k)
            side.append(int(k == 5 and i >= 60))
            fps.append(near(r, hub, r.randint(0, 9)))
    fps, nodes, sets = np.array(fps, np.uint64), np.arange(len(fps)) * 7, simhash.Union()
    planes = simhash.link(np.array(bucket), np.array(side, np.int8), fps, nodes, sets)
    want = simhash.Union()
    for i in range(len(fps)):
        for j in range(i):
            if bucket[i] == bucket[j] and (bucket[i] != 5 or side[i] != side[j]) and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4:
                want.join(7 * i, 7 * j)
    assert [sets.find(7 * i) for i in range(len(fps))] == [want.find(7 * i) for i in range(len(fps))]
    linked = sum(want.find(7 * i) != 7 * i for i in range(len(fps)))
    assert 0 < linked <= planes.compared


def test_a_group_of_near_copies_is_compared_about_once():
    r = random.Random(1)
    hub = r.getrandbits(64)
    fps = np.array(sorted({near(r, hub, 2) for _ in range(5000)}), np.uint64)
    sets = simhash.Union()
    planes = simhash.link(np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int8), fps, np.arange(len(fps)), sets)
    assert {sets.find(i) for i in range(len(fps))} == {0} and planes.compared < 4 * len(fps) + 64


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)]
    got = {(r["node"], r["comp"]) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(1000 + i, 1000) for i in range(50)}


BENCH = ["the of and ember lantern quarry willow drift copper fathom ridge marrow thistle harbor", "short item here", "", None, "same Words", "same words", "x"]


def contamination_of(t, items):
    """Items of one id are one; without an id they are one as well, written last."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w = word.findall(ascii_lower(t or ""))
    hit, found = set(), []
    for i, text in items:
        iw = word.findall(ascii_lower(text or ""))
        wins = [iw[k : k + 13] for k in range(max(1, len(iw) - 12))] if iw else []
        at = [(p, len(x)) for x in wins for p in range(len(w) - len(x) + 1) if w[p : p + len(x)] == x]
        hit |= {p + j for p, n in at for j in range(n)}
        if at and i not in found:
            found.append(i)
    names = [*sorted(str(i) for i in found if i is not None), *(["null"] if None in found else [])]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [8_000_000, 30])
def test_decontamination(spark, edge_rows, edge, empty, block):
    items = [*enumerate(BENCH), (2, "one more text of item two"), (None, "an item without an id"), (None, "and another one")]
    texts = ["one more text of item two, an item without an id", prose(77, 60_000) + " an item without an id and another one", BENCH[0], "before " + BENCH[0].upper() + " after " + BENCH[0], "A short, item; here! and x", "same words same words", " ".join(BENCH[0].split()[:12])]
    rows = [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(*r, "own", [1]) for r in rows], "doc_id long, text string, items string, spans array<int>").repartition(3)
    b = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    want = [(i, *contamination_of(t, items)) for i, t in rows]
    same(decontaminate.digest(d, b, block_chars=block), want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert decontaminate.clean(d, b, block_chars=block).columns == decontaminate.cut(d, b, block_chars=block).columns == d.columns
    kept = sorted(str(r["doc_id"]) for r in decontaminate.clean(d, b, block_chars=block).collect())
    assert kept == sorted(str(w[0]) for w in want if not w[5])
    assert decontaminate.digest(empty, b).count() == 0
    assert decontaminate.digest(edge, b.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut(d, b, block_chars=block).collect()}
    assert cut[102] == "" and cut[103].split() == ["before", "after"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index(text, pattern):
    fm = FMIndex(np.array(text, np.int64), 5)
    lo, hi = fm.search(np.array([pattern], np.int64), np.array([len(pattern)], np.int64))
    got = sorted(fm.locate(np.arange(lo[0], hi[0])).tolist()) if hi[0] > lo[0] else []
    assert got == [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]


def test_one_very_long_text(spark):
    """A text of half a million words beside its copy with one word less, and a benchmark item in its midst."""
    words = prose(11, 500_000).split()
    item = " ".join(f"item{i}" for i in range(40))
    long = " ".join([*words[:250_000], item, *words[250_000:]])
    docs = spark.createDataFrame([(1, long), (2, long.rsplit(" ", 1)[0]), (3, item), (4, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, "x", 1)], "item_id long, text string, row string, n_words int")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.digest(docs, bench).collect()}
    assert got == {1: (40, 1, False), 2: (40, 1, False), 3: (40, 1, True), 4: (0, 0, False)}
    near = {r["doc_id"]: (r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(docs).collect()}
    assert near[1][0] == near[2][0] == 1 and near[3][0] == 3 and near[1][1] == f"{simhash.fingerprint(long):016x}"


def test_cut_and_clean_with_clashing_names(spark):
    item = " ".join(f"item{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"before {item} after", "r", [1], "w"), (2, "plain text", "r", [2], "w")], "doc_id long, text string, row string, spans array<int>, n_words string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    same(decontaminate.cut(docs, bench), [(1, "before  after", "r", [1], "w"), (2, "plain text", "r", [2], "w")], *docs.columns)
    same(decontaminate.clean(docs, bench), [(2, "plain text", "r", [2], "w")], *docs.columns)
