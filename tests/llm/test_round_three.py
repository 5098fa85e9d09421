"""WARC bundles, the audit of filter orders, and vector codes: brute force over odd rows, and each way of a look-up."""

import glob
import hashlib
import random
import re
import struct
from itertools import permutations

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import prose, same
from pyspark.sql import functions as F

from wardline.llm import common, filter_audit, vector_codes, warc
from wardline.sources.tables import working_folder

LONG = "<p>" + "copy of a page " * 12 + "</p>"
PAGES = [
    (4, "http://a/x", LONG), (2, "http://b/y", LONG), (9, "http://c/z", LONG), (None, "http://d", LONG), (2, "http://b/y", LONG), (5, None, None), (6, "http://e f\r\nWARC-Type: x/%41é", ""),
    (7, "", "short"), (8, "http://h", "short"), (None, "u", None), (None, "u", "only here, with no id at all " * 5), (None, "v", "only here, with no id at all " * 5), (11, "w", "é日本😀" * 9), (12, "w", "é日本😀" * 9),
    (13, "x", "\r\n\r\nWARC/1.1\r\n" * 30), (14, "x", "\r\n\r\nWARC/1.1\r\n" * 30), (15, "z", prose(7, 60_000)), (-1, "z", "y" * 99), (-2, "z", "y" * 99), (-3, "z", "y" * 100), (-4, "z", "y" * 100),
]
PAGE = "page_id long, url string, html string"


def records_of(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        f = first.get(h or "") if len(raw) >= 100 else None
        refers = f if f is not None and f != i else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 0])
def test_warc_round_trip(spark, most):
    pages = spark.createDataFrame([(*p, "d", 1, b"p") for p in PAGES], PAGE + ", digest string, refers_to long, payload binary").repartition(3)
    folder = working_folder(spark)
    warc.write(warc.plan(pages, most), folder, frame_bytes=2_000, bundle_bytes=8_000)
    got = warc.read(spark, folder)
    same(got, records_of(PAGES), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    full = {(r["page_id"], r["target_uri"], bytes(r["payload"]).decode()) for r in got.where("record_type = 'response'").collect()}
    assert full == {(i, "about:blank" if u is None else u, h or "") for (i, u, h), r in zip(PAGES, records_of(PAGES), strict=True) if r[3] == "response"}
    assert {r["page_id"]: r["target_uri"] for r in got.where("record_type = 'revisit'").collect()}[4] == "http://a/x"


def test_bundles_are_plain_zstandard(spark):
    folder = working_folder(spark)
    pages = spark.createDataFrame([(i, f"u{i}", prose(i, 200)) for i in range(60)], PAGE).coalesce(2)
    warc.write(warc.plan(pages), folder, frame_bytes=4_000, bundle_bytes=5_000)
    files = [open(f, "rb").read() for f in glob.glob(folder.removeprefix("file://") + "/part-*")]
    assert len([f for f in files if f]) > 2
    n = 0
    for content in filter(None, files):
        table = warc.seek_table(content)
        assert struct.unpack("<I", content[-4:])[0] == 0x8F92EAB1 and len(table) > 2
        assert table[-1][0] + table[-1][1] + 17 + 12 * len(table) == len(content)
        text = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        assert text == b"".join(warc.frame(content, table, k) for k in range(len(table) - 1))
        for name, k, offset, length in warc.places(content):
            own = warc.frame(content, table, k)[offset : offset + length]
            assert own.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {name}\r\n".encode() in own and own.endswith(b"\r\n\r\n")
            n += 1
    assert n == 60


def test_warc_records_by_id(spark):
    folder = working_folder(spark)
    warc.write(warc.plan(spark.createDataFrame([(i, f"u{i}", prose(i, 100)) for i in range(50)], PAGE).repartition(3)), folder, frame_bytes=2_000, bundle_bytes=9_000)
    ids = spark.createDataFrame([(warc.record_id(i, ""),) for i in (3, 17, 17, 49, 1234)], "record_id string")
    same(warc.fetch(spark, folder, ids).withColumn("p", F.col("payload").cast("string")), [(i, prose(i, 100)) for i in (3, 17, 49)], "page_id", "p")
    assert warc.index(spark, folder).count() == 50


def test_damage_is_seen():
    b = warc.Bundle()
    b.add("a", warc.make_record(1, "u", b"payload", 7, hashlib.sha256(b"payload").hexdigest(), None))
    b.add("b", warc.make_record(2, "u", b"payload", 7, "0" * 64, None))
    content = b.close()
    table = warc.seek_table(content)
    raw = warc.frame(content, table, 0)
    _, at = warc.parse_record(raw)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw, at)
    with pytest.raises(ValueError, match="seek table"):
        warc.seek_table(content[:-1])
    with pytest.raises(ValueError, match="damaged"):
        warc.frame(content, [(*table[0][:3], table[0][3] ^ 1), *table[1:]], 0)


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE), working_folder(spark)).count() == 0


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_header_values(url):
    assert warc._plain_value(warc._header_value(url)) == url and not re.search("[\r\n ]", warc._header_value(url))


DOCS = "doc_id long, text string, source string, part string, bits int, good boolean, first_id long"
LABELS = "doc_id long, quality int, toxic int, part string"


def audit_of(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        rows.append((s or "", f + "E" * (i is not None and smallest[t] < i), i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                own = [r for r in rows if r[0] == part and r[1] == f]
                out[part, order, k] = [len(left), len(removed), sum(f in r[1] for r in gone), len(own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                gone += removed
    total = {}
    for (part, order, k), v in out.items():
        total[part, order[k - 1]] = total.get((part, order[k - 1]), 0) + v[1]
    return [(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()]


AUDIT = ("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")


def audit_rows(edge_texts):
    docs = [(i, t, ["web", None, "", "books"][i % 4]) for i, t in enumerate([*edge_texts, *edge_texts])]
    wide = " ".join(f"word{i}" for i in range(80))
    docs += [(100, wide, "web"), (None, wide, "web"), (90, wide, "books"), (90, wide, "web"), (101, wide + " #", None), (102, wide.upper(), "web"), (None, None, None), (103, wide.replace("word1", "word2"), "x")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 110, 3)] + [(90, 0, 0), (90, 1, None), (None, 1, 1), (100, None, 1)]
    return docs, labels


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 0])
def test_filter_audit(spark, edge_texts, most):
    docs, labels = audit_rows(edge_texts)
    d = spark.createDataFrame([(*r, "p", 1, True, 1) for r in docs], DOCS).repartition(3)
    lab = spark.createDataFrame([(*r, "p") for r in labels], LABELS)
    same(filter_audit.replay(filter_audit.flagged(d, lab, most)), audit_of(docs, labels), *AUDIT)


def test_filter_audit_of_nothing(spark, edge_texts):
    d, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(d, lab).count() == 0
    docs, _ = audit_rows(edge_texts)
    same(filter_audit.audit(spark.createDataFrame([(*r, "p", 1, True, 1) for r in docs], DOCS), lab), audit_of(docs, []), *AUDIT)


def test_orders(spark):
    assert sorted(r["filter_order"] for r in filter_audit.orders(spark).collect()) == sorted(map("".join, permutations("ABCDE")))


VECTORS = "vec_id long, embedding array<float>, label int, code string, v array<int>"


def codes_of(rows):
    import math

    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    w = len(kept[0][1]) // 16 if kept else 0
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[r[1][p * w : p * w + w] for r in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v):
        return [min((far(v[p * w : p * w + w], e), k) for k, e in enumerate(books[p])) for p in range(16)]

    for _ in range(2):
        got = [assign(v) for _, v, _ in kept]
        moved = [[list(e) for e in b] for b in books]
        for p in range(16):
            for k in range(len(first)):
                own = [v[p * w : p * w + w] for (_, v, _), g in zip(kept, got, strict=True) if g[p][1] == k]
                if own:
                    moved[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        books = moved
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [assign(v) for _, v, _ in kept]
    by_label = {}
    for (_, _, l), g in zip(kept, got, strict=True):
        by_label[l] = by_label.get(l, 0) + sum(d for d, _ in g)
    return [(i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), by_label[l], sha) for (i, _, l), g in zip(kept, got, strict=True)]


def vector_rows(n, dim, seed):
    r = random.Random(seed)
    grid = [-2.0, -0.5, -0.004, 0.0, 0.004, 0.25, 1.0, 300.0]
    rows = [(i * 3 % (n + 1), [r.choice(grid) if r.random() < 0.5 else r.gauss(0, 1) for _ in range(dim)], r.choice([None, 0, 1, 1, 1, 7])) for i in range(n)]
    same_one = rows[0][1]
    rows += [(1000 + i, same_one, 1) for i in range(n // 2)] + [(rows[1][0], rows[2][1], None), (None, rows[3][1], 1), (None, [0.0] * dim, None)]
    return rows + [(7, None, 1), (0, [float("nan")] * dim, 1), (0, [float("inf")] + [0.0] * (dim - 1), 1), (0, [0.0] * (dim - 1) + [-float("inf")], 1), (0, [None] + [0.0] * (dim - 1), 1)]


CODED = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("n,dim,most", [(150, 64, common.BROADCAST_ROWS), (150, 32, 0), (20, 16, common.BROADCAST_ROWS)])
def test_vector_codes(spark, n, dim, most):
    rows = vector_rows(n, dim, n + dim)
    d = spark.createDataFrame([(*r, "c", [1]) for r in rows], VECTORS).repartition(5)
    same(vector_codes.compress(d, most), codes_of(rows), *CODED)


def test_vector_codes_of_little(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    one = [(None, [0.5] * 16, None)]
    same(vector_codes.compress(spark.createDataFrame([(*r, "c", [1]) for r in one], VECTORS)), codes_of(one), *CODED)
    none = [(1, [], 3), (2, [], None)]
    got = vector_codes.compress(spark.createDataFrame([(*r, "c", [1]) for r in none], VECTORS)).collect()
    assert {(r["code"], r["error"]) for r in got} == {("00" * 16, 0)}


@pytest.mark.parametrize("bad,says", [([1.0] * 17, "multiple"), ([1.0] * 15 + [1e30], "larger"), ([1.0] * 32, "differ")])
def test_vectors_that_cannot_be_coded_are_named(spark, bad, says):
    d = spark.createDataFrame([(1, [1.0] * 16, 1, "c", [1]), (2, bad, 1, "c", [1])], VECTORS)
    with pytest.raises(Exception, match=says):
        vector_codes.compress(d).count()


@given(st.integers(0, 10**6), st.integers(1, 70), st.integers(1, 5), st.integers(1, 40), st.sampled_from([1, 2, 8]))
@settings(max_examples=150, deadline=None)
def test_tree_finds_the_first_nearest(seed, n, dim, queries, leaf):
    r = np.random.default_rng(seed)
    points, q = r.integers(-3, 4, (n, dim)), r.integers(-4, 5, (queries, dim))
    index, best = vector_codes.nearest(points, vector_codes.tree(points, leaf=leaf), q)
    far = ((q[:, None, :] - points) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_decoded_vectors_are_as_far_as_said(spark):
    rows = [r for r in vector_rows(80, 32, 5) if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    kept = vector_codes.kept(spark.createDataFrame([(*r, "c", [1]) for r in rows], VECTORS))
    books = vector_codes.fit(kept)
    got = vector_codes.decode(vector_codes.encode(kept, books), books).join(kept.select("vec_id", "v"), "vec_id")
    for r in got.where("vec_id > 1000").collect():
        assert sum((round(256 * a) - b) ** 2 for a, b in zip(r["approximation"], r["v"], strict=True)) == r["error"]


def test_hot_keys_take_no_part_in_the_shuffle(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 9}", "x") for i in range(900)], "id long, key string, __hot2 string").repartition(4)
    found = spark.createDataFrame([("hot", 1, 600), ("k0", 2, 100), ("k3", 3, 100)], "key string, first long, n long")
    want = [(i, 1 if i % 3 else {0: 2, 3: 3}.get(i % 9)) for i in range(900)]
    for most, hot_keys in ((10, 10), (0, 2), (0, 1000), (0, 1)):
        same(common.look_up(rows, found, "key", "first", ["id"], most, hot_keys), want, "id", "first")
