"""Language-model scores, the classifiers, and SentencePiece coding."""

import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import WORDS, prose

from wardline.llm import lm_scoring, quality_gam, sentencepiece_trie, toxicity_cnn


def test_lm_edges(spark, edge, edge_rows, empty):
    targets = spark.createDataFrame([(5, "x"), (5, "x"), (None, "x")], "doc_id long, text string")
    got = lm_scoring.score_corpus(edge, targets).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(lm_scoring.tokens(r[1])) for r in edge_rows)
    assert all((r["n_tokens"] == 0) == (r["target_loss"] is None) and (r["n_tokens"] or r["score"] == 0) for r in got)
    none = lm_scoring.score_corpus(edge, targets.limit(0)).collect()
    v = 1 + len({w for r in edge_rows for w in lm_scoring.tokens(r[1])})
    assert all(r["n_tokens"] == 0 or np.isclose(r["target_loss"], np.log(v)) for r in none)  # uniform
    assert lm_scoring.score_corpus(empty, targets).count() == 0


def test_lm_tells_parts_apart(spark):
    docs = [(i, prose(i, 60)) for i in range(60)] + [(100 + i, "zinc zebra zone " * 20) for i in range(10)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lm_scoring.score_corpus(d, spark.createDataFrame([(i,) for i in range(100, 110)], "doc_id long")).collect()}
    assert max(s[i] for i in range(100, 110)) < 0 < min(s[i] for i in range(60))


def test_lm_is_a_distribution(spark):
    """After any word the probabilities of all words and of one unseen word add up to 1: read from losses of one-bigram documents."""
    words = ["a", "b", "c"]
    docs = [(0, "a b a b"), (1, "b a c")] + [(10 + 3 * i + j, f"{x} {y}") for i, x in enumerate(words) for j, y in enumerate(words)]
    out = {r["doc_id"]: r for r in lm_scoring.score_corpus(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    heads = [(1 + 20 * 2.5 / 6, 0 + 20 * 2.5 / 6, 0 + 20 * 0.5 / 6)]  # target: n(start w) + MU p(w) of "a b a b"
    for i, x in enumerate(words):
        first = heads[0][i] / 21
        step = sum(np.exp(-2 * out[10 + 3 * i + j]["target_loss"]) / first for j in range(3))
        seen = {"a": 2, "b": 1, "c": 0}[x]
        assert np.isclose(step + 20 * 0.5 / 6 / (seen + 20), 1)


def test_lm_counts_every_word_and_bigram(spark):
    """A rare word and a rare bigram keep counts of their own, however large the corpus and the word; small blocks change nothing."""
    base = [prose(i, 5000) for i in range(220)]
    rare = [(1000, "zinc " + "z" * 70 + " zebra"), (1001, "zebra zinc"), (1002, None), (None, "zinc zebra"), (1002, "")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(base)] + rare, "doc_id long, text string").repartition(5)
    targets = spark.createDataFrame([(i,) for i in range(0, 1001, 3)] + [(1000,)], "doc_id long")
    good = {*range(0, 1001, 3), 1000}
    rows = [(i, (t or "").split()) for i, t in [*enumerate(base), *rare]]
    both = []
    for own in (lambda i: i in good, lambda i: True):
        words, pairs, context = Counter(), Counter(), Counter()
        for i, w in rows:
            if own(i):
                words.update(w)
                pairs.update(zip([None, *w], w))
                context.update([None, *w][: len(w)])
        both.append((words, pairs, context))
    v = len(both[1][0]) + 1
    want = {}
    for i, w in rows:
        losses = []
        for words, pairs, context in both:
            one = lambda x: (words[x] + 0.5) / (words.total() + 0.5 * v)  # noqa: B023, E731
            losses.append(-sum(np.log((pairs[a, b] + 20 * one(b)) / (context[a] + 20)) for a, b in zip([None, *w], w)) / max(1, len(w)))
        want[i, len(w)] = losses
    # One block and part; some of each on one level; on three levels.
    for size, keys, fan in ((lm_scoring.BLOCK_TOKENS, lm_scoring.PART_KEYS, lm_scoring.FAN), (20_000, 300_000, lm_scoring.FAN), (20_000, 20_000, 4)):
        got = lm_scoring.score_corpus(docs, targets, block_tokens=size, part_keys=keys, fan=fan).collect()
        assert len(got) == len(rows)
        for r in got:
            t, b = want[r["doc_id"], r["n_tokens"]]
            assert np.isclose(r["score"], t - b) and (r["n_tokens"] == 0) == (r["target_loss"] is None)
            assert r["n_tokens"] == 0 or np.allclose([r["target_loss"], r["background_loss"]], [t, b])
    assert lm_scoring.score_corpus(docs.limit(0), targets).count() == 0
    blank = lm_scoring.score_corpus(docs.where("doc_id = 1002"), targets.limit(0)).collect()
    assert [(r["n_tokens"], r["target_loss"], r["score"]) for r in blank] == [(0, None, 0.0)] * 2


def test_lm_sends_as_much_a_bigram_at_any_size():
    """Rows of a block, as the parts of the corpus grow by a million: few enough to hold many keys each."""
    r = np.random.default_rng(1)
    k1, k2 = np.sort(r.integers(0, 2**64, 1 << 19, np.uint64)), r.integers(0, 2**16, 1 << 19).astype(np.uint16)
    for parts in (1, 10, 100, 10_000, 1_000_000, 16_000_000):
        spans = lm_scoring._divisors(parts, lm_scoring.FAN)
        assert spans[-1] == 1 and all(a == b * lm_scoring.FAN for a, b in zip(spans, spans[1:])) and len(spans) <= 3
        rows = [lm_scoring._packed_pairs(k1[s], k2[s]) for s in lm_scoring._slices(lm_scoring._part(k1, parts) // spans[0])]
        assert len(rows) <= lm_scoring.FAN and sum(map(len, rows)) / len(k1) < 12


def test_lm_cells_hold_about_a_part(spark, monkeypatch):
    """Just over one level, a cell used to merge nearly all keys of ``fan`` blocks, whatever a part may hold."""
    r = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.integers(0, 1000, 500))) for i in range(96)], "doc_id long, text string").repartition(4)
    targets = spark.createDataFrame([(i,) for i in range(0, 96, 3)], "doc_id long")
    tables, written = [], lm_scoring.checkpointed

    def kept(df):
        tables.append(written(df))
        return tables[-1]

    monkeypatch.setattr(lm_scoring, "checkpointed", kept)
    got = lm_scoring.score_corpus(docs, targets, block_tokens=1000, part_keys=2000, fan=16).collect()
    cells = Counter()
    for table in tables[2:-1]:  # blocks, what they sent, what cells did, the sums
        for x in table.select("part", "block", "counts").collect():
            cells[x["part"] < 0, x["block"]] += len(lm_scoring._unpack(x["counts"], np.int64)) // (4 if x["part"] < 0 else 2)
    assert cells and max(cells.values()) <= 2 * 2000
    one = {x["doc_id"]: x["score"] for x in lm_scoring.score_corpus(docs, targets).collect()}
    assert len(got) == len(one) and all(np.isclose(x["score"], one[x["doc_id"]]) for x in got)


def quality_docs(n=400):
    junk = lambda i: " ".join(w + "###" for w in prose(i, 60).split())
    return [prose(i, 60) + "." if i % 4 else junk(i) for i in range(n)]


def test_gam_learns(spark):
    texts = quality_docs()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    m = quality_gam.train(docs, labels)
    out = quality_gam.classify(docs, m).collect()
    held = [r for r in out if r["held_out"]]
    assert 40 < len(held) < 120 and all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held)
    assert {r["doc_id"] for r in quality_gam.keep(docs, m).collect()} == {r["doc_id"] for r in out if r["predicted"]}
    assert len(m.pairs) == quality_gam.PAIRS


def test_gam_tables_beat_one_feature():
    """An interaction that no single feature shows is learned by the pair tables."""
    r = np.random.default_rng(0)
    x = r.random((2000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9


def tree_by_loops(g, h, leaves):
    """The best tree over ordered bins, its cuts tried one by one: greedy, as boosting asks for."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        tries = [(gain(a, c) + gain(c, b) - gain(a, b), -k, a, c, b) for k, (a, b) in enumerate(parts) for c in range(a + 1, b)]
        if not tries or max(tries)[0] <= 1e-9:
            break
        _, k, a, c, b = max(tries)
        parts[-k : -k + 1 or None] = []
        parts += [(a, c), (c, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


def test_gam_against_plain_loops(edge_texts):
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 17):
        g, h = r.normal(0, 3, n), r.random(n)
        assert np.allclose(quality_gam._tree(g, h), tree_by_loops(g.tolist(), h.tolist(), quality_gam.LEAVES))
    for n, m in ((2, 2), (4, 7)):
        g, h = r.normal(0, 3, (n, m)), r.random((n, m))
        table, best = quality_gam._cross(g, h)
        gain = lambda x, y: x.sum() ** 2 / (y.sum() + 1)
        quads = lambda x, i, j: (x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:])
        tries = {(i, j): sum(map(gain, quads(g, i, j), quads(h, i, j))) - gain(g, h) for i in range(1, n) for j in range(1, m)}
        i, j = max(tries, key=tries.get)
        assert np.isclose(best, tries[i, j])
        for q, a, b in zip(quads(table, i, j), quads(g, i, j), quads(h, i, j), strict=True):
            assert np.allclose(q, a.sum() / (b.sum() + 1))
    texts = [*edge_texts, *quality_docs(60), prose(11, 50_000)]
    x = quality_gam.matrix(texts)
    m = quality_gam.fit(quality_gam.matrix(quality_docs()), np.array([float(i % 4 > 0) for i in range(400)]))
    for row, got in zip(x.tolist(), m.score(x), strict=True):
        z = m.base
        for v, cuts, table in zip(row, m.cuts, m.tables, strict=True):
            z += table[sum(v >= c for c in cuts)]
        for i, j, a, b, table in m.pairs:
            z += table[sum(row[i] >= c for c in a)][sum(row[j] >= c for c in b)]
        assert np.isclose(got, 1 / (1 + np.exp(-max(-30, min(30, z)))))


@pytest.mark.parametrize("module,label", [(quality_gam, "quality"), (toxicity_cnn, "toxic")])
def test_classifier_edges(spark, edge, empty, module, label):
    rows = [(5, 1, 1), (6, 1, 1), (None, 1, 1), (7, None, None), (7, 2, 2)]
    some = spark.createDataFrame([(*r, "t", "l", "y", 0.5, "r") for r in rows], "doc_id long, quality int, toxic int, text string, lang string, y string, score double, row string")
    for lab in (some, some.limit(0)):
        m = module.train(edge, lab)
        out = module.classify(edge, m).collect()
        assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
        assert module.classify(empty, m).count() == 0
    assert module.train(empty, some) is not None


def test_cnn_learns(spark):
    bad = ["grubface", "slimewad", "grubhead"]
    texts = [prose(i, 80) + (" " + bad[i % 3] + " " + prose(i + 9999, 20) if i % 5 == 0 else "") for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    m = toxicity_cnn.train(docs, labels)
    out = toxicity_cnn.classify(docs, m).collect()
    assert sorted(out) == sorted(toxicity_cnn.classify_corpus(docs, labels).collect())
    held = [r for r in out if r["held_out"]]
    wrong = [r for r in held if r["predicted"] != int(r["doc_id"] % 5 == 0)]
    assert len(held) > 120 and len(wrong) <= 2
    # where in the text it stands makes no difference, and parts of the batch none either
    long = toxicity_cnn.Scorer(m).score([prose(3, 30_000) + " slimewad", prose(4, 30_000), None, ""])
    assert long[0] > 0.3 > long[1] and long[2] == long[3] < 0.3


def in_order(n, seed):
    """Texts whose class is only the order in which two of their words stand."""
    r = np.random.default_rng(seed)
    docs, y = [], r.integers(0, 2, n)
    for k in y.tolist():
        words = [w for w in r.choice(WORDS, 12).tolist() if w not in ("ember", "willow")]
        at = int(r.integers(0, len(words) + 1))
        docs.append([*words[:at], *(["ember", "willow"] if k else ["willow", "ember"]), *words[at:]])
    return docs, y.astype(float)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cnn_learns_the_order_of_words(seed):
    m = toxicity_cnn.fit(*in_order(2000, seed), seed=seed)
    docs, y = in_order(500, 100 + seed)
    assert ((toxicity_cnn.Scorer(m).logit(docs) > 0) == (y > 0)).mean() > 0.9


def cnn_by_loops(m, text):
    """A score from the model's tables alone: parts, windows, maxima, units, one after another."""
    row = {int(h): e for h, e in zip(m.rows, m.emb, strict=True)}
    v = [sum((row[h] for h in toxicity_cnn.parts(w) if h in row), np.zeros(toxicity_cnn.DIM)) for w in toxicity_cnn.tokens(text)]
    z, unit = m.base, 0
    for width in toxicity_cnn.WIDTHS:
        for k in range(toxicity_cnn.FILTERS):
            best = max((sum(v[i + j] @ m.filters[width][j][:, k] for j in range(width) if i + j < len(v)) for i in range(len(v))), default=0.0) + m.bias[unit]
            z += (best if best > 0 else toxicity_cnn.LEAK * best) * m.out[unit]
            unit += 1
    return 1 / (1 + np.exp(-(z * m.scale[0] + m.scale[1])))


def test_cnn_scores_equal_plain_loops(edge_texts):
    m = toxicity_cnn.fit(*in_order(400, 7))
    texts = [*edge_texts, *(" ".join(d) for d in in_order(20, 8)[0]), prose(9, 2000)]
    got = toxicity_cnn.Scorer(m).score(texts)
    assert np.allclose(got, [cnn_by_loops(m, t) for t in texts], atol=1e-4) and got.std() > 0.1


def test_thresholds_count_every_labelled_row(spark):
    """By plain loops over all labelled rows, long texts and a rare language too."""
    m = toxicity_cnn.fit(*in_order(400, 7))
    docs, y = in_order(300, 11)
    texts = [" ".join(d) + (" so on" * 8000 if i % 50 == 0 else "") for i, d in enumerate(docs)]
    y = np.where(np.arange(300) % 9 == 0, 1 - y, y)
    langs = [("en", "de", None)[i % 3] if i >= 40 else ("fr" if i < 25 else "it") for i in range(300)]
    base = spark.createDataFrame(list(zip(range(300), texts, langs)), "doc_id long, text string, lang string")
    labelled = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, y int")
    got = toxicity_cnn.thresholds(toxicity_cnn._scores(base.fillna({"lang": ""}), m), labelled)
    score = np.floor(toxicity_cnn.Scorer(m).score(texts) * 1000).astype(int)
    want = {}
    for lang in ("en", "de", "", "fr"):
        own = np.array([(x or "") == lang for x in langs])
        f1 = {b: 2 * ((score >= b) & own & (y == 1)).sum() / ((score >= b)[own].sum() + (y[own] == 1).sum()) for b in set(score[own].tolist())}
        best = [b for b, v in f1.items() if np.isclose(v, max(f1.values()))]
        want[lang] = sum(best) / len(best) / 1000
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def coder():
    return sentencepiece_trie.Coder(sentencepiece_trie.model_bytes())


ODD = ["", " ", "  a  b ", "\n\n", "x\ty", "日本語😀 the", "aaaaaaaa aaaab", "    deep   indent", "é́ñ", "def f(x):\n    return x**2\n", "<s> </s> <0x0A>", "\x00\x01", "á" * 50]


def test_pieces_equal_the_library():
    import sentencepiece

    c, sp = coder(), sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_trie.model_bytes())
    texts = ODD + [prose(i, 200) for i in range(20)] + ["".join(chr(97 + (i * j) % 26) for j in range(60)) for i in range(40)]
    assert c.encode_batch(texts) == sp.encode(texts)
    assert c.encode_batch(texts[::-1]) == sp.encode(texts[::-1])
    for t in texts:
        assert c.decode(c.encode_batch([t])[0]) == t


def test_batches_decode_as_single_texts_do():
    """Any ids, control pieces and bytes of longer characters among them, whole or broken."""
    c, r = coder(), np.random.default_rng(2)
    some = [*c.byte_of, *c.control, c.unk, c.ids["▁"], c.ids["▁a"], *r.integers(0, len(c.pieces), 50).tolist()]
    lists = [[], [c.bytes_id[32]], [c.ids["▁"]], *(r.choice(some, int(n)).tolist() for n in r.integers(0, 12, 300))]
    upto = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(upto), pa.array(np.array([i for x in lists for i in x], np.int32)))
    assert c.decode_batch(ids).to_pylist() == [c.decode(x) for x in lists]


def test_shared_prefixes():
    words = sorted({"", "a", "ab", "ab\x00", "ab\x00\x00", "abc", "日本", "日本語", "x" * 24, "x" * 25, "x" * 40 + "y", "x" * 40 + "z"})
    assert list(sentencepiece_trie._shared(words)) == [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:])]
    assert list(sentencepiece_trie._shared([])) == []


def spelled(c, pieces):
    """Pieces to ids; a character without a piece in bytes."""
    return [x for p in pieces for x in ([c.ids[p]] if p in c.ids else [c.bytes_id[b] for b in p.encode()])]


def test_ids_equal_merges_of_whole_texts():
    """Brute force: the best merge of two neighbours, leftmost first, over the whole text and not word by word."""
    c = coder()
    texts = [t for t in ODD if t] + [prose(i, 60) + "\n" + prose(i + 1, 5).upper() for i in range(6)]
    for t in texts:
        assert c.encode_batch([t])[0] == spelled(c, c._merge("▁" + t.replace(" ", "▁")))


def best_path(c, t):
    """(ids, score) by a plain dynamic program over the whole text."""
    longest = max(map(len, c.ids))
    s = "▁" + t.replace(" ", "▁") if t else ""
    best = [(0.0, None)]
    for e in range(1, len(s) + 1):
        known = [(best[b][0] + c.score[c.ids[s[b:e]]], b) for b in range(max(0, e - longest), e) if s[b:e] in c.ids]
        best.append(max(known + ([] if s[e - 1] in c.ids else [(best[e - 1][0] + c.unknown, e - 1)])))
    ids, at = [], len(s)
    while at:
        ids = spelled(c, [s[best[at][1] : at]]) + ids
        at = best[at][1]
    return ids, best[-1][0]


def test_best_paths_of_whole_texts():
    """Viterbi over the shared prefixes has the score of a plain dynamic program over the whole text."""
    c = coder()
    texts = [t for t in ODD if t] + [prose(i, 40) for i in range(6)]
    total = lambda x: sum(c.score[k] for k in x if k not in c.byte_of)
    for t, got, score in zip(texts, c.best_paths(texts), c.encode_both(texts)[2], strict=True):
        ids, want = best_path(c, t)
        assert np.isclose(score, want) and np.isclose(total(got), total(ids)) and c.decode(got) == t
    assert c.encode_batch(texts) == coder().encode_batch(texts)  # the ids stay the merges'
    assert c.encode_both([None, ""]) == ([None, b""], [None, b""], [None, 0.0])


def test_settings_of_the_model_are_checked(monkeypatch):
    ok = sentencepiece_trie._settings(sentencepiece_trie.model_bytes())
    for change in ({"prefix": False}, {"squeezes": True}, {"marks": False}, {"suffix": True}, {"mapping": True}):
        monkeypatch.setattr(sentencepiece_trie, "_settings", lambda _, c=change: ok | c)
        with pytest.raises(ValueError, match="normalisation"):
            coder()


def test_encode_decode(spark, edge, empty):
    coded = sentencepiece_trie.encode(edge)
    assert coded.count() == edge.count() and not coded.where("NOT round_trip").count()
    assert coded.where("n_tokens <> size(ids)").count() == 0 and coded.where("ids IS NULL").count() == 1
    back = sorted((r["doc_id"] or -1, r["text"] or "") for r in sentencepiece_trie.decode(coded).collect())
    assert back == sorted((r["doc_id"] or -1, r["text"] or "") for r in edge.collect())
    assert sentencepiece_trie.encode(empty).count() == 0
    c = coder()
    for r in coded.join(edge.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").where("doc_id <> 3").collect():
        want = (None, None) if r["text"] is None else best_path(c, r["text"][:3000])
        if r["text"] is None or len(r["text"]) <= 3000:
            assert r["best_ids"] is None if want[0] is None else np.isclose(sum(c.score[k] for k in r["best_ids"] if k not in c.byte_of), sum(c.score[k] for k in want[0] if k not in c.byte_of))
            assert r["best_score"] is None if want[1] is None else np.isclose(r["best_score"], want[1])


