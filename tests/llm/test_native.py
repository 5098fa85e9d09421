"""Quality rules, license scans, URL filters: brute force over odd rows."""

import re
from collections import Counter

import pytest
from llm_helpers import prose, same

from wardline.llm import license_scan, quality_rules, url_filters

WS, SEP = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rules_of(t):
    t = t or ""
    w = WS.findall(t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(8)}
    live = [x for x in t.split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(live) - len(set(live)), len(hit)


def test_rules(edge, edge_rows, empty):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in edge_rows:
        m = rules_of(r[1])
        want.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    out = quality_rules.apply_policy(quality_rules.ledger(edge))
    same(out, want, *cols)
    assert not out.where("base_failed AND kept").count()
    assert quality_rules.ledger(empty).count() == 0


def test_rules_on_a_very_long_text(spark):
    t = prose(4, 100_000) + "\n" + prose(5, 30) + "\n" + prose(5, 30) + " # | #"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    same(quality_rules.ledger(d), [(1, *rules_of(t))], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_ablation_and_policies(edge):
    led = quality_rules.ledger(edge)
    rows = {r["rule"]: r for r in quality_rules.ablation(led).collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for rule, bit in quality_rules.BITS.items():
        assert rows[rule]["n_fails"] == sum(b >> bit & 1 for b in bits)
        assert rows[rule]["n_alone"] == sum(b == 1 << bit for b in bits)
    kept = {p: quality_rules.apply_policy(led, p).where("kept").count() for p in quality_rules.POLICIES}
    assert kept["base"] >= kept["v1"] >= kept["v2"]


def licenses_of(t):
    w = SEP.findall(ascii_lower(t or ""))
    places, labels = [], set()
    for label, phrase in license_scan.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(edge, edge_rows, empty, spark):
    same(license_scan.label(edge), [(r[0], *licenses_of(r[1])) for r in edge_rows], "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert license_scan.label(empty).count() == 0


def test_license_notice_survives_edits(spark):
    words = dict(license_scan.NOTICES)["mit"].split()
    whole, cut = " ".join(words), " ".join([*words[:9], "kindly", *words[9:]])
    d = spark.createDataFrame([(1, "intro text " + whole), (2, "x " + cut), (3, " ".join(words[:8])), (4, "x under the mit license " * 4)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.label(d).collect()}
    assert out[1]["labels"] == "mit" and out[1]["base_labels"] == "" and out[1]["score"] == 1.0
    assert out[2]["labels"] == "mit" and 0.8 <= out[2]["score"] < 1.0
    assert out[3]["labels"] == "" and out[3]["score"] < 0.5
    assert out[4]["n_base"] == 4 and out[4]["first_word"] == 1 and out[4]["last_word"] == 16
    assert {(r["doc_id"], r["first_word"]) for r in license_scan.places(d).where("NOT base").collect()} == {(1, 2), (2, 1)}


def test_license_words_out_of_order_do_not_count(spark):
    """Neighbouring diagonals that hold a notice's k-grams backwards are no place of it, however long their chain."""
    words = dict(license_scan.NOTICES)["mpl-2"].split()
    grams = [words[i : i + 3] for i in range(len(words) - 2)]
    back = " ".join(" ".join(g) for g in reversed(grams))
    d = spark.createDataFrame([(1, back), (2, " ".join(" ".join([*words[i : i + 4], "x"]) for i in range(0, len(words), 4))), (3, ("so " + " ".join(words) + " and ") * 3)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.label(d).collect()}
    assert out[1]["labels"] == "" and out[1]["score"] < 0.5 and out[2]["score"] < 0.8 and out[3]["labels"] == "mpl-2"
    assert sorted(r["first_word"] for r in license_scan.places(d).collect()) == [1, len(words) + 3, 2 * len(words) + 5]


def test_long_text_takes_time_in_proportion(spark):
    """No k-gram carries its text: a text of 320,000 words goes through, places and all."""
    t = prose(1, 320_000) + " under the MIT license"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    same(license_scan.label(d), [(1, *licenses_of(t))], "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def urls_of(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = ascii_lower(re.split("[/?#]", rest, maxsplit=1)[0])
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for text, action in url_filters.SITE_RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, action)
    if best:
        return host, path, *best
    bad = any(re.search(p, host + path) for _, p, _ in url_filters.WORD_RULES)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "nothing", "http://", "http://EXAMPLE.com/en/7", "http://a.example.com/en/71?x=/de/", "http://example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://b.net/de/8",
    "http://x.example.net/de/8#y", "http://notexample.net/de/8", "http://q.org/es/", "http://q.org/ES/", "https://my-casino.io/a", "https://casinox.io", "ftp://free-bets.io/z", "http://h:80/de/",
    "http://a://b.net/de/1", "http://a.net\n/de/1",
]


@pytest.mark.parametrize("block", [url_filters.BLOCK_RULES, 3])
def test_urls(spark, monkeypatch, block):
    d = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, None, "h", "r"), (None, URLS[4], "h", "r")], "page_id long, url string, host string, rule string")
    want = [(i, *urls_of(u)) for i, u in [*enumerate(URLS), (0, None), (None, URLS[4])]]
    monkeypatch.setattr(url_filters, "BLOCK_RULES", block)
    same(url_filters.judge(d), want, "page_id", "host", "path", "rule", "verdict")
    assert url_filters.judge(d.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filters.judge(d, []).collect()} == {"allow"}


def test_urls_with_plurals_and_capitals(spark):
    urls = ["https://best-casinos.io/a", "http://casinos.io/casino", "http://a.b/BIGpoker", "http://a.b/pokerX", "http://a.b/POKER", "http://a.b/xCasinos", "http://a.b/Xcasinos", "http://a.b/casinosx"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [(i, *urls_of(u)) for i, u in enumerate(urls)]
    assert [w[4] for w in want] == ["block"] * 4 + ["allow"] * 2 + ["block", "allow"]
    out = url_filters.judge(d)
    same(out, want, "page_id", "host", "path", "rule", "verdict")
    assert {r["page_id"]: r["n_candidates"] for r in out.collect()}[1] == 1


@pytest.mark.parametrize("block", [url_filters.BLOCK_RULES, 1_500])
def test_many_rules_and_a_token_that_all_share(spark, monkeypatch, block):
    """5,000 site rules from a table, 3,000 of them under one host, against brute force; every URL holds the hosts' tokens."""
    sites = [(f"shop.com/{w}/{i}", "block" if i % 3 else "allow") for i in range(3000) for w in ("a",)] + [(f"s{i}.org/x/", "block" if i % 2 else "allow") for i in range(2000)]
    rules = [url_filters.site_rule(t, a) for t, a in sites]
    urls = [f"http://{'www.' * (i % 2)}shop.com/a/{i * 7 % 4000}" for i in range(300)] + [f"http://s{i * 11 % 2500}.org/{'x/' * (i % 3)}y" for i in range(300)] + ["http://" + "long-path/" * 5000 + "shop.com"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(url_filters, "BLOCK_RULES", block)
    want = []
    for i, u in enumerate(urls):
        h, path = u.split("://")[1].split("/", 1)
        fit = [(len(t), t, a) for t, a in sites for rh, rp in [t.split("/", 1)] if (h == rh or h.endswith("." + rh)) and path.startswith(rp)]
        want.append((i, h, "/" + path, *(max(fit)[1:] if fit else (None, "allow"))))
    assert sum(w[3] is not None for w in want) > 200
    same(url_filters.judge(d, url_filters.rule_table(spark, rules)), want, "page_id", "host", "path", "rule", "verdict")


def test_only_candidates_run(spark):
    d = spark.createDataFrame([(1, "http://q.org/fr/1"), (2, "http://q.org/es/1")], "page_id long, url string")
    assert {r["page_id"]: r["n_candidates"] for r in url_filters.judge(d).collect()} == {1: 0, 2: 1}
