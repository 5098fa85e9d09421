"""Helpers of these tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, score string, fp string, __id string"
WORDS = "the of and ember lantern quarry willow drift copper fathom ridge marrow thistle harbor violet summit ochre plume gravel meadow hollow".split()


def rows(texts, first=0):
    return [(i + first, t, "en", "s", None if t is None else len(t), "r", "w", "x", "f", "i") for i, t in enumerate(texts)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


def same(df, want, *cols):
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)
