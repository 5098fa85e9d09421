"""Version keys: strings whose plain order is the order of versions, so that a range of versions is a range of strings.

Two schemes: that of Python packages (epochs, pre-, post- and development releases, local labels) and semantic versions.
A key is made of native expressions. Numbers of any length are written behind the number of their digits; a part that ends is marked
with ``!``, which sorts below everything that can follow it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

END = "!"
#: A version of the Python scheme; the groups are epoch, release, pre-release letter and number, post-release (two spellings), development release, local label.
_PYTHON = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_SEMANTIC = r"^\s*[vV]?(\d+(?:\.\d+)*)(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+.*)?\s*$"
#: Spellings of the phases before a release, by rank.
_PHASES = {"1": ("a", "alpha"), "2": ("b", "beta"), "3": ("c", "rc", "pre", "preview")}


def _number(digits: Column) -> Column:
    """A number as text that sorts as the number; no digits count as 0."""
    bare = F.regexp_replace(F.concat(F.lit("0"), digits), r"^0+(?=\d)", "")
    return let(bare, lambda n: F.concat(F.lpad(F.length(n).cast("string"), 3, "0"), n))


def _release(release: Column) -> Column:
    """Trailing zeros do not count: 1.0 is 1."""
    short = F.regexp_replace(release, r"(\.0+)+$", "")
    return F.concat(F.array_join(F.transform(F.split(short, r"\."), _number), "."), F.lit(END))


def python_key(version: Column) -> Column:
    """The key of a Python package version, or null for what is none."""

    def of(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v, _PYTHON, i)
        phase, post, dev, local = part(3), (part(5) != "") | (part(6) != ""), part(8) != "", part(10)
        rank = F.lit("")
        for r, names in _PHASES.items():
            rank = F.when(phase.isin(*names), r).otherwise(rank)
        pre = F.when(phase != "", F.concat(rank, _number(part(4)))).when(dev & ~post, F.lit("0")).otherwise(F.lit("4"))
        after = F.when(post, F.concat(F.lit("1"), _number(F.concat(part(5), part(7))))).otherwise(F.lit("0"))
        before = F.when(dev, F.concat(F.lit("0"), _number(part(9)))).otherwise(F.lit("1"))
        each = F.transform(F.split(local, "[-_.]"), lambda s: F.when(F.rlike(s, F.lit(r"^\d+$")), F.concat(F.lit("2"), _number(s))).otherwise(F.concat(F.lit("1"), s, F.lit(END))))
        label = F.when(local != "", F.concat(F.lit("1"), F.array_join(each, ""), F.lit(END))).otherwise(F.lit("0"))
        return F.when(F.rlike(v, F.lit(_PYTHON)), F.concat(_number(part(1)), F.lit(":"), _release(part(2)), pre, after, before, label))

    return let(F.lower(version), of)


def semantic_key(version: Column) -> Column:
    """The key of a semantic version, or null for what is none. Build labels do not count; a missing number is 0, the case of labels does."""

    def of(v: Column) -> Column:
        pre = F.regexp_extract(v, _SEMANTIC, 2)
        each = F.transform(F.split(pre, r"\."), lambda s: F.when(F.rlike(s, F.lit(r"^\d+$")), F.concat(F.lit("1"), _number(s))).otherwise(F.concat(F.lit("2"), s, F.lit(END))))
        tail = F.when(pre != "", F.concat(F.lit("0"), F.array_join(each, ""), F.lit(END))).otherwise(F.lit("4"))
        return F.when(F.rlike(v, F.lit(_SEMANTIC)), F.concat(_number(F.lit("")), F.lit(":"), _release(F.regexp_extract(v, _SEMANTIC, 1)), tail))

    return let(version, of)


def key(ecosystem: Column, version: Column) -> Column:
    """By the ecosystem's scheme, as advisories name ecosystems; a version that fits no scheme is a key of its own, equal to itself only."""
    k = F.when(ecosystem == "PyPI", python_key(version)).otherwise(semantic_key(version))
    return F.when(version.isNotNull(), F.coalesce(k, F.concat(F.lit("?"), F.trim(version))))


def ordered(k: Column) -> Column:
    """Whether a key has a place in the order."""
    return ~F.startswith(k, F.lit("?"))


def within(k: Column, introduced: Column, fixed: Column, last_affected: Column) -> Column:
    """Whether a key lies in a range of keys: from ``introduced`` (null: the first version) to before ``fixed`` and up to ``last_affected`` (null: no end)."""
    above = introduced.isNull() | (k >= introduced)
    below = (fixed.isNull() | (k < fixed)) & (last_affected.isNull() | (k <= last_affected))
    return ordered(k) & above & below
