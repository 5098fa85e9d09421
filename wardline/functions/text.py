"""Text functions: native column expressions, and Arrow UDFs where Spark has none."""

from __future__ import annotations

import base64
import html
import re
import unicodedata
from collections import deque
from functools import wraps
from urllib.parse import unquote_plus

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as R

MAX_VARIANTS, MAX_DEPTH = 24, 1


def once(build):
    """Keeps what ``build`` makes of names and numbers: expressions that name their columns, so that every query of the process can use them.

    A large expression takes seconds to build, a call to the JVM for each node.
    """
    kept: dict = {}

    @wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def each_hit(rows: Column):
    """Explodes the entries of an array that are not null, as ``h``: the outer form, since for the inner one the optimiser adds a
    test that the array has entries, and so works it out twice. Nulls go in a filter after it."""
    return F.explode_outer(F.filter(rows, lambda h: h.isNotNull()))


def normalize_native(text: Column) -> Column:
    """Look-alikes to Latin, invisible characters to spaces, white space collapsed, lower case. No NFKC, no entities."""
    mapped = F.translate(text, R.LOOKALIKES + R.INVISIBLE, R.STANDS_FOR + " " * len(R.INVISIBLE))
    return F.lower(F.trim(F.regexp_replace(mapped, r"(?U)\s+", " ")))


# ---- what Spark has no function for


_MAP = str.maketrans(R.LOOKALIKES + R.INVISIBLE, R.STANDS_FOR + " " * len(R.INVISIBLE))
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_B64 = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
_HEX = re.compile(r"(?:0x)?((?:[0-9a-fA-F]{2}){12,})")
_PERCENT = re.compile(r"%[0-9a-fA-F]{2}")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)


def normalize(text: str) -> str:
    whole = unicodedata.normalize("NFKC", unescape(html.unescape(text))).translate(_MAP)
    return " ".join(whole.split()).lower()


def printable_ratio(text: str) -> float:
    return sum(c.isprintable() for c in text) / len(text) if text else 0.0


def _readable(raw: bytes) -> str | None:
    text = raw.decode("utf-8", "ignore").strip()
    return text if len(text) >= 12 and printable_ratio(text) >= 0.85 else None


def decode_base64(token: str) -> str | None:
    token = token.strip()
    if len(token) < 20:
        return None
    try:
        return _readable(base64.b64decode(token + "=" * (-len(token) % 4), validate=True))
    except ValueError:
        return None


def decode_hex(token: str) -> str | None:
    m = _HEX.fullmatch(token.strip())
    return _readable(bytes.fromhex(m[1])) if m else None


def decode_url(text: str) -> str:
    return unquote_plus(text) if _PERCENT.search(text) else text


#: Whole-text decoders, whose results are decoded again, and token decoders, whose results are not.
_WHOLE = (("html", html.unescape), ("unicode_escape", unescape), ("url_decode", decode_url))
_TOKENS = (("base64", _B64, decode_base64), ("hex", _HEX, decode_hex))


def variants(text: str) -> list[tuple[str, str]]:
    """The text and what decoders make of it, breadth first, at most ``MAX_VARIANTS``: (label, text)."""
    found = {text: "raw"}  # in order; a text keeps its first label
    queue = deque([(text, 0)])

    def derived(value: str, depth: int):
        for name, decode in _WHOLE:
            yield name, decode(value), depth + 1
        for name, token, decode in _TOKENS:
            for m in token.finditer(value):
                yield name, decode(m[0]), None

    while queue and len(found) < MAX_VARIANTS:
        value, depth = queue.popleft()
        for name, new, below in derived(value, depth):
            if len(found) >= MAX_VARIANTS:
                break
            if new is not None and new not in found:
                found[new] = f"{found[value]}>{name}"
                if below is not None and below <= MAX_DEPTH:
                    queue.append((new, below))
    return [(label, value) for value, label in found.items()]


def plain_base64(text: str) -> tuple[int, int] | None:
    """Where a long base64 token that decodes to ASCII text stands. Only the first token counts."""
    m = re.search(R.LONG_BASE64, text, re.IGNORECASE)
    decoded = decode_base64(m[0]) if m else None
    if decoded is None or sum(" " <= c <= "~" for c in decoded) < 0.98 * len(decoded):
        return None
    return m.span()


# Type objects, not strings: workers import this module, and parsing a string needs a session.
VARIANT = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("ord", T.IntegerType()), ("label", T.StringType()), ("norm", T.StringType()), ("b64_from", T.IntegerType()), ("b64_to", T.IntegerType()))]))


@F.pandas_udf(VARIANT)
def variants_udf(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        out = []
        for i, (label, value) in enumerate(variants(text)):
            norm = normalize(value)
            at = plain_base64(norm)
            out.append({"ord": i, "label": label, "norm": norm, "b64_from": at and at[0], "b64_to": at and at[1]})
        return out

    return texts.map(one)


#: No decoder changes a text of ASCII characters without these: ``&``, ``\\``, ``%``, twenty characters that base64 or hex may be made of, or the
#: separators that Python takes for white space and Java does not.
_PLAIN = r"^[\x00-\x1B\x20-\x7F]*$"
_MAY_DECODE = r"[&\\%]|[A-Za-z0-9+/]{20}"


def is_plain(text: Column) -> Column:
    """Whether the text is its only variant, and normalised by lower case and white space alone."""
    return F.rlike(text, F.lit(_PLAIN)) & ~F.rlike(text, F.lit(_MAY_DECODE))


def variants_of(text: Column) -> Column:
    """``variants_udf``, with texts that no decoder changes kept from Python, to which they are nulls."""
    none = F.lit(None).cast("int")
    norm = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    own = F.array(F.struct(F.lit(0).alias("ord"), F.lit("raw").alias("label"), norm.alias("norm"), none.alias("b64_from"), none.alias("b64_to")))
    plain = is_plain(text)
    return F.when(plain, own).otherwise(variants_udf(F.when(~plain, text)))


@F.pandas_udf(T.StringType())
def package_name_udf(names: pd.Series) -> pd.Series:
    """Names as compared: accents split off, other non-ASCII dropped, lower case, hyphens."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode().lower().replace("_", "-"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def schema_strings_udf(schemas: pd.Series) -> pd.Series:
    """Strings under default, example or description at any depth of a JSON schema."""
    import json

    def walk(node):
        if isinstance(node, dict):
            for k, v in node.items():
                if isinstance(v, str) and k in ("default", "example", "description"):
                    yield v
                else:
                    yield from walk(v)
        elif isinstance(node, list):
            for v in node:
                yield from walk(v)

    def one(text):
        try:
            return None if text is None else list(walk(json.loads(text)))
        except ValueError:
            return []

    return schemas.map(one)


# ---- native


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit("([a-z0-9_]+)"), F.lit(1))


def near(toks: Column, first: tuple[str, ...], second: tuple[str, ...], window: int) -> Column:
    """Whether a term of each list stand at most ``window`` tokens apart."""

    def places(terms):
        return F.filter(F.transform(toks, lambda t, i: F.when(t.isin(*terms), i)), lambda i: i.isNotNull())

    return let(places(second), lambda b: F.exists(places(first), lambda x: F.exists(b, lambda y: F.abs(x - y) <= window)))


def near_terms(norm: Column, first: tuple[str, ...], second: tuple[str, ...], window: int) -> Column:
    """``near`` on the tokens of a text; texts without the letters of both lists are not cut into tokens."""
    return any_phrase(norm, first) & any_phrase(norm, second) & near(tokens(norm), first, second, window)


def constants(words: tuple[str, ...]) -> Column:
    """Words as an array that the optimiser folds into one constant, however long the list."""
    return F.split(F.lit("\n".join(words)), "\n")


def any_phrase(norm: Column, phrases: tuple[str, ...]) -> Column:
    return norm.contains(phrases[0]) if len(phrases) == 1 else F.exists(constants(phrases), lambda p: F.contains(norm, p))


def intent(norm: Column, rule: str) -> Column:
    """The intent template of one rule, with only the parts that it needs."""
    override = lambda: near_terms(norm, R.OVERRIDE_TERMS, R.AUTHORITY_TERMS, R.OVERRIDE_WINDOW)
    role = lambda: any_phrase(norm, R.ROLE_PHRASES)
    exfil = lambda: near_terms(norm, R.EXFIL_TERMS, R.SECRET_TERMS, R.EXFIL_WINDOW)
    stealth = lambda: any_phrase(norm, R.STEALTH_PHRASES) & (override() | role() | exfil())
    return {"PI-001": override, "PI-002": role, "PI-004": exfil, "PI-008": stealth}[rule]()


def intents(norm: Column) -> dict[str, Column]:
    """The intent templates by rule."""
    return {rule: intent(norm, rule) for rule in TEMPLATE_NAMES}


@once
def intents_of(name: str) -> dict[str, Column]:
    """``intents`` of the column of this name."""
    return intents(F.col(name))


TEMPLATE_NAMES = {"PI-001": "override_authority_template", "PI-002": "role_reassignment_template", "PI-004": "secret_exfil_template", "PI-008": "stealth_instruction_template"}


def multiplier(norm: Column, label: Column) -> Column:
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    return F.least(
        F.lit(1.35),
        F.lit(1.0)
        + add(any_phrase(norm, R.AUTHORITY_MARKERS), 0.08)
        + add(any_phrase(norm, R.STEALTH_PHRASES), 0.14)
        + add(any_phrase(norm, ("primary directive", "must ")), 0.05)
        + add(any_phrase(label, ("base64", "hex", "url_decode", "unicode_escape")), 0.12),
    )


def window_around(norm: Column, start: Column, length: Column, reach: int = 80) -> Column:
    """What stands around a match at 1-based ``start``, trimmed."""
    left = F.greatest(F.lit(1), start - reach)
    return F.trim(F.substring(norm, left, (start + length + reach - left).cast("int")))


def entropy_chars(text: Column) -> Column:
    """Shannon entropy in bits a character, 0 for an empty text."""

    def of(symbols: Column) -> Column:
        n = F.length(text)
        share = F.transform(symbols, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
        return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    # A look through the text for each symbol, if they are few; sorted symbols otherwise.
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return let(chars, lambda all_: let(F.array_distinct(all_), lambda own: F.when(F.size(own) <= 128, of(own)).otherwise(_entropy(all_))))


def entropy_bytes(text: Column) -> Column:
    """Shannon entropy in bits a byte of the UTF-8 form, to four places."""
    return F.round(_entropy(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))), 4)


def _entropy(symbols: Column) -> Column:
    def of(sorted_symbols: Column) -> Column:
        n = F.size(sorted_symbols)
        # run lengths of the sorted symbols: positions where a symbol begins
        begins = F.filter(F.transform(sorted_symbols, lambda s, i: F.when((i == 0) | (s != F.get(sorted_symbols, i - 1)), i)), lambda i: i.isNotNull())
        return F.when(n == 0, F.lit(0.0)).otherwise(
            let(
                begins,
                lambda b: F.aggregate(
                    F.transform(b, lambda x, i: (F.coalesce(F.get(b, i + 1), n) - x) / n),
                    F.lit(0.0),
                    lambda acc, p: acc - p * F.log2(p),
                ),
            )
        )

    return let(F.array_sort(symbols), of)


def github_raw(url: Column) -> Column:
    """Pages of a repository to the raw file behind them; other addresses as they are."""
    blob, root = r"^https://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)", r"^https://github\.com/([^/]+)/([^/]+)/?$"
    return (
        F.when(F.rlike(url, F.lit(blob)), F.regexp_replace(url, blob + ".*", "https://raw.githubusercontent.com/$1/$2/$3/$4"))
        .when(F.rlike(url, F.lit(root)), F.regexp_replace(url, root, "https://raw.githubusercontent.com/$1/$2/main/README.md"))
        .otherwise(url)
    )
