"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for a document. The ledger keeps the measurements and one failure
bit a rule; policies are masks over those bits, so a new policy version or an ablation reads
the ledger and never the text again.

Defined cases: a null or empty text has no words and fails ``few_words``; a null doc_id stays
null; identical rows give identical rows; an empty table gives an empty ledger; other columns
of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_RE, id_and_text, let, split_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Bit of each rule in ``fail_bits``; bits are never reused for another rule.
BITS = {"few_words": 0, "repeated_windows": 1, "symbol_heavy": 2, "repeated_lines": 3, "long_words": 4, "shouting": 5}
#: Policies by version: a document is kept when none of the policy's rules failed. ``base`` is the contract's.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_heavy"),
    "v2": ("few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "long_words", "shouting"),
}
PRODUCTION = "v2"


def mask(policy: str) -> int:
    return sum(1 << BITS[r] for r in POLICIES[policy])


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of eight words that occur at least twice in the text; equal hashes are verified on the words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda p: F.array_sort(
                F.array_distinct(F.flatten(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.when((a.h == b.h) & (F.slice(words, a.i + 1, WINDOW) == F.slice(words, b.i + 1, WINDOW)), F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))))
            ),
        )
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, s: F.struct((s + WINDOW).alias("end"), (acc.n + F.least(F.lit(WINDOW), s + WINDOW - acc.end)).alias("n"))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.aggregate(starts, zero, step, lambda acc: acc.n))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, measurements, ``fail_bits``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    live = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    size = lambda c: F.size(c).cast("long")
    measures = let(
        F.struct(split_words(text, WS_RE).alias("words"), live.alias("live"), bare.alias("bare")),
        lambda r: F.struct(
            size(r.words).alias("n_words"),
            F.length(r.bare).cast("long").alias("word_chars"),
            (F.length(r.bare) - F.length(F.translate(r.bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (size(r.live) - size(F.array_distinct(r.live))).alias("n_dup_lines"),
            _repeat_words(r.words).cast("long").alias("n_repeat_words"),
            size(r.live).alias("n_lines"),
            (F.length(r.bare) - F.length(F.translate(r.bare, "!", ""))).cast("long").alias("n_bangs"),
        ),
    )
    m = id_and_text(docs, id_col, text_col).select("doc_id", measures.alias("m")).select("doc_id", "m.*")
    failed = {
        "few_words": F.col("n_words") < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbol_heavy": 4 * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": (2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_lines") >= 4),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
        "shouting": 4 * F.col("n_bangs") > F.col("n_words"),
    }
    bits = F.lit(0).cast("long")
    for rule, bit in BITS.items():
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return m.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. The base rules hold under every policy."""
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return led.withColumn("base_failed", hit(mask("base"))).withColumn("kept", ~hit(mask(policy) | mask("base")))


def ablation(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it fails (kept if the rule went)."""
    whole = mask(policy)
    aggs = []
    for rule in POLICIES[policy]:
        bit = 1 << BITS[rule]
        aggs.append(F.count_if(F.col("fail_bits").bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"{rule}__fails"))
        aggs.append(F.count_if(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")) == F.lit(bit)).alias(f"{rule}__alone"))
    one = led.agg(F.bit_or("fail_bits").alias("any_bits"), F.count(F.lit(1)).alias("n_docs"), *aggs)
    rows = [F.struct(F.lit(r).alias("rule"), F.col("n_docs"), F.col(f"{r}__fails").alias("n_fails"), F.col(f"{r}__alone").alias("n_alone")) for r in POLICIES[policy]]
    return one.select(F.inline(F.array(*rows)))
