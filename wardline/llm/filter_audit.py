"""Interaction audit of filters: what each removes under every order in which they can be applied.

Each document's flags are crossed with the 120 orders of five filters (a broadcast side of fixed size), five steps are
exploded, and the first failing step decides what each step does to the document; counts are summed within tasks before
they are shuffled. Copies of a text are found by hash with map-side minima; hot texts are looked up by broadcast.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * upper-case ASCII letters > 5 * code points; D any of
``#$%&*|``; E the text is identical to that of a smaller doc_id, removed or not. A null text is empty. A row without a
doc_id is larger than none, so E never fits it, and it has no labels. Several label rows of a document count together: it is good if one says
quality 1, toxic if one says toxic 1. Repeated rows count each; rows of one doc_id are no copies of one another by E.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, UPPER, WS_RE, checkpointed, let, look_up, split_words

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 50, 65, 5, "#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_bits(text: Column) -> Column:
    """Failures of the filters that look at one text: bit 0 is A."""
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    symbols = F.lit(False)
    for c in SYMBOLS:
        symbols = symbols | F.contains(text, F.lit(c))
    by_words = let(split_words(text, WS_RE), lambda w: (F.size(w) < MIN_WORDS).cast("int") + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PCT * F.size(w), 2).otherwise(0))
    return by_words + F.when(100 * upper > MAX_UPPER_PCT * F.length(text), 4).otherwise(0) + F.when(symbols, 8).otherwise(0)


def flagged(docs: DataFrame, labels: DataFrame, most: int = BROADCAST_ROWS, id_col: str = "doc_id") -> DataFrame:
    """(part, bits, good, toxic) of every document; texts are read once and not shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = checkpointed(rows.select("doc_id", "part", F.sha2(F.col("t").cast("binary"), 256).alias("text_key"), text_bits(F.col("t")).alias("bits")))
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    out = look_up(named, checkpointed(first.where("first_id < last_id").drop("last_id")), "text_key", "first_id", ["doc_id"], most)
    out = out.select("doc_id", "part", (F.col("bits") + F.when(F.col("first_id") < F.col("doc_id"), 16).otherwise(0)).alias("bits"))
    has = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(has("quality"), has("toxic"))
    # Rows without an id are no copies by E and meet no label: they take no part in the joins.
    told = out.join(known, "doc_id", "left").unionByName(rows.where("doc_id IS NULL").drop("text_key"), allowMissingColumns=True)
    return told.select("part", "bits", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(spark) -> DataFrame:
    """(filter_order, bit_at): every order, with the flag bit of the filter at each step."""
    return spark.createDataFrame([("".join(p), [1 << FILTERS.index(f) for f in p]) for p in permutations(FILTERS)], "filter_order string, bit_at array<int>")


def replay(flags: DataFrame) -> DataFrame:
    """(part, bits, good, toxic) to counts of documents by (part, filter_order, step)."""
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession)))
    never = len(FILTERS) + 1
    fails = lambda k: (F.col("bits").bitwiseAND(F.col("bit_at")[k - 1])) != 0
    first = F.lit(never)
    for k in range(len(FILTERS), 0, -1):
        first = F.when(fails(k), k).otherwise(first)
    steps = crossed.select("part", "filter_order", "bit_at", "bits", "good", "toxic", first.alias("first")).withColumn("step", F.explode(F.array(*[F.lit(k) for k in range(1, never)])))
    bit = F.col("bit_at")[F.col("step") - 1]
    removed = F.col("first") == F.col("step")
    conditions = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": (F.col("bits").bitwiseAND(bit) != 0) & (F.col("first") < F.col("step")),
        "unique_fails": F.col("bits") == bit,
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    counts = steps.groupBy("part", "filter_order", "step").agg(*[F.sum(F.when(conditions[c], 1).otherwise(0)).cast("long").alias(c) for c in COUNTS])
    # 600 rows a part from here on.
    at = F.substring("filter_order", F.col("step"), F.lit(1))
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", at)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return replay(flagged(docs, labels)).select("part", "filter_order", "step", *COUNTS, "shapley")
