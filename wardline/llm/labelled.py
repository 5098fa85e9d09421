"""Bounded samples of labelled rows for fitting, and joins that check a side's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have: two longs each.
BROADCAST_ROWS = 1_000_000


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id has no remainder: it is nobody's training row and is not held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def join_checked(left: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts ``small`` if it has at most ``limit`` rows, and shuffles otherwise."""
    few = small.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(small) if few else small, on, how)


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y), an id once: labels other than 0 and 1 and null ids go, and of conflicting ones 1 stays."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def fit_ids(labels: DataFrame, label: str, train: Column, per_class: int) -> tuple[DataFrame, float]:
    """At most ``per_class`` ids of each class in the order of a hash, with the share of ones among all training labels."""
    one = one_label(labels, label).where(train)
    n, ones = one.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [one.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), (float(ones) + 0.5) / (float(n) + 1.0)
