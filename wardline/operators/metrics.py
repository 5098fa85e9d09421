"""Evaluation: expected labels against verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECALL, PRECISION = 0.90, 0.85


def cell(expected: Column, actual: Column) -> Column:
    """TP, FN, FP or TN; null for labels outside BLOCK, WARN and SAFE, and for scans that failed."""
    bad = lambda c: c.isin("BLOCK", "WARN")
    return (
        F.when(bad(expected) & bad(actual), "TP")
        .when(bad(expected) & (actual == "SAFE"), "FN")
        .when((expected == "SAFE") & bad(actual), "FP")
        .when((expected == "SAFE") & (actual == "SAFE"), "TN")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def _counts() -> list[Column]:
    return [F.count_if(F.col("cell") == c).alias(c.lower()) for c in ("TP", "FP", "FN", "TN")]


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return df.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), _ratio(fp, fp + tn).alias("fpr"))


def confusion(results: DataFrame) -> DataFrame:
    """(expected_verdict, verdict) rows to one row of counts and rates."""
    r = results.withColumn("cell", cell(F.col("expected_verdict"), F.col("verdict")))
    return _rates(r.agg(*_counts(), F.count_if(F.col("cell").isNull()).alias("n_unlabeled")))


def by_vector(results: DataFrame) -> DataFrame:
    """The same for each expected attack vector; true negatives do not count there."""
    r = results.withColumn("cell", F.nullif(cell(F.col("expected_verdict"), F.col("verdict")), F.lit("TN"))).withColumn("vector", F.explode("attack_vectors"))
    return _rates(r.where("cell IS NOT NULL").groupBy("vector").agg(*_counts())).select("vector", "tp", "fp", "fn", "precision", "recall", "f1")


def passes(metrics: DataFrame) -> DataFrame:
    """Whether precision and recall reach the gate."""
    return metrics.select((F.col("recall") >= RECALL).alias("recall_ok"), (F.col("precision") >= PRECISION).alias("precision_ok"))


#: Shares asked for, and the error of the sketch that brackets them.
_SHARES, _ACCURACY = {"p50": 0.50, "p95": 0.95, "p99": 0.99}, 20_000


def index_percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """p50, p95 and p99 as elements of the sorted values, at n // 2, int(.95 n) and min(int(.99 n), n - 1).

    A sketch brackets each share by two cuts, which deal a key's values to seven zones. Exact counts of the zones
    tell where an element stands, and only the values of its zone are ranked: a ten-thousandth of a key, as a rule.
    A poor sketch makes a zone larger and no result wrong. Equal values are counted before they are shuffled.
    """
    rows = df.select(F.struct(*keys).alias("k"), F.col(value).alias("v"))
    around = [p + side * 2 / _ACCURACY for p in _SHARES.values() for side in (-1, 1)]
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", around, _ACCURACY).alias("cuts"))
    seen = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    zone = F.size(F.filter(F.coalesce("cuts", F.array()), lambda x: x < F.col("v")))  # nulls come first
    zoned = seen.join(per.select("k", "cuts"), "k").select("k", "v", "c", zone.alias("zone"))
    in_order = Window.partitionBy("k").orderBy("zone")  # seven rows a key at most
    zones = zoned.groupBy("k", "zone").agg(F.sum("c").alias("size")).withColumn("before", F.sum("size").over(in_order) - F.col("size"))
    at = {"p50": F.expr("n div 2"), "p95": F.floor(F.lit(_SHARES["p95"]) * F.col("n")), "p99": F.least(F.floor(F.lit(_SHARES["p99"]) * F.col("n")), F.col("n") - 1)}
    asked = per.select("k", "n", F.inline(F.array(*[F.struct(F.lit(p).alias("share"), i.alias("i")) for p, i in at.items()])))
    found = asked.join(zones, "k").where((F.col("before") <= F.col("i")) & (F.col("i") < F.col("before") + F.col("size")))
    ranked = zoned.join(found, ["k", "zone"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("k", "share").orderBy("v")))
    one = ranked.where((F.col("upto") > F.col("i")) & (F.col("upto") - F.col("c") <= F.col("i")))
    return one.groupBy("k").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("share") == p, F.col("v"))).alias(p) for p in _SHARES]).select("k.*", "n", *_SHARES)


def caught_by(l1: Column, fused: Column) -> Column:
    return F.when(l1 == "BLOCK", "L1").when(fused == "BLOCK", "L2").when(l1 == "WARN", "L1 (WARN)").when(fused == "WARN", "L2 (WARN)").otherwise("EVADED")


def judged_right(expected: Column, got: Column) -> Column:
    """A judge's verdict counts as right if equal, or SUSPICIOUS where MALICIOUS was expected."""
    return (expected == got) | ((expected == "MALICIOUS") & (got == "SUSPICIOUS"))


def by_category(results: DataFrame) -> DataFrame:
    """(category, total, caught, rate) of (category, caught_by): what did not evade and did not fail, which a null says as well."""
    got = ~F.coalesce("caught_by", F.lit("ERROR")).isin("EVADED", "ERROR", "?")
    return results.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(got).alias("caught")).withColumn("rate", F.round(F.col("caught") / F.col("total"), 6))


def judge_accuracy(results: DataFrame) -> DataFrame:
    """(n, n_right, accuracy) of (expected, judge_verdict); a reply without a verdict is wrong."""
    right = F.coalesce(judged_right(F.col("expected"), F.col("judge_verdict")), F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right")).withColumn("accuracy", F.round(F.try_divide("n_right", "n"), 6))


def risk_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and vector with subtotals (an extra over plain histograms)."""
    return findings.rollup("severity", "attack_vector").agg(F.count(F.lit(1)).alias("n_findings"))
