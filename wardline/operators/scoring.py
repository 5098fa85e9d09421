"""Dedup, scores, verdicts and the fusion of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from . import judge, traces

BLOCK, WARN, SLOPE, TOP = 0.75, 0.35, 1.2, 10


def enrich(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity, vector, rationale and remediation from the rule dimension, where a finding has none of its own."""
    r = rules.select("rule_id", F.col("severity").alias("r_sev"), F.col("attack_vector").alias("r_vec"), F.col("rationale").alias("r_why"), "remediation")
    out = findings.join(F.broadcast(r), "rule_id", "left")
    return out.withColumns({"severity": F.coalesce("severity", "r_sev"), "attack_vector": F.coalesce("attack_vector", "r_vec"), "rationale": F.coalesce("rationale", "r_why")}).drop("r_sev", "r_vec", "r_why")


def dedup(findings: DataFrame) -> DataFrame:
    """The first finding of each rule, place and snippet in a skill; the field's name is no part of the key, and nulls are alike.

    A window, since repeats are few: an aggregate that combines before the shuffle sorts twice and took a third longer. A
    group is what one skill's own fields repeat.
    """
    w = Window.partitionBy("skill_id", "rule_id", "file_path", "line_number", "snippet").orderBy("ord")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def weight(severity: Column) -> Column:
    out = F.lit(0.0)
    for s, w in R.SEVERITY_WEIGHT.items():
        out = F.when(severity == s, w).otherwise(out)
    return out


def rank(severity: Column) -> Column:
    out = F.lit(0)
    for s, n in R.SEVERITY_RANK.items():
        out = F.when(severity == s, n).otherwise(out)
    return out


def score(weighted: Column, bonus: Column) -> Column:
    return F.round(1.0 - F.exp(-SLOPE * (weighted + bonus)), 4)


def verdict(critical: Column, fused: Column) -> Column:
    return F.when(critical | (fused >= BLOCK), "BLOCK").when(fused >= WARN, "WARN").otherwise("SAFE")


def confidence(fused: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.55), 0.55 + 0.4 * fused))


def summary(findings: DataFrame) -> DataFrame:
    """(skill_id, layer) to weighted sum, counts and the highest severity. Partial sums before the one shuffle.

    Weights are multiples of 0.1 and confidences are rounded, so sums do not depend on order beyond rounding.
    """
    return findings.groupBy("skill_id", "layer").agg(
        F.sum(weight(F.col("severity")) * F.col("confidence")).alias("weighted"),
        F.count(F.lit(1)).alias("n_findings"),
        F.max(rank(F.col("severity"))).alias("top"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("critical"),
        F.bool_or(F.col("rule_id") == "PI-003").alias("invisible_unicode_detected"),
    )


def severity_name(n: Column) -> Column:
    out = F.lit("INFO")
    for s, k in R.SEVERITY_RANK.items():
        out = F.when(n == k, s).otherwise(out)
    return out


def layer1(skills: DataFrame, findings: DataFrame, flags: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """A row a skill: score, highest severity, flags of its code and counts of its dependencies (``deps.counts``)."""
    s = skills.select("skill_id").join(summary(findings).where("layer = 1").drop("layer"), "skill_id", "left")
    for more in (flags, counts):
        s = s.join(more, "skill_id", "left") if more is not None else s
    had = set(s.columns)
    flag = ("dynamic_import_detected", "subprocess_in_tool_body", "undeclared_network_access", "critical", "invisible_unicode_detected")
    count = ("n_findings", "typosquat_count", "advisory_count")
    s = s.withColumns({c: F.coalesce(c, F.lit(False)) if c in had else F.lit(False) for c in flag} | {c: (F.coalesce(c, F.lit(0)) if c in had else F.lit(0)).cast("long") for c in count})
    bonus = F.when(F.col("invisible_unicode_detected"), 2.0).otherwise(0.0) + F.when(F.col("subprocess_in_tool_body") & F.col("undeclared_network_access"), 1.5).otherwise(0.0)
    return s.withColumns({"l1_score": score(F.coalesce("weighted", F.lit(0.0)), bonus), "highest_severity": severity_name(F.coalesce("top", F.lit(0)))}).drop("weighted", "top")


def layer2(skills: DataFrame, findings: DataFrame, replies: DataFrame) -> DataFrame:
    """``replies``: rows of ``judge.layer`` with permission_delta_critical."""
    s = replies.join(summary(findings).where("layer = 2").select("skill_id", "weighted", F.col("critical").alias("l2_critical")), "skill_id", "left")
    return s.withColumn("l2_score", score(F.coalesce("weighted", F.lit(0.0)), judge.bonus())).withColumn("l2_critical", F.coalesce("l2_critical", F.lit(False))).drop("weighted")


def layer3(trace_rows: DataFrame, findings: DataFrame) -> DataFrame:
    s = trace_rows.join(summary(findings).where("layer = 3").select("skill_id", "weighted", F.col("critical").alias("l3_critical")), "skill_id", "left")
    return s.select("skill_id", score(F.coalesce("weighted", F.lit(0.0)), traces.bonus()).alias("l3_score"), F.coalesce("l3_critical", F.lit(False)).alias("l3_critical"))


def ordered(findings: DataFrame) -> DataFrame:
    """(skill_id, hard_block_reasons, remediation_steps): reasons in order; the first ten different remediations.

    What is gathered is the findings of one skill, whose number its own text and rules bound.
    """
    place = F.struct(F.when(F.col("layer") == 2, 9).otherwise(F.col("layer")).alias("l"), F.col("ord"))
    f = findings.withColumn("place", place)
    steps = f.groupBy("skill_id", "remediation").agg(F.min("place").alias("place")).groupBy("skill_id")
    steps = steps.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "remediation"))), lambda x: x.remediation), 1, TOP).alias("remediation_steps"))
    why = f.where("severity = 'CRITICAL'").groupBy("skill_id")
    why = why.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rationale"))), lambda x: x.rationale).alias("hard_block_reasons"))
    return steps.join(why, "skill_id", "left").withColumn("hard_block_reasons", F.coalesce("hard_block_reasons", F.array().cast("array<string>")))


def fuse(l1: DataFrame, l2: DataFrame | None = None, l3: DataFrame | None = None) -> DataFrame:
    """The mean of the layers that ran, to four places, and the verdict on it."""
    out = l1
    null = F.lit(None).cast("double")
    out = out.join(l2.select("skill_id", "l2_score", "l2_critical", "tokens"), "skill_id", "left") if l2 is not None else out.withColumns({"l2_score": null, "l2_critical": F.lit(False), "tokens": F.lit(0).cast("long")})
    out = out.join(l3, "skill_id", "left") if l3 is not None else out.withColumns({"l3_score": null, "l3_critical": F.lit(False)})
    ran = F.array_compact(F.array("l1_score", "l2_score", "l3_score"))
    # The mean of scores of four places is often a tie in decimals but not in binary: round the scaled double.
    fused = F.floor(F.aggregate(ran, F.lit(0.0), lambda a, x: a + x) / F.size(ran) * 10_000 + 0.5) / 10_000
    critical = F.col("critical") | F.coalesce("l2_critical", F.lit(False)) | F.coalesce("l3_critical", F.lit(False))
    layers = F.array_compact(F.array(F.lit("L1"), F.when(F.col("l2_score").isNotNull(), "L2"), F.when(F.col("l3_score").isNotNull(), "L3")))
    out = out.withColumns({"fused_risk_score": fused, "any_critical": critical})
    return out.select(
        "*", verdict(F.col("any_critical"), F.col("fused_risk_score")).alias("verdict"), confidence(F.col("fused_risk_score")).alias("confidence"), layers.alias("layers_executed"),
    ).drop("l2_critical", "l3_critical")
