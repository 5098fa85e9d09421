"""Rules on facts about Python source, and exercised against declared permissions. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions.text import each_hit

ENTROPY, LENGTH = 4.5, 64
_BASE = {r[0]: r[3] for r in R.RULES}


def _names(rule: str) -> tuple[str, ...]:
    return next(c[3] for c in R.CALLS if c[0] == rule)


def exercised(facts: DataFrame) -> DataFrame:
    """(skill_id, permission) that code exercises."""
    p = F.lit(None).cast("string")
    for _, permission, _, names in R.CALLS:
        if permission:
            p = F.when((F.col("kind") == "call") & F.col("name").isin(*names), permission).otherwise(p)
    opened = (F.col("kind") == "call") & (F.col("name") == "open")
    p = F.when(opened, F.when(F.rlike("detail", F.lit("[wax]")), "filesystem:write").otherwise("filesystem:read")).otherwise(p)
    p = F.when(F.col("kind") == "env_write", "env:write").otherwise(p)
    return facts.select("skill_id", p.alias("permission")).where("permission IS NOT NULL").distinct()


def findings(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """``declared``: (skill_id, permissions ARRAY). A fact may fit several rules, which come in a fixed order."""
    f = facts.join(declared, "skill_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))
    f = f if "file_ord" in f.columns else f.withColumn("file_ord", F.dense_rank().over(Window.partitionBy("skill_id").orderBy("path")))
    call = F.col("kind") == "call"
    undeclared = lambda p: ~F.array_contains("permissions", p)
    checks: list[tuple[str, Column]] = []
    for rule, permission, excused, names in R.CALLS:
        cond = call & F.col("name").isin(*names)
        checks.append((rule, cond & undeclared(permission) if excused else cond))
        if rule == "PE-002":
            checks.append(("OBFUSC-001", call & (F.col("detail") == "b64") & F.col("name").isin("eval", "exec")))
    checks += [
        ("PE-006", (F.col("kind") == "import") & F.col("name").isin(*R.NATIVE_MODULES)),
        ("PE-007", call & (F.col("name") == "open") & F.rlike("detail", F.lit("[wax]")) & undeclared("filesystem:write")),
        ("OBFUSC-002", (F.col("kind") == "getattr") & F.col("name").isin(*R.ASSEMBLED_NAMES)),
        ("EX-003", (F.col("kind") == "literal") & F.col("detail").isNull() & (F.col("length") >= LENGTH) & (F.col("entropy") >= ENTROPY)),
    ]
    hit = F.array(*[F.when(cond, F.struct(F.lit(i).alias("k"), F.lit(rule).alias("rule_id"), F.lit(_BASE[rule]).alias("confidence"))) for i, (rule, cond) in enumerate(checks)])
    rows = f.withColumn("h", each_hit(hit)).where("h IS NOT NULL")
    told = F.format_string("High-entropy string literal (H=%.2f bits/char, len=%d): a hidden payload or secret, perhaps", "entropy", "length")
    null = F.lit(None).cast("string")
    return rows.select(
        "skill_id", F.lit(1).alias("layer"), F.array(F.lit(4), F.coalesce(F.col("file_ord"), F.lit(0)), "fact_ord", "h.k").alias("ord"), "h.rule_id", "h.confidence",
        F.col("path").alias("file_path"), "line_number", null.alias("field_name"), "snippet", F.when(F.col("h.rule_id") == "EX-003", told).alias("rationale"),
        null.alias("severity"), null.alias("attack_vector"),
    )


def permission_delta(perms: DataFrame) -> DataFrame:
    """(skill_id, declared, exercised) arrays to over- and under-declared and validated ones, sorted."""
    return perms.select(
        "skill_id",
        F.array_sort(F.array_except("declared", "exercised")).alias("over_declared"),
        F.array_sort(F.array_except("exercised", "declared")).alias("under_declared"),
        F.array_sort(F.array_intersect("declared", "exercised")).alias("validated"),
    )


def delta_findings(delta: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return delta.where(F.size("under_declared") > 0).select(
        "skill_id", F.lit(1).alias("layer"), F.array(F.lit(5)).alias("ord"), F.lit("PE-DELTA-001").alias("rule_id"), F.lit(_BASE["PE-DELTA-001"]).alias("confidence"),
        null.alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit("permission_delta").alias("field_name"),
        F.concat(F.lit("under_declared: "), F.array_join("under_declared", ", ")).alias("snippet"), null.alias("rationale"), null.alias("severity"), null.alias("attack_vector"),
    )


def flags(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """(skill_id, dynamic_import_detected, subprocess_in_tool_body, undeclared_network_access)"""
    f = facts.where("kind = 'call'").join(declared, "skill_id", "left")
    name = F.col("name")
    net = name.isin(*_names("EX-001"), *_names("EX-002")) & ~F.coalesce(F.array_contains("permissions", "network:egress"), F.lit(False))
    return f.groupBy("skill_id").agg(
        F.bool_or(name.isin(*_names("PE-005"))).alias("dynamic_import_detected"),
        F.bool_or(name.isin(*_names("PE-003"), *_names("PE-004"))).alias("subprocess_in_tool_body"),
        F.bool_or(net).alias("undeclared_network_access"),
    )
