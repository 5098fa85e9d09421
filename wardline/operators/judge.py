"""Recorded replies of a language-model judge: (skill_id, pass, raw_text, tokens)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
VERDICTS = ("CLEAN", "SUSPICIOUS", "MALICIOUS")
REPLY = "verdict string, confidence string, attack_types array<string>, findings array<string>, rationale string"
ONE = "field_name string, evidence_quote string, attack_type string, severity string"
#: Attack type to (rule, vector) in each pass, with the fallback.
DETECT = {
    "T2_PROMPT_INJECTION": ("L2-PI-001", "T2_PROMPT_INJECTION"),
    "T3_TOOL_DESC_JAILBREAK": ("L2-PI-001", "T3_TOOL_DESC_JAILBREAK"),
    "T6_DATA_EXFILTRATION": ("L2-PI-002", "T6_DATA_EXFILTRATION"),
    "T7_STATE_POISONING": ("L2-PI-003", "T7_STATE_POISONING"),
}
CONSISTENCY = {
    "DESC_MISMATCH": ("L2-CC-001", "T3_TOOL_DESC_JAILBREAK"),
    "OVER_DECLARED": ("L2-CC-002", "T4_PRIVILEGE_ESCALATION"),
    "UNDER_DECLARED": ("L2-CC-003", "T4_PRIVILEGE_ESCALATION"),
}


def parse(replies: DataFrame) -> DataFrame:
    """Adds verdict, confidence, attack_types, rationale and findings; a reply that breaks a rule of the format is PARSE_ERROR."""
    fenced = F.regexp_extract("raw_text", r"(?is)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(F.rlike("raw_text", F.lit(r"(?is)```.*?```")), fenced).otherwise(F.col("raw_text")), F.lit(" \t\r\n"))
    j = replies.withColumn("j", F.from_json(body, REPLY))
    verdict = F.upper("j.verdict")
    number = F.expr("try_cast(j.confidence AS double)")
    ok = verdict.isin(*VERDICTS) & number.isNotNull() & F.col("j.attack_types").isNotNull() & F.col("j.findings").isNotNull() & F.col("j.rationale").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    item = lambda x: F.from_json(x, ONE)
    fixed = F.transform(
        F.filter("j.findings", lambda x: F.startswith(F.ltrim(x), F.lit("{"))),
        lambda x: F.transform(
            F.array(item(x)),
            lambda f: F.struct(
                F.coalesce(f.field_name, F.lit("unknown")).alias("field_name"),
                F.substring(F.coalesce(f.evidence_quote, F.lit("")), 1, 200).alias("evidence_quote"),
                F.coalesce(f.attack_type, F.lit("T2_PROMPT_INJECTION")).alias("attack_type"),
                F.when(F.upper(f.severity).isin(*SEVERITIES), F.upper(f.severity)).otherwise("MEDIUM").alias("severity"),
            ),
        )[0],
    )
    none = F.array().cast("array<struct<field_name:string,evidence_quote:string,attack_type:string,severity:string>>")
    return (
        j.withColumn("verdict", F.when(ok, verdict).otherwise("PARSE_ERROR"))
        .withColumn("confidence", F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(0.0))
        .withColumn("attack_types", F.when(ok, F.col("j.attack_types")).otherwise(F.array().cast("array<string>")))
        .withColumn("rationale", F.when(ok, F.substring("j.rationale", 1, 500)).otherwise(""))
        .withColumn("findings", F.when(ok, fixed).otherwise(none))
        .drop("j", "raw_text")
    )


def _pick(table: dict, at: int, default: str) -> Column:
    out = F.lit(default)
    for kind, row in table.items():
        out = F.when(F.col("f.attack_type") == kind, row[at]).otherwise(out)
    return out


def findings(parsed: DataFrame) -> DataFrame:
    """Findings of both passes, ``detect`` and then ``consistency``; a reply's confidence is that of its findings."""
    rows = parsed.select("skill_id", "pass", "confidence", "rationale", F.posexplode("findings").alias("i", "f"))
    first = F.col("pass") == "detect"
    rule = F.when(first, _pick(DETECT, 0, "L2-PI-001")).otherwise(_pick(CONSISTENCY, 0, "L2-CC-001"))
    vector = F.when(first, _pick(DETECT, 1, "T2_PROMPT_INJECTION")).otherwise(_pick(CONSISTENCY, 1, "T3_TOOL_DESC_JAILBREAK"))
    null = F.lit(None).cast("string")
    return rows.select(
        "skill_id", F.lit(2).alias("layer"), F.array(F.when(first, 0).otherwise(1), "i").alias("ord"), rule.alias("rule_id"), "confidence", null.alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), F.col("f.field_name").alias("field_name"), F.col("f.evidence_quote").alias("snippet"), "rationale",
        F.col("f.severity").alias("severity"), vector.alias("attack_vector"),
    )


def layer(parsed: DataFrame) -> DataFrame:
    """A row a skill: the first pass's verdict (null after a parse error), tokens of both, mismatch, and max confidence by field."""
    first = F.col("pass") == "detect"
    mismatch = (F.col("pass") == "consistency") & (F.exists("findings", lambda f: f.attack_type == "DESC_MISMATCH") | F.array_contains("attack_types", "DESC_MISMATCH"))
    whole = parsed.groupBy("skill_id").agg(
        F.max(F.when(first, F.nullif("verdict", F.lit("PARSE_ERROR")))).alias("judge_verdict"),
        F.max(F.when(first & (F.col("verdict") != "PARSE_ERROR"), F.col("confidence"))).alias("judge_confidence"),
        F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"),
        F.bool_or(mismatch).alias("description_code_mismatch"),
    )
    return whole.join(field_risk(parsed), "skill_id", "left")


def field_risk(parsed: DataFrame) -> DataFrame:
    """(skill_id, field_risk_scores MAP): the highest confidence of each field with a finding."""
    f = parsed.select("skill_id", "confidence", F.explode("findings.field_name").alias("field")).groupBy("skill_id", "field").agg(F.max("confidence").alias("c"))
    return f.groupBy("skill_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "c")))).alias("field_risk_scores"))


def bonus() -> Column:
    """The layer's bonus of a row of ``layer`` with ``permission_delta_critical``."""
    c = F.coalesce("judge_confidence", F.lit(0.0))
    return (
        F.when(F.col("judge_verdict") == "MALICIOUS", 1.5 * c).when(F.col("judge_verdict") == "SUSPICIOUS", 0.7 * c).otherwise(0.0)
        + F.when(F.col("description_code_mismatch"), 0.8).otherwise(0.0)
        + F.when(F.col("permission_delta_critical"), 1.2).otherwise(0.0)
    )


# ---- what the judge is asked


#: The marks around text that an author controls, and the lines of a delta and of findings below.
def untrusted(text: Column) -> Column:
    return F.concat(F.lit("<untrusted_content>\n"), text, F.lit("\n</untrusted_content>"))


def tool_text(tools: str, schemas: bool = True) -> Column:
    """Lines on each tool of an array of (name, description, input_schema)."""

    def lines(t: Column) -> Column:
        head = F.concat(F.lit("[TOOL:"), t["name"])
        out = [F.concat(head, F.lit("] description: "), F.coalesce(t.description, F.lit("")))]
        if schemas:
            out.append(F.when(F.length(t.input_schema) > 0, F.concat(head, F.lit("] input_schema: "), t.input_schema)))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    return F.array_join(F.flatten(F.transform(tools, lines)), "\n")


def all_untrusted_text(tools: str = "tools", schemas: bool = True) -> Column:
    """All text of a skill that its author controls."""
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"[{name}]: "), F.col(c)))
    return F.concat_ws("\n", F.nullif(tool_text(tools, schemas), F.lit("")), part("README", "readme_text"), part("CHANGELOG", "changelog_text"))


def delta_text() -> Column:
    """A permission delta in three lines."""
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
    return F.concat(
        F.lit("over_declared:  ["), some("over_declared"), F.lit("]\nunder_declared: ["), some("under_declared"), F.lit("]"),
        F.when(F.size("under_declared") > 0, "   ← CRITICAL").otherwise(""), F.lit("\nvalidated:      ["), some("validated"), F.lit("]"),
    )


def findings_text(l1: DataFrame, findings: DataFrame) -> DataFrame:
    """(skill_id, l1_text): the flags of a row of ``scoring.layer1``, and its first ten findings, each with 80 characters of its rationale."""
    one = F.struct("ord", F.concat("rule_id", F.lit(" ("), F.substring("rationale", 1, 80), F.lit(")")).alias("t"))
    # What is gathered is the findings of one skill, whose number its own text and rules bound.
    told = findings.where("layer = 1").groupBy("skill_id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.t), 1, 10), ", ").alias("told"))
    flag = lambda c: F.concat(F.lit(f"- {c}: "), F.initcap(F.coalesce(c, F.lit(False)).cast("string")))
    flags = [flag(c) for c in ("subprocess_in_tool_body", "undeclared_network_access", "dynamic_import_detected", "invisible_unicode_detected")]
    lines = F.concat_ws("\n", *flags, F.concat(F.lit("- AST rule matches: "), F.coalesce("told", F.lit("none"))))
    return l1.join(told, "skill_id", "left").select("skill_id", lines.alias("l1_text"))


def refresh(asked: DataFrame, call: Callable[[str, str], tuple[str, int]], retries: int = 2, wait: float = 1.0) -> DataFrame:
    """Replies for (skill_id, pass, system, user) by ``call``, which gives (text, tokens): a job of its own that fills the table of replies.

    A call that fails is tried again ``retries`` times; if it never succeeds, its reply is null and parses as an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for skill, step, system, user in b[["skill_id", "pass", "system", "user"]].itertuples(index=False):
                got = (None, 0)
                for left in range(retries, -1, -1):
                    try:
                        got = call(system, user)
                        break
                    except Exception:  # whatever a client raises
                        if left:
                            time.sleep(wait)
                out.append((skill, step, *got))
            yield pd.DataFrame(out, columns=["skill_id", "pass", "raw_text", "tokens"])

    return asked.select("skill_id", "pass", "system", "user").mapInPandas(run, "skill_id string, pass string, raw_text string, tokens int")
