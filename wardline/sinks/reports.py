"""Reports: SARIF, JSON, console rows, the exit code, and scripts of recorded tool calls as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import PRECISION, RECALL

#: SARIF levels.
LEVELS = {"INFO": "note", "LOW": "note", "MEDIUM": "warning", "HIGH": "error", "CRITICAL": "error"}
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def level(severity: Column) -> Column:
    out = F.lit("note")
    for s, v in LEVELS.items():
        out = F.when(severity == s, v).otherwise(out)
    return out


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result (JSON) for each finding; a location only if it has both file and line."""
    where = F.when(
        F.col("file_path").isNotNull() & (F.col("line_number") > 0),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))),
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        level(F.col("severity")).alias("level"),
        F.struct(F.col("rationale").alias("text")).alias("message"),
        F.struct(F.col("attack_vector").alias("attackVector"), "confidence", "remediation").alias("properties"),
        where.alias("locations"),
    )
    return findings.select("skill_id", "layer", "ord", "rule_id", level(F.col("severity")).alias("level"), F.to_json(result).alias("result"))


def sarif(findings: DataFrame) -> DataFrame:
    """(skill_id, sarif): a document for each skill."""
    r = sarif_results(findings).withColumn("place", F.struct(F.when(F.col("layer") == 2, 9).otherwise(F.col("layer")).alias("l"), F.col("ord")))
    parts = r.groupBy("skill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "result"))), lambda x: x.result), ",").alias("results"))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"wardline","version":"0.1.0"}}}},"results":['
    return parts.select("skill_id", F.concat(F.lit(head), "results", F.lit("]}]}")).alias("sarif"))


def sarif_of_rejects(rejects: DataFrame) -> DataFrame:
    """(skill_id, sarif): a document for each file that was not scanned, which says so; it is an unsuccessful run if that fails the scan."""
    note = F.struct(F.when(F.col("failed"), "error").otherwise("note").alias("level"), F.struct(F.col("reason").alias("text")).alias("message"),
                    F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    told = F.to_json(F.struct((~F.col("failed")).alias("executionSuccessful"), F.array(note).alias("toolExecutionNotifications")))
    head = f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"wardline","version":"0.1.0"}}}},"results":[],"invocations":['
    return rejects.select(F.col("path").alias("skill_id"), F.concat(F.lit(head), told, F.lit("]}]}")).alias("sarif"))


def reject_json(rejects: DataFrame) -> DataFrame:
    """(skill_id, json) like ``verdict_json``: the verdict of a file that was not scanned is ERROR, or SKIPPED if no parser is meant to take it."""
    verdict = F.when(F.col("failed"), "ERROR").otherwise("SKIPPED").alias("verdict")
    return rejects.select(F.col("path").alias("skill_id"), F.to_json(F.struct(F.col("path").alias("skill_id"), verdict, "reason")).alias("json"))


def verdict_json(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("skill_id", F.to_json(F.struct(*[F.col(c) for c in verdicts.columns])).alias("json"))


def console_rows(findings: DataFrame) -> DataFrame:
    """Layer, rule, severity, vector and evidence as a console shows them."""
    evidence = (
        F.when(F.col("file_path").isNotNull() & (F.col("line_number") > 0), F.concat(F.substring_index("file_path", "/", -1), F.lit(":"), F.col("line_number").cast("string")))
        .when(F.length("field_name") > 0, F.col("field_name"))
        .when(F.length("snippet") > 0, F.substring("snippet", 1, 60))
        .otherwise("-")
    )
    return findings.select("skill_id", F.concat(F.lit("L"), F.col("layer").cast("string")).alias("layer"), "ord", "rule_id", "severity", "attack_vector", evidence.alias("evidence"))


def summary_line(verdicts: DataFrame) -> DataFrame:
    line = F.format_string("Risk score: %.4f | Confidence: %.2f | Findings: %d | Layers: %s", "fused_risk_score", "confidence", "n_findings", F.array_join("layers_executed", " + "))
    return verdicts.select("skill_id", "verdict", line.alias("line"))


def benchmark_json(results: DataFrame, metrics: DataFrame, by_vector: DataFrame, times: DataFrame) -> DataFrame:
    """The evaluation as JSON lines: a summary, the times of reading sources, a line for each attack vector, and one for each labelled file; (kind, key, json)."""
    total = results.agg(F.count(F.lit(1)).alias("total_fixtures"), F.count_if(F.col("verdict") == "ERROR").alias("errors"))
    rate = lambda c: F.round(c, 4).alias(c)
    met = F.struct((F.col("precision") >= PRECISION).alias("precision"), (F.col("recall") >= RECALL).alias("recall"))
    # Both sides have one row.
    one = metrics.withColumn("__k", F.lit(1)).join(total.withColumn("__k", F.lit(1)), "__k")
    summary = one.select(F.lit("summary").alias("kind"), F.lit("").alias("key"), F.to_json(F.struct(
        "total_fixtures", "errors", "tp", "fp", "fn", "tn", *map(rate, ("precision", "recall", "f1", "accuracy")), F.round("fpr", 4).alias("false_positive_rate"), met.alias("thresholds_met"),
    )).alias("json"))
    vectors = by_vector.select(F.lit("attack_vector").alias("kind"), F.col("vector").alias("key"), F.to_json(F.struct("vector", *map(rate, ("precision", "recall", "f1")), "tp", "fn")).alias("json"))
    fixtures = results.select(F.lit("fixture").alias("kind"), F.col("fixture_id").alias("key"), F.to_json(F.struct(
        F.col("fixture_id").alias("id"), F.col("skill_id").alias("path"), F.col("expected_verdict").alias("expected"), F.col("verdict").alias("actual"), "correct", "rules_expected", "rules_fired", F.round("read_ms", 3).alias("read_ms"),
    )).alias("json"))
    spent = times.select(F.lit("read_ms").alias("kind"), F.lit("").alias("key"), F.to_json(F.struct("n", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])).alias("json"))
    return summary.unionByName(spent).unionByName(vectors).unionByName(fixtures)


def exit_code(verdicts: DataFrame, rejects: DataFrame | None = None) -> int:
    """2 if anything is blocked; else 1 if something was not scanned that should have been, or nothing was scanned; else 0."""
    if verdicts.where("verdict = 'BLOCK'").limit(1).count():
        return 2
    if rejects is None:
        return 0
    return 1 if rejects.where("failed").limit(1).count() or not verdicts.limit(1).count() else 0


def _quoted(c: Column) -> Column:
    """A Python literal of a string."""
    escaped = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def call_statement(name: Column, args: Column, idx: Column) -> Column:
    """One recorded tool call as a Python statement (text only), or null for a tool that is not known."""
    arg = lambda k, default: _quoted(F.coalesce(F.element_at(args, k), F.lit(default)))
    n = idx.cast("string")

    def connect(var: str, host: Column, port: int) -> Column:
        s = F.concat(F.lit(var), n)
        return F.concat(F.lit("import socket; "), s, F.lit(" = socket.socket(); "), s, F.lit(".connect(("), host, F.lit(f", {port}))"))

    return (
        F.when(name == "http_request", connect("c", arg("url", "unknown-url"), 443))
        .when(name == "write_file", F.concat(F.lit("open("), arg("path", "/tmp/agent_output.txt"), F.lit(", 'w').write("), arg("content", ""), F.lit(")")))
        .when(name == "run_command", F.concat(F.lit("import subprocess; subprocess.run("), arg("command", ""), F.lit(", shell=True)")))
        .when(name == "read_env_var", F.concat(F.lit("import os; os.environ.get("), arg("name", ""), F.lit(")")))
        .when(name == "send_message", F.concat(connect("m", arg("recipient", "localhost"), 25), F.lit("; m"), n, F.lit(".send(b"), arg("body", ""), F.lit(")")))
    )


def call_scripts(calls: DataFrame) -> DataFrame:
    """(skill_id, call_ord, name, input MAP) to a script a skill: every known call in a block of its own; skills without any go."""
    block = F.concat(F.lit("try:\n    "), F.col("s"), F.lit("\nexcept Exception:\n    pass"))
    c = calls.select("skill_id", "call_ord", call_statement(F.col("name"), F.col("input"), F.col("call_ord")).alias("s")).where("s IS NOT NULL")
    lines = c.groupBy("skill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("call_ord", block.alias("b")))), lambda x: x.b), "\n").alias("b"))
    return lines.select("skill_id", F.concat(F.lit("# recorded tool calls, for a sandbox without network\n"), "b", F.lit("\n")).alias("script"))
