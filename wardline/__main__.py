"""python -m wardline scan PATH [--sarif-out DIR] [--json-output DIR] [--advisories P] [--replies P] [--traces P] [--rules DIR]
                            [--source-file P ...] [--source-directory DIR] [--directory-level N] [--advisory-dumps DIR] [--packages P] [--copies]
python -m wardline evaluate PATH [--output DIR] [--rules DIR]
python -m wardline watch LANDING --output DIR --checkpoint DIR [--keep-on]

scan: every file is a skill, or with --directory-level every folder so many steps below PATH (0: PATH itself). Exit code: 2 if a skill is
blocked, 1 if the scan fails, if a file that should have been scanned was not, or if nothing was, 0 otherwise. watch: manifests that land are scanned
where their list of tools changed; without --keep-on what has landed, once. evaluate: files with expected verdicts against the first layer. Exit code: 0 if recall
and precision reach the gate, 1 otherwise and where nothing is labelled.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.metrics import passes
from .plans.scan import Evaluation, evaluate, scan_path
from .rules import rule_problems
from .sinks import reports
from .sources import dumps
from .sources.files import read
from .sources.tables import written
from .streaming.rescan import STATE_STORE, watch


def console(verdicts: DataFrame, findings: DataFrame, rejects: DataFrame) -> None:
    """Prints every skill, the worst verdict first, then every finding, then what was not scanned; the driver holds a partition at a time."""
    shown = lambda v: "".join(c if c.isprintable() else repr(c)[1:-1] for c in ("" if v is None else str(v)))
    worst_first = reports.summary_line(verdicts).orderBy(F.col("verdict") != "BLOCK", F.desc("verdict"), "skill_id")
    left_out = rejects.select("path", F.when(F.col("failed"), "NOT SCANNED").otherwise("skipped").alias("status"), "reason").orderBy(F.desc("status"), "path")
    for rows in (worst_first, reports.console_rows(findings).orderBy("skill_id", "layer", "ord").drop("ord"), left_out):
        print(" | ".join(rows.columns))
        for r in rows.toLocalIterator():
            print(" | ".join(map(shown, r)))


def benchmark(done: Evaluation, output: str | None) -> int:
    """Prints the report, and the files that came out wrong; with ``output`` writes it as JSON lines."""
    m = done.metrics.first()
    if m["tp"] + m["fp"] + m["fn"] + m["tn"] + m["n_unlabeled"] == 0:
        print("no file with an expected verdict", file=sys.stderr)
        return 1
    print(" | ".join(f"{c} {m[c]}" for c in done.metrics.columns))
    for r in done.times.toLocalIterator():
        print(f"reading {r['n']} sources, ms | " + " | ".join(f"{p} {r[p]:.3f}" for p in ("p50", "p95", "p99")))
    for r in done.by_vector.orderBy("vector").toLocalIterator():
        print(" | ".join(str(x) for x in r))
    for r in done.results.where("NOT correct").orderBy("fixture_id").toLocalIterator():
        print(f"{r['fixture_id']} | expected {r['expected_verdict']} | {r['verdict']} | rules {','.join(r['rules_fired']) or '-'}")
    if output:
        reports.benchmark_json(done.results, done.metrics, done.by_vector, done.times).select("json").write.mode("overwrite").text(output)
    passed = passes(done.metrics).first()
    return 0 if passed["recall_ok"] and passed["precision_ok"] else 1


def dumped_advisories(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(advisories, what was left out) of a folder of documents."""
    docs, large = dumps.documents(spark, folder)
    return written(dumps.advisories(docs)), dumps.advisory_rejects(docs).unionByName(large)


def said(rows: DataFrame, what: str) -> None:
    """Tells of (path, reason) rows on the error stream."""
    for r in rows.orderBy(*rows.columns).toLocalIterator():
        print(f"{what}: {r[0]}: {r[1]}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wardline")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    for o in ("--sarif-out", "--json-output", "--advisories", "--replies", "--traces", "--rules", "--source-directory", "--advisory-dumps", "--packages"):
        s.add_argument(o)
    s.add_argument("--source-file", action="append")
    s.add_argument("--directory-level", type=int)
    s.add_argument("--copies", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("path")
    e.add_argument("--output")
    e.add_argument("--rules")
    w = sub.add_parser("watch")
    w.add_argument("landing")
    w.add_argument("--output", required=True)
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--keep-on", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("wardline").getOrCreate()
    try:
        if a.command == "watch":
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
            watch(spark, a.landing, a.output, a.checkpoint, once=not a.keep_on).awaitTermination()
            return 0
        if a.command == "evaluate":
            return benchmark(evaluate(read(spark, a.path), a.rules, written), a.output)
        table = lambda path: spark.read.parquet(path) if path else None
        advisories = table(a.advisories)
        if a.advisory_dumps:
            found, left_out = dumped_advisories(spark, a.advisory_dumps)
            advisories = found if advisories is None else advisories.unionByName(found, allowMissingColumns=True)
            said(left_out, "advisory document left out")
        if a.rules:
            said(rule_problems(spark, a.rules).select("path", "problem"), "rule left out")
        out = scan_path(spark, a.path, advisories=advisories, packages=table(a.packages), replies=table(a.replies), trace_rows=table(a.traces), rule_folder=a.rules, keep=written,
                        source_files=a.source_file, source_directory=a.source_directory, directory_level=a.directory_level, copies=a.copies)
        if a.sarif_out:
            reports.sarif(out.findings).unionByName(reports.sarif_of_rejects(out.rejects)).select("sarif").write.mode("overwrite").text(a.sarif_out)
        if a.json_output:
            reports.verdict_json(out.verdicts).unionByName(reports.reject_json(out.rejects)).select("json").write.mode("overwrite").text(a.json_output)
        if not (a.sarif_out or a.json_output):
            console(out.verdicts, out.findings, out.rejects)
        code = reports.exit_code(out.verdicts, out.rejects)
        if code == 1:
            print("scan failed: not everything was scanned", file=sys.stderr)
        return code
    except Exception as e:  # the command's contract: any failure is 1
        print(f"scan failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
