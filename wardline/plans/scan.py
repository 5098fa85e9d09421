"""The scan of a corpus: files to findings, scores and verdicts.

With ``keep`` left out, a scan is one lazy plan. A caller that reads more than one of its tables passes ``tables.written``: then
sources are parsed once, findings and verdicts are computed once, and every report reads what was written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import pyfacts
from ..functions import text as X
from ..operators import code, deps, judge, metrics, scoring, textual, traces
from ..sources import files as S


Keep = Callable[[DataFrame], DataFrame]
#: Sets of declared permissions are subsets of a fixed list.
MAX_SETS = 2 ** len(R.PERMISSIONS)


def lazy(df: DataFrame) -> DataFrame:
    return df


@dataclass
class Scan:
    skills: DataFrame
    fields: DataFrame
    dependencies: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    delta: DataFrame
    rejects: DataFrame  # path, reason, failed: what was not scanned, and whether that is a failure of the scan
    times: DataFrame  # skill_id, nanos of reading its sources


def declared(skills: DataFrame) -> DataFrame:
    """(skill_id, permissions)"""
    return skills.select("skill_id", F.array_distinct(F.flatten("tools.declared_permissions")).alias("permissions"))


def taken_apart(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every manifest, Python and Markdown file as a skill of its own: (skills, their sources, their dependencies, rejects)."""
    usable = S.scannable(files)
    impl = S.implementation_files(files)
    m = S.manifests(usable)
    beside = usable.where("ext = '.json'").select("dir").distinct()
    is_side = F.col("name").isin("README.md", "CHANGELOG.md")
    alone = usable.join(impl.select("path"), "path", "left_anti").join(beside.withColumn("side", F.lit(True)), "dir", "left").where(~(is_side & F.coalesce("side", F.lit(False))))
    skills = m.unionByName(S.python_skills(usable.join(alone.select("path"), "path", "left_semi").unionByName(usable.where(F.col("name").isin("README.md", "CHANGELOG.md", "requirements.txt"))))).unionByName(S.markdown_skills(alone.select(usable.columns)))
    sources = impl.select(F.col("skill_path").alias("skill_id"), "path").unionByName(alone.where("ext = '.py'").select(F.col("path").alias("skill_id"), "path"))
    read = sources.join(usable.select("path", "content"), "path")
    return skills, read, S.dependencies(usable, skills), S.rejects(files)


def scan_files(files: DataFrame, advisories: DataFrame | None = None, replies: DataFrame | None = None, trace_rows: DataFrame | None = None, rule_folder: str | None = None, keep: Keep = lazy, given: DataFrame | None = None, packages: DataFrame | None = None, copies: bool = False) -> Scan:
    """Every manifest, Python and Markdown file as a skill of its own.

    ``given``: source files that count for every skill instead of those found. Files that stand beside a manifest as its implementation, or as its README or change log, belong to it.
    ``packages`` (name): the known names of a registry, in place of the fixed list. ``copies``: many fields hold the same texts, each of which is then matched once.
    """
    skills, sources, dependencies, rejects = taken_apart(files)
    return scan(skills, sources, dependencies, advisories, replies, trace_rows, R.rule_table(files.sparkSession, rule_folder), keep, rejects, given, packages, copies)


def scan_directories(files: DataFrame, advisories: DataFrame | None = None, replies: DataFrame | None = None, trace_rows: DataFrame | None = None, rule_folder: str | None = None, keep: Keep = lazy, given: DataFrame | None = None, packages: DataFrame | None = None, copies: bool = False) -> Scan:
    """Folders as targets (``S.with_target``), each of which is one skill: its manifest, or all its Python files together."""
    spark = files.sparkSession
    usable = S.scannable(files)
    chosen = keep(S.directory_targets(usable))
    is_json = F.endswith(F.lower("path"), F.lit(".json"))
    own = usable.where(F.col("dir") == F.col("target"))
    m = S.manifests(own.join(chosen.where(is_json).select("path"), "path", "left_semi").unionByName(own.where("ext <> '.json'")))
    python = chosen.where(~is_json)
    side = own.join(python.select("target").distinct(), "target", "left_semi").where("ext <> '.py'")
    loose = usable.join(python.select("path"), "path", "left_semi")
    skills = m.unionByName(S.directory_skills(loose.unionByName(side)))
    impl = S.implementation_files(files.where(F.col("dir") == F.col("target"))).join(m.select(F.col("skill_id").alias("skill_path")), "skill_path", "left_semi")
    sources = impl.select(F.col("skill_path").alias("skill_id"), "path").unionByName(python.select(F.col("target").alias("skill_id"), "path"))
    read = sources.join(usable.select("path", "content"), "path")
    stated = S.requirements.from_manifest(m.select("skill_id", "raw"))
    near = S.sidecars(side).where("requirements_text IS NOT NULL").select(F.col("dir").alias("skill_id"), F.col("requirements_text").alias("text"))
    refused = S.rejects(files).unionByName(S.empty_targets(files).withColumn("failed", F.lit(True)))
    return scan(skills, read, stated.unionByName(S.requirements.from_text(near)), advisories, replies, trace_rows, R.rule_table(spark, rule_folder), keep, refused, given, packages, copies)


def of_named_sources(own: DataFrame, given: DataFrame, keep: Keep = lazy) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Facts of source files that count for every skill, read once.

    What code does to a skill depends on the permissions it declares alone, of which there are few sets. So facts meet those sets,
    each of which stands for its skills: (facts by set, permissions by set, and what takes rows of a set to its skills, by key).
    """
    facts = keep(pyfacts.fact_table(given.where("ext = '.py'").select(F.lit("").alias("skill_id"), "path", "content")))
    held = F.array_sort("permissions")
    member = keep(own.select("skill_id", F.array_join(held, ",").alias("set_id"), held.alias("permissions")))
    sets = member.select(F.col("set_id").alias("skill_id"), "permissions").distinct()
    ids = tuple(r["skill_id"] for r in sets.select("skill_id").limit(MAX_SETS + 1).collect())
    if len(ids) > MAX_SETS:
        raise ValueError("permissions that are no subsets of the known ones")
    by_set = facts.drop("skill_id").withColumn("skill_id", F.explode(X.constants(ids)))
    return by_set, sets, lambda rows: member.select("skill_id", "set_id").join(rows.withColumnRenamed("skill_id", "set_id"), "set_id").drop("set_id")


def scan(skills: DataFrame, sources: DataFrame, dependencies: DataFrame, advisories: DataFrame | None, replies: DataFrame | None, trace_rows: DataFrame | None, rules: DataFrame, keep: Keep = lazy, rejects: DataFrame | None = None, given: DataFrame | None = None, packages: DataFrame | None = None, copies: bool = False) -> Scan:
    """``rejects``: files that were left out before; sources that cannot be read to their end join them. A skill that is such a source has no verdict."""
    skills, dependencies = keep(skills.drop("raw")), keep(dependencies)
    fields = S.text_fields(skills)
    own = declared(skills)
    if given is None:
        facts, by, to_skills = keep(pyfacts.fact_table(sources)), own, lazy
    else:
        facts, by, to_skills = of_named_sources(own, given, keep)
    unread = pyfacts.unread(facts).withColumn("failed", F.lit(True))
    rejects = keep(unread if rejects is None else rejects.unionByName(unread))
    used = code.exercised(facts).groupBy("skill_id").agg(F.array_sort(F.collect_set("permission")).alias("exercised"))
    none = F.array().cast("array<string>")
    compared = to_skills(by.join(used, "skill_id", "left").select("skill_id", F.col("permissions").alias("declared"), F.coalesce("exercised", none).alias("exercised")))
    delta = code.permission_delta(compared)
    first = textual.findings(fields, copies=copies).unionByName(textual.dynamic_tools(skills)).unionByName(deps.findings(dependencies, advisories, packages)).unionByName(to_skills(code.findings(facts, by))).unionByName(code.delta_findings(delta))
    found = scoring.dedup(first)
    parsed = lt = None
    if replies is not None:
        # Without tools there is nothing to be consistent with: that pass is left out before the join.
        no_tools = skills.where(F.size("tools") == 0).select("skill_id", F.lit("consistency").alias("pass"))
        parsed = judge.parse(replies.join(no_tools, ["skill_id", "pass"], "left_anti"))
        found = found.unionByName(judge.findings(parsed))
    if trace_rows is not None:
        lt = trace_rows.join(own.withColumnRenamed("permissions", "declared"), "skill_id", "left").withColumn("declared", F.coalesce("declared", none))
        found = found.unionByName(traces.findings(lt))
    found = keep(scoring.enrich(found, rules))
    l1 = scoring.layer1(skills, found, to_skills(code.flags(facts, by)), deps.counts(dependencies, advisories, packages))
    l2 = l3 = None
    if parsed is not None:
        critical = delta.select("skill_id", (F.size("under_declared") > 0).alias("permission_delta_critical"))
        has_tools = skills.select("skill_id", (F.size("tools") > 0).alias("has_tools"))
        per = judge.layer(parsed).join(critical, "skill_id", "left").join(has_tools, "skill_id", "left")
        per = per.withColumn("permission_delta_critical", F.coalesce("permission_delta_critical", F.lit(False)) & F.coalesce("has_tools", F.lit(False))).drop("has_tools")
        l2 = scoring.layer2(skills, found, per)
    if lt is not None:
        l3 = scoring.layer3(lt, found)
    told = scoring.fuse(l1, l2, l3).join(skills.select("skill_id", "skill_name", "framework"), "skill_id")
    verdicts = keep(told.join(rejects.where("failed").select(F.col("path").alias("skill_id")).distinct(), "skill_id", "left_anti"))
    return Scan(skills, fields, dependencies, found, verdicts, delta, rejects, to_skills(pyfacts.file_times(facts)))


def scan_path(spark: SparkSession, path: str, source_files: list[str] | None = None, source_directory: str | None = None, directory_level: int | None = None, **kw) -> Scan:
    """Named source files come before a named directory, and both before what is found beside a skill."""
    named = source_files or ([source_directory] if source_directory else None)
    given = reduce(DataFrame.unionByName, [S.read(spark, p) for p in named]) if named else None
    files = S.read(spark, path)
    if directory_level is not None:
        return scan_directories(S.with_target(files, path, directory_level), given=given, **kw)
    return scan_files(files, given=given, **kw)


@dataclass
class Evaluation:
    results: DataFrame  # skill_id, fixture_id, expected_verdict, attack_vectors, rules_expected, verdict, rules_fired, correct, read_ms
    metrics: DataFrame
    by_vector: DataFrame
    times: DataFrame  # n, p50, p95, p99 of read_ms: sources read in the tasks; of Markdown files and manifests without sources there is none


def evaluate(files: DataFrame, rule_folder: str | None = None, keep: Keep = lazy) -> Evaluation:
    """The first layer against the labels written in files. A labelled file without a verdict is an ERROR, which counts in no cell."""
    out = scan_files(files, rule_folder=rule_folder, keep=keep)
    fired = out.findings.groupBy("skill_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "ord", "rule_id"))), lambda x: x.rule_id).alias("rules_fired"))
    r = S.labels(files).join(out.verdicts.select("skill_id", "verdict"), "skill_id", "left").join(fired, "skill_id", "left")
    r = r.withColumns({"verdict": F.coalesce("verdict", F.lit("ERROR")), "rules_fired": F.coalesce("rules_fired", F.array().cast("array<string>"))})
    r = r.join(out.times, "skill_id", "left").withColumn("read_ms", F.col("nanos") / 1e6).drop("nanos")
    r = keep(r.withColumn("correct", F.col("verdict") == F.col("expected_verdict")))
    timed = r.where("read_ms IS NOT NULL").withColumn("of", F.lit("sources"))
    return Evaluation(r, keep(metrics.confusion(r)), metrics.by_vector(r), metrics.index_percentiles(timed, "read_ms", "of").drop("of"))
