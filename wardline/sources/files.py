"""Files to skills: manifests, Python files, Markdown files and directories, for a whole corpus at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import pyfacts
from ..functions.text import github_raw, schema_strings_udf
from . import requirements

KINDS = {".json": "mcp", ".py": "python", ".md": "markdown", ".markdown": "markdown"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, dir, name, stem, ext, content) of the files under ``path``, whatever their length; one that Spark cannot hold in a row fails the scan.

    The content of a file that is not valid UTF-8 is null, which puts it among ``rejects``.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    return describe(f.select("path", F.when(F.is_valid_utf8(text), text).alias("content")))


def describe(files: DataFrame) -> DataFrame:
    """Adds dir, name, stem and lower-case ext to (path, content)."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path",
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"),
        name.alias("name"),
        F.regexp_replace(name, r"(.)\.[^.]*$", "$1").alias("stem"),
        F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1)).alias("ext"),
        "content",
    )


def kind(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, k in KINDS.items():
        out = F.when(ext == e, k).otherwise(out)
    return out


def _tools(parsed: Column) -> Column:
    """The tools of a manifest that are objects."""
    listed = F.try_variant_get(parsed, "$.tools", "array<variant>")
    return F.filter(F.coalesce(listed, F.expr("array()").cast("array<variant>")), lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))


def _refused(name: Column) -> Column:
    return F.rlike(name, F.lit(r"[\n\r<>]")) | (F.length(name) > 128)


def refusal(content: Column) -> Column:
    """Why a JSON file is no manifest that can be scanned, or null."""
    parsed = F.try_parse_json(content)
    names = F.transform(_tools(parsed), lambda t: F.coalesce(F.try_variant_get(t, "$.name", "string"), F.lit("")))
    return F.when(parsed.isNull() | ~F.startswith(F.trim(content, F.lit(" \t\r\n")), F.lit("{")), "not a JSON object").when(F.exists(names, _refused), "tool name not allowed")


UNSUPPORTED = "unsupported file type"


def rejects(files: DataFrame) -> DataFrame:
    """(path, reason, failed): files that no parser takes. Of a kind that is scanned, that is a failure of the scan; files of other kinds are only listed."""
    text = kind(F.col("ext")).isNotNull() | (F.col("name") == "requirements.txt")
    reason = F.when(F.col("content").isNull() & text, "not valid UTF-8").when(kind(F.col("ext")).isNull(), UNSUPPORTED).when(F.col("ext") == ".json", refusal(F.col("content")))
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL").withColumn("failed", F.col("reason") != UNSUPPORTED)


def scannable(files: DataFrame) -> DataFrame:
    """Files without those that are ``rejects`` by failure."""
    return files.where(F.col("content").isNotNull() & ((F.col("ext") != ".json") | refusal(F.col("content")).isNull()))


def directory_targets(files: DataFrame) -> DataFrame:
    """(target, path): what stands for each target folder: a manifest of its own whose name says so, else its first JSON file by name, else all Python files in it at any depth."""
    j = files.where("ext = '.json' AND dir = target").withColumn("said", F.rlike(F.lower("name"), F.lit("mcp|manifest")))
    one = j.groupBy("target").agg(F.min(F.struct((~F.col("said")).alias("unsaid"), "name", "path")).alias("m")).select("target", "m.path")
    python = files.where("ext = '.py'").join(one.select("target"), "target", "left_anti")
    return one.unionByName(python.select("target", "path"))


def sidecars(files: DataFrame) -> DataFrame:
    """(dir, readme_text, changelog_text, requirements_text): files beside a manifest, by exact name."""
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("content")))
    return files.where(F.col("name").isin("README.md", "CHANGELOG.md", "requirements.txt")).groupBy("dir").agg(
        pick("README.md").alias("readme_text"), pick("CHANGELOG.md").alias("changelog_text"), pick("requirements.txt").alias("requirements_text"),
    )


def implementation_files(files: DataFrame) -> DataFrame:
    """(skill path, source path): Python files that start like the manifest's first two name parts; else all, if it is the only JSON file there.

    Files meet manifests by folder and beginning: each Python file goes under all its beginnings, so a folder of very many of both makes no pairs but those that belong together.
    """
    j = files.where("ext = '.json'")
    m = j.where(refusal(F.col("content")).isNull())  # one that is not scanned has no implementation
    m = m.select(F.col("path").alias("skill_path"), "dir", F.array_join(F.slice(F.split("stem", "-"), 1, 2), "-").alias("prefix"))
    p = files.where("ext = '.py'").select("dir", "path", "stem")
    begins = F.transform(F.sequence(F.lit(0), F.length("stem")), lambda n: F.substring("stem", F.lit(1), n))
    alike = m.join(p.select("dir", "path", F.explode(begins).alias("prefix")), ["dir", "prefix"]).select("skill_path", "path")
    lone = j.groupBy("dir").agg(F.count(F.lit(1)).alias("n_json")).where("n_json = 1").select("dir")
    other = m.join(lone, "dir").join(alike.select("skill_path"), "skill_path", "left_anti")
    return alike.unionByName(other.join(p, "dir").select("skill_path", "path"))


def with_target(files: DataFrame, root: str, level: int) -> DataFrame:
    """Adds ``target``: the folder ``level`` steps below ``root`` that a file is in, at any depth; files in none go."""
    home = re.escape(root.rstrip("/"))
    return files.withColumn("target", F.nullif(F.regexp_extract("path", f"^((?:[a-z0-9]+:/*)?{home}(?:/[^/]+){{{level}}})/", 1), F.lit(""))).where("target IS NOT NULL")


def empty_targets(files: DataFrame) -> DataFrame:
    """(path, reason) of targets that hold neither a JSON file of their own nor a Python file."""
    some = ((F.col("ext") == ".json") & (F.col("dir") == F.col("target"))) | (F.col("ext") == ".py")
    return files.groupBy(F.col("target").alias("path")).agg(F.bool_or(some).alias("some")).where("NOT some").select("path", F.lit("no file to scan in the folder").alias("reason"))


def known_permissions(values: Column) -> Column:
    """Tokens that are permissions; others go without a word."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isin(*R.PERMISSIONS))


def manifests(files: DataFrame) -> DataFrame:
    """JSON manifests to skills: (skill_id, framework, skill_name, server_name, server_version, dynamic_tools, tools, readme_text, changelog_text, raw).

    A tool without permissions of its own has the manifest's; tools that are no objects go; a tool name that holds line
    breaks or angle brackets, or is longer than 128 characters, puts the skill among ``rejected_names``.
    """
    m = files.where("ext = '.json'").withColumn("raw", F.expr("try_parse_json(content)")).where("raw IS NOT NULL")
    got = lambda path, t: F.expr(f"try_variant_get(raw, '{path}', '{t}')")
    top = known_permissions(got("$.permissions", "array<string>"))

    def tool(v: Column) -> Column:
        own = known_permissions(F.try_variant_get(v, "$.permissions", "array<string>"))
        return F.struct(
            F.coalesce(F.try_variant_get(v, "$.name", "string"), F.lit("unnamed_tool")).alias("name"),
            F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit("")).alias("description"),
            F.coalesce(F.to_json(F.try_variant_get(v, "$.inputSchema", "variant")), F.lit("")).alias("input_schema"),
            F.when(F.size(own) > 0, own).otherwise(top).alias("declared_permissions"),
            F.coalesce(F.try_variant_get(v, "$.return_direct", "boolean"), F.lit(False)).alias("return_direct"),
            F.lit(False).alias("is_async"),
        )

    s = m.join(sidecars(files), "dir", "left")
    server = F.nullif(F.trim(got("$.name", "string")), F.lit(""))
    return s.select(
        F.col("path").alias("skill_id"),
        F.lit("mcp").alias("framework"),
        F.coalesce(server, F.lit("unknown_skill")).alias("skill_name"),
        server.alias("server_name"),
        got("$.version", "string").alias("server_version"),
        F.coalesce(got("$.serverCapabilities.tools.listChanged", "boolean"), F.lit(False)).alias("dynamic_tools"),
        F.transform(_tools(F.col("raw")), tool).alias("tools"),
        "readme_text",
        "changelog_text",
        "raw",
    )


def rejected_names(skills: DataFrame) -> DataFrame:
    return skills.where(F.exists("tools", lambda t: _refused(t["name"]))).select("skill_id", F.lit("tool name not allowed").alias("reason"))


_TOOL = "array<struct<name:string,description:string,input_schema:string,declared_permissions:array<string>,return_direct:boolean,is_async:boolean>>"


def python_skills(files: DataFrame) -> DataFrame:
    """Python files to skills, with the tools that they construct."""
    p = files.where("ext = '.py'")
    made = _constructed(p.select(F.col("path").alias("skill_id"), "path", "content"))
    out = p.select(F.col("path").alias("skill_id"), "dir", "stem").join(made, "skill_id", "left").join(sidecars(files), "dir", "left")
    return _plain(out.withColumn("tools", F.coalesce("tools", F.array().cast(_TOOL))), F.col("stem"))


def directory_skills(files: DataFrame) -> DataFrame:
    """(target, path, dir, content ...) of Python files and sidecars to one skill for each target, with the tools of all its files."""
    p = files.where("ext = '.py'").select(F.col("target").alias("skill_id"), "path", "content")
    own = p.select("skill_id").distinct().withColumn("dir", F.col("skill_id"))
    out = own.join(_constructed(p), "skill_id", "left").join(sidecars(files), "dir", "left")
    return _plain(out.withColumn("tools", F.coalesce("tools", F.array().cast(_TOOL))), F.lit(""))


def _constructed(sources: DataFrame) -> DataFrame:
    """(skill_id, path, content) to (skill_id, tools), by file and place."""
    t = pyfacts.tool_table(sources)
    one = F.struct("path", "tool_ord", F.struct("name", "description", F.lit("").alias("input_schema"), F.array().cast("array<string>").alias("declared_permissions"), "return_direct", F.lit(False).alias("is_async")).alias("t"))
    return t.groupBy("skill_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.t).alias("tools"))


def markdown_skills(files: DataFrame) -> DataFrame:
    """Markdown files to skills without tools."""
    m = files.where(F.col("ext").isin(".md", ".markdown"))
    return _plain(m.select(F.col("path").alias("skill_id"), "stem", F.col("content").alias("readme_text"), F.lit(None).cast("string").alias("changelog_text"), F.array().cast(_TOOL).alias("tools")), F.col("stem"))


def _plain(df: DataFrame, name: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(
        "skill_id", F.lit("langchain").alias("framework"), F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown_skill")).alias("skill_name"), null.alias("server_name"),
        null.alias("server_version"), F.lit(False).alias("dynamic_tools"), "tools", "readme_text", "changelog_text", F.lit(None).cast("variant").alias("raw"),
    )


def text_fields(skills: DataFrame) -> DataFrame:
    """(skill_id, field_ord, field_name, text): of each tool its name, description and schema strings, then README, change log and server name; empty ones of the latter go."""
    t = skills.select("skill_id", F.posexplode("tools").alias("t_ord", "t"))
    named = lambda part: F.concat(F.lit("tool:"), F.col("t.name"), F.lit(f":{part}"))
    own = t.select("skill_id", F.inline(F.array(
        F.struct((F.col("t_ord") * 1000).alias("field_ord"), named("name").alias("field_name"), F.col("t.name").alias("text")),
        F.struct((F.col("t_ord") * 1000 + 1).alias("field_ord"), named("description").alias("field_name"), F.col("t.description").alias("text")),
    )))
    schema = t.where(F.length("t.input_schema") > 0).select("skill_id", "t_ord", named("schema").alias("field_name"), F.posexplode(schema_strings_udf("t.input_schema")).alias("i", "text"))
    schema = schema.select("skill_id", (F.col("t_ord") * 1000 + 2 + F.col("i")).alias("field_ord"), "field_name", "text")
    last = 1_000_000_000
    rest = skills.select("skill_id", F.inline(F.filter(F.array(*[
        F.struct(F.lit(last + i).alias("field_ord"), F.lit(n).alias("field_name"), F.col(c).alias("text"))
        for i, (n, c) in enumerate((("readme_text", "readme_text"), ("changelog_text", "changelog_text"), ("mcp_server_name", "server_name")))
    ]), lambda f: F.length(f.text) > 0)))
    return own.unionByName(schema).unionByName(rest)


def dependencies(files: DataFrame, skills: DataFrame) -> DataFrame:
    """Dependencies of manifests, and of requirements.txt beside Python files."""
    stated = requirements.from_manifest(skills.where("raw IS NOT NULL").select("skill_id", "raw"))
    near = files.where("ext = '.py'").select(F.col("path").alias("skill_id"), "dir").join(sidecars(files).where("requirements_text IS NOT NULL"), "dir")
    return stated.unionByName(requirements.from_text(near.select("skill_id", F.col("requirements_text").alias("text"))))


def labels(files: DataFrame) -> DataFrame:
    """Expected verdicts written in files: a JSON key, an indented block, or a line of older files."""
    f = files.where(kind(F.col("ext")).isNotNull() & ~F.rlike(F.lower("name"), F.lit(r"-impl\.py$")) & (F.col("name") != "__init__.py"))
    meta = F.from_json(F.expr("to_json(try_variant_get(try_parse_json(content), '$._fixture_meta', 'variant'))"), "id string, expected_verdict string, attack_vectors array<string>, rules_expected array<string>")
    block = F.regexp_extract("content", r"(?m)_fixture_meta\s*:\s*\n((?:[ \t]+\S[^\n]*\n)+)", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^\s*{k}\s*:\s*(.*)$", 1)), F.lit(""))
    items = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    old = F.nullif(F.regexp_extract("content", r"(?i)Expected verdict:\s*(\w+)", 1), F.lit(""))
    old_vectors = F.regexp_extract("content", r"(?i)Attack vectors?:\s*([^\n]+)", 1)
    js = F.col("ext") == ".json"
    none = F.array().cast("array<string>")
    f = f.withColumn("meta", F.when(js, meta)).withColumn("block", F.when(~js, block).otherwise(""))
    has = F.col("block") != ""
    return f.where(F.when(js, F.col("meta").isNotNull()).otherwise(has | old.isNotNull())).select(
        F.col("path").alias("skill_id"),
        F.coalesce(F.when(js, F.col("meta.id")).when(has, key("id")), F.col("stem")).alias("fixture_id"),
        F.upper(F.when(js, F.coalesce("meta.expected_verdict", F.lit("BLOCK"))).when(has, F.coalesce(key("expected_verdict"), F.lit("BLOCK"))).otherwise(old)).alias("expected_verdict"),
        F.coalesce(F.when(js, F.col("meta.attack_vectors")).when(has, items(key("attack_vectors"))).otherwise(items(old_vectors)), none).alias("attack_vectors"),
        F.coalesce(F.when(js, F.col("meta.rules_expected")).when(has, items(key("rules_expected"))), none).alias("rules_expected"),
    )


#: What a fetched file may be long in bytes.
LANDED_BYTES = 10 * 1024 * 1024


def landed(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetched targets (url, content) to files and rejects: the raw file's address is the path, with .md after it if it ends in no kind that is scanned.

    The fetch itself is a job outside: no query calls a service.
    """
    bare = F.substring_index(github_raw(F.col("url")), "?", 1)
    named = fetched.select("url", F.when(F.rlike(F.lower(bare), F.lit(r"[^/]\.(json|py|md|markdown)$")), bare).otherwise(F.concat(bare, F.lit(".md"))).alias("path"), "content")
    small = F.octet_length("content") <= LANDED_BYTES
    return describe(named.where(small)), named.where(~small).select("path", F.lit("longer than a fetched file may be").alias("reason"))
