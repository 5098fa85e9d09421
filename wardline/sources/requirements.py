"""Requirement lines as columns, without Python: one pass of regular expressions a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

NAME = "[A-Za-z0-9][A-Za-z0-9_.-]*"
_WS = " \t\r\n\x0b\x0c"


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WS))


def parse(line: Column) -> Column:
    """A requirement line as struct(name, version_spec, pinned_hash), or null where it declares nothing."""
    cut = _strip(F.regexp_replace(_strip(line), r"(?s) #.*$", ""))
    return let(cut, lambda raw: let(_strip(F.regexp_replace(F.regexp_replace(raw, r"(?s)--hash=.*$", ""), r"(?s);.*$", "")), lambda rest: _entry(_strip(line), raw, rest)))


def _entry(line: Column, raw: Column, rest: Column) -> Column:
    """``raw``: without comments; ``rest``: without hash and markers, either."""
    no = F.lit(None).cast("string")
    vcs = F.startswith(raw, F.lit("git+")) | F.startswith(raw, F.lit("-e "))
    egg = F.nullif(F.regexp_extract(raw, f"#egg=({NAME})", 1), F.lit(""))
    direct = rf"(?s)^({NAME})\s*@\s*(.+)$"
    pinned = F.nullif(F.regexp_extract(raw, r"(?s)--hash=\s*(\S+)", 1), F.lit(""))
    name = F.nullif(F.regexp_extract(rest, f"^({NAME})", 1), F.lit(""))
    spec = F.nullif(_strip(F.regexp_replace(rest, f"^{NAME}", "")), F.lit(""))

    def entry(n: Column, v: Column, h: Column) -> Column:
        return F.when(n.isNotNull(), F.struct(n.alias("name"), v.alias("version_spec"), h.alias("pinned_hash")))

    return (
        F.when((raw == "") | F.startswith(line, F.lit("#")), F.lit(None))
        .when(vcs, entry(egg, no, no))
        .when(F.startswith(raw, F.lit("-")), F.lit(None))
        .when(F.rlike(raw, F.lit(direct)), entry(F.regexp_extract(raw, direct, 1), F.concat(F.lit("@ "), F.regexp_extract(raw, direct, 2)), no))
        .otherwise(entry(name, spec, pinned))
    )


def dependencies(lines: DataFrame) -> DataFrame:
    """(skill_id, dep_ord, line) to dependencies; lines that declare nothing go."""
    return lines.select("skill_id", "dep_ord", parse(F.col("line")).alias("d")).where("d IS NOT NULL").select("skill_id", "dep_ord", "d.*", F.lit("pypi").alias("ecosystem"))


def from_text(files: DataFrame) -> DataFrame:
    """(skill_id, text of a requirements file) to dependencies."""
    lines = files.select("skill_id", F.posexplode(F.split("text", r"\r\n|\n|\r|\x0b|\x0c")).alias("dep_ord", "line"))
    return dependencies(lines)


def from_manifest(manifests: DataFrame) -> DataFrame:
    """(skill_id, raw VARIANT) to dependencies: the lists under ``dependencies``, then ``requirements_txt``.

    Strings only; whatever the ecosystem's key, entries count as pypi.
    """
    listed = manifests.select(
        "skill_id",
        F.expr("filter(flatten(map_values(try_variant_get(raw, '$.dependencies', 'map<string,array<variant>>'))), v -> schema_of_variant(v) = 'STRING')").alias("vs"),
        F.expr("try_variant_get(raw, '$.requirements_txt', 'string')").alias("txt"),
    )
    line = F.concat(
        F.coalesce(F.transform("vs", lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>")),
        F.coalesce(F.split("txt", r"\r\n|\n|\r"), F.array().cast("array<string>")),
    )
    return dependencies(listed.select("skill_id", F.posexplode(line).alias("dep_ord", "line")))


def pinned_version(spec: Column) -> Column:
    """The version of an exact pin, else null."""
    return F.when(F.startswith(F.trim(spec), F.lit("==")), F.nullif(F.trim(F.substring(F.trim(spec), 3, 1_000_000)), F.lit("")))


def advisory_ecosystem(ecosystem: Column) -> Column:
    """Names of ecosystems as advisories write them."""
    return F.when(ecosystem == "pypi", "PyPI").when(ecosystem == "cargo", "crates.io").when(ecosystem == "go", "Go").otherwise(ecosystem)
