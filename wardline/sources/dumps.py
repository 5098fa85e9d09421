"""Landed dumps of advisories and package releases: JSON documents, one a file, in any store that Spark reads.

Files are read by Spark, one partition for a few of them, and taken apart by native functions. A file over ``MAX_BYTES`` is not
read at all; it and whatever is no document of its kind are reject rows. Nothing is fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators import versions as V

#: What a dumped document may be long in bytes.
MAX_BYTES = 64 * 1024 * 1024


def documents(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """((path, content), rejects) of the JSON files under ``folder``; the content of longer ones stays where it is."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    text = F.col("content").cast("string")
    small = f.where(F.col("length") <= max_bytes).select("path", F.when(F.is_valid_utf8(text), text).alias("content"))
    return small, f.where(F.col("length") > max_bytes).select("path", F.lit("longer than a dumped document may be").alias("reason"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _listed(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.expr("array()").cast("array<variant>"))


def _parsed(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.try_parse_json("content").alias("v"))


def _reasons(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """(path, reason) of what is no JSON or lacks a field that has to be there."""
    p = _parsed(docs)
    reason = F.when(F.col("v").isNull(), "not JSON")
    for path, kind in names.items():
        reason = reason.when(_get(F.col("v"), path, kind).isNull(), f"no {path[2:]}")
    return p.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def advisory_rejects(docs: DataFrame) -> DataFrame:
    return _reasons(docs, {"$.id": "string", "$.affected": "array<variant>"})


def _intervals(eco: Column, events: Column) -> Column:
    """Events of a range, in any order, to intervals: each introduction lasts to the first event after it that ends it."""

    def event(e: Column) -> Column:
        first, fixed, last = (_get(e, f"$.{k}", "string") for k in ("introduced", "fixed", "last_affected"))
        value = F.coalesce(first, fixed, last)
        # Of events at one version an end comes first: what is fixed there may be introduced anew there.
        rank = F.when(fixed.isNotNull(), 0).when(first.isNotNull(), 1).otherwise(2)
        return F.struct(F.when(value == "0", F.lit("")).otherwise(V.key(eco, value)).alias("key"), rank.alias("rank"), value.alias("value"))

    ordered = F.array_sort(F.filter(F.transform(events, event), lambda e: e.value.isNotNull()))

    def of(es: Column) -> Column:
        def interval(e: Column, i: Column) -> Column:
            end = F.get(F.filter(es, lambda x, j: (j > i) & (x.rank != 1)), F.lit(0))
            return F.when(e.rank == 1, F.struct(e.value.alias("introduced"), F.when(end["rank"] == 0, end["value"]).alias("fixed"), F.when(end["rank"] == 2, end["value"]).alias("last_affected")))

        return F.filter(F.transform(es, interval), lambda x: x.isNotNull())

    return let(ordered, of)


def advisories(docs: DataFrame) -> DataFrame:
    """(path, content) to rows as ``deps.advise`` takes them: (ecosystem, name, version, introduced, fixed, last_affected, advisory_id).

    A row for each listed version and each interval of an affected package; a package with neither has one row, for every version. The
    id is the first alias that is a CVE, else the document's. Ranges of commits are left out: they name no versions.
    """
    v = F.col("v")
    cve = F.get(F.filter(F.coalesce(_get(v, "$.aliases", "array<string>"), F.array().cast("array<string>")), lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(0))
    p = _parsed(docs).where(_get(v, "$.id", "string").isNotNull())
    p = p.select(F.coalesce(cve, _get(v, "$.id", "string")).alias("advisory_id"), F.explode_outer(_listed(v, "$.affected")).alias("a")).where("a IS NOT NULL")
    a = F.col("a")
    p = p.select("advisory_id", _get(a, "$.package.ecosystem", "string").alias("ecosystem"), _get(a, "$.package.name", "string").alias("name"),
                 F.coalesce(_get(a, "$.versions", "array<string>"), F.array().cast("array<string>")).alias("versions"), _listed(a, "$.ranges").alias("ranges")).where("name IS NOT NULL")
    no = F.lit(None).cast("string")
    row = lambda version, introduced, fixed, last: F.struct(version.alias("version"), introduced.alias("introduced"), fixed.alias("fixed"), last.alias("last_affected"))
    kept = F.filter("ranges", lambda r: F.coalesce(_get(r, "$.type", "string"), F.lit("")) != "GIT")
    spans = F.flatten(F.transform(kept, lambda r: _intervals(F.col("ecosystem"), _listed(r, "$.events"))))
    rows = F.concat(F.transform("versions", lambda x: row(x, no, no, no)), F.transform(spans, lambda s: row(no, s.introduced, s.fixed, s.last_affected)))
    whole = F.array(row(no, no, no, no))
    out = p.select("ecosystem", "name", "advisory_id", F.explode_outer(let(rows, lambda x: F.when((F.size(x) == 0) & (F.size("ranges") == 0), whole).otherwise(x))).alias("r"))
    return out.where("r IS NOT NULL").select("ecosystem", "name", "r.version", "r.introduced", "r.fixed", "r.last_affected", "advisory_id")


def release_rejects(docs: DataFrame) -> DataFrame:
    return _reasons(docs, {"$.info.name": "string", "$.releases": "map<string,variant>"})


def releases(docs: DataFrame) -> DataFrame:
    """(path, content) of package documents to (ecosystem, name, version, upload_time): the first upload of each version that has one."""
    v = F.col("v")
    p = _parsed(docs).select(_get(v, "$.info.name", "string").alias("name"), F.explode_outer(_get(v, "$.releases", "map<string,array<variant>>")).alias("version", "files")).where("name IS NOT NULL AND version IS NOT NULL")
    times = F.transform("files", lambda f: F.try_to_timestamp(F.coalesce(_get(f, "$.upload_time_iso_8601", "string"), _get(f, "$.upload_time", "string"))))
    return p.select(F.lit("pypi").alias("ecosystem"), "name", "version", F.array_min(F.coalesce(times, F.array().cast("array<timestamp>"))).alias("upload_time")).where("upload_time IS NOT NULL")
