"""Rules on text fields: (skill_id, field_ord, field_name, text) to findings.

All rules of a field are evaluated in one projection over the array of its decoded variants;
the first variant that a rule fits wins, within the row, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X

HIT = "struct<variant_ord:int,stage:int,rule_ord:int,rule_id:string,confidence:double,snippet:string>"
FINDING = "skill_id string, layer int, ord array<int>, rule_id string, confidence double, file_path string, line_number int, field_name string, snippet string, rationale string, severity string, attack_vector string"
_BASE = {r[0]: r[3] for r in R.RULES}


def with_variants(fields: DataFrame, decode: bool = True) -> DataFrame:
    """Adds ``variants``; without ``decode`` only the text itself, normalised natively."""
    if decode:
        return fields.withColumn("variants", X.variants_of(F.col("text")))
    none = F.lit(None).cast("int")
    return fields.withColumn("variants", F.array(F.struct(F.lit(0).alias("ord"), F.lit("raw").alias("label"), X.normalize_native(F.col("text")).alias("norm"), none.alias("b64_from"), none.alias("b64_to"))))


def _regex(p: str) -> Column:
    return F.lit(f"(?isU){p}")


def pattern_ord(norm: Column, rule: str) -> Column:
    """Number of the first pattern of a rule that fits, or null."""
    out = F.lit(None).cast("int")
    for n, p in reversed(list(enumerate(R.TEXT_PATTERNS[rule]))):
        out = F.when(X.any_phrase(norm, R.PATTERN_NEEDS[rule][n]) & F.rlike(norm, _regex(p)), n).otherwise(out)
    return out


@X.once
def pattern_hits(name: str) -> Column:
    """(rule_id, pattern_ord) of the rules whose patterns fit the column of this name."""
    h = [F.struct(F.lit(r).alias("rule_id"), pattern_ord(F.col(name), r).alias("pattern_ord")) for r in R.TEXT_PATTERNS]
    return F.filter(F.array(*h), lambda x: x.pattern_ord.isNotNull())


def _snippet(v: Column, rule: str, n: Column) -> Column:
    # where the match begins: after what is left of the text before it; evaluated for hits only
    found = F.regexp_substr(v.norm, F.get(F.array(*map(_regex, R.TEXT_PATTERNS[rule])), n))
    out = X.let(found, lambda m: X.window_around(v.norm, F.instr(v.norm, m), F.length(m)))
    if rule == "PI-005":
        out = F.when(n == len(R.TEXT_PATTERNS[rule]), X.window_around(v.norm, v.b64_from + 1, v.b64_to - v.b64_from)).otherwise(out)
    return out


def _by_rule(variants: Column, rule: str, rule_ord: int) -> Column:
    """The first hit of one rule, as an array of at most one; its confidence is the rule's own."""

    def of(v: Column) -> Column:
        n = pattern_ord(v.norm, rule) if rule in R.TEXT_PATTERNS else F.lit(None).cast("int")
        if rule == "PI-005":
            n = F.coalesce(n, F.when(v.b64_from.isNotNull(), len(R.TEXT_PATTERNS[rule])))
        by_template = X.intent(v.norm, rule) if rule in X.TEMPLATE_NAMES else F.lit(False)

        def hit(n: Column) -> Column:
            by_pattern = n.isNotNull()
            told = F.when(by_pattern, F.concat(F.lit("pattern_match; variant="), v.label, F.lit("; "), _snippet(v, rule, n))).otherwise(
                F.concat(F.lit(f"{X.TEMPLATE_NAMES.get(rule, '')}; variant="), v.label, F.lit("; "), X.window_around(v.norm, F.lit(1), F.least(F.lit(180), F.length(v.norm))))
            )
            return F.when(
                (F.length(v.norm) > 0) & (by_pattern | by_template),
                F.struct(
                    v.ord.alias("variant_ord"),
                    F.when(by_pattern, 0).otherwise(1).alias("stage"),
                    F.lit(rule_ord).alias("rule_ord"),
                    F.lit(rule).alias("rule_id"),
                    F.lit(_BASE[rule]).alias("confidence"),
                    F.substring(F.trim(told), 1, 220).alias("snippet"),
                ).cast(HIT),
            )

        return X.let(n, hit)

    return F.slice(F.filter(F.transform(variants, of), lambda h: h.isNotNull()), 1, 1)


def _scaled(found: Column, variants: Column) -> Column:
    """Hits with their confidence scaled by the variant they were found in; one expression for all rules keeps the plan small."""

    def scale(h: Column) -> Column:
        by = X.let(F.get(variants, h.variant_ord), lambda v: X.multiplier(v.norm, v.label))
        return h.withField("confidence", F.least(F.lit(1.0), h.confidence * by))

    return F.transform(found, scale)


def _constant(cond: Column, variant_ord: int, stage: int, rule: str, snippet: Column) -> Column:
    """A rule on the raw text, whose confidence is not scaled."""
    hit = F.struct(F.lit(variant_ord), F.lit(stage), F.lit(0), F.lit(rule), F.lit(_BASE[rule]), snippet).cast(HIT)
    return F.when(cond, F.array(hit)).otherwise(F.array().cast(f"array<{HIT}>"))


@X.once
def _found() -> Column:
    """The hits of a row, from its ``text``, ``field_name`` and ``variants``."""
    order = ("PI-001", "PI-002", "PI-004", "PI-005", "PI-008", "PI-009")
    shown = F.transform(
        F.slice(F.filter(F.split("text", ""), lambda c: F.rlike(c, F.lit(f"[{R.INVISIBLE}]"))), 1, 6),
        lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")),
    )
    invisible = _constant(F.rlike("text", F.lit(f"[{R.INVISIBLE}]")), -1, 0, "PI-003", F.concat(F.lit("Invisible codepoints: "), F.array_join(shown, " ")))
    is_name = F.endswith("field_name", F.lit(":name")) | (F.col("field_name") == "mcp_server_name")
    lookalike = _constant(is_name & F.rlike("text", F.lit(R.LOOKALIKE_CLASS)), 99, 0, "PI-006", F.col("text"))
    variants = F.col("variants")
    by_rule = F.concat(*[_by_rule(variants, r, i) for i, r in enumerate(order)])
    return F.concat(invisible, _scaled(by_rule, variants), lookalike)


def hits(fields: DataFrame, decode: bool = True) -> DataFrame:
    """A row for each field and rule that fits."""
    v = with_variants(fields.where(F.col("text").isNotNull()), decode)
    return v.select("skill_id", "field_ord", "field_name", F.inline(_found()))


def hits_of_copies(fields: DataFrame, decode: bool = True) -> DataFrame:
    """``hits`` where many fields hold the same text: each distinct text is decoded and matched once, and its hits meet the fields by hash.

    Copies are dropped within tasks before a text is shuffled; fields travel without their texts.
    """
    is_name = F.endswith("field_name", F.lit(":name")) | (F.col("field_name") == "mcp_server_name")
    f = fields.where(F.col("text").isNotNull()).withColumn("text_key", F.concat(F.sha2("text", 256), F.when(is_name, "n").otherwise("t")))
    one = f.groupBy("text_key").agg(F.first("text").alias("text"))
    name = F.when(F.endswith("text_key", F.lit("n")), ":name").otherwise("")
    found = hits(one.select(F.col("text_key").alias("skill_id"), F.lit(0).alias("field_ord"), name.alias("field_name"), "text"), decode)
    found = found.withColumnRenamed("skill_id", "text_key").drop("field_ord", "field_name")
    return f.select("skill_id", "field_ord", "field_name", "text_key").join(found, "text_key").drop("text_key")


def findings(fields: DataFrame, decode: bool = True, copies: bool = False) -> DataFrame:
    """``copies``: by ``hits_of_copies``, which says the same."""
    h = (hits_of_copies if copies else hits)(fields, decode)
    null = F.lit(None).cast("string")
    return h.select(
        "skill_id", F.lit(1).alias("layer"), F.array(F.lit(0), "field_ord", "variant_ord", "stage", "rule_ord").alias("ord"), "rule_id", "confidence", null.alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), "field_name", "snippet", null.alias("rationale"), null.alias("severity"), null.alias("attack_vector"),
    )


def dynamic_tools(skills: DataFrame) -> DataFrame:
    """(skill_id, dynamic_tools) to SC-007 findings."""
    null = F.lit(None).cast("string")
    return skills.where("dynamic_tools").select(
        "skill_id", F.lit(1).alias("layer"), F.array(F.lit(1)).alias("ord"), F.lit("SC-007").alias("rule_id"), F.lit(_BASE["SC-007"]).alias("confidence"), null.alias("file_path"),
        F.lit(None).cast("int").alias("line_number"), F.lit("mcp_supports_dynamic_tools").alias("field_name"), F.lit("tools.listChanged=true").alias("snippet"),
        null.alias("rationale"), null.alias("severity"), null.alias("attack_vector"),
    )


def provenance(skills: DataFrame, min_age_days: int = 30) -> DataFrame:
    """Extension, off in the scan: SC-001, SC-002, SC-005 and SC-006 on (skill_id, source_url, package_age_days, maintainer_count, publisher_verified)."""
    checks = {
        "SC-001": F.col("source_url").isNotNull() & ~F.startswith("source_url", F.lit("https://")),
        "SC-002": F.rlike("source_url", F.lit(r"^[a-z]+://\d{1,3}(\.\d{1,3}){3}([:/]|$)")),
        "SC-005": F.col("package_age_days") < min_age_days,
        "SC-006": (F.col("maintainer_count") == 1) & ~F.col("publisher_verified"),
    }
    return skills.select("skill_id", X.each_hit(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()])).alias("rule_id")).where("rule_id IS NOT NULL")


#: More tools, or more characters of their descriptions, than an agent's context should take.
MAX_TOOLS, MAX_DESCRIPTIONS = 50, 50_000


def tool_flood(skills: DataFrame) -> DataFrame:
    """Extension, off in the scan: TOOL-COUNT-001, (skill_id, rule_id, n_tools, description_chars) of skills with too many tools or too long descriptions."""
    chars = F.aggregate("tools", F.lit(0).cast("long"), lambda n, t: n + F.length(F.coalesce(t.description, F.lit(""))))
    counted = skills.select("skill_id", F.lit("TOOL-COUNT-001").alias("rule_id"), F.greatest(F.size("tools"), F.lit(0)).alias("n_tools"), F.coalesce(chars, F.lit(0).cast("long")).alias("description_chars"))
    return counted.where((F.col("n_tools") > MAX_TOOLS) | (F.col("description_chars") > MAX_DESCRIPTIONS))
