"""Supply-chain rules on dependencies: (skill_id, dep_ord, name, version_spec, pinned_hash, ecosystem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import text as X
from ..sources import requirements as Q
from . import versions as V

MAX_DISTANCE = 2
_BASE = {r[0]: r[3] for r in R.RULES}


def normalized_name(name: Column, ascii_only: bool = False) -> Column:
    """Names as compared. Names from requirement lines are ASCII, where native functions do; of others only those that are not go to Python."""
    native = F.lower(F.replace(name, F.lit("_"), F.lit("-")))
    is_ascii = F.rlike(name, F.lit(r"^[\x00-\x7F]*$"))
    return native if ascii_only else F.when(is_ascii, native).otherwise(X.package_name_udf(F.when(~is_ascii, name)))


def typosquats(deps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(norm_name, typosquat_of, distance) for each distinct unknown name near a known one; ties go to the first name.

    ``known`` (name): a registry's names, in any script, met through ``look_alikes``. Without it the fixed list is a literal and distances are taken once a
    distinct name, with no join at all: on an aggregate of the name, since a filter on the group's own key would be pushed below the grouping, to every row.
    """
    of = lambda df: df.select(normalized_name(F.col("name"), known is None).alias("norm_name"))
    names = of(deps)
    if known is not None:
        return look_alikes(names, of(known))
    fixed = X.constants(R.KNOWN_PACKAGES)
    unknown = names.where(~F.array_contains(fixed, F.col("norm_name"))).groupBy("norm_name").agg(F.max("norm_name").alias("one"))
    near = F.filter(
        F.transform(fixed, lambda k: F.struct(F.levenshtein(F.col("one"), k, MAX_DISTANCE).alias("distance"), k.alias("typosquat_of"))),
        lambda s: s.distance >= 0,
    )
    return unknown.select("norm_name", F.array_min(near).alias("n")).where("n IS NOT NULL").select("norm_name", "n.typosquat_of", "n.distance")


def shortened(name: Column, by: int = MAX_DISTANCE) -> Column:
    """A name and all it becomes when up to ``by`` of its characters go."""

    def one_less(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.length(s))))
        return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))

    level = every = F.array(name)
    for _ in range(by):
        level = F.array_distinct(F.flatten(F.transform(level, one_less)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def look_alikes(names: DataFrame, known: DataFrame) -> DataFrame:
    """``typosquats`` against any number of known names, both (norm_name), by an index of shortened names.

    Two names at most two edits apart share what is left when up to two characters of each go, so candidates meet by
    equality and only they are compared. Names longer than the longest known one by more than two have no candidate and are not
    shortened. Names that are known go first, by an anti join; repeats before either.
    """
    known = known.where("norm_name IS NOT NULL").distinct()
    asked = names.where("norm_name IS NOT NULL").distinct().join(known, "norm_name", "left_anti")
    longest = known.agg(F.max(F.length("norm_name"))).first()[0]
    asked = asked.where(F.length("norm_name") <= (longest or 0) + MAX_DISTANCE)
    by_short = lambda df, name: df.select(F.col("norm_name").alias(name), F.explode(shortened(F.col("norm_name"))).alias("short"))
    met = by_short(asked, "norm_name").join(by_short(known, "typosquat_of"), "short")
    met = met.where(F.abs(F.length("norm_name") - F.length("typosquat_of")) <= MAX_DISTANCE)
    near = met.select("norm_name", F.struct(F.levenshtein("norm_name", "typosquat_of", MAX_DISTANCE).alias("distance"), "typosquat_of").alias("n")).where("n.distance >= 0")
    return near.groupBy("norm_name").agg(F.min("n").alias("n")).select("norm_name", "n.typosquat_of", "n.distance")


#: Pieces that the pins of a name are dealt to, and that advisories go to all of.
PIECES = 8
_RANGE = ("introduced", "fixed", "last_affected")


def advised(asked: DataFrame, advisories: DataFrame) -> DataFrame:
    """(eco, name, pin) to (eco, name, pin, advisory_id): advisories that affect the version, or any version where none is pinned.

    An advisory row names one ``version``, or a range by ``introduced``, ``fixed`` and ``last_affected`` (columns that may be absent), or neither,
    which is every version. Versions and bounds become keys whose order is that of versions, once for each distinct one. The join
    is by name and piece: the pins of a name with very many versions are spread over ``PIECES`` tasks, advisories are few and go to each.
    """
    a = advisories.select(
        F.col("ecosystem").alias("eco"), "name", F.col("version").alias("adv_version"), "advisory_id", *[(F.col(c) if c in advisories.columns else F.lit(None).cast("string")).alias(c) for c in _RANGE],
    )
    first = F.when(F.trim("introduced") != "0", F.col("introduced"))
    bounds = {"introduced": first, "fixed": F.col("fixed"), "last_affected": F.col("last_affected")}
    ranged = F.coalesce("introduced", "fixed", "last_affected").isNotNull()
    a = a.select("eco", "name", "adv_version", "advisory_id", ranged.alias("ranged"), V.key(F.col("eco"), F.col("adv_version")).alias("adv_key"), *[V.key(F.col("eco"), c).alias(n) for n, c in bounds.items()])
    a = a.withColumns({c: F.when(V.ordered(F.col(c)), F.col(c)) for c in _RANGE})  # a bound that is no version does not bound
    a = a.withColumn("piece", F.explode(F.array(*[F.lit(i) for i in range(PIECES)])))
    pins = asked.select("eco", "name", "pin", V.key(F.col("eco"), F.col("pin")).alias("pin_key"), F.pmod(F.xxhash64("pin"), F.lit(PIECES)).cast("int").alias("piece"))
    in_range = V.within(F.col("pin_key"), *[F.col(c) for c in _RANGE])
    affected = F.when(F.col("pin").isNull(), True).when(F.col("ranged"), in_range | F.coalesce(F.col("adv_key") == F.col("pin_key"), F.lit(False))).otherwise(F.col("adv_version").isNull() | (F.col("adv_key") == F.col("pin_key")))
    return pins.join(a, ["eco", "name", "piece"]).where(affected).select("eco", "name", "pin", "advisory_id")


def advise(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Adds ``known_cve_ids``: advisories of the name (and, where pinned, the version), sorted."""
    keyed = deps.withColumn("eco", Q.advisory_ecosystem(F.col("ecosystem"))).withColumn("pin", Q.pinned_version(F.col("version_spec")))
    found = advised(keyed.select("eco", "name", "pin").distinct(), advisories)
    ids = found.groupBy("eco", "name", "pin").agg(F.array_sort(F.collect_set("advisory_id")).alias("ids"))
    ids = ids.select(F.col("eco").alias("e2"), F.col("name").alias("n2"), F.col("pin").alias("p2"), "ids")
    on = (F.col("eco") == F.col("e2")) & (F.col("name") == F.col("n2")) & F.col("pin").eqNullSafe(F.col("p2"))
    return keyed.join(ids, on, "left").withColumn("known_cve_ids", F.coalesce("ids", F.array().cast("array<string>"))).select(*deps.columns, "known_cve_ids")


def with_age(deps: DataFrame, releases: DataFrame, now: Column) -> DataFrame:
    """Adds ``age_days`` of a name's first release and ``osv_risk_score`` = max(0, 1 - age / 365)."""
    first = releases.groupBy("ecosystem", "name").agg(F.min("upload_time").alias("first_release"))
    out = deps.join(first, ["ecosystem", "name"], "left").withColumn("age_days", F.datediff(now, "first_release").cast("long"))
    return out.withColumn("osv_risk_score", F.greatest(F.lit(0.0), F.lit(1.0) - F.col("age_days") / 365.0)).select(*deps.columns, "age_days", "osv_risk_score")


def unpinned(deps: DataFrame) -> DataFrame:
    """(skill_id, n_unpinned) for skills with a dependency without a hash."""
    return deps.groupBy("skill_id").agg(F.count_if(F.col("pinned_hash").isNull()).alias("n_unpinned")).where("n_unpinned > 0")


def counts(deps: DataFrame, advisories: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(skill_id, advisory_count, typosquat_count): every advisory of every dependency, and every dependency near a known name, repeats too."""
    near = deps.withColumn("norm_name", normalized_name(F.col("name"), packages is None)).join(typosquats(deps, known=packages).select("norm_name", F.lit(1).alias("is_near")), "norm_name", "left")
    known = advise(near, advisories) if advisories is not None else near.withColumn("known_cve_ids", F.array().cast("array<string>"))
    return known.groupBy("skill_id").agg(F.sum(F.size("known_cve_ids")).cast("long").alias("advisory_count"), F.count("is_near").alias("typosquat_count"))


def findings(deps: DataFrame, advisories: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """``packages`` (name): the known names of a registry, in place of the fixed list."""
    null = F.lit(None).cast("string")

    def shape(df: DataFrame, order: Column, rule: str, snippet: Column) -> DataFrame:
        return df.select(
            "skill_id", F.lit(1).alias("layer"), order.alias("ord"), F.lit(rule).alias("rule_id"), F.lit(_BASE[rule]).alias("confidence"), null.alias("file_path"),
            F.lit(None).cast("int").alias("line_number"), F.lit("dependencies").alias("field_name"), snippet.alias("snippet"), null.alias("rationale"),
            null.alias("severity"), null.alias("attack_vector"),
        )

    some = shape(unpinned(deps), F.array(F.lit(2)), "SC-004", F.concat(F.col("n_unpinned").cast("string"), F.lit(" dependency entries without hash pinning")))
    near = deps.withColumn("norm_name", normalized_name(F.col("name"), packages is None)).join(typosquats(deps, known=packages), "norm_name")
    squat = shape(near, F.array(F.lit(3), "dep_ord", F.lit(0)), "SC-003", F.concat(F.col("name"), F.lit(" resembles "), F.col("typosquat_of")))
    out = some.unionByName(squat)
    if advisories is not None:
        known = advise(deps, advisories).where(F.size("known_cve_ids") > 0)
        out = out.unionByName(shape(known, F.array(F.lit(3), "dep_ord", F.lit(1)), "SC-008", F.concat(F.col("name"), F.lit(": "), F.array_join("known_cve_ids", ", "))))
    return out
