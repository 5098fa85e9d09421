"""URL filters with an index on each rule's rarest literal token.

Every rule is a regular expression with literal tokens that any URL it fits must hold. A rule
stands in the index under the one of its tokens that is rarest among the URLs' own tokens, or under each of its alternatives. The
tokens of a URL fetch candidate rules, and only those run as regular expressions. Patterns take an upper-case letter of the path
for a separator, so a path is cut into tokens twice: in lower case, and at its upper-case letters.

Rules and index are tables. URLs are exploded into their tokens, which meet blocks of at most ``BLOCK_RULES`` index rows by
broadcast, so that a token which all URLs share is no hot key; the rows of a URL come from one task, are summed up there, and one row for
each URL is shuffled, whatever the number of rules.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is allowed; null ids stay null; repeated rows stay repeated; an empty table gives no rows; other
columns are not read; of rules of one rank the last by name wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

#: Index rows in a broadcast block; a row is a token and a pattern.
BLOCK_RULES = 100_000
TOKEN_SPLIT = "[^a-z0-9]+"
#: Ranks from here on are those of site rules.
SITE_RANK = 1_000


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    pattern: str  # on host + path, host in lower case
    tokens: tuple[str, ...]  # whole tokens, in lower case, that every fitting URL holds; of alternatives (a|b) it holds one
    rank: int  # the largest rank wins


#: Host and path rules; the longest that fits wins.
SITE_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: What the method blocks besides: word patterns in the host or path.
WORD_RULES = (
    ("casino", r"(^|[^a-z0-9])casinos?([^a-z0-9]|$)", ("casino|casinos",)),
    ("slots", r"(^|[^a-z0-9])(online|free)-slots([^a-z0-9]|$)", ("slots",)),
    ("bets", r"(^|[^a-z0-9])(free|best|sport|sports)-bets([^a-z0-9]|$)", ("bets",)),
    ("betting", r"(^|[^a-z0-9])(sports?|online)-?betting([^a-z0-9]|$)", ("betting|sportbetting|sportsbetting|onlinebetting",)),
    ("pills", r"(^|[^a-z0-9])(cheap|diet)-pills([^a-z0-9]|$)", ("pills",)),
    ("viagra", r"(^|[^a-z0-9])(viagra|cialis)([^a-z0-9]|$)", ("viagra|cialis",)),
    ("poker", r"(^|[^a-z0-9])poker([^a-z0-9]|$)", ("poker",)),
    ("xxx", r"(^|[^a-z0-9])xxx([^a-z0-9]|$)", ("xxx",)),
    ("porn", r"(^|[^a-z0-9])porno?([^a-z0-9]|$)", ("porn|porno",)),
    ("payday", r"(^|[^a-z0-9])payday-loans?([^a-z0-9]|$)", ("payday",)),
    ("escorts", r"(^|[^a-z0-9])escorts([^a-z0-9]|$)", ("escorts",)),
    ("warez", r"(^|[^a-z0-9])warez([^a-z0-9]|$)", ("warez",)),
)


def site_rule(text: str, action: str) -> Rule:
    """A rule for a host, its subdomains and paths that start alike."""
    host, _, rest = text.partition("/")
    whole = rest.split("/")[:-1]  # the last part is a prefix of a token, perhaps not a whole one
    tokens = tuple(t for part in [*host.split("."), *whole] for t in re.split(TOKEN_SPLIT, part.lower()) if t)
    return Rule(text, action, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(rest)}", tokens, SITE_RANK + len(text))


def default_rules() -> list[Rule]:
    return [site_rule(t, a) for t, a in SITE_RULES] + [Rule(n, "block", p, t, 0) for n, p, t in WORD_RULES]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """name, action, pattern, tokens, rank: the form in which rules may also be read from a table."""
    return spark.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.rank) for r in rules], "name string, action string, pattern string, tokens array<string>, rank int")


def _parts(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat_ws("/", host, ascii_lower(path), path), TOKEN_SPLIT), lambda t: t != ""))


def _fetch(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """The inner join by ``token`` with a written table, a broadcast block of it at a time."""
    blocks = 1 + table.count() // BLOCK_RULES
    # A token with more rows than a block holds is dealt out over them by its row.
    of = F.pmod(F.xxhash64(*table.columns), F.lit(blocks))
    return reduce(DataFrame.unionByName, [tokens.join(F.broadcast(table.where(of == i) if blocks > 1 else table), "token") for i in range(blocks)])


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """token, no, rank, name, action, pattern: each rule (``no``) under its rarest token among ``urls`` (host, path), or each alternative of it.

    Ties go to the longer token, then the first.
    """
    numbered = checkpointed(rules.select(F.monotonically_increasing_id().alias("no"), "rank", "name", "action", "pattern", "tokens"))
    slots = numbered.select("no", F.explode("tokens").alias("slot"))
    if not numbered.where("coalesce(size(tokens), 0) < 1").isEmpty():
        raise ValueError("every rule needs a literal token")
    each = slots.select("slot", F.explode(F.split("slot", r"\|")).alias("token")).distinct()
    held = urls.select(F.explode_outer(_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = _fetch(held, checkpointed(each.select("token").distinct())).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    by_slot = each.join(counts, "token", "left").groupBy("slot").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    best = slots.join(by_slot, "slot").groupBy("no").agg(F.min(F.struct("n", (-F.length("slot")).alias("short"), "slot")).alias("best"))
    return numbered.join(best, "no").select(F.explode(F.split("best.slot", r"\|")).alias("token"), "no", "rank", "name", "action", "pattern")


def judge(urls: DataFrame, rules: list[Rule] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the fitting site rule), verdict, reason (the rule that decided) and n_candidates."""
    if not isinstance(rules, DataFrame):
        rules = rule_table(urls.sparkSession, default_rules() if rules is None else rules)
    host, path = _parts(F.col("url"))
    base = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    # The empty token is no URL's: under it each URL meets one row that fits nothing, and so stays.
    mark = urls.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(-1).cast("long").alias("no"), F.lit(-1).alias("rank"), *(F.lit("").alias(c) for c in ("name", "action", "pattern")))
    index = checkpointed(index_rules(base, rules).unionByName(mark))
    met = base.select("page_id", "host", "path", F.concat(F.array(F.lit("")), _tokens(F.col("host"), F.col("path"))).alias("tokens"))
    met = _fetch(met.select("page_id", "host", "path", F.explode_outer("tokens").alias("token")), index)
    fit = F.when((F.col("no") >= 0) & F.regexp_like(F.concat("host", "path"), F.col("pattern")), F.struct("rank", "name", "action"))
    one = met.withColumn("fit", fit).groupBy("page_id", "host", "path").agg(
        F.count_if(F.col("no") < 0).alias("copies"),
        # A rule under several alternatives may be fetched twice by one URL.
        F.size(F.collect_set(F.when(F.col("no") >= 0, F.col("no")))).alias("n_candidates"),
        F.max(F.when(F.col("fit.rank") >= SITE_RANK, F.col("fit"))).alias("site"),
        F.max("fit").alias("best"),
    )
    # Rows that are identical met under one key; give each its row back.
    one = one.withColumn("copy", F.explode_outer(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select("page_id", "host", "path", F.col("site.name").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"), F.col("best.name").alias("reason"), "n_candidates")
