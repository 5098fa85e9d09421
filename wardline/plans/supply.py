"""Queries on versions, registries, dumps, refused files, named sources and changed tool lists, with the same in SQL.

As in ``inputs``, tables name the inputs; the SQL makes them anew and evaluates what the operators evaluate, by other means.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import pyfacts
from ..functions import text as X
from ..operators import code, deps, textual
from ..sources import dumps, files, requirements
from ..sources.tables import working_folder
from ..streaming import rescan
from . import scan
from .corpus import HIT_SQL, _in, _q, _query, _t, fields
from .inputs import SOURCES, _case

# ---- versions: a package of twenty for each part, pinned to a version of one of twelve forms

_A, _B = "p_size % 7", "p_partkey % 3"
_VERSION = _case(
    12, f"concat('1.', {_A})", f"concat('1.', {_A}, '.0')", f"concat('1.', {_A}, 'rc', {_B})", f"concat('1.', {_A}, 'a', {_B}, '.dev1')", f"concat('1.', {_A}, '.dev', {_B})", f"concat('1.', {_A}, '.post', {_B})",
    f"concat('1!0.', {_A})", f"concat('0.', {_A}, 'b', {_B})", f"concat('2.', {_A}, '.', {_B})", f"concat('1.', {_A}, '+local.', {_B})", f"concat('1.', {_A}, '.post', {_B}, '.dev1')", f"concat('10.', {_A})",
)
_SPEC = f"CASE WHEN p_partkey % 29 = 0 THEN '>=1' ELSE concat('==', {_VERSION}) END"
_PACKAGE = "concat('pkg-', {k} % 20)"
_LOW = _case(4, "'0'", "concat('1.', s_suppkey % 3)", "NULL", "'1.1rc1'", of="s_suppkey")
_HIGH = _case(5, "'1.4'", "'1.3.post1'", "NULL", "'1!0.2'", "'1.2rc2'", of="s_suppkey")
_LAST = "CASE WHEN s_suppkey % 5 = 2 AND s_suppkey % 2 = 1 THEN '1.3' END"
_EXACT = "CASE WHEN s_suppkey % 20 = 2 AND s_suppkey % 3 > 0 THEN concat('1.', s_suppkey % 7) END"
_ADVISORY = f"SELECT 'PyPI' AS ecosystem, {_PACKAGE.format(k='s_suppkey')} AS name, {_EXACT} AS version, {_LOW} AS introduced, {_HIGH} AS fixed, {_LAST} AS last_affected, concat('ADV-', s_suppkey) AS advisory_id FROM supplier"
#: Parts of a version by the order of Python packages, and a number of each version by them.
_ORDER_SQL = r"""parts AS (
  SELECT v, coalesce(nullif(regexp_extract(v, '^(\d+)!', 1), ''), '0')::BIGINT AS epoch,
         list_transform(string_split(regexp_replace(regexp_extract(v, '^(?:\d+!)?(\d+(?:\.\d+)*)', 1), '(\.0+)+$', ''), '.'), lambda x: x::BIGINT) AS rel,
         regexp_extract(v, '\d(a|b|rc)\d', 1) AS phase, regexp_extract(v, '(?:a|b|rc)(\d+)', 1) AS nth, regexp_extract(v, '\.post(\d+)', 1) AS post, regexp_extract(v, '\.dev(\d+)', 1) AS dev, regexp_extract(v, '\+(.*)$', 1) AS label
  FROM vs),
ranks AS (
  SELECT v, dense_rank() OVER (ORDER BY epoch, rel, CASE phase WHEN 'a' THEN 1 WHEN 'b' THEN 2 WHEN 'rc' THEN 3 ELSE CASE WHEN dev <> '' AND post = '' THEN 0 ELSE 4 END END, coalesce(nullif(nth, ''), '0')::BIGINT,
                                coalesce(nullif(post, ''), '-1')::BIGINT, coalesce(nullif(dev, ''), '1000000')::BIGINT, label) AS n
  FROM parts)"""


def _pinned(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("skill_id"), F.lit(0).alias("dep_ord"), F.expr(_PACKAGE.format(k="p_partkey")).alias("name"), F.expr(_SPEC).alias("version_spec"), F.lit(None).cast("string").alias("pinned_hash"), F.lit("pypi").alias("ecosystem"))


_AFFECTED_SQL = f"""d AS (SELECT CAST(p_partkey AS VARCHAR) AS skill_id, {_PACKAGE.format(k='p_partkey')} AS name, CASE WHEN p_partkey % 29 > 0 THEN {_VERSION} END AS pin FROM part),
vs AS (SELECT pin AS v FROM d WHERE pin IS NOT NULL UNION SELECT unnest([version, introduced, fixed, last_affected]) FROM adv),
{_ORDER_SQL},
hit AS (
  SELECT d.skill_id, a.advisory_id FROM d JOIN adv a USING (name) LEFT JOIN ranks p ON p.v = d.pin LEFT JOIN ranks x ON x.v = a.version LEFT JOIN ranks lo ON lo.v = a.introduced AND a.introduced <> '0'
  LEFT JOIN ranks hi ON hi.v = a.fixed LEFT JOIN ranks la ON la.v = a.last_affected
  WHERE d.pin IS NULL OR (a.introduced IS NULL AND a.fixed IS NULL AND a.last_affected IS NULL AND (a.version IS NULL OR x.n = p.n))
     OR ((a.introduced IS NOT NULL OR a.fixed IS NOT NULL OR a.last_affected IS NOT NULL) AND (lo.n IS NULL OR p.n >= lo.n) AND (hi.n IS NULL OR p.n < hi.n) AND (la.n IS NULL OR p.n <= la.n)))
SELECT d.skill_id, d.name, coalesce(string_agg(DISTINCT advisory_id, ',' ORDER BY advisory_id), '') AS ids FROM d LEFT JOIN hit USING (skill_id) GROUP BY d.skill_id, d.name"""


@_query(f"WITH adv AS ({_ADVISORY}), {_AFFECTED_SQL}")
def advisory_ranges(spark, sf):
    """Advisories of versions by range: epochs, pre-, post- and development releases, local labels, unpinned ones."""
    _t(spark, sf, "supplier").createOrReplaceTempView("wardline_supplier")
    adv = spark.sql(_ADVISORY.replace("FROM supplier", "FROM wardline_supplier"))
    return deps.advise(_pinned(spark, sf), adv).select("skill_id", "name", F.array_join("known_cve_ids", ",").alias("ids"))


_K = "CAST(s_suppkey AS {s})"
_DOCUMENT = (
    "CASE WHEN s_suppkey % 10 = 9 THEN '{{\"id\": ' WHEN s_suppkey % 10 = 8 THEN concat('{{\"id\": \"X-', " + _K + ", '\"}}') ELSE concat("
    "'{{\"id\": \"OSV-', " + _K + ", '\", \"aliases\": [\"G-1\"', CASE WHEN s_suppkey % 2 = 0 THEN concat(', \"CVE-', " + _K + ", '\"') ELSE '' END, '], \"affected\": [{{\"package\": {{\"ecosystem\": \"PyPI\", \"name\": \"pkg-', s_suppkey % 20, '\"}}, "
    "\"versions\": [\"0.', s_suppkey % 7, 'b1\"], \"ranges\": [{{\"type\": \"GIT\", \"events\": [{{\"introduced\": \"0\"}}]}}, {{\"type\": \"ECOSYSTEM\", \"events\": [{{\"introduced\": \"0\"}}, {{\"fixed\": \"1.', s_suppkey % 4, '\"}}, "
    "{{\"introduced\": \"1.5rc1\"}}, {{\"last_affected\": \"1!0.', s_suppkey % 5, '\"}}]}}]}}]}}') END"
)


def _documents(spark, sf) -> DataFrame:
    s = _t(spark, sf, "supplier")
    return s.select(F.concat(F.lit("/d/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"), F.expr(_DOCUMENT.format(s="STRING")).alias("content"))


@_query(f"""WITH docs AS (SELECT {_DOCUMENT.format(s='VARCHAR')} AS c FROM supplier), j AS (SELECT CAST(c AS JSON) AS j FROM docs WHERE json_valid(c)),
aff AS (SELECT coalesce(list_filter(CAST(j->'$.aliases' AS VARCHAR[]), lambda x: starts_with(x, 'CVE-'))[1], j->>'$.id') AS advisory_id, unnest(CAST(j->'$.affected' AS JSON[])) AS a FROM j WHERE (j->'$.affected') IS NOT NULL),
rng AS (SELECT advisory_id, a->>'$.package.name' AS name, CAST(a->'$.versions' AS VARCHAR[]) AS versions, unnest(CAST(a->'$.ranges' AS JSON[])) AS r FROM aff),
ev AS (SELECT advisory_id, name, unnest(CAST(r->'$.events' AS JSON[])) AS e, generate_subscripts(CAST(r->'$.events' AS JSON[]), 1) AS i FROM rng WHERE (r->>'$.type') <> 'GIT'),
nx AS (SELECT advisory_id, name, e->>'$.introduced' AS introduced, lead(e->>'$.fixed') OVER w AS fixed, lead(e->>'$.last_affected') OVER w AS last_affected FROM ev WINDOW w AS (PARTITION BY advisory_id, name ORDER BY i)),
adv AS (SELECT advisory_id, name, NULL::VARCHAR AS version, introduced, fixed, last_affected FROM nx WHERE introduced IS NOT NULL
        UNION ALL SELECT DISTINCT advisory_id, name, unnest(versions), NULL, NULL, NULL FROM rng), {_AFFECTED_SQL}""")
def advisory_dumps(spark, sf):
    """Advisories from dumped documents: listed versions, intervals from events, aliases; broken documents and ranges of commits left out."""
    return deps.advise(_pinned(spark, sf), dumps.advisories(_documents(spark, sf))).select("skill_id", "name", F.array_join("known_cve_ids", ",").alias("ids"))


@_query(f"""WITH docs AS (SELECT '/d/' || s_suppkey || '.json' AS path, {_DOCUMENT.format(s='VARCHAR')} AS c FROM supplier)
SELECT path, CASE WHEN NOT json_valid(c) THEN 'not JSON' ELSE 'no affected' END AS reason FROM docs WHERE NOT json_valid(c) OR (try_cast(c AS JSON)->'$.affected') IS NULL""")
def advisory_rejects(spark, sf):
    return dumps.advisory_rejects(_documents(spark, sf))


_EDIT = _case(
    6, "concat(substr(n, 1, 2), substr(n, 4))", "concat(substr(n, 1, 3), 'x', substr(n, 4))", "concat('q', substr(n, 2))", "concat(substr(n, 2, 1), substr(n, 1, 1), substr(n, 3), 'z')", "n", "concat('zz', n, 'zz')", of="c_custkey",
)
_REGISTRY = "SELECT p_partkey, concat(replace(p_name, ' ', '-'), '-', p_size) AS n FROM part"


@_query(f"""WITH k AS ({_REGISTRY}), u AS (SELECT DISTINCT {_EDIT} AS norm_name FROM customer JOIN k ON p_partkey = c_custkey), r AS (SELECT DISTINCT n AS known FROM k)
SELECT norm_name, known AS typosquat_of, CAST(dist AS INTEGER) AS distance FROM (
  SELECT norm_name, known, levenshtein(norm_name, known) AS dist, row_number() OVER (PARTITION BY norm_name ORDER BY levenshtein(norm_name, known), known) AS i
  FROM u, r WHERE norm_name NOT IN (SELECT known FROM r) AND abs(length(norm_name) - length(known)) <= 2 AND levenshtein(norm_name, known) <= 2) WHERE i = 1""")
def registry_lookalikes(spark, sf):
    """Names near those of a registry, by the index of shortened names."""
    k = _t(spark, sf, "part").select("p_partkey", F.expr("concat(replace(p_name, ' ', '-'), '-', p_size)").alias("n"))
    asked = _t(spark, sf, "customer").join(k, F.col("p_partkey") == F.col("c_custkey")).select(F.expr(_EDIT).alias("name"))
    return deps.typosquats(asked, known=k.select(F.col("n").alias("name")))


# ---- what cannot be scanned: eight kinds of files

_BODY = _case(
    8, "concat('{\"name\": \"', p_name, '\", \"tools\": [{\"name\": \"t', p_partkey, '\"}]}')", "concat('{\"name\": \"', p_name, '\", \"tools\": [{\"na')",
    "concat('{\"tools\": [{\"name\": \"fine\"}, {\"name\": \"a', substr('<>xy', CAST(p_partkey // 8 % 4 AS INTEGER) + 1, 1), 'b\"}]}')", "'[1, 2]'", "concat('text of ', p_name)", "concat('x = ', p_partkey, chr(10))",
    "concat('def f', substr('(:', CAST(p_partkey // 8 % 2 AS INTEGER) + 1, 1), '):', chr(10), '    pass', chr(10))", "'picture'",
)
_KIND = _case(8, "'mcp.json'", "'mcp.json'", "'mcp.json'", "'list.json'", "'README.md'", "'tool.py'", "'tool.py'", "'view.png'")
_BROKEN_BYTES = "p_partkey % 8 = 4 AND p_partkey // 8 % 3 = 0"
_spark_int = lambda x: x.replace("p_partkey // 8", "p_partkey div 8")


@_query(rf"""WITH f AS (SELECT '/r/' || p_partkey || '/' || {_KIND} AS path, {_BODY} AS c, {_BROKEN_BYTES} AS broken FROM part),
w AS (
  SELECT path, CASE WHEN broken THEN 'not valid UTF-8' WHEN path LIKE '%.png' THEN 'unsupported file type'
                    WHEN path LIKE '%.json' AND (NOT json_valid(c) OR NOT starts_with(c, '{{')) THEN 'not a JSON object'
                    WHEN path LIKE '%.json' AND len(list_filter(list_transform(coalesce(CAST(try_cast(c AS JSON)->'$.tools' AS JSON[]), []), lambda t: t->>'$.name'), lambda n: regexp_matches(n, '[\n\r<>]') OR length(n) > 128)) > 0 THEN 'tool name not allowed'
                    WHEN path LIKE '%.py' AND regexp_matches(c, 'def [a-z]+[^(]') AND NOT regexp_matches(c, 'def [a-z]+\(\)') THEN 'Python source not read: SyntaxError' END AS reason
  FROM f)
SELECT path, reason, reason <> 'unsupported file type' AS failed FROM w WHERE reason IS NOT NULL""")
def scan_rejects(spark, sf):
    """What a scan lists as not scanned, and whether that fails it."""
    text = F.encode(F.expr(_spark_int(_BODY)), "UTF-8")
    raw = F.when(F.expr(_spark_int(_BROKEN_BYTES)), F.concat(text, F.unhex(F.lit("E9")))).otherwise(text).cast("string")
    p = _t(spark, sf, "part").select(F.concat(F.lit("/r/"), F.col("p_partkey").cast("string"), F.lit("/"), F.expr(_KIND)).alias("path"), F.when(F.is_valid_utf8(raw), raw).alias("content"))
    _, sources, _, refused = scan.taken_apart(files.describe(p))
    return refused.unionByName(pyfacts.unread(pyfacts.fact_table(sources)).withColumn("failed", F.lit(True)))


# ---- Python sources

_NAMES = [(name, rule, excused) for rule, _, excused, names in R.CALLS for name in names]
_CALL = "CASE (p_partkey // 6) % " + str(len(_NAMES)) + " " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(_NAMES)) + " END"
_FORM = _case(6, "concat('return ', n, '(x)')", "concat('y = ', n, '(x)')", "concat(n, '(x)')", "concat('# ', n, '(x)')", "concat('s = \"', n, '(x)\"')", "concat('if ', n, '(x): pass')")


@_query(rf"""WITH s AS (SELECT p_partkey, {_FORM} AS line FROM (SELECT p_partkey, {_CALL} AS n FROM part)), k(name, rule_id) AS (VALUES {', '.join(f"('{n}', '{r}')" for n, r, _ in _NAMES)}),
c AS (SELECT p_partkey, line, regexp_extract(line, '^(?:return |y = |if )?([A-Za-z_][A-Za-z0-9_.]*)\(', 1) AS name FROM s)
SELECT CAST(p_partkey AS VARCHAR) AS skill_id, rule_id, 2 AS line_number, line AS snippet FROM c JOIN k USING (name)""")
def call_rules(spark, sf):
    """Every call that a rule names, in six forms of statements, two of which do not call it."""
    s = _t(spark, sf, "part").withColumn("n", F.expr(_CALL.replace("p_partkey // 6", "p_partkey div 6"))).select(
        F.col("p_partkey").cast("string").alias("skill_id"), F.lit("m.py").alias("path"), F.concat(F.lit("def f(x):\n    "), F.expr(_FORM), F.lit("\n    pass\n")).alias("content"),
    )
    none = s.select("skill_id", F.array().cast("array<string>").alias("permissions"))
    return code.findings(pyfacts.fact_table(s), none).select("skill_id", "rule_id", "line_number", "snippet")


_PERMITTED = ("network:egress", "subprocess:exec", "env:read", "filesystem:write")
_NAMED_ROWS = ", ".join(f"({i}, {_q(r)}, {n}, {_q(s)}, {e})" for i, (_, rows) in enumerate(SOURCES) for r, n, s, e in rows)
_EXCUSE = {"PE-003": "subprocess:exec", "PE-007": "filesystem:write", "PE-008": "env:read", "EX-001": "network:egress", "EX-002": "network:egress"}


@_query(f"""WITH e(i, rule_id, line_number, snippet, excused) AS (VALUES {_NAMED_ROWS}), x(rule_id, permission) AS (VALUES {', '.join(f"('{r}', '{p}')" for r, p in _EXCUSE.items())}),
s AS (SELECT CAST(doc_id AS VARCHAR) AS skill_id, list_filter({list(_PERMITTED)}, lambda p: doc_id % 16 // CASE p WHEN 'network:egress' THEN 1 WHEN 'subprocess:exec' THEN 2 WHEN 'env:read' THEN 4 ELSE 8 END % 2 = 1) AS own FROM documents)
SELECT skill_id, rule_id, '/named/' || i || '.py' AS file_path, CAST(line_number AS INTEGER) AS line_number, snippet FROM s CROSS JOIN e LEFT JOIN x USING (rule_id) WHERE NOT (excused AND list_contains(own, permission))""")
def named_sources(spark, sf):
    """Source files named by the caller count for every skill: read once, and met by sets of declared permissions."""
    own = F.filter(F.array(*map(F.lit, _PERMITTED)), lambda p: F.floor(F.col("doc_id") % 16 / F.when(p == "network:egress", 1).when(p == "subprocess:exec", 2).when(p == "env:read", 4).otherwise(8)) % 2 == 1)
    skills = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("skill_id"), own.alias("permissions"))
    given = files.describe(spark.createDataFrame([(f"/named/{i}.py", text) for i, (text, _) in enumerate(SOURCES)], "path string, content string"))
    facts, sets, to_skills = scan.of_named_sources(skills, given)
    return to_skills(code.findings(facts, sets)).select("skill_id", "rule_id", "file_path", "line_number", "snippet")


# ---- manifests and text fields

_JSON = "concat('{\"dependencies\": {\"python\": [\"', lower(replace(p_name, ' ', '-')), '==', p_size, '.', p_partkey % 4, '\", 3, \"# none\", \"extra_', p_partkey % 9, '\"]}, \"requirements_txt\": \"one>=', p_partkey % 5, chr(92), 'n# c', chr(92), 'n', chr(92), 'ntwo\"}')"


@_query(rf"""WITH j AS (SELECT CAST(p_partkey AS VARCHAR) AS skill_id, CAST({_JSON} AS JSON) AS j FROM part),
l AS (SELECT skill_id, list_concat(list_transform(list_filter(CAST(j->'$.dependencies.python' AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: x->>'$'), string_split(j->>'$.requirements_txt', chr(10))) AS l FROM j),
u AS (SELECT skill_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS dep_ord FROM l)
SELECT skill_id, CAST(dep_ord AS INTEGER) AS dep_ord, regexp_extract(line, '^([A-Za-z0-9][A-Za-z0-9_.-]*)', 1) AS name, nullif(regexp_replace(line, '^[A-Za-z0-9][A-Za-z0-9_.-]*', ''), '') AS version_spec FROM u WHERE line <> '' AND NOT starts_with(line, '#')""")
def manifest_dependencies(spark, sf):
    """Dependencies that manifests state: lists by language, entries that are no strings, and a requirements text."""
    m = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("skill_id"), F.try_parse_json(F.expr(_JSON)).alias("raw"))
    return requirements.from_manifest(m).select("skill_id", "dep_ord", "name", "version_spec")


_FIELD_JSON = "concat('{\"name\": \"', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END, '\", \"tools\": [{\"name\": \"t', p_partkey, '\", \"description\": \"', p_type, '\", \"inputSchema\": {\"properties\": {\"a\": {\"default\": \"', p_brand, '\"}}}}, {\"name\": \"u\"}]}')"


@_query(rf"""WITH j AS (SELECT p_partkey, '/f/' || p_partkey || '/mcp.json' AS skill_id, CAST({_FIELD_JSON} AS JSON) AS j FROM part),
t AS (SELECT skill_id, unnest(CAST(j->'$.tools' AS JSON[])) AS t, generate_subscripts(CAST(j->'$.tools' AS JSON[]), 1) - 1 AS k FROM j)
SELECT skill_id, CAST(k * 1000 + o AS INTEGER) AS field_ord, 'tool:' || (t->>'$.name') || ':' || part AS field_name, text FROM (
  SELECT skill_id, k, t, 0 AS o, 'name' AS part, t->>'$.name' AS text FROM t UNION ALL SELECT skill_id, k, t, 1, 'description', coalesce((t->>'$.description'), '') FROM t
  UNION ALL SELECT skill_id, k, t, 2, 'schema', t->>'$.inputSchema.properties.a.default' FROM t WHERE (t->'$.inputSchema') IS NOT NULL)
UNION ALL SELECT skill_id, 1000000000, 'readme_text', 'read ' || p_partkey FROM j WHERE p_partkey % 3 = 0
UNION ALL SELECT skill_id, 1000000002, 'mcp_server_name', j->>'$.name' FROM j WHERE (j->>'$.name') <> ''""")
def skill_text_fields(spark, sf):
    """The text fields of manifests, in order: tools by place, then what stands beside them."""
    p = _t(spark, sf, "part")
    at = lambda name: F.concat(F.lit("/f/"), F.col("p_partkey").cast("string"), F.lit(f"/{name}")).alias("path")
    m = p.select(at("mcp.json"), F.expr(_FIELD_JSON).alias("content")).unionByName(p.where("p_partkey % 3 = 0").select(at("README.md"), F.expr("concat('read ', p_partkey)").alias("content")))
    return files.text_fields(files.manifests(files.describe(m)))


@_query(f"WITH {HIT_SQL} SELECT skill_id, rule_id, round(confidence, 6) AS confidence FROM hit WHERE rule_id IN {_in(('PI-001', 'PI-002', 'PI-004', 'PI-005', 'PI-008', 'PI-009'))}")
def copied_text_findings(spark, sf):
    """The rules on text where each distinct text is matched once."""
    h = textual.hits_of_copies(fields(spark, sf), decode=False).where(F.col("rule_id").isin("PI-001", "PI-002", "PI-004", "PI-005", "PI-008", "PI-009"))
    return h.select("skill_id", "rule_id", F.round("confidence", 6).alias("confidence"))


@_query(r"""SELECT CAST(doc_id AS VARCHAR) AS skill_id, sha256(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS norm_sha256 FROM documents
WHERE regexp_full_match(text, '[\x00-\x1B\x20-\x7F]*') AND NOT regexp_matches(text, '[&\\%]|[A-Za-z0-9+/]{20}')""")
def plain_variants(spark, sf):
    """The only variant of documents that no decoder changes, which is made without Python."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("skill_id"), "text").where(X.is_plain(F.col("text")))
    v = d.select("skill_id", F.inline(X.variants_of(F.col("text")))).where("label = 'raw'")
    return v.select("skill_id", F.sha2("norm", 256).alias("norm_sha256"))


# ---- tool lists that change: a manifest of its user for each event

_MANIFEST = "concat('{{\"permissions\": [', CASE WHEN event_id % 2 = 0 THEN '\"env:read\"' ELSE '' END, '], \"tools\": [{{\"name\": \"', event_type, '\", \"description\": \"', CAST(event_id % 3 AS {s}), '\"}}]}}')"


@_query(f"""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS skill_id, ts, event_id, event_type, {_MANIFEST.format(s='VARCHAR')} AS c, event_id % 2 = 0 AS reads FROM events),
l AS (SELECT *, lag(c) OVER w AS before, lag(event_type) OVER w AS tool_before, lag(reads) OVER w AS reads_before FROM m WINDOW w AS (PARTITION BY skill_id ORDER BY ts))
SELECT skill_id, CASE WHEN before IS NULL THEN 'new' ELSE 'changed' END AS change, epoch_us(ts) AS seen_us, CASE WHEN tool_before IS DISTINCT FROM event_type THEN event_type ELSE '' END AS added_tools,
       CASE WHEN reads AND NOT coalesce(reads_before, false) THEN 'env:read' ELSE '' END AS added_permissions FROM l WHERE before IS DISTINCT FROM c""")
def tool_list_changes(spark, sf):
    """A stream of manifests, one for each event of a user: those whose tool list is another than the last, with what was added."""
    landing, out = f"{working_folder(spark)}/m", working_folder(spark)
    e = _t(spark, sf, "events")
    e.select(F.col("user_id").cast("string").alias("skill_id"), F.expr(_MANIFEST.format(s="STRING")).alias("content"), F.col("ts").cast("timestamp").alias("seen_at")).write.parquet(landing)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, rescan.STATE_STORE)
    try:
        changes = rescan.tool_changes(spark.readStream.schema(rescan.MANIFESTS).parquet(landing), forget=timedelta(days=3650))
        w = changes.writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        w.awaitTermination()
    finally:
        spark.conf.set(key, before)
    c = spark.read.schema(rescan.CHANGES).parquet(f"{out}/changes")
    return c.select("skill_id", "change", F.unix_micros("seen_at").alias("seen_us"), F.array_join("added_tools", ",").alias("added_tools"), F.array_join("added_permissions", ",").alias("added_permissions"))
