"""DuckDB SQL for the queries that SQL can express. Fixed patterns come from the operators' own tables."""

from __future__ import annotations

from .license_scan import K, MAX_GAP, MIN_COVERAGE, templates
from .lm_scoring import ALPHA, MU
from .url_filters import SITE_RULES, WORD_RULES
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BARE = r"'[^\x20\x09-\x0D]+'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_BARE}) AS w,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS own
  FROM documents),
k AS (SELECT r, own, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] ELSE chr(10) END AS v FROM (SELECT r, own, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
one AS (SELECT x, count(*) FILTER (own) AS t, count(*) AS b FROM k GROUP BY x),
ctx AS (SELECT v, count(*) FILTER (own) AS ct, count(*) AS cb FROM k GROUP BY v),
two AS (SELECT v, x, count(*) FILTER (own) AS pt, count(*) AS pb FROM k GROUP BY v, x),
n AS (SELECT sum(t) AS nt, sum(b) AS nb, {ALPHA} * (count(*) + 1) AS mass FROM one),
loss AS (
  SELECT v, x, -ln((pt + {MU} * (t + {ALPHA}) / (nt + mass)) / (ct + {MU})) AS lt, -ln((pb + {MU} * (b + {ALPHA}) / (nb + mass)) / (cb + {MU})) AS lb
  FROM two JOIN one USING (x) JOIN ctx USING (v), n),
s AS (SELECT r, avg(lt) AS lt, avg(lb) AS lb FROM k JOIN loss USING (v, x) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(coalesce(lt - lb, 0.0::DOUBLE), 6) AS score
FROM d LEFT JOIN s USING (r)"""

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_BARE}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
wins AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM wins) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS s(j) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
         length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM d LEFT JOIN rep USING (r)),
f AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (4 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines AND n_lines >= 4)::INT
            + 16 * (word_chars > 20 * n_words)::INT + 32 * (4 * n_bangs > n_words)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (
  SELECT r, doc_id, i, l[i] AS line,
         translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
own AS (SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM lines)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM own GROUP BY r, doc_id"""


def op7() -> str:
    def site(text: str) -> str:
        host, _, rest = text.partition("/")
        return f"(host = {_q(host)} OR host LIKE {_q('%.' + host)}) AND starts_with(path, {_q('/' + rest)})"

    by_length = sorted(SITE_RULES, key=lambda x: -len(x[0]))
    rule = "CASE " + " ".join(f"WHEN {site(t)} THEN {_q(t)}" for t, _ in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = {_q(t)} THEN {_q(a)}" for t, a in SITE_RULES)
    words = " OR ".join(f"regexp_matches(host || path, {_q(p)})" for _, p, _ in WORD_RULES)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (SELECT *, {rule} AS rule FROM p)
SELECT page_id, host, path, rule, {verdict} WHEN {words} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def op8() -> str:
    grams = [(n, label, base, j, len(w) - K + 1, " ".join(w[j : j + K])) for n, label, base, w in templates() for j in range(len(w) - K + 1)]
    rows = ", ".join(f"({n}, {_q(a)}, {str(b).upper()}, {j}, {g}, {_q(t)})" for n, a, b, j, g, t in grams)
    return rf"""
WITH tpl(t_no, label, base, t_pos, t_grams, gram) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
g AS (SELECT r, i - 1 AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
v AS (SELECT r, t_no, label, base, t_grams, t_pos, p, p - t_pos AS diag FROM g JOIN tpl USING (gram)),
i AS (
  SELECT *, sum(jump) OVER (PARTITION BY r, t_no ORDER BY diag, t_pos ROWS UNBOUNDED PRECEDING) AS place
  FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, t_no ORDER BY diag, t_pos) <= CASE WHEN base THEN 0 ELSE {MAX_GAP} END THEN 0 ELSE 1 END AS jump FROM v)),
f AS (SELECT r, t_no, label, base, t_grams, place, t_pos, min(p) AS p FROM i GROUP BY ALL),
o AS (SELECT *, p > coalesce(max(p) OVER (PARTITION BY r, t_no, place ORDER BY t_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS in_order FROM f),
s AS (
  SELECT r, t_no, label, base, min(p) AS first_word, (count(*) FILTER (in_order))::DOUBLE / t_grams AS coverage
  FROM o GROUP BY r, t_no, label, base, t_grams, place),
h AS (SELECT *, base AND coverage = 1.0 AS base_hit, (base AND coverage = 1.0) OR (NOT base AND coverage >= {MIN_COVERAGE}) AS hit FROM s)
SELECT d.doc_id, any_value(len(d.w))::BIGINT AS n_words, (count(*) FILTER (base_hit))::BIGINT AS n_base,
       (min(first_word) FILTER (base_hit))::BIGINT AS first_word, (max(first_word) FILTER (base_hit))::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base_hit)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (hit)), ','), '') AS labels,
       round(coalesce(max(coverage), 0.0), 6) AS score
FROM d LEFT JOIN h USING (r) GROUP BY d.r, d.doc_id"""


OP9 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, unnest(range(0, n)) AS j, i FROM m) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""

OP11 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p WHERE strlen(h) >= 100 GROUP BY h),
m AS (SELECT page_id, p.h, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON p.h = f.h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM m"""


def op12() -> str:
    at = ", ".join(f"CASE WHEN contains(fails, '{f}') THEN strpos(filter_order, '{f}') ELSE 6 END" for f in "ABCDE")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_BARE}) AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id),
c(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT c1.x || c2.x || c3.x || c4.x || c5.x AS filter_order FROM c c1, c c2, c c3, c c4, c c5
  WHERE c2.x <> c1.x AND c3.x NOT IN (c1.x, c2.x) AND c4.x NOT IN (c1.x, c2.x, c3.x) AND c5.x NOT IN (c1.x, c2.x, c3.x, c4.x)),
r AS (SELECT part, good, toxic, fails, filter_order, least({at}) AS first FROM f, o),
s AS (SELECT *, substr(filter_order, step, 1) AS own FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r)),
g AS (
  SELECT part, filter_order, step::INT AS step, own, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (contains(fails, own) AND first < step) AS redundant, count(*) FILTER (fails = own) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""


def op13(width: int = 4) -> str:
    """For vectors of 16 parts of ``width`` components."""
    each = range(1, width + 1)
    dist = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in each)
    #: The smallest distance * 64 + index is the nearest entry, and the first of equal ones.
    near = f"SELECT r, p.part, min(({dist}) * {ENTRIES} + e) AS m FROM p JOIN {{0}} c ON p.part = c.part GROUP BY r, p.part"
    mean = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*))::BIGINT // count(*)" for i in each)
    steps = ""
    for k in range(ROUNDS):
        steps += f"""
a{k} AS ({near.format(f"c{k}")}),
n{k} AS (SELECT p.part, m % {ENTRIES} AS e, [{mean}] AS c FROM a{k} JOIN p ON a{k}.r = p.r AND a{k}.part = p.part GROUP BY p.part, m % {ENTRIES}),
c{k + 1} AS (SELECT o.part, o.e, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN n{k} n ON o.part = n.part AND o.e = n.e),"""
    entry = " || ',' || ".join(f"c[{i}]" for i in each)
    digits = "'0123456789abcdef'"
    return f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, vec_id, v, j AS part, list_slice(v, j * {width} + 1, (j + 1) * {width}) AS x FROM (SELECT *, unnest(range({PARTS})) AS j FROM k)),
c0 AS (SELECT part, e, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM p) WHERE e < {ENTRIES}),{steps}
z AS ({near.format(f"c{ROUNDS}")}),
w AS (SELECT r, string_agg(substr({digits}, (m % {ENTRIES} // 16 + 1)::INT, 1) || substr({digits}, (m % 16 + 1)::INT, 1), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg({entry}, ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w JOIN k USING (r), h"""


SQL = {
    "op1_lm_scoring": OP1,
    "op4_quality_rules": OP4,
    "op5_line_dedup": OP5,
    "op7_url_filters": op7(),
    "op8_license_scan": op8(),
    "op9_decontamination": OP9,
    "op11_warc": OP11,
    "op12_filter_audit": op12(),
    "op13_vector_codes": op13(),
}
