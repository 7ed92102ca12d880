"""Queries of filters, replacements, the plan and its checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbraline.functions import names as N
from umbraline.operators import filters, relations, replacing
from umbraline.operators import pseudonyms as P
from umbraline.operators.rule_tables import FORM_WORDS, PLACEHOLDERS
from umbraline.plans import binding
from umbraline.plans import oracle as O
from umbraline.plans.entities import _PERSON
from umbraline.plans.queries import query
from umbraline.sources import tables as T

_T = "coalesce(text, '')"
_FIN = binding._FIN.replace("trim(text, ' ')", f"trim({_T}, ' ')")
_FORM = f"list_filter(string_split_regex(lower({_T}), '[^\\p{{L}}]+'), lambda w: w <> '')"
_NAME = O.PERSON_SHAPE


@query(f"""WITH pp AS ({_NAME}), {O.CANDS} SELECT cand_id, CASE WHEN NOT regexp_matches({_T}, '[\\p{{L}}\\p{{N}}]') THEN 'empty' WHEN {_FIN} AND source <> 'manual' THEN 'financial'
WHEN {O.NORM} IN ({O.listed(N.STATE_CODES)}) THEN 'state' WHEN trim(regexp_replace(lower(trim({_T}, ' ')), '\\s+', ' ', 'g'), ' .:;') IN ({O.listed(PLACEHOLDERS)}) THEN 'placeholder'
WHEN pii_type IN ('PERSON', 'ORG_PRIVATE') AND len({_FORM}) > 0 AND len(list_filter({_FORM}, lambda w: w NOT IN ({O.listed(FORM_WORDS)}))) = 0 THEN 'form words'
WHEN source IN ({O.listed(filters.MODELS)}) AND pii_type = 'STREET' AND NOT (regexp_matches({_T}, '[0-9]') AND regexp_matches({_T}, {O.q(filters.STREET_WORD)})) THEN 'no street'
WHEN source IN ({O.listed(filters.MODELS)}) AND pii_type IN ({O.listed(filters.SHAPED)}) AND NOT regexp_matches({_T}, '[0-9@_./-]') THEN 'no shape'
WHEN source = 'group' AND pii_type = 'UNCLASSIFIED_GROUP_VALUE' AND is_person THEN 'name' ELSE 'kept' END AS verdict FROM c LEFT JOIN pp USING (cand_id)""")
def candidate_verdicts(spark, d):
    return filters.verdicts(T.candidates(spark, d))


@query(f"WITH {O.CANDS} SELECT cand_id FROM c WHERE source = 'manual' OR coalesce(pii_type <> 'UNCLASSIFIED_GROUP_VALUE' AND source NOT IN ('coverage', 'audit') AND coalesce(confidence, 0.0) >= 0.65, false)")
def conservative_candidates(spark, d):
    return filters.conservative(T.candidates(spark, d))


@query(f"""WITH {O.LINES}, {O.CANDS}, od AS (SELECT * FROM l ANTI JOIN c USING ({O.KEY}) WHERE regexp_matches(text, {O.q(rf'^\s*{filters.DATE}(?:\s+{filters.DATE}){{0,2}}\s*$')})),
iy AS (SELECT DISTINCT l.fixture, l.page_no, l.y0 AS iy0, l.y1 AS iy1 FROM l SEMI JOIN (SELECT * FROM c WHERE pii_type IN ({O.listed(filters.IDENTITY)})) USING ({O.KEY}))
SELECT DISTINCT {O.KEY}, trim(text, ' ') AS value FROM od JOIN iy USING (fixture, page_no) WHERE iy0 <= y1 + 60 AND y0 <= iy1 + 60""")
def dates_beside_identity(spark, d):
    return filters.dates_beside_identity(T.lines(spark, d), T.candidates(spark, d))


@query(f"""WITH {O.CANDS}, tk AS (SELECT DISTINCT fixture, unnest(string_split({O.fold('text')}, ' ')) AS token FROM c WHERE pii_type = 'PERSON' AND label_confirmed AND text IS NOT NULL)
SELECT cand_id FROM (SELECT *, {O.fold('text')} AS token FROM c WHERE source IN ({O.listed(filters.MODELS)}) AND pii_type IN ('CITY_STATE', 'ORG_PRIVATE', 'BIRTHPLACE') AND text IS NOT NULL)
SEMI JOIN (SELECT * FROM tk WHERE length(token) >= 3) USING (fixture, token) WHERE NOT contains(token, ' ')""")
def name_components(spark, d):
    return filters.name_components(T.candidates(spark, d))


@query(f"""WITH {O.CANDS}, {binding.VALUES_CTE}, iv AS (SELECT {O.KEY}, val.span_start AS a, val.span_end AS b, value, c.cand_id, c.span_start AS s, c.span_end AS e FROM val JOIN c USING (fixture, page_no, block_no, line_no)
WHERE NOT non_pii AND NOT unknown AND c.source <> 'manual' AND val.span_start <= c.span_start AND c.span_end <= val.span_end)
SELECT min(cand_id) AS cand_id, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end FROM iv GROUP BY {O.KEY}, a, b, value HAVING count(*) = 1 AND max(e) - min(s) < b - a AND NOT regexp_matches(value, '[$%]')""")
def expanded_to_field(spark, d):
    return filters.expanded(binding._values(spark, d), T.candidates(spark, d))


@query(f"""WITH {O.LINES} SELECT DISTINCT {O.KEY}, value FROM (SELECT {O.KEY}, unnest(regexp_extract_all(text, {O.q(rf'\b{filters.DATE}\b')})) AS value FROM l WHERE regexp_matches(lower(text), {O.q(filters.CUES)}))""")
def personal_dates(spark, d):
    return filters.personal_dates(T.lines(spark, d))


_BYTE = lambda i: f"CAST(('0x' || substr(dg, {2 * i + 1}, 2)) AS INTEGER)"
_DIG = lambda a, n: " || ".join(f"CAST({_BYTE(i)} % 10 AS VARCHAR)" for i in range(a, a + n))
_PICK = lambda names, i: f"([{O.listed(names)}])[{_BYTE(i)} % {len(names)} + 1]"
_FULL = f"({_PICK(replacing.GIVEN, 0)} || ' ' || {_PICK(replacing.SURNAMES, 1)})"
_CAPS = "regexp_matches(original, '^[^\\p{Ll}]+$')"
_STREET = f"(left(CAST({_BYTE(2)} % 9 + 1 AS VARCHAR) || {_DIG(3, 6)}, greatest(length(regexp_extract(original, '[0-9]+')), 1)) || ' ' || {_PICK(replacing.STREETS, 0)} || ' Street')"
_KINDS = ["PERSON", "STREET", "ADDRESS", "ORG_PRIVATE", "SSN", "EIN", "EMAIL", "PHONE"]


@query(f"""WITH {O._REG}, sd AS (SELECT record_id, pii_type, original, sha256(CAST(CAST(('0x' || substr(sha256({O._SEED}), 1, 16)) AS UBIGINT) AS VARCHAR)) AS dg FROM reg WHERE original IS NOT NULL AND pii_type IN ({O.listed(_KINDS)}))
SELECT record_id, CASE WHEN pii_type = 'PERSON' THEN CASE WHEN {_CAPS} THEN upper({_FULL}) WHEN contains(original, ',') THEN {_PICK(replacing.SURNAMES, 1)} || ', ' || {_PICK(replacing.GIVEN, 0)} ELSE {_FULL} END
WHEN pii_type IN ('STREET', 'ADDRESS') THEN CASE WHEN {_CAPS} THEN upper({_STREET}) ELSE {_STREET} END
WHEN pii_type = 'ORG_PRIVATE' THEN {_PICK(replacing.ORGANISATIONS, 0)} || ' ' || {_PICK(replacing.STREETS, 1)} || regexp_extract(original, {O.q(replacing.SUFFIX)})
WHEN pii_type = 'SSN' THEN '1' || {_DIG(0, 2)} || '-' || {_DIG(2, 2)} || '-' || {_DIG(4, 4)} WHEN pii_type = 'EIN' THEN {_DIG(0, 2)} || '-' || {_DIG(2, 7)}
WHEN pii_type = 'EMAIL' THEN lower({_PICK(replacing.GIVEN, 0)}) || '.' || {_DIG(1, 4)} || '@example.com' WHEN pii_type = 'PHONE' THEN '555-01' || {_DIG(0, 2)} || '-' || {_DIG(2, 4)} END AS replacement FROM sd""")
def generated_replacements(spark, d):
    rows = T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"]).where(F.col("original").isNotNull() & F.col("pii_type").isin(_KINDS))
    of = P.seed(F.col("scope_ref"), F.col("pii_type"), F.col("original"))
    return rows.select("record_id", replacing.generated(F.col("pii_type"), F.col("original"), of).alias("replacement"))


@query()
def assigned_replacements(spark, d):
    return replacing.assigned(T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"]))


@query(f"""WITH {O.CANDS}, o AS (SELECT {O.KEY}, cand_id, span_start, span_end, CASE WHEN span_start >= coalesce(max(span_end) OVER (PARTITION BY {O.KEY} ORDER BY span_start, span_end, cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
THEN 1 ELSE 0 END AS nw FROM c WHERE pii_type IS NOT NULL AND span_end > span_start), g AS (SELECT *, sum(nw) OVER (PARTITION BY {O.KEY} ORDER BY span_start, span_end, cand_id) AS g FROM o)
SELECT {O.KEY}, min(span_start) AS span_start, max(span_end) AS span_end, arg_max(cand_id, {{'n': span_end - span_start, 'm': -cand_id}}) AS cand_id, count(*) AS n FROM g GROUP BY {O.KEY}, g""")
def merged_targets(spark, d):
    return replacing.merged_targets(T.candidates(spark, d))


@query()
def verify_checks(spark, d):
    lines = T.lines(spark, d)
    # As one struct, so that all reads of the candidates have the same columns and share one shuffle.
    row = F.struct(*T.LINE_KEY, "span_start", "span_end", "text", "pii_type", "source", "confidence").alias("row")
    c = T.records(T.table(spark, d, "candidates").select("cand_id", row), ["cand_id"]).select("cand_id", "row.*")
    return replacing.verified(lines, relations.rewritten_lines(lines, c), c)


@query()
def value_occurrences(spark, d):
    """How often the values of each document's sure candidates stand in it."""
    values = T.candidates(spark, d).where("text is not null and confidence >= 0.85").select("fixture", F.trim("text").alias("value")).distinct()
    return replacing.value_counts(T.lines(spark, d), values)


_REWRITTEN = f"""tg AS (SELECT {O.KEY}, span_start, span_end, pii_type, coalesce(lag(span_end) OVER (PARTITION BY {O.KEY} ORDER BY span_start), 0) AS at FROM c WHERE pii_type IS NOT NULL AND text IS NOT NULL),
pc AS (SELECT {O.KEY}, string_agg(substr(l.text, tg.at + 1, tg.span_start - tg.at) || '[' || pii_type || ']', '' ORDER BY tg.span_start) AS head, max(span_end) AS until FROM tg JOIN l USING (fixture, page_no, block_no, line_no) GROUP BY ALL),
rw AS (SELECT {O.KEY}, CASE WHEN head IS NULL THEN text ELSE head || substr(text, until + 1) END AS text FROM l LEFT JOIN pc USING (fixture, page_no, block_no, line_no))"""
_HELD = lambda t, v: f"regexp_matches({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(regexp_replace({v}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g'), '\\s+', '\\\\s+', 'g') || '($|[^\\p{{L}}\\p{{N}}_])')"
# The costly search only where the value's first word stands in the line at all.
_HOLDS = lambda t, v: f"CASE WHEN contains(lower({t}), lower(regexp_extract({v}, '[\\p{{L}}\\p{{N}}]+'))) THEN {_HELD(t, v)} ELSE false END"
# Queries that are registered elsewhere, tables without overlapping candidates taken for granted.
O_REWRITTEN = f"WITH {O.LINES}, {O.CANDS}, {_REWRITTEN} SELECT * FROM rw"
O_LEAKS = f"""WITH {O.LINES}, {O.CANDS}, {_REWRITTEN}, vl AS (SELECT DISTINCT fixture, pii_type, {O.NORM_TEXT} AS value FROM c WHERE text IS NOT NULL AND pii_type IS NOT NULL),
sn AS (SELECT DISTINCT fixture, pii_type, value FROM vl JOIN rw USING (fixture) WHERE length(value) >= 4 AND {_HOLDS('rw.text', 'value')})
SELECT fixture, pii_type, count(*) AS n_values, CAST(sum(CASE WHEN sn.value IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_leaked FROM vl LEFT JOIN sn USING (fixture, pii_type, value) WHERE length(value) >= 4 GROUP BY ALL"""
O_PROPAGATED = f"""WITH {O.LINES}, {O.CANDS}, su AS (SELECT {O.KEY}, pii_type, {O.NORM} AS value FROM c WHERE text IS NOT NULL AND confidence >= 0.85 AND pii_type IN ('PERSON', 'ORG_PRIVATE', 'EMAIL', 'SSN', 'EIN', 'PHONE')),
vl AS (SELECT DISTINCT fixture, pii_type, value FROM su WHERE length(value) >= 4) SELECT DISTINCT {O.KEY}, pii_type, value FROM l JOIN vl USING (fixture) ANTI JOIN su USING ({O.KEY}, pii_type, value) WHERE {_HOLDS('l.text', 'value')}"""
O_PAIRS = f"""WITH {O.CANDS}, {_PERSON.split("n4 AS")[0].rstrip().rstrip(",").replace("n3 AS (SELECT fixture, name,", "n3 AS (SELECT fixture, name, CASE WHEN comma THEN r ELSE w[1:greatest(len(w) - 1, 0)] END AS gs,")},
gg AS (SELECT DISTINCT fixture, name, {O.fold('surname')} AS s, list_transform(gs, lambda v: {O.fold('v')}) AS g FROM n3)
SELECT a.fixture, a.name AS name_a, b.name AS name_b FROM gg a JOIN gg b ON a.fixture = b.fixture AND a.s = b.s AND a.name < b.name WHERE a.s <> '' AND len(a.g) > 0 AND len(b.g) > 0
AND len(list_filter(range(1, least(len(a.g), len(b.g)) + 1), lambda i: NOT (a.g[i] = b.g[i] OR (least(length(a.g[i]), length(b.g[i])) = 1 AND left(a.g[i], 1) = left(b.g[i], 1))))) = 0"""
