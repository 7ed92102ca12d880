"""Queries of known entities, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbraline.functions import names as N
from umbraline.functions import text as X
from umbraline.operators import entities, labels
from umbraline.plans import oracle as O
from umbraline.plans.queries import query
from umbraline.sources import tables as T

_PERSON = f"""nm AS (SELECT DISTINCT fixture, {O.NORM} AS name FROM c WHERE pii_type = 'PERSON' AND text IS NOT NULL),
n1 AS (SELECT fixture, name, regexp_replace(regexp_replace({O.COLLAPSED.replace('(text,', '(name,')}, {O.q(rf'(?i)^(({N.TITLES})\.? )+')}, ''), {O.q(rf'(?i)(,? ?\b({N.SUFFIXES})\.?)+$')}, '') AS t FROM nm WHERE name <> ''),
n2 AS (SELECT *, contains(t, ',') AS comma, list_filter(string_split(t, ' '), lambda v: v <> '') AS w, list_filter(string_split(trim(split_part(t, ',', 2), ' '), ' '), lambda v: v <> '') AS r FROM n1),
n3 AS (SELECT fixture, name, CASE WHEN comma THEN trim(split_part(t, ',', 1), ' ') ELSE w[-1] END AS surname, coalesce(CASE WHEN comma THEN r[1] WHEN len(w) > 1 THEN w[1] END, '') AS given FROM n2),
n4 AS (SELECT fixture, name, {O.fold('surname')} AS s, {O.fold('given')} AS g FROM n3)"""
_BLANK = f"(regexp_matches(v, '^[ \\t\\r\\n\\f\\v]$') OR contains({O.q(X.HYPHENS)}, v))"
_BLANK_BEFORE = _BLANK.replace("(v, ", "(ch[i - 1], ").replace(", v)", ", ch[i - 1])")
_PIECE = f"CASE WHEN {_BLANK} THEN CASE WHEN i > 1 AND {_BLANK_BEFORE} THEN '' ELSE ' ' END WHEN contains({O.q(X.APOSTROPHES)}, v) THEN '' ELSE {O.fold('v')} END"
_FOLDED = f"""ch AS (SELECT {O.KEY}, string_split(text, '') AS ch FROM l WHERE text IS NOT NULL),
pc AS (SELECT {O.KEY}, list_transform(ch, lambda v, i: {_PIECE}) AS p FROM ch),
fl AS (SELECT {O.KEY}, array_to_string(p, '') AS t, flatten(list_transform(p, lambda v, i: list_transform(range(length(v)), lambda x: i - 1))) AS places FROM pc)"""


def _occurrences(terms: str) -> str:
    """SQL relations ending in ``occ`` (line key, value, span_start, span_end) for the relation ``terms`` (fixture, value)."""
    return f"""{_FOLDED}, nd AS (SELECT DISTINCT fixture, value, {O.fold('value')} AS needle FROM {terms}),
me AS (SELECT {O.KEY}, value, needle, t, places, unnest(range(1, length(t) - length(needle) + 2)) AS i FROM fl JOIN nd USING (fixture) WHERE needle <> '' AND contains(t, needle)),
occ AS (SELECT DISTINCT {O.KEY}, value, CAST(places[i] AS INTEGER) AS span_start, CAST(places[i + length(needle) - 1] + 1 AS INTEGER) AS span_end FROM me WHERE substr(t, i, length(needle)) = needle
AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND (i + length(needle) > length(t) OR NOT regexp_matches(substr(t, i + length(needle), 1), '[\\p{{L}}\\p{{N}}]')))"""


_TERMS = "tm AS (SELECT DISTINCT fixture, text AS value FROM expected_decisions WHERE length(trim(text, ' ')) >= 3)"


def _terms(spark, d):
    return T.table(spark, d, "expected_decisions").where("length(trim(text)) >= 3").select("fixture", F.col("text").alias("value")).distinct()


@query(f"WITH {O.LINES}, {_FOLDED} SELECT {O.KEY}, t AS folded, array_to_string(places, ',') AS places FROM fl")
def folded_lines(spark, d):
    rows = T.lines(spark, d).where("text is not null").select(*T.LINE_KEY, entities.folded_with_map(F.col("text")).alias("f"))
    return rows.select(*T.LINE_KEY, F.col("f.text").alias("folded"), F.array_join("f.places", ",").alias("places"))


@query(f"WITH {O.LINES}, {_TERMS}, {_occurrences('tm')} SELECT * FROM occ")
def occurrences(spark, d):
    return entities.occurrences(T.lines(spark, d), _terms(spark, d))


@query(f"""WITH {O.CANDS}, {O.LABELS_CTE}, {_TERMS}, {_occurrences('tm')}, ov AS (SELECT {O.KEY}, occ.value, occ.span_start, occ.span_end, bool_or(NOT coalesce(needs_review, false)) AS live FROM occ JOIN c USING (fixture, page_no, block_no, line_no)
WHERE c.span_start < occ.span_end AND occ.span_start < c.span_end GROUP BY ALL), onl AS (SELECT DISTINCT {O.KEY}, occ.value, span_start, span_end FROM occ JOIN lab USING (fixture, page_no, block_no, line_no) WHERE label_start < span_end AND span_start < label_end)
SELECT occ.*, CASE WHEN ov.live THEN 'redacted' WHEN ov.live IS NOT NULL THEN 'kept' WHEN onl.value IS NOT NULL THEN 'protected' ELSE 'undetected' END AS status FROM occ
LEFT JOIN ov USING (fixture, page_no, block_no, line_no, value, span_start, span_end) LEFT JOIN onl USING (fixture, page_no, block_no, line_no, value, span_start, span_end)""")
def searched_terms(spark, d):
    """Every place of the values that decisions are expected for, and what is done about it."""
    lines = T.lines(spark, d)
    return entities.search(lines, _terms(spark, d), T.candidates(spark, d), labels.detect_labels(lines))


@query(f"""WITH {O.CANDS} SELECT fixture, pii_type, {O.NORM_TEXT} AS value, count(*) AS n, max(confidence) AS confidence FROM c WHERE text IS NOT NULL AND pii_type IN ({O.listed(entities.PROPAGATED)})
AND (coalesce(label_confirmed, false) OR (source = 'regex' AND confidence >= 0.85)) AND length({O.NORM_TEXT}) >= 4 GROUP BY ALL""")
def known_subjects(spark, d):
    return entities.subjects(T.candidates(spark, d))


@query(f"""WITH {O.CANDS}, {_PERSON}, fu AS (SELECT DISTINCT fixture, s, g AS owner FROM n4 WHERE length(g) > 1), it AS (SELECT fixture, s, left(owner, 1) AS i, count(*) AS n, min(owner) AS one FROM fu GROUP BY ALL),
lo AS (SELECT fixture, s, count(*) AS n_all, min(owner) AS one_all FROM fu GROUP BY ALL)
SELECT n4.fixture, name, trim(CASE WHEN length(g) > 1 THEN g WHEN length(g) = 1 AND n = 1 THEN one WHEN g = '' AND n_all = 1 THEN one_all ELSE g END || ' ' || n4.s, ' ') AS entity
FROM n4 LEFT JOIN it ON n4.fixture = it.fixture AND n4.s = it.s AND left(g, 1) = it.i LEFT JOIN lo ON n4.fixture = lo.fixture AND n4.s = lo.s""")
def person_index(spark, d):
    return entities.person_index(T.candidates(spark, d))


@query(f"""WITH {O.LINES}, {O.CANDS.replace('FROM candidates', "FROM candidates WHERE pii_type <> 'PERSON' OR label_confirmed")}, {_PERSON},
kn AS (SELECT fixture, upper(left(regexp_replace(surname, '[^\\p{{L}}]', '', 'g'), 4)) AS control, min(surname) AS surname FROM n3 GROUP BY ALL HAVING length(control) >= 3),
tk AS (SELECT {O.KEY}, unnest(list_distinct(string_split_regex(text, '[^A-Z0-9]+'))) AS control FROM l WHERE regexp_matches(text, '^[A-Z0-9 .<>/#-]+$') AND regexp_matches(text, '[0-9].* [0-9]|[0-9] .*[0-9]'))
SELECT {O.KEY}, control, surname FROM tk JOIN kn USING (fixture, control)""")
def name_controls(spark, d):
    return entities.name_controls(T.lines(spark, d), T.candidates(spark, d))


@query(f"""WITH {O.CANDS} SELECT a.cand_id, min(b.cand_id) AS inside FROM c a JOIN c b ON a.fixture = b.fixture AND a.page_no = b.page_no AND a.block_no = b.block_no AND a.line_no = b.line_no
WHERE b.span_start <= a.span_start AND a.span_end <= b.span_end AND b.span_end - b.span_start > a.span_end - a.span_start GROUP BY ALL""")
def fragments_inside(spark, d):
    return entities.fragments(T.candidates(spark, d))
