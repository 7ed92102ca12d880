"""Queries of field groups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbraline.operators import binding, labels
from umbraline.operators.rule_tables import DIGIT_TYPES, PLACEHOLDERS, SATISFIED_BY
from umbraline.operators.rules import MONEY, PERCENT
from umbraline.plans import oracle as O
from umbraline.plans.queries import query
from umbraline.sources import tables as T

_G = "fixture, page_no, label_block, label_line, label_start"
_TRIM = "trim(text, ' ')"
_FIN = f"({_TRIM} = '' OR regexp_full_match({_TRIM}, {O.q(MONEY)}) OR regexp_full_match({_TRIM}, {O.q(PERCENT)}) OR (regexp_matches({_TRIM}, '^[\\s$()\\-]*[0-9,.]+[\\s$()%]*$') AND regexp_matches({_TRIM}, '[$%]')))"
_MISS = f"(expects = 'PERSON' AND (regexp_matches({_TRIM}, {O.q(binding.ADDRESS_SHAPE)}) OR regexp_matches({_TRIM}, {O.q(binding.STREET_SHAPE)})))"
_OWN = binding.OWN_LABEL.replace("‐-―•", r"\x{2010}-\x{2015}\x{2022}")
VALUES_CTE = f"""{O.LABELS_CTE},
vi AS (SELECT fixture, page_no, block_no AS label_block, line_no AS label_line, label_start, label, expects, non_pii, unknown, 'inline' AS how, 1 AS position, block_no, line_no,
label_end + length(substr(text, label_end + 1)) - length(ltrim(substr(text, label_end + 1), ' ')) AS span_start, value FROM lab WHERE value <> ''),
ob AS (SELECT fixture, page_no, block_no AS label_block, line_no AS label_line, label_start, label, expects, non_pii, unknown, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1, font AS lfont, color AS lcolor FROM last WHERE value = ''),
ot AS (SELECT l.*, b.block_no IS NOT NULL AS begins, kn.block_no IS NOT NULL AS is_known FROM l LEFT JOIN (SELECT DISTINCT {O.KEY} FROM lab WHERE label_start = 0) b USING ({O.KEY})
LEFT JOIN (SELECT DISTINCT {O.KEY} FROM lab WHERE NOT unknown) kn USING ({O.KEY})),
pr AS (SELECT ob.*, ot.* EXCLUDE (fixture, page_no) FROM ob JOIN ot USING (fixture, page_no) WHERE block_no <> label_block OR line_no <> label_line),
nr AS (SELECT * FROM pr WHERE x0 >= lx1 - 0.5 AND y0 <= (ly0 + ly1) / 2 AND (ly0 + ly1) / 2 <= y1 AND {_TRIM} <> '' QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY x0, block_no, line_no) = 1),
rt AS (SELECT * FROM nr WHERE x0 - lx1 <= 80 AND NOT begins AND NOT is_known AND (font IS DISTINCT FROM lfont OR color IS DISTINCT FROM lcolor)
AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 AND NOT coalesce(regexp_matches(font, {O.q(binding.SYMBOL_FONT)}), false)),
bw AS (SELECT *, greatest(y1 - y0, 1.0) AS h, greatest(ly1 - ly0, 1.0) AS lh FROM pr ANTI JOIN rt USING ({_G}) WHERE y0 > ly0 + 0.4 * greatest(ly1 - ly0, 1.0)
AND (least(x1, lx1) - greatest(x0, lx0) > 1.0 OR abs(x0 - lx0) <= 14.0)),
bs AS (SELECT *, row_number() OVER dn AS position, CASE WHEN coalesce(begins OR regexp_matches(text, {O.q(_OWN)}) OR y0 - coalesce(lag(y1) OVER dn, ly1) > 0.45 * greatest(h, lh) OR abs(x0 - lx0) > 14.0
OR {_FIN} OR regexp_matches(text, {O.q(MONEY)}) OR regexp_matches(text, {O.q(PERCENT)}) OR {_MISS}, true) THEN 1 ELSE 0 END AS stop FROM bw WINDOW dn AS (PARTITION BY {_G} ORDER BY y0, x0, block_no, line_no)),
bt AS (SELECT *, sum(stop) OVER (PARTITION BY {_G} ORDER BY position) AS stopped FROM bs),
pl AS (SELECT {_G}, label, expects, non_pii, unknown, 'right' AS how, 1 AS position, block_no, line_no, text FROM rt
UNION ALL SELECT {_G}, label, expects, non_pii, unknown, 'below', position, block_no, line_no, text FROM bt WHERE stopped = 0 AND position <= CASE WHEN expects = 'PERSON' THEN 2 ELSE 6 END),
p3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {O.KEY} ORDER BY label_block, label_line, label_start) > 1 THEN 1 ELSE 0 END AS lost FROM pl),
p4 AS (SELECT *, sum(lost) OVER (PARTITION BY {_G} ORDER BY position) AS lost_so_far FROM p3),
val AS (SELECT *, CAST(span_start + length(value) AS INTEGER) AS span_end FROM (SELECT {_G}, label, expects, non_pii, unknown, how, position, block_no, line_no, span_start, value FROM vi
UNION ALL SELECT {_G}, label, expects, non_pii, unknown, how, position, block_no, line_no, length(text) - length(ltrim(text, ' ')), {_TRIM} FROM p4 WHERE lost_so_far = 0))"""
_MEMBERS = f"""{O.CANDS}, {VALUES_CTE}, mem AS (SELECT {_G}, block_no, line_no, val.expects, val.span_start AS a, cand_id, pii_type, c.text, c.span_start AS s, c.span_end AS e,
least(c.span_end, val.span_end) - greatest(c.span_start, val.span_start) AS covered FROM val JOIN c USING (fixture, page_no, block_no, line_no) WHERE c.span_start < val.span_end AND val.span_start < c.span_end)"""
_SAT = "CASE t " + " ".join(f"WHEN {O.q(k)} THEN [{O.listed(v)}]" for k, v in SATISFIED_BY.items()) + " ELSE [t] END"
_SENS = f"coalesce({O.SENSITIVE_OF('value')}, false)"
_ELIGIBLE = f"NOT non_pii AND trim(regexp_replace(lower(trim(value, ' ')), '\\s+', ' ', 'g'), ' .:;') NOT IN ({O.listed(PLACEHOLDERS)}) AND (NOT unknown OR {_SENS})"


def _values(spark, d):
    lines = T.lines(spark, d)
    return binding.value_lines(lines, labels.detect_labels(lines))


@query(f"WITH {VALUES_CTE} SELECT {_G.replace('label_start', 'CAST(label_start AS INTEGER) AS label_start')}, label, expects, how, CAST(position AS INTEGER) AS position, block_no, line_no, CAST(span_start AS INTEGER) AS span_start, span_end, value FROM val")
def field_groups(spark, d):
    return _values(spark, d).select(*binding.GROUP, "label", F.array_join("expects", ",").alias("expects"), "how", "position", "block_no", "line_no", "span_start", "span_end", "value")


@query(f"""WITH {_MEMBERS}, g AS (SELECT {_G}, min(label) AS label, any_value(expects) AS expects FROM val WHERE expects <> '' GROUP BY ALL), f AS (SELECT {_G}, list(DISTINCT pii_type) AS found FROM mem GROUP BY ALL),
j AS (SELECT {_G}, label, coalesce(found, []) AS found, list_filter(string_split(expects, ','), lambda t: NOT list_has_any({_SAT}, coalesce(found, []))) AS missing FROM g LEFT JOIN f USING ({_G}))
SELECT {_G.replace('label_start', 'CAST(label_start AS INTEGER) AS label_start')}, label, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'complete' WHEN list_contains(found, 'UNCLASSIFIED_GROUP_VALUE') THEN 'unclassified' ELSE 'partial' END AS state FROM j""")
def group_coverage(spark, d):
    return binding.coverage(_values(spark, d), T.candidates(spark, d))


@query(f"""WITH {_MEMBERS}, k AS (SELECT {_G}, block_no, line_no, a AS span_start, sum(covered) AS covered FROM mem GROUP BY ALL)
SELECT {_G.replace('label_start', 'CAST(label_start AS INTEGER) AS label_start')}, block_no, line_no, CAST(span_start AS INTEGER) AS span_start, span_end, value, CASE WHEN expects <> '' AND NOT contains(expects, ',') THEN expects ELSE 'UNCLASSIFIED_GROUP_VALUE' END AS pii_type,
expects = '' OR contains(expects, ',') AS needs_review FROM val LEFT JOIN k USING ({_G}, block_no, line_no, span_start) WHERE {_ELIGIBLE} AND coalesce(covered, 0) < 0.95 * length(value)
AND NOT (expects <> '' AND len(list_filter(string_split(expects, ','), lambda t: t NOT IN ({O.listed(DIGIT_TYPES)}))) = 0 AND NOT regexp_matches(value, '[0-9]'))""")
def uncovered_values(spark, d):
    return binding.uncovered(_values(spark, d), T.candidates(spark, d))


@query(f"""WITH {_MEMBERS}, h2h AS (SELECT fixture, lower(trim(text, ' ')) AS value, page_no, label_block, label_line, label_start, label FROM mem JOIN (SELECT DISTINCT {_G}, label FROM val) USING ({_G})
WHERE covered * 2 >= e - s AND text IS NOT NULL) SELECT fixture, value, label FROM h2h QUALIFY row_number() OVER (PARTITION BY fixture, value ORDER BY page_no, label_block, label_line, label_start, label) = 1""")
def label_hints(spark, d):
    return binding.hints(_values(spark, d), T.candidates(spark, d))
