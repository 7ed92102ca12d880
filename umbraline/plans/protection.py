"""Queries of protected text, the gate and overlaps, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from umbraline.operators import binding, gate, labels, relations, rules
from umbraline.operators.rule_tables import STRONG_TYPES
from umbraline.plans import oracle as O
from umbraline.plans.queries import query
from umbraline.sources import tables as T

_SAID = "coalesce(lower(array_to_string(list_transform(evidence, lambda e: e.detail), ' ')), '')"
_STRENGTH = f"""CASE WHEN source IN ('manual', 'group') THEN 'strong' WHEN source = 'regex' AND (contains({_SAID}, 'label context') OR pii_type IN ({O.listed(STRONG_TYPES)})) THEN 'strong'
WHEN source = 'coverage' AND regexp_matches({_SAID}, 'entity|propagat|subject|alias') THEN 'strong' WHEN source IN ('coverage', 'regex') OR (source = 'ner' AND confidence >= 0.8) THEN 'medium' ELSE 'weak' END"""
_GUESS = f"(source NOT IN ('manual', 'regex', 'group') OR (source = 'group' AND contains({_SAID}, 'joint-name') AND group_id IS NULL))"


@query(f"WITH {O.CANDS} SELECT cand_id, {_STRENGTH} AS strength, {_GUESS} AS proposal FROM c")
def candidate_strengths(spark, d):
    c = T.candidates(spark, d)
    of = gate.strength(F.col("pii_type"), F.col("source"), F.col("confidence"), F.col("evidence"))
    return c.select("cand_id", of.alias("strength"), gate.is_proposal(F.col("source"), F.col("evidence"), F.col("group_id")).alias("proposal"))


@query(f"""WITH {O.NAME_TOKENS}, op AS (SELECT cand_id, fixture, pii_type, text FROM c WHERE {_GUESS} AND NOT coalesce(label_confirmed, false) AND NOT (source = 'coverage' AND {_STRENGTH} = 'strong')
AND text IS NOT NULL AND pii_type IS NOT NULL), pw AS (SELECT cand_id, fixture, unnest(list_distinct(string_split({O.fold('text')}, ' '))) AS token FROM op WHERE pii_type = 'PERSON'),
bo AS (SELECT cand_id FROM pw LEFT JOIN nt USING (fixture, token) WHERE length(token) >= 2 GROUP BY cand_id HAVING bool_and(nt.n IS NOT NULL)) SELECT cand_id FROM op ANTI JOIN bo USING (cand_id)""")
def held_proposals(spark, d):
    c = T.candidates(spark, d)
    return gate.held_back(c, relations.name_tokens(c))


@query(f"""WITH {O.CANDS}, w AS (SELECT DISTINCT {O.fold(O.NORM)} AS v FROM expected_decisions WHERE state = 'kept' AND text IS NOT NULL)
SELECT cand_id, CASE WHEN {_STRENGTH} = 'strong' THEN 'flagged' ELSE 'dropped' END AS outcome FROM (SELECT *, {O.fold(O.NORM)} AS v FROM c WHERE text IS NOT NULL) SEMI JOIN (SELECT * FROM w WHERE v <> '') USING (v)""")
def objected_candidates(spark, d):
    """Values that the decisions keep as they are: weak candidates go, strong ones are flagged."""
    rejected = T.table(spark, d, "expected_decisions").where("state = 'kept' and text is not null").select(F.col("text").alias("value"))
    return gate.objections(T.candidates(spark, d), rejected)


def _regions(spark, d):
    lines = T.lines(spark, d)
    found = labels.detect_labels(lines)
    return lines, gate.protected(lines, found, binding.value_lines(lines, found))


@query()
def protected_regions(spark, d):
    return _regions(spark, d)[1]


@query()
def gated(spark, d):
    lines, regions = _regions(spark, d)
    return gate.gated(T.candidates(spark, d), lines, regions)


@query()
def resolved_candidates(spark, d):
    return gate.resolved(T.candidates(spark, d))


@query(f"""WITH {O.LABELS_CTE}, {O.CANDS}, k AS (SELECT cand_id, c.fixture, c.page_no, l.x0 + (l.x1 - l.x0) * span_start / nullif(length(l.text), 0) AS a, l.x0 + (l.x1 - l.x0) * span_end / nullif(length(l.text), 0) AS b, l.y0, l.y1
FROM c JOIN l USING (fixture, page_no, block_no, line_no)), b AS (SELECT fixture, page_no, x0 + (x1 - x0) * label_start / nullif(length(text), 0) AS p, x0 + (x1 - x0) * label_end / nullif(length(text), 0) AS q, y0 AS r, y1 AS s FROM lab)
SELECT DISTINCT cand_id FROM k JOIN b USING (fixture, page_no) WHERE b > a AND y1 > y0 AND greatest(0.0, least(b, q) - greatest(a, p)) * greatest(0.0, least(y1, s) - greatest(y0, r)) >= 0.5 * (b - a) * (y1 - y0)""".replace("b AS (SELECT fixture", "bb AS (SELECT fixture").replace("JOIN b USING", "JOIN bb USING"))
def label_geometry_veto(spark, d):
    """Candidates at least half of whose rectangle a label's rectangle of the page covers."""
    lines = T.lines(spark, d)
    at = lambda c: F.col("x0") + (F.col("x1") - F.col("x0")) * F.col(c) / F.nullif(F.length("line"), F.lit(0))
    texts = lines.select(*T.LINE_KEY, "x0", "x1", "y0", "y1", F.col("text").alias("line"))
    cands = T.candidates(spark, d).join(texts, T.LINE_KEY).select("cand_id", "fixture", "page_no", at("span_start").alias("a"), at("span_end").alias("b"), "y0", "y1")
    found = labels.detect_labels(lines).withColumn("line", F.col("text")).select("fixture", "page_no", at("label_start").alias("p"), at("label_end").alias("q"), F.col("y0").alias("r"), F.col("y1").alias("s"))
    wide = F.greatest(F.lit(0.0), F.least("b", "q") - F.greatest("a", "p")) * F.greatest(F.lit(0.0), F.least("y1", "s") - F.greatest("y0", "r"))
    return cands.join(found, ["fixture", "page_no"]).where("b > a and y1 > y0").where(wide >= 0.5 * (F.col("b") - F.col("a")) * (F.col("y1") - F.col("y0"))).select("cand_id").distinct()


@query()
def figure_texts(spark, d):
    """Candidates whose whole text is one business figure, with its kind."""
    c = T.candidates(spark, d).where("text is not null").select(F.lit("").alias("fixture"), F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), F.col("cand_id").alias("line_no"), F.trim("text").alias("text"))
    found = rules.find_figures(c).join(c.select("line_no", "text"), "line_no").where("span_start = 0 and span_end = length(text)")
    return found.groupBy(F.col("line_no").alias("cand_id")).agg(F.min("kind").alias("kind"))
