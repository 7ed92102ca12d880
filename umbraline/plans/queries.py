"""Every query of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraline.functions import names as N
from umbraline.functions import text as X
from umbraline.functions import validators as V
from umbraline.operators import cleaning, graph, labels, pseudonyms, relations, rules
from umbraline.operators.rule_tables import RULES
from umbraline.plans import oracle as O
from umbraline.sources import tables as T
from umbraline.sources.tables import LINE_KEY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scans


@query(O.SCAN_LINES)
def scan_lines(spark, d):
    return T.document_lines(T.table(spark, d, "documents"))


@query(f"WITH {O.LINES} SELECT fixture, count(*) AS n_lines, count(DISTINCT page_no) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM l GROUP BY fixture")
def scan_pages(spark, d):
    return T.lines(spark, d).groupBy("fixture").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_distinct("page_no").alias("n_pages"), F.sum(F.length("text").cast("bigint")).alias("n_chars")
    )


@query(O.PAGE_QUALITY)
def page_quality(spark, d):
    """Pages with enough characters, few of them letters, or none that can be read."""
    chars = F.length(F.regexp_replace("text", r"[ \t\r\n\f\x0B]", "")).cast("bigint")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("bigint")
    bad = F.length(F.regexp_replace("text", "[^�\\x00-\\x08]", "")).cast("bigint")
    page = T.lines(spark, d).groupBy("fixture", "page_no").agg(F.sum(chars).alias("chars"), F.sum(letters).alias("letters"), F.sum(bad).alias("bad"))
    state = F.when(F.col("chars") < 24, "empty").when((F.col("bad") * 20 > F.col("chars")) | (F.col("letters") * 100 < F.col("chars") * 35), "unreadable").otherwise("ok")
    return page.select("fixture", "page_no", "chars", "letters", state.alias("state"))


@query(f"WITH {O.LINES} SELECT fixture, page_no, block_no, line_no, translate(text, {O.q(O.LOOKALIKE_FROM)}, {O.q(O.LOOKALIKE_TO)}) AS text FROM l")
def normalized_chars(spark, d):
    return T.lines(spark, d).select(*LINE_KEY, F.translate("text", O.LOOKALIKE_FROM, O.LOOKALIKE_TO).alias("text"))


@query("SELECT DISTINCT roster_id, pii_type, trim(regexp_replace(original, '[ \\t\\r\\n]+', ' ', 'g')) AS original, pseudonym FROM roster WHERE coalesce(pseudonym, '') <> ''")
def roster_scan(spark, d):
    rows = T.table(spark, d, "roster").where("coalesce(pseudonym, '') <> ''")
    return rows.select("roster_id", "pii_type", X.collapsed(F.col("original")).alias("original"), "pseudonym").distinct()


# Rules


@query()
def rule_hits(spark, d):
    return rules.detect_rules(T.lines(spark, d))


@query(O.rules_sql([r for r in RULES if r.name in O.PLAIN_RULES]))
def rule_hits_plain(spark, d):
    """The rules that need no look-around."""
    chosen = [r for r in RULES if r.name in O.PLAIN_RULES]
    return rules.detect_rules(T.lines(spark, d), chosen)


@query(O.digit_rules_sql())
def rule_hits_digits(spark, d):
    """The rules on runs of digits, checked place by place."""
    return rules.detect_rules(T.lines(spark, d), [r for r in RULES if r.name in O.DIGIT_RULES])


@query(O.CONTEXT)
def context_window(spark, d):
    return rules.with_context(T.lines(spark, d)).select(*LINE_KEY, F.md5("context").alias("context_md5"))


@query(O.MONEY)
def money_tokens(spark, d):
    found = T.lines(spark, d).select(*LINE_KEY, rules.financial_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return found.select(*LINE_KEY, F.array_join("t", " ").alias("tokens"))


@query()
def figures(spark, d):
    return rules.find_figures(T.lines(spark, d))


@query(O.VALIDATORS)
def validators(spark, d):
    c = T.candidates(spark, d).where("text is not null")
    return c.select("cand_id", *(V.valid(kind, "text").alias(f"valid_{kind}") for kind in V.SQL))


# Labels and their values


@query(O.LABELS)
def field_labels(spark, d):
    found = labels.detect_labels(T.lines(spark, d))
    return found.select(*LINE_KEY, "label", "label_start", "label_end", F.array_join("expects", ",").alias("expects"), "non_pii", "unknown")


@query(f"WITH {O.LABELS_CTE} SELECT fixture, page_no, block_no, line_no, label, value FROM lab WHERE value <> '' AND NOT non_pii")
def inline_values(spark, d):
    return labels.detect_labels(T.lines(spark, d)).where("value <> '' and not non_pii").select(*LINE_KEY, "label", "value")


@query(O.RIGHT)
def right_neighbours(spark, d):
    lines = T.lines(spark, d)
    return labels.right_neighbours(labels.detect_labels(lines), lines)


@query(O.STACKED)
def stacked_values(spark, d):
    lines = T.lines(spark, d)
    return labels.stacked_values(lines, labels.detect_labels(lines))


@query(O.CLIPPED)
def clipped_by_labels(spark, d):
    return relations.clipped_by_labels(T.candidates(spark, d), labels.detect_labels(T.lines(spark, d)))


@query(O.RETYPED)
def retyped_from_labels(spark, d):
    return relations.retyped_from_labels(T.candidates(spark, d), labels.detect_labels(T.lines(spark, d)))


# Aggregations


@query(O.ADJUDICATED)
def adjudicated(spark, d):
    return relations.adjudicated(T.candidates(spark, d)).select("cand_id", "score", "verdict")


@query(f"WITH a AS ({O.ADJUDICATED}) SELECT verdict, count(*) AS n FROM a GROUP BY verdict")
def adjudication_counts(spark, d):
    return relations.adjudicated(T.candidates(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {O.CANDS} SELECT pii_type, {O.NORM_TEXT} AS value, count(*) AS occurrences, bool_or(needs_review) AS needs_review FROM c "
       "WHERE text IS NOT NULL AND pii_type IS NOT NULL GROUP BY 1, 2")  # fmt: skip
def occurrence_groups(spark, d):
    return relations.occurrence_groups(T.candidates(spark, d))


@query(f"WITH {O.CANDS} SELECT fixture, pii_type, text, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT page_no + 1)), ',') AS pages FROM c "
       "WHERE text IS NOT NULL AND pii_type IS NOT NULL GROUP BY ALL")  # fmt: skip
def occurrence_changes(spark, d):
    return relations.changes(T.candidates(spark, d))


@query(f"WITH {O.LINES} SELECT fixture, {O.NORM_TEXT} AS value, CAST(floor(y0 / 6) AS BIGINT) AS band, count(DISTINCT page_no) AS n_pages, count(*) AS n_lines FROM l "
       f"WHERE text IS NOT NULL AND length({O.NORM_TEXT}) >= 4 GROUP BY ALL HAVING count(DISTINCT page_no) >= 3")  # fmt: skip
def form_repeat(spark, d):
    return relations.repeated_text(T.lines(spark, d))


@query(O.STYLES)
def form_styles(spark, d):
    lines = T.lines(spark, d)
    return relations.form_styles(labels.detect_labels(lines), lines)


@query(f"WITH {O.LINES}, w AS (SELECT fixture, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM l WHERE regexp_matches(text, '^[A-Z][A-Z ]+$')) "
       "SELECT fixture, word, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3")  # fmt: skip
def form_vocabulary(spark, d):
    return relations.form_vocabulary(T.lines(spark, d))


@query(f"WITH {O.NAME_TOKENS} SELECT * FROM nt")
def confirmed_name_tokens(spark, d):
    return relations.name_tokens(T.candidates(spark, d))


@query(O.ALL_CONFIRMED)
def all_words_confirmed(spark, d):
    return relations.all_words_confirmed(T.candidates(spark, d))


@query(O.GAPS)
def coverage_gaps(spark, d):
    return relations.coverage_gaps(T.candidates(spark, d))


@query(O.METRICS)
def eval_metrics(spark, d):
    return relations.metrics(T.candidates(spark, d), T.table(spark, d, "expected_decisions"))


# Joins and windows


@query(O.ROSTER_LOOKUP)
def roster_lookup(spark, d):
    registry = T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"])
    return relations.roster_lookup(registry, T.table(spark, d, "roster"))


@query(f"WITH {O.LINES} SELECT fixture, page_no, block_no, line_no, row_number() OVER (PARTITION BY fixture, page_no ORDER BY floor(((x0 + x1) / 2) / 306.0), y0, x0, block_no, line_no) AS position FROM l")
def reading_order(spark, d):
    return relations.reading_order(T.lines(spark, d))


@query(f"WITH {O.LINES} SELECT fixture, page_no, block_no, line_no, lag(text) OVER w AS before, lead(text) OVER w AS after FROM l WINDOW w AS (PARTITION BY fixture, page_no ORDER BY block_no, line_no)")
def neighbour_lines(spark, d):
    return relations.neighbours(T.lines(spark, d))


@query(O.WINDOWS)
def word_windows(spark, d):
    return relations.word_windows(T.table(spark, d, "documents"))


@query(O.FIRST_SEEN)
def first_seen(spark, d):
    return relations.first_seen(T.candidates(spark, d))


@query(O.SEARCH)
def search_status(spark, d):
    hits = T.records(T.table(spark, d, "search_hits").drop("found_at"), ["hit_id"])
    return relations.search_status(hits, T.candidates(spark, d))


# Scalar functions


@query(f"WITH {O.CANDS} SELECT cand_id, {O.fold('text')} AS folded FROM c")
def folded(spark, d):
    return T.candidates(spark, d).select("cand_id", X.fold(F.col("text")).alias("folded"))


@query(f"WITH {O.CANDS} SELECT cand_id, {O.NORM} AS normalized FROM c")
def normalized_values(spark, d):
    return T.candidates(spark, d).select("cand_id", X.normalized(F.col("text")).alias("normalized"))


@query(O.KEYS)
def entity_keys(spark, d):
    return T.candidates(spark, d).where("text is not null").select("cand_id", X.entity_key(F.col("pii_type"), F.col("text")).alias("k")).select("cand_id", "k.key_type", "k.key")


@query(f"WITH {O.CANDS} SELECT cand_id, regexp_replace(regexp_replace(regexp_replace(text, '\\p{{Lu}}', 'X', 'g'), '\\p{{Ll}}', 'x', 'g'), '[0-9]', '9', 'g') AS shape FROM c")
def shapes(spark, d):
    return T.candidates(spark, d).select("cand_id", X.shape(F.col("text")).alias("shape"))


@query(f"""WITH {O.CANDS}, w AS (SELECT cand_id, unnest(string_split_regex(text, '[ \\t]+')) AS t FROM c WHERE text IS NOT NULL)
SELECT cand_id, t AS token, CASE WHEN NOT regexp_matches(t, '\\p{{L}}') THEN NULL WHEN NOT regexp_matches(t, '\\p{{Lu}}|\\p{{Ll}}') THEN 'caseless'
WHEN NOT regexp_matches(t, '\\p{{Ll}}') THEN 'upper' WHEN NOT regexp_matches(t, '\\p{{Lu}}') THEN 'lower'
WHEN regexp_matches(t, '^[^\\p{{L}}]*\\p{{Lu}}[^\\p{{Lu}}]*$') THEN 'title' ELSE 'mixed' END AS case_class FROM w""")
def case_classes(spark, d):
    tokens = T.candidates(spark, d).where("text is not null").select("cand_id", F.explode(F.split("text", "[ \t]+")).alias("token"))
    return tokens.select("cand_id", "token", X.case_class(F.col("token")).alias("case_class"))


@query(O.PERSON_SHAPE)
def person_shapes(spark, d):
    return T.candidates(spark, d).where("text is not null").select("cand_id", N.looks_like_person(F.col("text")).alias("p")).select("cand_id", "p.is_person", "p.confidence")


@query(O.PARSED)
def parsed_names(spark, d):
    c = T.candidates(spark, d).where("pii_type = 'PERSON' and text is not null").select("cand_id", N.parse_person(F.col("text")).alias("p"))
    return c.select("cand_id", F.array_join("p.given", " ").alias("given"), "p.surname", "p.surname_first")


@query()
def same_person_pairs(spark, d):
    """Pairs of distinct names of a document that can be one person; names meet at the folded surname."""
    c = T.candidates(spark, d).where("pii_type = 'PERSON' and text is not null").select("fixture", X.normalized(F.col("text")).alias("name")).distinct()
    c = c.withColumn("p", N.parse_person(F.col("name"))).withColumn("s", X.fold(F.col("p.surname"))).where("s <> ''")
    a, b = (c.select("fixture", "s", F.col("name").alias(f"name_{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    return a.join(b, ["fixture", "s"]).where("name_a < name_b").where(N.same_person(F.col("pa"), F.col("pb"))).select("fixture", "name_a", "name_b")


@query(O.SEEDS)
def pseudonym_seeds(spark, d):
    registry = T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"])
    return registry.select("record_id", pseudonyms.seed(F.col("scope_ref"), F.col("pii_type"), F.col("original")).cast("string").alias("seed"))


@query(O.MASKED)
def masked_values(spark, d):
    registry = T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"])
    rows = registry.where("original is not null").withColumn("seed", pseudonyms.seed(F.col("scope_ref"), F.col("pii_type"), F.col("original")))
    return rows.select("record_id", pseudonyms.masked(F.col("original"), F.col("seed")).alias("masked"))


@query(O.RECTS)
def line_rects(spark, d):
    """The rectangle of each block, and the share of it that its lines cover."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    block = T.lines(spark, d).groupBy("fixture", "page_no", "block_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.sum(area), 2).alias("covered")
    )
    return block.withColumn("share", F.round(F.col("covered") / F.nullif(area, F.lit(0.0)), 4))


# Cleaning


@query(O.TRIMMED)
def trimmed_persons(spark, d):
    return cleaning.trimmed(T.candidates(spark, d))


@query(O.COMPOUNDS)
def split_compounds(spark, d):
    return cleaning.split_compounds(T.candidates(spark, d))


@query(O.JOINT)
def joint_names(spark, d):
    return cleaning.joint_names(T.lines(spark, d))


@query(f"WITH {O.CANDS} SELECT cand_id FROM c WHERE {O.NORM} IN ({O.listed(N.STATE_CODES)})")
def bare_states(spark, d):
    return cleaning.bare_states(T.candidates(spark, d))


@query(O.LABEL_TEXTS)
def label_texts(spark, d):
    return cleaning.label_texts(T.candidates(spark, d), labels.detect_labels(T.lines(spark, d)))


@query(f"WITH {O.CANDS}, {O.LINES} SELECT cand_id FROM c SEMI JOIN (SELECT * FROM l WHERE color = {cleaning.REPLACED_COLOR}) USING (fixture, page_no, block_no, line_no)")
def in_replaced_text(spark, d):
    return cleaning.in_replaced_text(T.candidates(spark, d), T.lines(spark, d))


@query(O.SENSITIVE)
def sensitive_values(spark, d):
    return T.candidates(spark, d).where("text is not null").select("cand_id", cleaning.looks_sensitive(F.col("text")).alias("sensitive"))


@query(O.LEAKING)
def leaking_pseudonyms(spark, d):
    return cleaning.leaking_pseudonyms(T.records(T.table(spark, d, "registry").drop("ingested_at"), ["record_id"]))


@query(O.VARIANTS)
def spelling_variants(spark, d):
    return cleaning.spelling_variants(T.candidates(spark, d))


@query(O.SUBJECTS)
def subjects(spark, d):
    return cleaning.subjects(T.candidates(spark, d))


@query(O.SUFFIXED)
def name_suffixes(spark, d):
    return cleaning.suffixed(T.candidates(spark, d))


# Resolution, entities, rewriting


@query()
def resolved_overlaps(spark, d):
    return relations.resolve_overlaps(T.candidates(spark, d))


@query(O.COMPONENTS)
def entity_components(spark, d):
    """Candidates linked through one line or one field group."""
    return graph.components(T.candidates(spark, d), "cand_id", [LINE_KEY, ["fixture", "group_id"]])


@query()
def propagated(spark, d):
    return relations.propagated(T.lines(spark, d), T.candidates(spark, d))


@query()
def figure_overlaps(spark, d):
    lines = T.lines(spark, d)
    return relations.figure_overlaps(T.candidates(spark, d), rules.find_figures(lines))


@query()
def rewritten_lines(spark, d):
    return relations.rewritten_lines(T.lines(spark, d), T.candidates(spark, d))


@query()
def leak_check(spark, d):
    c = T.candidates(spark, d)
    return relations.leaks(relations.rewritten_lines(T.lines(spark, d), c), c)


# Further groups of queries register themselves.
from umbraline.plans import binding, entities, protection, replacing  # noqa: E402, F401

ORACLES |= {"rewritten_lines": replacing.O_REWRITTEN, "leak_check": replacing.O_LEAKS, "propagated": replacing.O_PROPAGATED, "same_person_pairs": replacing.O_PAIRS}
