"""The deterministic rules as one pass over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.functions.offsets import quoted, spans, spans_sql
from umbraline.functions.validators import valid_sql
from umbraline.operators.rule_tables import FIGURES, RULES, Rule
from umbraline.sources.tables import LINE_KEY

#: Lines above in the same column that count as context, and how near the line directly above is, in heights.
CONTEXT_LINES, ADJACENT = 8, 1.8
MONEY = r"\$\s?-?[\d,]+(?:\.\d{1,2})?|\(\s?\$\s?[\d,]+(?:\.\d{1,2})?\s?\)|\(\s?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?\s?\)"
PERCENT = r"-?\d+(?:\.\d+)?\s?%"


def with_context(lines: DataFrame) -> DataFrame:
    """``lines`` with ``context``: the line, the one directly above and those above in its column, in lower case.

    Lines above end no more than a point below the line's top. The nearest of them counts if it is
    within ADJACENT heights; of those that overlap the line from side to side the CONTEXT_LINES lowest.
    A page is joined with itself and bounded by what fits on paper, so nothing grows with the data.
    """
    own = lines.select(*LINE_KEY, "x0", "y0", "x1", F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)).alias("height"))
    above = lines.select("fixture", "page_no", F.struct((-F.col("y1")).alias("up"), F.col("block_no").alias("b"), F.col("line_no").alias("l"), "text").alias("o"),
                         F.col("x0").alias("ox0"), F.col("x1").alias("ox1"))
    pairs = own.join(above, ["fixture", "page_no"]).where(-F.col("o.up") <= F.col("y0") + 1)
    near = F.col("y0") + F.col("o.up") < ADJACENT * F.col("height")
    column = ~((F.col("ox1") < F.col("x0") - 2) | (F.col("x1") < F.col("ox0") - 2))
    found = pairs.groupBy(*LINE_KEY).agg(
        F.min(F.when(near, F.col("o"))).alias("nearest"), F.slice(F.array_sort(F.collect_list(F.when(column, F.col("o")))), 1, CONTEXT_LINES).alias("column")
    )
    joined = lines.join(found, LINE_KEY, "left")
    texts = F.concat(F.array(F.col("text"), F.col("nearest.text")), F.coalesce(F.transform("column", lambda o: o["text"]), F.array().cast("array<string>")))
    return joined.withColumn("context", F.lower(F.array_join(texts, " "))).drop("nearest", "column")


def _pattern(rule: Rule) -> str:
    return rule.pattern if rule.case_sensitive else "(?i)" + rule.pattern


def _hits(rule: Rule) -> str:
    """SQL of one rule's hits on a line with ``text``, ``context`` and ``money``."""
    cue = "(" + " OR ".join(f"contains(context, {quoted(c)})" for c in rule.cues) + ")" if rule.cues else "false"
    ok = valid_sql(rule.validator, "m.value") if rule.validator else "true"
    sure = f"CASE WHEN {cue} THEN least(0.99D, {rule.confidence + 0.08!r}D) ELSE {rule.confidence!r}D END"
    review = f"NOT {ok} OR NOT {cue}" if rule.review_unless_context else f"NOT {ok}"
    keep = f"({ok} OR {cue})"
    if rule.money_guard:
        keep += " AND NOT exists(money, x -> x.span_start <= m.span_start AND x.span_end >= m.span_end) AND NOT contains(substring(text, greatest(m.span_start - 1, 1), least(m.span_start, 2)), '$')"
    row = (
        f"named_struct('rule', {quoted(rule.name)}, 'pii_type', {quoted(rule.pii_type)}, 'span_start', m.span_start, 'span_end', m.span_end, 'value', m.value, "
        f"'confidence', round(CASE WHEN {ok} THEN {sure} ELSE least({sure}, 0.6D) END, 4), 'needs_review', {review})"
    )
    hits = f"transform(filter({spans_sql('text', _pattern(rule))}, m -> {keep}), m -> {row})"
    # A rule that needs a cue is not even tried on a line without one.
    return f"CASE WHEN {cue} THEN {hits} END" if rule.context_required else hits


def detect_rules(lines: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Every match of every rule: line key, rule, pii_type, span, value, confidence, needs_review.

    A match is dropped without its required cue, inside an amount where the rule guards against
    that, and if its check fails with no cue near. Null and empty lines have none.
    """
    money = F.concat(spans("text", MONEY), spans("text", PERCENT))
    # explode keeps the amounts of a line from being found again for every rule.
    scanned = with_context(lines).withColumn("money", F.explode(F.array(money)))
    hits = F.expr(f"flatten(array_compact(array({', '.join(map(_hits, rules))})))")
    found = scanned.select(*LINE_KEY, F.explode(hits).alias("h"))
    return found.select(*LINE_KEY, "h.rule", "h.pii_type", "h.span_start", "h.span_end", "h.value", "h.confidence", "h.needs_review")


def financial_tokens(text: Column) -> Column:
    """Sorted amounts and percentages of ``text``, without blanks."""
    found = F.concat(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0)))
    return F.array_sort(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda m: F.regexp_replace(m, r"\s", "")))


def find_figures(lines: DataFrame, kinds: list[tuple[str, str, str]] = FIGURES) -> DataFrame:
    """(line key, kind, reason, span_start, span_end, value): every business figure or form reference, blanks at the ends cut."""

    def family(kind: str, reason: str, pattern: str) -> Column:
        def trimmed(m: Column) -> Column:
            lead = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], r"^\s+", ""))
            value = F.regexp_replace(m["value"], r"^\s+|\s+$", "")
            start = (m["span_start"] + lead).cast("int")
            return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), start.alias("span_start"), (start + F.length(value)).alias("span_end"), value.alias("value"))

        return F.transform(spans("text", pattern), trimmed)

    found = lines.select(*LINE_KEY, F.explode(F.concat(*(family(*k) for k in kinds))).alias("f"))
    return found.select(*LINE_KEY, "f.*").where(F.col("value").rlike(r"[\p{L}\p{N}]"))
