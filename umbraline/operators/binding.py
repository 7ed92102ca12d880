"""Field groups: the values that belong to a label, beside it, to its right or below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.operators.cleaning import looks_sensitive
from umbraline.operators.labels import BELOW_GAP, LEFT_DRIFT, RIGHT_GAP, STACKED, last_labels
from umbraline.operators.rule_tables import DIGIT_TYPES, PLACEHOLDERS, SATISFIED_BY
from umbraline.operators.rules import MONEY, PERCENT
from umbraline.sources.tables import LINE_KEY

#: A label that is a person's name takes at most this many lines below it.
NAME_LINES = 2
#: A value is covered if at least this share of its characters is.
COVERED = 0.95
# A line that is a label of its own, shapes of addresses and streets, fonts of signs.
OWN_LABEL = r"^[\s\-‐-―•*]*[A-Za-z][A-Za-z '&/().#\-]{1,40}:(\s|$)"
ADDRESS_SHAPE = (
    r"(?i),\s*(?:AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|"
    r"WA|WV|WI|WY|DC)\.?\s*[0-9]{5}?\b"
)
STREET_SHAPE = (
    r"(?i)^[0-9]{1,6}\s+\S+.*\b(?:st|street|ave|avenue|rd|road|blvd|dr|drive|ln|lane|ct|court|way|cir|circle|pl|place|ter|terrace|pkwy|hwy|cmn|common|apt|ste|unit)\b"
)
SYMBOL_FONT = r"(?i)pistd|dingbat|symbol|wingding|zapf"
GROUP = ["fixture", "page_no", "label_block", "label_line", "label_start"]


def pure_financial(text: Column) -> Column:
    """Blank, or nothing but an amount or a percentage."""
    t = F.trim(text)
    return (t == "") | t.rlike(rf"^(?:{MONEY}|{PERCENT})$") | (t.rlike(r"^[\s$()\-]*[0-9,.]+[\s$()%]*$") & t.rlike(r"[$%]"))


def placeholder(text: Column) -> Column:
    """What a form holds where it names nobody."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), F.lit(" .:;")).isin(PLACEHOLDERS)


def shape_mismatch(text: Column, expects: Column) -> Column:
    """An address under a label that announces a person and nothing else."""
    t = F.trim(text)
    return (F.array_join(expects, ",") == "PERSON") & (t.rlike(ADDRESS_SHAPE) | t.rlike(STREET_SHAPE))


def shape_fits(text: Column, expects: Column) -> Column:
    """Types that are made of digits need one."""
    digits = (F.size(expects) > 0) & (F.size(F.array_except(expects, F.lit(DIGIT_TYPES))) == 0)
    return ~digits | text.rlike("[0-9]")


def value_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(GROUP, label, expects, non_pii, unknown, how, position, block_no, line_no, span_start, span_end, value).

    ``how`` is ``inline`` (behind the label, up to the next one), ``right`` (the nearest line of the
    row, in another style) or ``below``. Lines below belong to a label as long as they lie in its
    column without a gap, begin no label of their own and hold no figure; lines of other columns are passed over.
    A line that several labels reach goes to the first of them, and with it all that the others have further down. Pages are joined with
    themselves, so the work is bounded by what fits on a page.
    """
    kept = [F.col("block_no").alias("label_block"), F.col("line_no").alias("label_line"), "label_start", "label", "expects", "non_pii", "unknown"]
    behind = F.substring(F.col("text"), F.col("label_end") + 1, F.length("text"))
    start = F.col("label_end") + F.length(behind) - F.length(F.ltrim(behind))
    inline = labels.where("value <> ''").select(
        "fixture", "page_no", *kept, F.lit("inline").alias("how"), F.lit(1).alias("position"), "block_no", "line_no",
        start.cast("int").alias("span_start"), (start + F.length("value")).cast("int").alias("span_end"), "value",
    )

    open_ = last_labels(labels).where("value = ''").select(
        "fixture", "page_no", *kept, *(F.col(c).alias("l" + c) for c in ("x0", "y0", "x1", "y1")), F.struct("font", "color").alias("lstyle")
    )
    begins = labels.where("label_start = 0").select(*LINE_KEY, F.lit(True).alias("begins")).distinct()
    known = labels.where("not unknown").select(*LINE_KEY, F.lit(True).alias("known")).distinct()
    others = lines.join(begins, LINE_KEY, "left").join(known, LINE_KEY, "left").select(
        "fixture", "page_no", "block_no", "line_no", "text", "x0", "y0", "x1", "y1", "font", F.struct("font", "color").alias("style"), "begins", "known"
    )
    pairs = open_.join(others, ["fixture", "page_no"]).where("block_no <> label_block or line_no <> label_line")

    middle = (F.col("ly0") + F.col("ly1")) / 2
    row = pairs.where((F.col("x0") >= F.col("lx1") - 0.5) & (F.col("y0") <= middle) & (middle <= F.col("y1")) & (F.trim("text") != ""))
    nearest = row.withColumn("position", F.row_number().over(Window.partitionBy(*GROUP).orderBy("x0", "block_no", "line_no"))).where("position = 1")
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 2
    right = nearest.where(
        (F.col("x0") - F.col("lx1") <= RIGHT_GAP) & F.col("begins").isNull() & F.col("known").isNull() & ~F.col("style").eqNullSafe(F.col("lstyle"))
        & letters & ~F.coalesce(F.col("font").rlike(SYMBOL_FONT), F.lit(False))
    )

    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    label_height = F.greatest(F.col("ly1") - F.col("ly0"), F.lit(1.0))
    in_column = (F.least("x1", "lx1") - F.greatest("x0", "lx0") > 1.0) | (F.abs(F.col("x0") - F.col("lx0")) <= LEFT_DRIFT)
    below = pairs.where((F.col("y0") > F.col("ly0") + 0.4 * label_height) & in_column).join(right.select(*GROUP), GROUP, "left_anti")
    down = Window.partitionBy(*GROUP).orderBy("y0", "x0", "block_no", "line_no")
    gap = F.col("y0") - F.coalesce(F.lag("y1").over(down), F.col("ly1"))
    stop = (
        F.col("begins").isNotNull() | F.col("text").rlike(OWN_LABEL) | (gap > BELOW_GAP * F.greatest(height, label_height)) | (F.abs(F.col("x0") - F.col("lx0")) > LEFT_DRIFT)
        | pure_financial(F.col("text")) | F.col("text").rlike(MONEY) | F.col("text").rlike(PERCENT) | shape_mismatch(F.col("text"), F.col("expects"))
    )
    cap = F.when(F.array_join("expects", ",") == "PERSON", NAME_LINES).otherwise(STACKED)
    stacked = below.withColumns({"stop": F.coalesce(stop, F.lit(True)).cast("int"), "position": F.row_number().over(down)})
    stacked = stacked.withColumn("stopped", F.sum("stop").over(down)).where((F.col("stopped") == 0) & (F.col("position") <= cap))
    out = ["fixture", "page_no", "label_block", "label_line", "label_start", "label", "expects", "non_pii", "unknown", "how", "position", "block_no", "line_no"]
    placed = right.withColumn("how", F.lit("right")).select(*out, "text").unionByName(stacked.withColumn("how", F.lit("below")).select(*out, "text"))
    first = F.row_number().over(Window.partitionBy(*LINE_KEY).orderBy("label_block", "label_line", "label_start"))
    placed = placed.withColumn("lost", (first > 1).cast("int"))
    placed = placed.withColumn("lost", F.sum("lost").over(Window.partitionBy(*GROUP).orderBy("position"))).where("lost = 0")
    lead = F.length("text") - F.length(F.ltrim("text"))
    whole = placed.select(*out, lead.cast("int").alias("span_start"), (lead + F.length(F.trim("text"))).cast("int").alias("span_end"), F.trim("text").alias("value"))
    return inline.unionByName(whole)


def eligible(values: DataFrame) -> DataFrame:
    """The values a label vouches for: all of a known label's, those of an unknown one that look sensitive, no placeholders."""
    return values.where(~F.col("non_pii") & ~placeholder(F.col("value")) & (~F.col("unknown") | looks_sensitive(F.col("value"))))


def members(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(GROUP, line key, expects, cand_id, pii_type, covered): the candidates that touch a value of a group, and how much of it."""
    v = values.select(*GROUP, "block_no", "line_no", "expects", F.col("span_start").alias("a"), F.col("span_end").alias("b"), "value")
    joined = v.join(candidates.select(*LINE_KEY, "cand_id", "pii_type", "span_start", "span_end"), LINE_KEY).where("span_start < b and a < span_end")
    return joined.withColumn("covered", F.least("span_end", "b") - F.greatest("span_start", "a"))


def coverage(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(GROUP, label, missing, state) of the groups that announce something: ``complete``, ``partial`` or ``unclassified``.

    An expected type is there if a candidate of a type that satisfies it touches a value of the group.
    """
    found = members(values, candidates).groupBy(*GROUP).agg(F.collect_set("pii_type").alias("found"))
    table = F.create_map(*(F.lit(x) for t, ok in SATISFIED_BY.items() for x in (t, ok)))
    groups = values.where(F.size("expects") > 0).groupBy(*GROUP).agg(F.min("label").alias("label"), F.first("expects").alias("expects"))
    joined = groups.join(found, GROUP, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    missing = F.filter("expects", lambda t: ~F.arrays_overlap(F.coalesce(table[t], F.array(t)), F.col("found")))
    state = F.when(F.size("missing") == 0, "complete").when(F.array_contains("found", "UNCLASSIFIED_GROUP_VALUE"), "unclassified").otherwise("partial")
    return joined.withColumn("missing", missing).select(*GROUP, "label", F.array_join("missing", ",").alias("missing"), state.alias("state"))


def uncovered(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(GROUP, line key, span_start, span_end, value, pii_type, needs_review): a candidate for each value that none covers.

    Its type is the only one its label announces; otherwise it stays unclassified, for review.
    """
    covered = members(values, candidates).groupBy(*GROUP, "block_no", "line_no", "a").agg(F.sum("covered").alias("covered"))
    joined = eligible(values).join(covered.withColumnRenamed("a", "span_start"), [*GROUP, "block_no", "line_no", "span_start"], "left")
    bare = joined.where((F.coalesce("covered", F.lit(0)) < COVERED * F.length("value")) & shape_fits(F.col("value"), F.col("expects")))
    kind = F.when(F.size("expects") == 1, F.col("expects")[0]).otherwise("UNCLASSIFIED_GROUP_VALUE")
    return bare.select(*GROUP, "block_no", "line_no", "span_start", "span_end", "value", kind.alias("pii_type"), (F.size("expects") != 1).alias("needs_review"))


def hints(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fixture, value, label): under which label each candidate's value stands first, at least half of it inside."""
    inside = members(values, candidates).join(candidates.select("cand_id", "text", F.col("span_start").alias("s"), F.col("span_end").alias("e")), "cand_id")
    half = inside.where("covered * 2 >= e - s and text is not null").join(values.select(*GROUP, "label").distinct(), GROUP)
    first = F.min(F.struct("page_no", "label_block", "label_line", "label_start", "label")).alias("f")
    return half.groupBy("fixture", F.lower(F.trim("text")).alias("value")).agg(first).select("fixture", "value", F.col("f.label").alias("label"))
