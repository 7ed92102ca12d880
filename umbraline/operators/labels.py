"""Field labels, and the values that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from umbraline.functions.offsets import spans
from umbraline.operators.rule_tables import FIGURE_LABELS, FORM_WORDS, LABELS
from umbraline.sources.tables import LINE_KEY

#: A figure label must cover this share of the text.
DOMINANCE = 0.3
#: Points: how far to the right a value may start, and how far below, in heights of its label.
RIGHT_GAP, BELOW_GAP, LEFT_DRIFT, STACKED = 80.0, 0.45, 14.0, 6
# What is a value and no label; words before "city" that make it a label.
VALUE = r"@|\d{4,}|\$\s?[\d,]+|\d{3}[.\-]\d{3}[.\-]\d{4}"
PLACE_MODIFIERS = ["your", "my", "his", "her", "their", "spouse's", "mailing", "current", "previous", "birth", "resident", "residence", "foreign"]
LABEL = ["label", "label_start", "label_end", "expects", "non_pii", "unknown"]


def cleaned(text: Column) -> Column:
    """Without bullets before and leaders behind."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[.…_\-]{2,}\s*$", ""), r"^[\s\-‐-―•●▪*]+", ""))


def matched_labels(labels: DataFrame) -> DataFrame:
    """(label, m) for the distinct ``labels`` (label) that are labels: m is a struct of what each announces.

    A figure label that covers enough of it wins; otherwise, of the labels that are not buried in a
    sentence, the one whose match ends last and is longest; the name of a place is none; a text of
    letters that is neither is an unknown label. Every pattern is tried once on each distinct label: explode
    holds its matches, so that what follows does not try it again.
    """
    first = lambda p: F.regexp_extract("label", rf"(?i)\b(?:{p})\b", 0)
    tried = labels.distinct().where("label <> '' and length(label) <= 110").select(
        "label", F.explode(F.array(F.struct(F.array(*(first(p) for p in FIGURE_LABELS)).alias("figures"), F.array(*(first(p) for p, _ in LABELS)).alias("named")))).alias("t")
    )
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    def option(found: Column, n: Column) -> Column:
        end = F.instr(F.col("label"), found) + F.length(found)
        before = F.regexp_replace(F.substring(F.col("label"), F.lit(1), F.instr(F.col("label"), found) - 1), r"(?i)^\s*if\b[^,.;:]{0,40},\s*", "")
        buried = (words(F.col("label")) > 4) & (words(before) > 2)
        return F.when((F.length(F.trim(found)) >= 3) & ~buried, F.struct(end.alias("e"), F.length(found).alias("l"), (-n).alias("o"), n.alias("n")))

    figure = F.array_max(F.transform("t.figures", F.length)) >= DOMINANCE * F.length("label")
    best = F.array_max(F.filter(F.transform("t.named", option), lambda o: o.isNotNull()))["n"]
    expects = F.lit([",".join(e) for _, e in LABELS])
    plain = F.col("label").rlike(r"^[A-Za-z][A-Za-z0-9 '&/().,\-]{1,44}$")
    place = F.col("label").rlike(r"(?i)^(?:\p{L}[\p{L}\p{N}_.'’\-]*\s+){1,3}(?:city|town)\.?$") & ~F.arrays_overlap(
        F.transform(F.split(F.lower("label"), r"\s+"), lambda w: F.btrim(w, F.lit(".,'’"))), F.lit([w for w in [*FORM_WORDS, *PLACE_MODIFIERS] if w not in ("city", "town")])
    )
    judged = tried.select("label", figure.alias("figure"), best.alias("best"), plain.alias("plain"), place.alias("place"))
    known = F.when(F.col("best").isNotNull() & ~F.col("figure"), F.split(F.get(expects, F.col("best")), ",")).otherwise(F.array().cast("array<string>"))
    m = F.struct(known.alias("expects"), F.col("figure").alias("non_pii"), (~F.col("figure") & F.col("best").isNull()).alias("unknown"))
    return judged.where("figure or (best is not null and not place) or (best is null and plain)").select("label", m.alias("m"))


def detect_labels(lines: DataFrame) -> DataFrame:
    """``lines`` by their labels, with LABEL columns, ``value`` (what stands behind a label up to the next) and ``n_label``.

    A line that begins with words and a colon has that label and those behind a gap that end in a
    colon. If the words before the colon hold a value, the fields between the gaps each have the words before
    their value as their label. A line without a colon that holds no value is a label itself if it
    is a known one.
    """
    raw = F.regexp_extract("text", r"^([^:]{2,60}):", 1)
    item = lambda label, a, b: F.struct(label.alias("raw"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    begun = lines.withColumn("head", raw)

    def piece(m: Column, i: Column) -> Column:
        label = F.rtrim(F.regexp_extract(m["value"], r"^((?:[^\s\d@$]+(?: |$))*)", 1))
        whole = (i == F.size("pieces") - 1) & (label == m["value"])
        return item(label, m["span_start"], m["span_start"] + F.length(label) + whole.cast("int"))

    def later(m: Column) -> Column:
        label = F.regexp_extract(m["value"], r"^[ \t]+(.*):$", 1)
        return item(label, m["span_end"] - 1 - F.length(label), m["span_end"])

    further = F.filter(spans("text", r"(?<=\S)(?: {2,}|\t+)[A-Za-z][A-Za-z '&/().,\-]{1,40}?:"), lambda m: m["span_start"] > F.length("head"))
    marked = begun.withColumns({"pieces": spans("head", r"\S+(?: \S+)*"), "further": further})
    found = (
        F.when(F.col("head").rlike(VALUE), F.transform("pieces", piece))
        .when(F.col("head") != "", F.concat(F.array(item(F.col("head"), F.lit(0), F.length("head") + 1)), F.transform("further", later)))
        .when(~F.col("text").rlike(VALUE), F.array(item(F.col("text"), F.lit(0), F.length("text"))))
    )
    each = marked.select(*lines.columns, "head", F.explode(found).alias("x")).withColumn("label", cleaned(F.col("x.raw"))).where("label <> ''")
    known = each.join(matched_labels(each.select("label")), "label").where("head <> '' or not m.unknown")
    in_line = Window.partitionBy(*LINE_KEY).orderBy("x.a")
    until = F.coalesce(F.lead("x.a").over(in_line), F.length("text"))
    return known.select(
        *lines.columns, "label", F.col("x.a").alias("label_start"), F.col("x.b").alias("label_end"), "m.expects", "m.non_pii", "m.unknown",
        F.trim(F.substring(F.col("text"), F.col("x.b") + 1, until - F.col("x.b"))).alias("value"), F.row_number().over(in_line).alias("n_label"),
    )


def last_labels(labels: DataFrame) -> DataFrame:
    """The last label of each line, which values below and to the right belong to."""
    return labels.withColumn("last", F.max("n_label").over(Window.partitionBy(*LINE_KEY))).where("n_label = last").drop("last")


def right_neighbours(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """(line key of the label, label, value_block, value_line, value): the nearest line right of a label without a value.

    It starts behind the label within RIGHT_GAP, and its middle lies within the label's height. The
    join is within a page, whose lines are few.
    """
    keys = ["fixture", "page_no"]
    left = last_labels(labels).where("value = '' and not non_pii").select(*LINE_KEY, "label", *(F.col(c).alias("l" + c) for c in ("x0", "y0", "x1", "y1")))
    right = lines.select(*keys, F.col("block_no").alias("value_block"), F.col("line_no").alias("value_line"), F.col("text").alias("value"), "x0", "y0", "y1")
    middle = (F.col("y0") + F.col("y1")) / 2
    near = left.join(right, keys).where(
        (F.col("x0") >= F.col("lx1") - 0.5) & (F.col("x0") - F.col("lx1") <= RIGHT_GAP) & (middle >= F.col("ly0")) & (middle <= F.col("ly1"))
    )
    near = near.where(F.length(F.regexp_replace("value", r"[^\p{L}\p{N}]", "")) >= 2)
    best = near.groupBy(*LINE_KEY, "label").agg(F.min(F.struct("x0", "value_block", "value_line", "value")).alias("v"))
    return best.select(*LINE_KEY, "label", "v.value_block", "v.value_line", "v.value")


def stacked_values(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(fixture, page_no, label_block, label_line, label, position, block_no, line_no, value): lines stacked under a label.

    Going down the page from a label without a value of its own, lines belong to it until one is a label itself, drifts to the
    side, leaves a gap or STACKED are taken.
    """
    marks = last_labels(labels).select(*LINE_KEY, F.col("label"), (F.col("non_pii") | (F.col("value") != "")).alias("non_pii"))
    page = lines.join(marks, LINE_KEY, "left")
    order = Window.partitionBy("fixture", "page_no").orderBy("y0", "x0", "block_no", "line_no")
    page = page.withColumn("run", F.sum(F.col("label").isNotNull().cast("int")).over(order))
    run = Window.partitionBy("fixture", "page_no", "run").orderBy("y0", "x0", "block_no", "line_no")
    head = lambda c: F.first(c).over(run.rowsBetween(Window.unboundedPreceding, 0))
    page = page.withColumns({
        "label_block": head("block_no"), "label_line": head("line_no"), "head": head("label"), "head_x": head("x0"), "skip": head("non_pii"),
        "above": F.lag("y1").over(run), "position": F.row_number().over(run) - 1,
    })
    stop = (F.abs(F.col("x0") - F.col("head_x")) > LEFT_DRIFT) | (F.col("y0") - F.col("above") > BELOW_GAP * (F.col("y1") - F.col("y0")))
    page = page.withColumn("stop", F.when(F.col("position") > 0, F.coalesce(stop, F.lit(True))).otherwise(F.lit(False)).cast("int"))
    page = page.withColumn("stopped", F.sum("stop").over(run))
    return page.where((F.col("run") > 0) & ~F.col("skip") & (F.col("position") > 0) & (F.col("position") <= STACKED) & (F.col("stopped") == 0)).select(
        "fixture", "page_no", "label_block", "label_line", F.col("head").alias("label"), F.col("position").cast("int").alias("position"), "block_no", "line_no",
        F.col("text").alias("value"),
    )
