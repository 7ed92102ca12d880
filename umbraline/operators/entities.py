"""Known entities: where their values occur, who is the same, what they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.functions.names import parse_person
from umbraline.functions.text import APOSTROPHES, HYPHENS, fold, normalized
from umbraline.sources.tables import LINE_KEY

#: Types that are looked for elsewhere in their document, and how sure a rule's value must be for that (fixed values).
PROPAGATED = ["PERSON", "ORG_PRIVATE", "EMAIL", "SSN", "EIN", "PHONE", "ADDRESS", "STREET"]
SURE = 0.85
#: Letters of a surname on a line of codes.
CONTROL = 4


def folded_with_map(text: Column) -> Column:
    """struct<text, places>: ``text`` folded character by character, and for each folded character the place it came from.

    White space and hyphens are one blank, apostrophes and dots nothing, as in ``fold``; blanks at the ends stay.
    """
    chars = F.split(text, "")
    blank = lambda c: c.rlike(r"^[ \t\r\n\f\x0B]$") | F.contains(F.lit(HYPHENS), c)

    def piece(c: Column, i: Column) -> Column:
        before = F.get(chars, i - 1)
        return F.when(blank(c), F.when((i > 0) & blank(before), "").otherwise(" ")).when(F.contains(F.lit(APOSTROPHES), c), "").otherwise(fold(c))

    pieces = F.transform(chars, piece)
    places = F.flatten(F.transform(pieces, lambda p, i: F.array_repeat(i, F.length(p))))
    return F.struct(F.array_join(pieces, "").alias("text"), places.alias("places"))


def occurrences(lines: DataFrame, values: DataFrame) -> DataFrame:
    """(line key, value, span_start, span_end): every whole-word place of ``values`` (fixture, value) in the lines of their document.

    Case, accents, hyphens and apostrophes make no difference, and matches may overlap; places are those of the
    line as it is written. A value meets the lines that hold its longest word, not all lines.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    needles = values.select("fixture", "value", fold(F.col("value")).alias("needle")).where("needle <> ''").distinct()
    longest = F.array_max(F.transform(words(F.col("needle")), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    needles = needles.withColumn("word", F.coalesce(longest, F.lit("")))
    held = lines.where("text is not null").select(*LINE_KEY, F.explode(F.array(folded_with_map(F.col("text")))).alias("f"))
    held = held.withColumn("word", F.explode(F.array_distinct(F.array_append(words(F.col("f.text")), F.lit("")))))
    met = held.join(needles, ["fixture", "word"]).where(F.contains("f.text", F.col("needle")))
    n, m = F.length("needle"), F.length("f.text")
    edge = lambda i: ~F.substring(F.col("f.text"), i, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    starts = F.filter(
        F.sequence(F.lit(1), m - n + 1),
        lambda i: (F.substring(F.col("f.text"), i, n) == F.col("needle")) & ((i == 1) | edge(i - 1)) & ((i + n > m) | edge(i + n)),
    )
    placed = met.select(*LINE_KEY, "value", F.explode(starts).alias("i"), "f", n.alias("n"))
    return placed.select(
        *LINE_KEY, "value", F.get("f.places", F.col("i") - 1).cast("int").alias("span_start"), (F.get("f.places", F.col("i") + F.col("n") - 2) + 1).cast("int").alias("span_end")
    ).distinct()


def subjects(candidates: DataFrame) -> DataFrame:
    """(fixture, pii_type, value, n, confidence): what a label or a sure rule names, of four characters and more."""
    value = F.lower(normalized(F.col("text")))
    sure = F.coalesce("label_confirmed", F.lit(False)) | ((F.col("source") == "regex") & (F.col("confidence") >= SURE))
    rows = candidates.where(F.col("pii_type").isin(PROPAGATED) & sure & F.col("text").isNotNull()).select("fixture", "pii_type", value.alias("value"), "confidence")
    return rows.where("length(value) >= 4").groupBy("fixture", "pii_type", "value").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def person_index(candidates: DataFrame) -> DataFrame:
    """(fixture, name, entity): every spelling of a person in a document, and the folded full name it belongs to.

    Full names of equal first name and surname are one person. An initial or a lone surname belongs to
    the only person of the document it fits; with none or several it is one of its own. Names meet at the
    surname and are compared with the distinct full names there, never with all of the document.
    """
    rows = candidates.where("pii_type = 'PERSON' and text is not null").select("fixture", normalized(F.col("text")).alias("name")).where("name <> ''").distinct()
    parsed = rows.withColumn("p", parse_person(F.col("name"))).select("fixture", "name", fold(F.col("p.surname")).alias("s"), fold(F.coalesce(F.get("p.given", F.lit(0)), F.lit(""))).alias("g"))
    full = parsed.where("length(g) > 1").select("fixture", "s", F.col("g").alias("owner")).distinct()
    initial = full.groupBy("fixture", "s", F.substring("owner", 1, 1).alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("only"))
    lone = full.groupBy("fixture", "s").agg(F.count(F.lit(1)).alias("n_all"), F.min("owner").alias("only_all"))
    joined = parsed.withColumn("i", F.substring("g", 1, 1)).join(initial, ["fixture", "s", "i"], "left").join(lone, ["fixture", "s"], "left")
    given = F.when(F.length("g") > 1, F.col("g")).when((F.length("g") == 1) & (F.col("n") == 1), F.col("only")).when((F.col("g") == "") & (F.col("n_all") == 1), F.col("only_all")).otherwise(F.col("g"))
    return joined.select("fixture", "name", F.trim(F.concat_ws(" ", given, F.col("s"))).alias("entity"))


def name_controls(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(line key, control, surname): the first letters of a confirmed person's surname on a line of codes."""
    sure = candidates.where("pii_type = 'PERSON' and label_confirmed and text is not null").select("fixture", parse_person(normalized(F.col("text")))["surname"].alias("surname"))
    control = F.upper(F.substring(F.regexp_replace("surname", r"[^\p{L}]", ""), 1, CONTROL))
    known = sure.select("fixture", "surname", control.alias("control")).where("length(control) >= 3").groupBy("fixture", "control").agg(F.min("surname").alias("surname"))
    codes = lines.where(F.col("text").rlike(r"^[A-Z0-9 .<>/#-]+$") & F.col("text").rlike(r"[0-9].* [0-9]|[0-9] .*[0-9]"))
    tokens = codes.select(*LINE_KEY, F.explode(F.array_distinct(F.split("text", r"[^A-Z0-9]+"))).alias("control"))
    return tokens.join(known, ["fixture", "control"]).select(*LINE_KEY, "control", "surname")


def fragments(candidates: DataFrame) -> DataFrame:
    """(cand_id, inside): candidates whose place lies wholly inside a longer one of their line."""
    c = candidates.select(*LINE_KEY, "cand_id", "span_start", "span_end")
    outer = c.select(*LINE_KEY, F.col("cand_id").alias("inside"), F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    hit = c.join(outer, LINE_KEY).where("a <= span_start and span_end <= b and b - a > span_end - span_start")
    return hit.groupBy("cand_id").agg(F.min("inside").alias("inside"))


def search(lines: DataFrame, terms: DataFrame, candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(line key, value, span_start, span_end, status): each place of ``terms`` (fixture, value) and what is done about it.

    ``redacted`` if a candidate that needs no review touches it, ``kept`` if another does, ``protected`` if it lies on a label, else ``undetected``.
    """
    hits = occurrences(lines, terms)
    c = candidates.select(*LINE_KEY, F.col("span_start").alias("a"), F.col("span_end").alias("b"), (~F.coalesce("needs_review", F.lit(False))).alias("live"))
    touch = (F.col("a") < F.col("span_end")) & (F.col("span_start") < F.col("b"))
    key = [*LINE_KEY, "value", "span_start", "span_end"]
    over = hits.join(c, LINE_KEY).where(touch).groupBy(*key).agg(F.max("live").alias("live"))
    marks = labels.select(*LINE_KEY, F.col("label_start").alias("a"), F.col("label_end").alias("b"))
    on_label = hits.join(marks, LINE_KEY).where(touch).select(*key).distinct().withColumn("on_label", F.lit(True))
    joined = hits.join(over, key, "left").join(on_label, key, "left")
    status = F.when(F.col("live"), "redacted").when(F.col("live").isNotNull(), "kept").when(F.col("on_label"), "protected").otherwise("undetected")
    return joined.select(*key, status.alias("status"))
