"""Trimming, splitting and filtering of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.functions.names import STATE_CODES, SUFFIXES, TITLES, looks_like_person, parse_person
from umbraline.functions.text import collapsed, fold, normalized
from umbraline.sources.tables import LINE_KEY

#: Colour of text that an earlier run has put in place (fixed value).
REPLACED_COLOR = 13369344
JOINT = r"(\p{Lu}[\p{L}'’-]+) (?:&|and) (\p{Lu}[\p{L}'’-]+(?: \p{Lu}\.?)?) (\p{Lu}[\p{L}'’-]+)"


def trimmed(candidates: DataFrame) -> DataFrame:
    """(cand_id, span_start, span_end, value): persons without a title before and a possessive behind."""
    persons = candidates.where("pii_type = 'PERSON' and text is not null")
    head = F.regexp_extract("text", rf"(?i)^((?:{TITLES})\.? +)", 1)
    value = F.regexp_replace(F.substring("text", F.length(head) + 1, F.length("text")), r"['’][sS]$", "")
    out = persons.select("cand_id", (F.col("span_start") + F.length(head)).alias("span_start"), value.alias("value"))
    return out.where("value <> ''").select("cand_id", "span_start", (F.col("span_start") + F.length("value")).alias("span_end"), "value")


def split_compounds(candidates: DataFrame) -> DataFrame:
    """(cand_id, part_no, part): the persons of a compound like ``Mark & Jane Lang``; a lone first name gets the surname of the last part."""
    rows = candidates.where("pii_type = 'PERSON' and text is not null").select("cand_id", F.split(collapsed(F.col("text")), r"(?i) (?:&|and|\+) ").alias("parts"))
    last = F.element_at(F.split(F.element_at("parts", -1), " "), -1)
    named = F.transform("parts", lambda p: F.when(F.contains(F.trim(p), F.lit(" ")) | (F.size("parts") == 1), F.trim(p)).otherwise(F.concat_ws(" ", F.trim(p), last)))
    placed = rows.select("cand_id", F.size("parts").alias("n"), F.posexplode(named).alias("part_no", "part"))
    return placed.where("n > 1 and part <> ''").select("cand_id", "part_no", "part")


def joint_names(lines: DataFrame) -> DataFrame:
    """(line key, first, second, surname): households written as ``Mark & Jane Lang``."""
    found = lines.where(F.col("text").rlike(JOINT)).select(*LINE_KEY, *(F.regexp_extract("text", JOINT, i).alias(c) for i, c in enumerate(("first", "second", "surname"), 1)))
    return found


def bare_states(candidates: DataFrame) -> DataFrame:
    """(cand_id): candidates that are nothing but the code of a state."""
    return candidates.where(normalized(F.col("text")).isin(STATE_CODES)).select("cand_id")


def label_texts(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(cand_id): candidates whose whole text is a label somewhere in their document."""
    known = labels.select("fixture", F.lower(normalized(F.col("label"))).alias("v")).where("v <> ''").distinct()
    return candidates.where("text is not null").withColumn("v", F.lower(normalized(F.col("text")))).join(known, ["fixture", "v"], "left_semi").select("cand_id")


def in_replaced_text(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(cand_id): candidates on lines that an earlier run has written."""
    return candidates.join(lines.where(F.col("color") == REPLACED_COLOR).select(*LINE_KEY), LINE_KEY, "left_semi").select("cand_id")


def looks_sensitive(text: Column) -> Column:
    """An address of mail, a personal name, a street, a city with a state, or five digits."""
    return F.coalesce(
        text.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}") | looks_like_person(text)["is_person"]
        | text.rlike(r"(?i)[0-9]+ .*\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct)\b") | text.rlike(r", [A-Z]{2}\b")
        | (F.length(F.regexp_replace(text, r"[^0-9]", "")) >= 5), F.lit(False),
    )


def leaking_pseudonyms(registry: DataFrame) -> DataFrame:
    """(record_id, problem): replacements that are empty, the same as the original, or share a word of three letters with it."""
    words = lambda c: F.filter(F.split(fold(F.col(c)), " "), lambda w: F.length(w) >= 3)
    problem = (
        F.when(F.coalesce(F.trim("pseudonym"), F.lit("")) == "", "empty")
        .when(fold(F.col("pseudonym")) == fold(F.col("original")), "identical")
        .when(F.arrays_overlap(words("pseudonym"), words("original")), "shares a word")
    )
    return registry.where("original is not null").select("record_id", problem.alias("problem")).where("problem is not null")


def spelling_variants(candidates: DataFrame) -> DataFrame:
    """(fixture, name, variant): other ways in which a person's name may stand in its document, four letters and more."""
    rows = candidates.where("pii_type = 'PERSON' and text is not null").select("fixture", normalized(F.col("text")).alias("name")).distinct()
    p = rows.withColumn("p", parse_person(F.col("name"))).where("p.surname <> '' and size(p.given) > 0")
    given = F.array_join("p.given", " ")
    full = F.array_join(F.filter("p.given", lambda g: F.length(F.replace(g, F.lit("."), F.lit(""))) > 1), " ")
    options = F.array(
        F.concat_ws(" ", given, F.col("p.surname")), F.concat_ws(", ", F.col("p.surname"), given), F.trim(F.concat_ws(" ", full, F.col("p.surname"))),
        F.replace(F.concat_ws(" ", given, F.col("p.surname")), F.lit("-"), F.lit(" ")),
    )
    out = p.select("fixture", "name", F.explode(F.array_distinct(options)).alias("variant"))
    return out.where((F.length("variant") >= 4) & (F.col("variant") != F.col("name")))


def subjects(candidates: DataFrame) -> DataFrame:
    """(fixture, pii_type, value, confidence, cand_id): the surest candidate of each value, the least id on a tie."""
    value = F.lower(normalized(F.col("text")))
    rows = candidates.where("text is not null and pii_type is not null and length(text) >= 4").select("fixture", "pii_type", value.alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("c"), "cand_id")
    best = rows.groupBy("fixture", "pii_type", "value").agg(F.max(F.struct("c", (-F.col("cand_id")).alias("m"))).alias("b"))
    return best.select("fixture", "pii_type", "value", F.col("b.c").alias("confidence"), (-F.col("b.m")).alias("cand_id"))


def suffixed(candidates: DataFrame) -> DataFrame:
    """(cand_id, suffix): the generation or degree behind a person's name, in lower case."""
    found = F.lower(F.regexp_extract(F.trim("text"), rf"(?i)[ ,]({SUFFIXES})\.?$", 1))
    return candidates.where("pii_type = 'PERSON' and text is not null").select("cand_id", found.alias("suffix")).where("suffix <> ''")
