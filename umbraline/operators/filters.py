"""What becomes of candidates that are implausible, contradict their shape or stand beside an identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraline.functions.names import STATE_CODES, looks_like_person
from umbraline.functions.text import fold, normalized
from umbraline.operators.binding import placeholder, pure_financial
from umbraline.operators.rule_tables import FORM_WORDS
from umbraline.sources.tables import LINE_KEY

MODELS = ["ner", "coverage", "audit"]
#: Points between a date and the identity it stands beside; types that are an identity (fixed values).
BESIDE, IDENTITY = 60.0, ["PERSON", "SSN", "ITIN", "EIN", "TIN", "ADDRESS", "STREET"]
STREET_WORD = r"(?i)\b(street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|boulevard|blvd|way|place|pl|circle|cir|terrace|ter|parkway|pkwy|highway|hwy|trail|crossing|common)\b"
SHAPED = ["USERNAME", "EMPLOYEE_ID", "MRN", "DRIVERS_LICENSE", "PASSPORT"]
DATE = r"(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)[0-9]{2}"
CUES = r"born|birth|dob|death|died|hire|married"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def form_wording(text: Column) -> Column:
    """Whether every word is one of a form; a text without letters is none."""
    words = _words(text)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(F.lit(FORM_WORDS), w))


def verdicts(candidates: DataFrame) -> DataFrame:
    """(cand_id, verdict): what a candidate's own text says against it; the first that holds.

    ``empty`` (no letter or digit), ``financial``, ``state`` (a bare code), ``placeholder``, ``form words``,
    ``no street`` (a model's street without number and kind), ``no shape`` (a model's identifier without digit or sign), ``name``
    (an unclassified value of a field that is a person's), or ``kept``. Nulls are ``empty``.
    """
    text = F.coalesce("text", F.lit(""))
    model = F.col("source").isin(MODELS)
    return candidates.select(
        "cand_id",
        F.when(~text.rlike(r"[\p{L}\p{N}]"), "empty")
        .when(pure_financial(text) & (F.col("source") != "manual"), "financial")
        .when(normalized(text).isin(STATE_CODES), "state")
        .when(placeholder(text), "placeholder")
        .when(F.col("pii_type").isin("PERSON", "ORG_PRIVATE") & form_wording(text), "form words")
        .when(model & (F.col("pii_type") == "STREET") & ~(text.rlike("[0-9]") & text.rlike(STREET_WORD)), "no street")
        .when(model & F.col("pii_type").isin(SHAPED) & ~text.rlike(r"[0-9@_./-]"), "no shape")
        .when((F.col("source") == "group") & (F.col("pii_type") == "UNCLASSIFIED_GROUP_VALUE") & looks_like_person(text)["is_person"], "name")
        .otherwise("kept")
        .alias("verdict"),
    )


def conservative(candidates: DataFrame, least: float = 0.65) -> DataFrame:
    """(cand_id): what is left if only the user's candidates and sure, typed ones of rules, labels and models that name things count."""
    sure = (F.col("pii_type") != "UNCLASSIFIED_GROUP_VALUE") & ~F.col("source").isin("coverage", "audit") & (F.coalesce("confidence", F.lit(0.0)) >= least)
    return candidates.where((F.col("source") == "manual") | F.coalesce(sure, F.lit(False))).select("cand_id")


def dates_beside_identity(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(line key, value): lines of nothing but dates within BESIDE points of an identity of their page, and not covered by a candidate."""
    only = lines.where(F.col("text").rlike(rf"^\s*{DATE}(?:\s+{DATE}){{0,2}}\s*$")).join(candidates.select(*LINE_KEY).distinct(), LINE_KEY, "left_anti")
    at = lines.select(*LINE_KEY, F.col("y0").alias("iy0"), F.col("y1").alias("iy1"))
    identity = candidates.where(F.col("pii_type").isin(IDENTITY)).select(*LINE_KEY).distinct().join(at, LINE_KEY).select("fixture", "page_no", "iy0", "iy1").distinct()
    near = (F.col("iy0") <= F.col("y1") + BESIDE) & (F.col("y0") <= F.col("iy1") + BESIDE)
    return only.join(identity, ["fixture", "page_no"]).where(near).select(*LINE_KEY, F.trim("text").alias("value")).distinct()


def name_components(candidates: DataFrame) -> DataFrame:
    """(cand_id): one-word places and organisations of a model that are a word of a person a label confirms in the document."""
    sure = candidates.where("pii_type = 'PERSON' and label_confirmed and text is not null")
    tokens = sure.select("fixture", F.explode(F.array_distinct(F.split(fold(F.col("text")), " "))).alias("token")).where("length(token) >= 3").distinct()
    single = candidates.where(F.col("source").isin(MODELS) & F.col("pii_type").isin("CITY_STATE", "ORG_PRIVATE", "BIRTHPLACE") & F.col("text").isNotNull())
    return single.withColumn("token", fold(F.col("text"))).where(~F.contains("token", F.lit(" "))).join(tokens, ["fixture", "token"], "left_semi").select("cand_id")


def expanded(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cand_id, span_start, span_end): the only candidate on a value of a labelled field, widened to all of it."""
    v = values.where("not non_pii and not unknown").select(*LINE_KEY, F.col("span_start").alias("a"), F.col("span_end").alias("b"), "value")
    c = candidates.where("source <> 'manual'").select(*LINE_KEY, "cand_id", "span_start", "span_end")
    inside = v.join(c, LINE_KEY).where("a <= span_start and span_end <= b")
    one = inside.groupBy(*LINE_KEY, "a", "b", "value").agg(F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("cand_id"), F.min("span_start").alias("s"), F.max("span_end").alias("e"))
    wider = one.where((F.col("n") == 1) & (F.col("e") - F.col("s") < F.col("b") - F.col("a")) & ~F.col("value").rlike(r"[$%]"))
    return wider.select("cand_id", F.col("a").cast("int").alias("span_start"), F.col("b").cast("int").alias("span_end"))


def personal_dates(lines: DataFrame) -> DataFrame:
    """(line key, value): dates on lines that speak of a birth, a death, a hiring or a wedding."""
    found = lines.where(F.lower("text").rlike(CUES)).select(*LINE_KEY, F.explode(F.regexp_extract_all("text", F.lit(rf"\b{DATE}\b"), F.lit(0))).alias("value"))
    return found.distinct()
