"""Shapes and parts of personal names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraline.functions.text import collapsed, fold
from umbraline.operators.rule_tables import FORM_WORDS

# Codes of states, titles, endings of names.
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()
TITLES = "mr|mrs|ms|dr|rev|prof"
SUFFIXES = "jr|sr|ii|iii|iv|md|cpa|esq|phd|dds"
_UP = r"\p{Lu}[\p{L}\p{M}'’-]*"
_CAPS = r"\p{Lu}[\p{Lu}\p{M}'’-]+"


def has_form_word(text: Column) -> Column:
    """Whether any word of ``text`` is one of FORM_WORDS; an empty text counts as such."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    known = F.array(*(F.lit(w) for w in FORM_WORDS))
    return (F.size(words) == 0) | F.arrays_overlap(words, known)


def looks_like_person(text: Column) -> Column:
    """struct<is_person, confidence>: whether the shape of ``text`` is that of a personal name, and how surely.

    The forms are tried in this order: all capitals, one word of capitals, surname first, title
    case, mixed case with initials, letters of a caseless script.
    """
    t = collapsed(text)
    able = (F.length(t) <= 60) & ~has_form_word(t) & ~t.rlike(r"[0-9@]")
    long = F.length(t) >= 4
    surname_first = t.rlike(rf"^{_UP}( {_UP})?, ?{_UP}( \p{{Lu}}\.?)?$") & ~F.regexp_extract(t, r", ?(.*)$", 1).isin(STATE_CODES)
    score = (
        F.when(~able, 0.0)
        .when(long & t.rlike(rf"^{_CAPS}( {_CAPS}){{1,3}}$"), 0.72)
        .when(long & t.rlike(r"^[\p{Lu}]{3,}$"), 0.55)
        .when(long & surname_first, 0.75)
        .when(long & t.rlike(rf"^{_UP}( {_UP}){{1,3}}$"), 0.62)
        .when(long & t.rlike(rf"^{_UP}( ({_UP}|\p{{Lu}}\.)){{1,3}}$"), 0.58)
        .when(t.rlike(r"^\p{Lo}{2,12}$"), 0.52)
        .otherwise(0.0)
    )
    score = F.coalesce(score, F.lit(0.0))
    return F.struct((score > 0).alias("is_person"), score.alias("confidence"))


def parse_person(text: Column) -> Column:
    """struct<given array<string>, surname string, surname_first boolean>: titles and suffixes dropped."""
    t = F.regexp_replace(collapsed(text), rf"(?i)^(({TITLES})\.? )+", "")
    t = F.regexp_replace(t, rf"(?i)(,? ?\b({SUFFIXES})\.?)+$", "")
    comma = t.contains(",")
    left, right = F.trim(F.split_part(t, F.lit(","), F.lit(1))), F.trim(F.split_part(t, F.lit(","), F.lit(2)))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    given = F.when(comma, F.filter(F.split(right, " "), lambda w: w != "")).otherwise(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    surname = F.when(comma, left).otherwise(F.element_at(words, -1))
    return F.struct(given.alias("given"), surname.alias("surname"), comma.alias("surname_first"))


def same_person(a: Column, b: Column) -> Column:
    """Whether two parsed names can be one person: equal folded surname, first and middle names equal or initials of each other."""
    fits = lambda x, y: (x == y) | ((F.least(F.length(x), F.length(y)) == 1) & (F.substring(x, 1, 1) == F.substring(y, 1, 1)))
    x, y = F.transform(a["given"], fold), F.transform(b["given"], fold)
    n = F.least(F.size(x), F.size(y))
    return (fold(a["surname"]) == fold(b["surname"])) & (n > 0) & F.forall(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), fits), lambda v: v)
