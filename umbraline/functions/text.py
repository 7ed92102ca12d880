"""Comparison keys and shapes of text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a decomposition that count as their plain form; signs that are blanks or nothing.
PLAIN = {"ł": "l", "đ": "d", "ø": "o", "ð": "d", "ħ": "h", "ı": "i", "ŧ": "t"}
TWO_LETTERS = {"æ": "ae", "œ": "oe", "þ": "th", "ß": "ss"}
HYPHENS = "-‐‑‒–—―−﹘﹣－"
APOSTROPHES = "'’‘ʼ`´′."
STREET_SHORT = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "circle": "cir", "place": "pl",
    "terrace": "ter", "parkway": "pkwy", "highway": "hwy", "suite": "ste", "apartment": "apt", "common": "cmn", "trail": "trl", "crossing": "xing",
}
LEGAL_SUFFIXES = "llc|l.l.c|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|llp|pllc|pc|plc".split("|")
DIGIT_KEYED = ["SSN", "ITIN", "EIN", "TIN", "BANK_ACCOUNT", "ROUTING_NUMBER", "CARD_NUMBER"]


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Small letters with marks, and the letter each is without them (built from Unicode's decompositions)."""
    marked, plain = "", ""
    for number in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(number)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch == ch.lower() and base != ch and base.isalpha():
            marked, plain = marked + ch, plain + base
    return marked + "".join(PLAIN), plain + "".join(PLAIN.values())


def fold(text: Column) -> Column:
    """Key for comparing: lower case, no accents, hyphens as blanks, no apostrophes or dots, single blanks."""
    t = F.translate(F.lower(text), *accent_table())
    for letter, two in TWO_LETTERS.items():
        t = F.replace(t, F.lit(letter), F.lit(two))
    t = F.regexp_replace(t, "[̀-ͯ]", "")
    t = F.translate(t, HYPHENS, " " * len(HYPHENS))
    t = F.translate(t, APOSTROPHES, "")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f\x0B]+", " "))


@lru_cache(maxsize=1)
def case_table() -> tuple[str, str]:
    """Letters whose lower case differs from that of letters which the pattern flags ``iu`` take as the same, and the letter to use."""
    one = lambda ch, other: other if len(other) == 1 else ch
    odd = {}
    for number in range(0x80, 0x1E944):
        ch = chr(number)
        low, same = one(ch, ch.lower()), one(ch, one(ch, ch.upper()).lower())
        # A mark that counts as a letter stays a mark, so that runs of letters end where they did.
        if low != same and ch.isalnum():
            odd[low] = same
    return "".join(odd), "".join(odd.values())


def caseless(text: Column) -> Column:
    """Lower case in which two texts are equal where the pattern flags ``iu`` take them as equal."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), *case_table())


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def normalized(text: Column) -> Column:
    """Single blanks, without blanks and signs at the ends."""
    return F.btrim(collapsed(text), F.lit(" .,;:"))


def registry_normalized(text: Column) -> Column:
    """Normalized, in lower case, kinds of streets in short form."""
    words = F.split(F.lower(normalized(text)), " ")
    short = F.create_map(*(F.lit(x) for pair in STREET_SHORT.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(short[w], w)), " ")


def org_core(text: Column) -> Column:
    """The name of a business without its trailing legal forms; all of it if there is nothing else."""
    whole = F.lower(normalized(text))
    tokens = F.transform(F.split(whole, " "), lambda w: F.btrim(w, F.lit(".,;:")))
    joined = F.array_join(tokens, " ")
    core = F.regexp_replace(joined, r"( |^)(" + "|".join(s.replace(".", r"\.") for s in LEGAL_SUFFIXES) + r")(?= |$)", "$1\u0001$2")
    cut = F.regexp_replace(core, "( ?\u0001[^ ]+)+$", "")
    cut = F.trim(F.replace(cut, F.lit("\u0001"), F.lit("")))
    return F.when(cut == "", whole).otherwise(cut)


def entity_key(pii_type: Column, text: Column) -> Column:
    """struct<key_type, key>: what two spellings of one value share."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    street = pii_type.isin("STREET", "ADDRESS") & text.rlike(r"^[ \t\r\n]*[0-9]")
    key = (
        F.when(pii_type.isin(DIGIT_KEYED) & (digits != ""), digits)
        .when(pii_type == "ORG_PRIVATE", org_core(text))
        .when(pii_type == "PERSON", fold(text))
        .otherwise(registry_normalized(text))
    )
    return F.struct(F.when(street, "ADDRESS").otherwise(pii_type).alias("key_type"), key.alias("key"))


def shape(text: Column) -> Column:
    """Capitals as X, small letters as x, digits as 9, the rest as it is."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"[0-9]", "9")


def case_class(token: Column) -> Column:
    """upper, title, mixed, lower or caseless, by the letters of ``token``; null without letters."""
    return (
        F.when(~token.rlike(r"\p{L}"), None)
        .when(~token.rlike(r"\p{Lu}|\p{Ll}"), "caseless")
        .when(~token.rlike(r"\p{Ll}"), "upper")
        .when(~token.rlike(r"\p{Lu}"), "lower")
        .when(token.rlike(r"^[^\p{L}]*\p{Lu}[^\p{Lu}]*$"), "title")
        .otherwise("mixed")
    )
