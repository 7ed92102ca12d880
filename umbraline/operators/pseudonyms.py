"""Stable replacements, from a hash of scope, type and value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraline.functions.text import collapsed


def seed(scope: Column, pii_type: Column, value: Column) -> Column:
    """The first eight bytes of SHA-256 of ``scope|TYPE|value`` as a whole number (decimal, as it may exceed a bigint)."""
    text = F.concat_ws("|", scope, pii_type, F.lower(collapsed(value)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def masked(value: Column, seed: Column) -> Column:
    """``value`` with other digits and letters of the same case, in the words that hold a digit; the rest stays."""
    digest = F.sha2(seed.cast("string"), 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def letter(acc: Column, ch: Column) -> Column:
        b = byte(acc["i"])
        other = (
            F.when(ch.rlike("^[0-9]$"), (b % 10).cast("string"))
            .when(ch.rlike("^[A-Z]$"), F.chr((b % 26 + 65).cast("bigint")))
            .when(ch.rlike("^[a-z]$"), F.chr((b % 26 + 97).cast("bigint")))
        )
        return F.struct(F.concat(acc["out"], F.coalesce(other, ch)).alias("out"), (acc["i"] + other.isNotNull().cast("int")).alias("i"))

    def word(acc: Column, w: Column) -> Column:
        changed = F.aggregate(F.split(w, ""), acc, letter)
        return F.when(w.rlike("[0-9]"), changed).otherwise(F.struct(F.concat(acc["out"], w).alias("out"), acc["i"].alias("i")))

    pieces = F.regexp_extract_all(value, F.lit(r"[ \t\r\n\f\x0B]+|[^ \t\r\n\f\x0B]+"), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    return F.aggregate(pieces, start, word)["out"]
