"""Matches of a pattern with their places, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<span_start:int,span_end:int,value:string>>"


def quoted(text: str) -> str:
    """``text`` as a string of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str) -> str:
    """SQL of the matches of ``pattern`` in the expression ``text``, as an array of SPAN.

    The gaps between matches give the places: a match starts behind all earlier gaps and matches.
    Both arrays are bound to a variable, so they are computed once and not for every match. One
    piece of SQL is parsed far faster than hundreds of column calls are built.
    """
    p = quoted(pattern)
    length = "(a, x) -> a + length(x)"
    start = f"aggregate(slice(both.gaps, 1, i + 1), 0, {length}) + aggregate(slice(both.found, 1, i), 0, {length})"
    placed = f"transform(both.found, (m, i) -> named_struct('span_start', {start}, 'span_end', {start} + length(m), 'value', m))"
    both = f"named_struct('found', regexp_extract_all({text}, {p}, 0), 'gaps', split({text}, {p}, -1))"
    return f"CASE WHEN {text} RLIKE {p} THEN flatten(transform(array({both}), both -> {placed})) ELSE CAST(array() AS {SPAN}) END"


def spans(text: str, pattern: str) -> Column:
    """The matches of ``pattern`` in the column or expression ``text``; null and empty texts have none.

    The pattern must not match the empty string.
    """
    return F.expr(spans_sql(text, pattern))
