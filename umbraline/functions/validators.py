"""Checksums and structure of identity numbers, as SQL over a value ``{v}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that no employer number has (fixed values).
EIN_RESERVED = ["00", "07", "08", "09", "17", "18", "19", "28", "29", "49", "69", "70", "78", "79", "89"]
DIGITS = "regexp_replace({v}, '[^0-9]', '')"


def _sum(weights: tuple[int, ...]) -> str:
    return " + ".join(f"{w} * CAST(substring({DIGITS}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1))


SQL = {
    # Nine digits; area not 000, 666 or 9xx; group not 00; serial not 0000.
    "ssn": f"(length({DIGITS}) = 9 AND substring({DIGITS}, 1, 3) NOT IN ('000', '666') AND substring({DIGITS}, 1, 1) <> '9' "
    f"AND substring({DIGITS}, 4, 2) <> '00' AND substring({DIGITS}, 6, 4) <> '0000')",
    # Nine digits whose prefix is assigned.
    "ein": f"(length({DIGITS}) = 9 AND substring({DIGITS}, 1, 2) NOT IN ({', '.join(repr(x) for x in EIN_RESERVED)}))",
    # 13 to 19 digits that pass the Luhn check.
    "luhn": f"(length({DIGITS}) BETWEEN 13 AND 19 AND luhn_check({DIGITS}))",
    # Nine digits whose sum weighted 3, 7, 1 is a multiple of ten.
    "aba": f"(length({DIGITS}) = 9 AND coalesce(({_sum((3, 7, 1) * 3)}) % 10 = 0, false))",
}


def valid_sql(kind: str, value: str) -> str:
    """SQL that tells whether ``value`` passes the check ``kind``; null fails."""
    return f"coalesce({SQL[kind].format(v=value)}, false)"


def valid(kind: str, value: str) -> Column:
    return F.expr(valid_sql(kind, value))
