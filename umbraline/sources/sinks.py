"""Writing results without ever overwriting what they came from."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types whose values are kept in the persistent roster (fixed values).
ROSTER_TYPES = (
    "PERSON ORG_PRIVATE SSN ITIN EIN TIN EMAIL PHONE BANK_ACCOUNT ROUTING_NUMBER STREET ADDRESS DOB POLICY_NUMBER MEMBER_ID EMPLOYEE_ID "
    "DRIVERS_LICENSE PASSPORT"
).split()


def export(df: DataFrame, out: str, source: str) -> str:
    """Write ``df`` to ``out``; refuses the source itself and anything that exists."""
    if os.path.abspath(out) == os.path.abspath(source):
        raise ValueError("the output must not be the source")
    df.write.mode("errorifexists").parquet(out)
    return out


def free_path(path: str, taken) -> str:
    """``path``, or the first of path-2, path-3 ... that ``taken`` does not know."""
    if not taken(path):
        return path
    stem, dot, ending = path.rpartition(".")
    stem, ending = (stem, dot + ending) if dot else (path, "")
    n = 2
    while taken(f"{stem}-{n}{ending}"):
        n += 1
    return f"{stem}-{n}{ending}"


def write_mapping(registry: DataFrame, out: str) -> str:
    """The pseudonyms to keep, in a place of their own: roster types only, sorted by type and original."""
    kept = registry.where(F.col("pii_type").isin(ROSTER_TYPES) & (F.coalesce("pseudonym", F.lit("")) != ""))
    kept.sortWithinPartitions("pii_type", "original").write.mode("errorifexists").parquet(out)
    return out
