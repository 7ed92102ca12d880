"""Reading the Parquet tables of a scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraline.plans.lineage import shuffled

LINE_KEY = ["fixture", "page_no", "block_no", "line_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; columns and filters are pushed into the scan by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: rows delivered again are the same record (pre-aggregated before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*(F.first(c).alias(c) for c in rest)).select(*df.columns)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text lines of the pages, each once; by page, so that groupings and windows within pages need no further shuffle."""
    return records(shuffled(table(spark, sf_dir, "fixture_lines").drop("ingested_at"), "fixture", "page_no"), LINE_KEY)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates, each once."""
    return records(table(spark, sf_dir, "candidates").drop("ingested_at", "detected_at"), ["cand_id"])


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, x0, y0, x1, y1): the lines of each text that are not blank.

    Cells are 5 wide and 12 high and lines lie close under each other; null and empty texts have none.
    """
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\r\n|[\n\r\f\x0b\x1c\x1d\x1e\x85  ]")).alias("line_no", "text"))
    rows = rows.where(F.col("text").rlike(r"[^ \t\x0B\f\r\n ]"))
    return rows.withColumns({
        "x0": F.lit(0.0), "y0": F.col("line_no") * 12.0, "x1": F.length("text") * 5.0, "y1": (F.col("line_no") + 1) * 12.0,
    })
