"""Lines as they arrive: counts over event time, and the rules on every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbraline.operators.rules import detect_rules
from umbraline.sources.tables import LINE_KEY


def line_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """New files of ``path`` as a stream of lines."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """(day, n): lines by the day they came in. A line repeated within ``late`` counts once, later ones are let go."""
    once = stream.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(LINE_KEY)
    return once.groupBy(F.window("ingested_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def scan_arrivals(stream: DataFrame, out: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame] = detect_rules) -> StreamingQuery:
    """Run ``operator`` on every batch and append its rows to ``out``; a batch that is replayed writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
