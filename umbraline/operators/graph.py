"""Connected records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraline.plans.lineage import cut

#: Turns after which the labels must have settled; a path of n records needs about log n of them.
TURNS = 40


def components(records: DataFrame, id_col: str, links: list[list[str]]) -> DataFrame:
    """(id_col, component): records that share the values of any of ``links``, directly or through others.

    Labels sink to the least id of each shared value, and from there to that record's own label, until
    none moves. A value with many records is one pre-aggregated group, never pairs. Null values link nothing.
    """
    ids = records.select(F.col(id_col).alias("id")).distinct()
    hubs = []
    for n, columns in enumerate(links):
        rows = records.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
        hubs.append(rows.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(n), *columns).alias("h1"), F.hash(F.lit(n), *columns).alias("h2")))
    edges = cut(reduce(DataFrame.unionByName, hubs).distinct())
    state = cut(ids.withColumn("component", F.col("id")))
    for _ in range(TURNS):
        least = edges.join(state, "id").groupBy("h1", "h2").agg(F.min("component").alias("m"))
        offered = edges.join(least, ["h1", "h2"]).groupBy("id").agg(F.min("m").alias("m"))
        lower = state.join(offered, "id", "left").select("id", "component", F.least("component", "m").alias("new"))
        jump = state.select(F.col("id").alias("new"), F.col("component").alias("further"))
        moved = cut(lower.join(jump, "new", "left").select("id", F.least("new", "further").alias("component"), (F.least("new", "further") != F.col("component")).alias("moved")))
        state = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            break
    return state.withColumnRenamed("id", id_col)
