"""Cutting lineage in a folder that outlives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make a temporary one only where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="umbraline-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that a lost executor never replays what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plain(df: DataFrame) -> DataFrame:
    """As ``cut``, without the constraints and statistics that a checkpoint hands on: over many turns the planner drowns in them."""
    done = cut(df)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), df.sparkSession)


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores where its few files make fewer tasks than that; larger scans stay as they are.

    Only for frames without a shuffle: asking for the partitions would run one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions, by ``keys`` if given; these are not coalesced before slow Python work.

    A grouping by the same keys needs no further shuffle.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
