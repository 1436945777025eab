"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark opens the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one machine alone may do without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: `df` is written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so that helper columns cannot clash with those of the caller."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    """The columns of the struct made by `packed`."""
    return df.select("row.*")


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their rank (from 0) in a total order, without a task that sees them all; one number a partition goes to the driver."""
    dealt = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = sorted(placed.groupBy("part").count().collect())
    before = list(accumulate([c["count"] for c in counts], initial=0))[:-1]
    # by Arrow: rows of Python objects go through workers of their own, which stay beside those of the operators
    starts = rows.sparkSession.createDataFrame(pa.table({"part": pa.array([c["part"] for c in counts], pa.int32()), "start": pa.array(before, pa.int64())}))
    return placed.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")
