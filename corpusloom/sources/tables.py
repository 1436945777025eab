"""Input tables as texts (key, text, lang, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the files give fewer partitions than there are; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a text; its source is its type."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("key"), "text", "lang", F.col("source").alias("type"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a text whose blocks are its turns; the type is a third of the conversations."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(
        F.col("conv_id").alias("key"),
        F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("talk"), (F.col("conv_id") % 3).cast("string")).alias("type"),
    )
