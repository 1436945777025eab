"""Ledger tables that stand in for a user's: derived from the documents, labels, conversations and events of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import table

RULES = [(".", "sam", "own"), ("dir1", "sam", "other"), ("dir1/sub1", "sam", "own"), ("dir2", "kim", "own"), ("dir2", "kim", "other"), ("dir3/sub0", "kim", "own")]
FACETS = [(".", "type", "any"), ("dir1", "type", "essay"), ("dir1/sub1", "type", "note"), ("dir1", "year", "old")]
PROFILES = [("base", None, "self"), ("sam", "base", "self"), ("acme", "sam", "given"), ("kim", "base", "given"), ("loop1", "loop2", "self"), ("loop2", "loop1", "self")]


def manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "lang", F.col("source").alias("type"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
    key = F.col("key")

    def every(n: int):
        return key % n == 0

    folder = F.concat(F.lit("dir"), (key % 7).cast("string"))
    status = F.when(every(11), "forgotten").when(every(13), "unreachable").when(every(17), "superseded").otherwise("active")
    ownership = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "own").when(F.col("quality") == 0, "other").otherwise("undecided")
    return docs.join(labels, "key", "left").select(
        "key", F.concat(folder, F.lit("/sub"), (key % 3).cast("string"), F.lit("/f"), key.cast("string"), F.lit(".md")).alias("path"), folder.alias("folder"), "lang", "type",
        T.n_words(F.coalesce("text", F.lit(""))).cast("long").alias("words"), status.alias("status"), ownership.alias("ownership"), every(19).alias("holdout"), (~every(29)).alias("cached"), (2015 + key % 10).alias("year"),
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    """What a scan meets: a fifth of the texts are gone, some have moved, some have changed."""
    key = F.col("key")
    path = F.when(key % 6 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return manifest(spark, d).where(key % 5 != 0).select(F.when(key % 23 == 0, key + 1_000_000).otherwise(key).alias("key"), path.alias("path"), "words", "lang", "type", "year")


def texts_by_new_key(spark: SparkSession, d: str) -> DataFrame:
    """key and text, for the keys that `found` gives to changed texts too."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return docs.select(F.when(F.col("key") % 23 == 0, F.col("key") + 1_000_000).otherwise(F.col("key")).alias("key"), "text")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_path string, profile string, ownership string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile string, parent string, consent string")


def cues(spark: SparkSession, d: str) -> DataFrame:
    """Events as cues of a session by speaker."""
    return table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("speaker"), "ts", F.col("event_id").alias("cue"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations with their words; a day stands for the conversation."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", T.n_words(F.coalesce("text", F.lit(""))).cast("long").alias("words"), day.alias("day"))
