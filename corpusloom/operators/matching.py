"""Kept drafts and published texts: which draft a text came from, each draft once.

Candidates share a run of `SIZE` words (an index of runs, joined); the share of the draft's words that a candidate keeps in
order decides whether it will do. Then texts choose in the order in which they were found: each takes the draft it keeps
most of among those left. That order is a preference common to all drafts, so the one stable matching is the same, and
deferred acceptance finds it in rounds of joins: texts propose, a draft keeps its first proposers, the others go on to
their next. Drafts with one content and day are one with a capacity, so copies settle in one round. Nothing needs all
of a profile in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import pandas as pd

from . import ranks
from .align import share
from .similarity import checkpointed, grams

SHARE, EXPIRES_DAYS, SIZE = 0.40, 90, 4


@F.pandas_udf(DoubleType())
def shares(before: pd.Series, after: pd.Series) -> pd.Series:
    """The share of each pair; a pair of equal texts is not walked through."""
    return pd.Series([1.0 if a == b else share(a, b) for a, b in zip(before, after, strict=True)], dtype="float64")


def _runs(rows: DataFrame, name: str, size: int) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return rows.select("profile", name, F.explode(F.transform(grams(words, size), lambda g: F.xxhash64(g))).alias("run"))


def classes(drafts: DataFrame) -> DataFrame:
    """profile, kind, ts, text, first (smallest id) and n of the drafts with one content, kept at one time."""
    kind = F.xxhash64("text", F.col("ts").cast("string"))
    return drafts.groupBy("profile", kind.alias("kind"), "ts").agg(F.first("text").alias("text"), F.min("id").alias("first"), F.count("*").alias("n"))


def candidates(kinds: DataFrame, texts: DataFrame, least: float = SHARE, days: int = EXPIRES_DAYS, size: int = SIZE) -> DataFrame:
    """profile, kind, first, text_id, ts, share: open drafts of which a text keeps `least` or more of the words."""
    texts = texts.select("profile", F.col("id").alias("text_id"), F.col("ts").alias("found"), F.col("text").alias("published"))
    pairs = _runs(kinds, "kind", size).join(_runs(texts.withColumnRenamed("published", "text"), "text_id", size), ["profile", "run"]).select("profile", "kind", "text_id").distinct()
    both = pairs.join(kinds.select("profile", "kind", "first", "ts", "text"), ["profile", "kind"]).join(texts, ["profile", "text_id"])
    # a text may be older than the draft: what counts is when it was found
    met = both.where(F.col("found") <= F.col("ts") + F.expr(f"interval {days} days")).withColumn("share", shares("text", "published"))
    return met.where(F.col("share") >= least).select("profile", "kind", "first", "text_id", F.col("found").alias("ts"), "share")


def assigned(pairs: DataFrame, capacity: DataFrame) -> DataFrame:
    """profile, kind, text_id, place (from 1 within the kind), share: each text has the draft it keeps most of among those that
    earlier texts (by ts, then text_id) have left; of equal shares the kind whose first draft has the smaller id."""
    left = checkpointed(pairs)
    size = capacity.select("profile", "kind", "n")
    while True:
        best = left.groupBy("profile", "text_id", "ts").agg(F.min(F.struct((-F.col("share")).alias("minus"), "first", "kind")).alias("b"))
        wish = best.select("profile", "text_id", "ts", F.col("b.kind").alias("kind"), (-F.col("b.minus")).alias("share"))
        held = checkpointed(ranks.numbered(wish, ["profile", "kind"], ["ts", "text_id"], "place").join(size, ["profile", "kind"]))
        over = held.where("place > n").select("profile", "kind", "text_id")
        if over.isEmpty():
            return held.select("profile", "kind", "text_id", "place", "share")
        left = checkpointed(left.join(over, ["profile", "kind", "text_id"], "left_anti"))


def matched(drafts: DataFrame, texts: DataFrame, least: float = SHARE, days: int = EXPIRES_DAYS, size: int = SIZE) -> DataFrame:
    """profile, draft, text_id, share. drafts and texts: profile, id, ts, text; a null text matches nothing.

    Of drafts with one content and time the one with the smallest id goes to the earliest of the texts that take them.
    """
    drafts = drafts.where("text is not null")
    kinds = checkpointed(classes(drafts))
    got = assigned(candidates(kinds, texts.where("text is not null"), least, days, size), kinds)
    own = drafts.select("profile", F.xxhash64("text", F.col("ts").cast("string")).alias("kind"), "id")
    numbered = ranks.numbered(own, ["profile", "kind"], ["id"], "place").withColumnRenamed("id", "draft")
    return got.join(numbered, ["profile", "kind", "place"]).select("profile", "draft", "text_id", F.round("share", 6).alias("share"))
