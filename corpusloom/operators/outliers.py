"""Texts that sit unusually far from the others of their slot, and whether a text fits a slot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks, style
from .similarity import MAX_BROADCAST, checkpointed

MIN_TEXTS, K, FACTOR, TOP, GAP = 5, 4, 1.5, 3, 1.25


def long_values(texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, metric, value, floor."""
    rows = style.melted(style.sums(texts).select("key", *by, *style.values().values()), ["key", *by])
    return rows.join(style.metric_table(texts.sparkSession).select("metric", "floor"), "metric")


def without_self(rows: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with n and ref: the size of the slot and the median of the metric over the slot's other texts.

    Leaving one value out moves the middle by one place at most, so three middle values of the whole slot
    and the side on which the own value lies are enough: rows are neither sorted nor joined to themselves.
    """
    group = [*by, "metric"]
    mids = {f"m{k}": F.floor(F.col("_total") / 2) + k for k in range(3)}
    near = ranks.placed(rows, group, "value").where(ranks.holds(mids["m0"]) | ranks.holds(mids["m1"]) | ranks.holds(mids["m2"]))
    near = near.groupBy(*group, F.col("_total").alias("n")).agg(*[F.max(F.when(ranks.holds(p), F.col("_x"))).alias(m) for m, p in mids.items()])
    near = checkpointed(near.where("n > 1"))
    near = F.broadcast(near) if near.count() <= MAX_BROADCAST else near
    # n even: n - 1 others, their middle is m1 for a value up to m0, else m0; n odd: the mean of two neighbours (equal values have equal refs)
    even = F.when(F.col("value") <= F.col("m0"), F.col("m1")).otherwise(F.col("m0"))
    high = F.when(F.col("value") <= F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    ref = F.when(F.col("n") % 2 == 0, even).otherwise((even + high) / 2)
    return rows.join(near, group).withColumn("ref", ref).drop("m0", "m1", "m2")


def gap():
    return F.abs(F.log(F.greatest("value", "floor") / F.greatest("ref", "floor")))


def distances(texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, distance: mean absolute log ratio to the median of the others, values under the floor raised to it."""
    rows = without_self(long_values(style.summed_once(texts), by), by)
    return rows.groupBy("key", *by).agg(F.avg(gap()).alias("distance"))


def thresholds(dist: DataFrame, by: list[str]) -> DataFrame:
    """by, n, median, threshold: four robust deviations above the median, but at least one and a half medians."""
    dist = checkpointed(dist)
    mid = checkpointed(ranks.quantiles(dist, by, "distance", {"median": 0.5}).join(dist.groupBy(*by).agg(F.count("*").alias("n")), by))
    off = ranks.quantiles(dist.join(mid, by).withColumn("off", F.abs(F.col("distance") - F.col("median"))), by, "off", {"mad": 0.5})
    return mid.join(off, by).withColumn("threshold", F.greatest(F.col("median") + K * 1.4826 * F.col("mad"), FACTOR * F.col("median"))).drop("mad")


def outliers(texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, distance, threshold, median for texts beyond their slot's threshold, in slots of five texts or more."""
    dist = checkpointed(distances(texts, by))
    rows = dist.join(thresholds(dist, by), by).where((F.col("n") >= MIN_TEXTS) & (F.col("distance") > F.col("threshold")))
    return rows.select("key", *by, *[F.round(c, 3).alias(c) for c in ("distance", "threshold", "median")])


def off_metrics(texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, metric, rank: for each text up to three metrics furthest from the others' median, at least a quarter off."""
    rows = without_self(long_values(style.summed_once(texts), by), by).withColumn("gap", F.round(gap(), 9))
    ranked = rows.where(F.col("gap") >= F.log(F.lit(GAP))).withColumn("rank", F.expr("row_number() over (partition by key order by gap desc, metric)"))
    return ranked.where(F.col("rank") <= TOP).select("key", *by, "metric", F.col("rank").cast("long").alias("rank"))


def verify(drafts: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, distance, share_further, verdict of every draft against the texts of its slot."""
    texts = style.summed_once(texts)
    own = checkpointed(distances(texts, by))
    limits = thresholds(own, by).where(F.col("n") >= MIN_TEXTS)
    ref = ranks.quantiles(long_values(texts, by), [*by, "metric"], "value", {"ref": 0.5})
    d = long_values(drafts, by).join(ref, [*by, "metric"]).groupBy("key", *by).agg(F.avg(gap()).alias("d"))
    # in one order of drafts and texts, a draft's running count of texts is how many are nearer than it
    line = d.select("key", *by, F.col("d").alias("x"), F.lit(0).alias("text")).unionByName(own.select("key", *by, F.col("distance").alias("x"), F.lit(1).alias("text")))
    nearer = ranks.running(line, by, ["x", "text", "key"], "text", "nearer").where("text = 0")
    share = nearer.select("key", *by, F.col("x").alias("d"), "nearer").join(own.groupBy(*by).agg(F.count("*").alias("own")), by).withColumn("share", 1 - F.col("nearer") / F.col("own"))
    rows = share.join(limits, by)
    verdict = F.when(F.col("d") <= F.col("median"), "closer than most").when(F.col("d") <= F.col("threshold"), "within the range").otherwise("unlike the others")
    return rows.select("key", *by, F.round("d", 3).alias("distance"), F.round("share", 3).alias("share_further"), verdict.alias("verdict"))
