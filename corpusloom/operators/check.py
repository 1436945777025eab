"""Checks of a draft: metric flags against a slot, bunched habits by a Poisson tail, and the verdict."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import style

FAIL_PERCENT, BUNCH_MIN, BUNCH_P = 28, 3, 0.01


def metric_flags(drafts: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """key, by, metric, value, slot, flag of every metric of every draft, all drafts in one pass.

    `slots` has `by` and the metrics; a band column pair may come with it later (see style.bands).
    """
    own = style.melted(slots, by).withColumnRenamed("value", "slot")
    rows = style.melted(style.text_metrics(drafts), list(dict.fromkeys(["key", *by]))).join(own, [*by, "metric"]).join(style.metric_table(drafts.sparkSession), "metric")
    ratio = F.col("value") / F.col("slot")
    under = F.when(F.col("value") - F.col("slot") > 2 * F.col("floor"), "overshoot").otherwise("ok")
    dense = ~F.col("sparse") & (F.col("shortfall") > 0.05)
    flag = F.when(F.col("slot") < F.col("floor"), under).when(ratio > F.col("overshoot"), "overshoot").when(dense & (ratio < F.col("shortfall")), "shortfall").otherwise("ok")
    return rows.select("key", *by, "metric", "value", "slot", flag.alias("flag"))


def _judged(flags: DataFrame, *more: Column) -> DataFrame:
    """key, flagged, status and what `more` aggregates of a draft's flags."""
    n = flags.groupBy("key").agg(F.count("*").alias("m"), F.sum((F.col("flag") != "ok").cast("long")).alias("flagged"), *more)
    bound = F.least(F.col("m"), F.greatest(F.lit(2), F.ceil(FAIL_PERCENT * F.col("m") / 100)))
    return n.withColumn("status", F.when(F.col("flagged") >= bound, "fail").otherwise("pass")).drop("m")


def status(flags: DataFrame) -> DataFrame:
    """key, flagged, status: fail from 28 % of the metrics on, rounded up, but at least two."""
    return _judged(flags)


def stirling_rest(k: Column) -> Column:
    """ln k! less the leading part of Stirling's formula, for k from 1 on: a table, and a series beyond it."""
    known = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)) for i in range(1, 16)])
    x = k.cast("double")
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(k < 16, F.get(known, (k - 1).cast("int"))).otherwise(series)


def log_factorial(k: Column) -> Column:
    """ln k!, at a cost that does not grow with k."""
    x = k.cast("double")
    return F.when(k < 2, 0.0).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + stirling_rest(k))


def poisson_tail(k: Column, mean: Column) -> Column:
    """P(X >= k) for a Poisson variable; terms are summed from logarithms."""
    terms = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.exp(-mean + i * F.log(mean) - F.when(i > 0, log_factorial(i)).otherwise(0.0)))
    below = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(k <= 0, 1.0).when(mean <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - below)))


def is_bunch(count: Column, mean: Column) -> Column:
    return (count >= BUNCH_MIN) & (poisson_tail(count, mean) < BUNCH_P)


HABITS = {"hedges_per_1k": "hedges", "semicolons_per_1k": "semicolons", "dashes_per_1k": "dashes", "colons_per_1k": "colons", "contractions_per_1k": "contractions"}
BUNCH_WORDS = 40


def bunches(drafts: DataFrame, slots: DataFrame, by: list[str]) -> DataFrame:
    """key, paragraph, habit, count, expected: paragraphs of forty words that use a countable habit far above the slot's rate."""
    names = list(dict.fromkeys(["key", "lang", *by]))
    paras = drafts.select(*names, F.explode(T.prose_blocks(F.coalesce("text", F.lit("")))).alias("b"))
    rows = style._counted(paras.where("not b.heading").withColumn("paragraph", F.col("b.n").cast("long")).withColumn("_paras", F.array("b.block")).drop("b"), "lang").where(F.col("n_words") >= BUNCH_WORDS)
    long = rows.select("key", "paragraph", "n_words", *by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("count")) for m, c in HABITS.items()])).alias("x"))
    long = long.select("key", "paragraph", "n_words", *by, "x.metric", "x.count").where("count is not null")
    own = style.melted(slots, by).withColumnRenamed("value", "rate")
    mean = F.col("rate") * F.col("n_words") / 1000
    hit = long.join(own, [*by, "metric"]).where(F.col("count") >= BUNCH_MIN).where(is_bunch(F.col("count").cast("int"), mean))
    return hit.select("key", "paragraph", F.col("metric").alias("habit"), "count", F.round(mean, 2).alias("expected"))


def verdicts(drafts: DataFrame, slots: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """key, status, flagged, over, under: what would pass has low confidence where its slot has; the metrics that are off are listed by name.

    `levels` has `by` and level. `drafts` may have their sums in the place of the text.
    """
    named = lambda f: F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("flag") == f, F.col("metric")))))
    rows = _judged(metric_flags(drafts, slots, by), named("overshoot").alias("over"), named("shortfall").alias("under"))
    rows = rows.join(drafts.select("key", *by), "key").join(levels.select(*by, "level"), by, "left")
    said = F.when((F.col("status") == "pass") & (F.col("level") == "low"), "low_confidence").otherwise(F.col("status"))
    return rows.select("key", said.alias("status"), "flagged", "over", "under")


def report(drafts: DataFrame, slots: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """key, status, flagged, over, under, bunched: the whole check, `verdicts` and the number of bunched paragraphs."""
    n = bunches(drafts, slots, by).groupBy("key").agg(F.count("*").alias("bunched"))
    return verdicts(drafts, slots, levels, by).join(n, "key", "left").withColumn("bunched", F.coalesce("bunched", F.lit(0)))
