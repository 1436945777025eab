"""Texts against their slot without them, and slots that texts leave and join, all from sums.

A slot's sums less a text's own are the slot without it, so the reference of every text costs one join, not a pass
over the others. In the same way a slot is kept up: sums of the texts that leave are subtracted, those of new ones
added, and exact histograms of the texts' own values move by counts; only the texts that move are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks, style
from .style import SUMS

FAIL_FROM = tuple(range(2, 9))


def _flag(value: Column, slot: Column) -> Column:
    """What check.metric_flags says of one value, with the columns of style.metric_table beside it."""
    under = F.when(value - slot > 2 * F.col("floor"), "overshoot").otherwise("ok")
    dense = ~F.col("sparse") & (F.col("shortfall") > 0.05)
    return F.when(slot < F.col("floor"), under).when(value / slot > F.col("overshoot"), "overshoot").when(dense & (value / slot < F.col("shortfall")), "shortfall").otherwise("ok")


def without_own(texts: DataFrame, by: list[str]) -> DataFrame:
    """key, by, metric, rest: the metrics of each text's slot without the text; a slot of one text has none."""
    rows = style.sums(texts).select("key", *by, *SUMS)
    total = style.summed(rows, by).where("n_texts > 1").select(*by, *[F.col(s).alias(f"_{s}") for s in SUMS])
    rest = rows.join(total, by).select("key", *by, *[(F.col(f"_{s}") - F.coalesce(F.col(s), F.lit(0))).alias(s) for s in SUMS])
    return style.melted(rest.select("key", *by, *style.values().values()), ["key", *by]).withColumnRenamed("value", "rest")


def flags(units: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """key, unit, by, metric, value, rest, flag: each unit (key, unit, by, SUMS), a text or a part of one, against its text's slot without the text."""
    own = style.melted(units.select("key", "unit", *by, *style.values().values()), ["key", "unit", *by])
    rows = own.join(without_own(texts, by), ["key", *by, "metric"]).join(style.metric_table(texts.sparkSession), "metric")
    return rows.select("key", "unit", *by, "metric", "value", "rest", _flag(F.col("value"), F.col("rest")).alias("flag"))


def counted(flagged: DataFrame, by: list[str]) -> DataFrame:
    """key, unit, by, flagged: how many metrics are off."""
    return flagged.groupBy("key", "unit", *by).agg(F.count_if(F.col("flag") != "ok").alias("flagged"))


def simulated(counts: DataFrame, by: list[str], thresholds: tuple[int, ...] = FAIL_FROM) -> DataFrame:
    """by, k, units, any_flag, fails: the share of units with a flag, and with k flags or more, as a check that fails from k would find."""
    g = counts.groupBy(*by).agg(F.count("*").alias("units"), F.count_if(F.col("flagged") > 0).alias("any"), *[F.count_if(F.col("flagged") >= k).alias(f"k{k}") for k in thresholds])
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.round(F.col(f"k{k}") / F.col("units"), 6).alias("fails")) for k in thresholds])
    return g.select(*by, "units", F.round(F.col("any") / F.col("units"), 6).alias("any_flag"), F.explode(each).alias("x")).select(*by, "x.k", "units", "any_flag", "x.fails")


# --- slots that texts leave and join


def state(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, SUMS and n_texts of every slot: all that is needed to move it."""
    return style.summed(style.sums(texts), by).select(*by, *SUMS, "n_texts")


def moved(before: DataFrame, gone: DataFrame, come: DataFrame, by: list[str]) -> DataFrame:
    """The state after some texts have left and others come; slots without a text are no more. Only these texts are measured."""
    minus = state(gone, by)
    minus = minus.select(*by, *[(-F.col(c)).alias(c) for c in (*SUMS, "n_texts")])
    every = before.unionByName(minus).unionByName(state(come, by))
    return every.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*SUMS, "n_texts")]).where("n_texts > 0")


def histogram(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, value, n: how many texts of a slot have each value of each metric, exactly."""
    rows = style.melted(style.sums(texts).select("key", *by, *style.values().values()), ["key", *by])
    return rows.groupBy(*by, "metric", "value").agg(F.count("*").alias("n"))


def moved_histogram(before: DataFrame, gone: DataFrame, come: DataFrame, by: list[str]) -> DataFrame:
    minus = histogram(gone, by).withColumn("n", -F.col("n"))
    every = before.unionByName(minus).unionByName(histogram(come, by))
    return every.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n")).where("n > 0")


def _between(low: Column, high: Column, share: Column) -> Column:
    """The value a share of the way from low to high, rounded to six digits; low's product is not rounded before the sum, as
    SQL engines fuse the two, so values that end in a five come out alike."""
    fused = F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
    return F.when(low.isNotNull() & high.isNotNull(), F.floor(fused * 1e6 + 0.5) / 1e6)


def quantiles(hist: DataFrame, by: list[str], asked: dict[str, float]) -> DataFrame:
    """by, metric and a column for each quantile, between the two values next to it, from running counts of the histogram."""
    group = [*by, "metric"]
    placed = ranks.running(hist, group, ["value"], "n").join(hist.groupBy(*group).agg(F.sum("n").alias("total")), group)
    at = {name: F.lit(q) * (F.col("total") - 1) for name, q in asked.items()}
    first = [F.min(F.when(F.col("upto") > f(x), F.col("value"))).alias(f"{name}_{k}") for name, x in at.items() for k, f in enumerate((F.floor, F.ceil))]
    got = placed.groupBy(*group, "total").agg(*first)
    return got.select(*group, *[_between(F.col(f"{n}_0"), F.col(f"{n}_1"), x - F.floor(x)).alias(n) for n, x in at.items()])


def rederived(before: DataFrame, hist: DataFrame, gone: DataFrame, come: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, n_texts, value, q05, q95 of the slots that any text leaves or joins, from the state and histogram before."""
    gone, come = style.summed_once(gone), style.summed_once(come)
    touched = gone.select(*by).union(come.select(*by)).distinct()
    slots = moved(before.join(touched, by, "left_semi"), gone, come, by)
    values = style.melted(slots.select(*by, "n_texts", *style.values().values()), [*by, "n_texts"])
    bands = quantiles(moved_histogram(hist.join(touched, by, "left_semi"), gone, come, by), by, {"q05": 0.05, "q95": 0.95})
    return values.join(bands, [*by, "metric"]).select(*by, "metric", "n_texts", "value", "q05", "q95")


def fingerprints(texts: DataFrame, by: list[str]) -> DataFrame:
    """What `rederived` gives, built anew from all texts."""
    values = style.melted(state(texts, by).select(*by, "n_texts", *style.values().values()), [*by, "n_texts"])
    return values.join(quantiles(histogram(texts, by), by, {"q05": 0.05, "q95": 0.95}), [*by, "metric"]).select(*by, "metric", "n_texts", "value", "q05", "q95")


