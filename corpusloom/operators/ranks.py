"""Running numbers and sums over very large groups, without a task that holds a whole group.

Rows are range-partitioned and sorted, each partition is numbered by itself, and what the partitions before it
hold of the same group is added: one number for each partition and group it touches.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import checkpointed


def running(rows: DataFrame, group: list[str], order: list[str], value: str | None = None, name: str = "upto", total: str | None = None) -> DataFrame:
    """`rows` with `name`: the sum of `value` (of ones, if none is named) in the group up to and with the row, in a total order;
    and with the group's whole sum, if a name for it is given."""
    rows = checkpointed(rows)  # a range partitioning reads its rows twice
    dealt = checkpointed(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order))
    own = dealt.withColumns({"_part": F.spark_partition_id(), "_v": F.col(value) if value else F.lit(1).cast("long")})
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("_part", *group).agg(F.sum("_v").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    whole = {total: F.sum("_s").over(Window.partitionBy(*group))} if total else {}
    parts = parts.withColumns(whole)
    keys = ["_part", *group]
    back = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", *whole)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    summed = own.withColumn("_here", F.sum("_v").over(here)).join(back, same)
    return summed.withColumn(name, F.col("_here") + F.col("_before")).select(*rows.columns, name, *whole)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """`rows` with their number in the group, from 1."""
    return running(rows, group, order, None, name)


def placed(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """by, _x, _w, _n and _total: each value that is not null once, how often it stands in the group, its last place there
    (from 1) and the group's size. Equal values are counted before anything is sorted, by partial aggregates.

    `weight` says how often a row counts.
    """
    times = F.sum(weight) if weight else F.count("*")
    own = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(times.alias("_w"))
    return running(own, by, ["_x"], "_w", "_n", "_total")


def holds(place: Column) -> Column:
    """Whether a row of `placed` holds a place of its group (from 1)."""
    return (F.col("_n") - F.col("_w") < place) & (place <= F.col("_n"))


def quantiles(rows: DataFrame, by: list[str], value: str, asked: dict[str, float], weight: str | None = None) -> DataFrame:
    """by and a column for each quantile asked for, exactly, between the two values next to it; no group is gathered."""
    at = {name: F.lit(q) * (F.col("_total") - 1) for name, q in asked.items()}
    sides = {f"_{name}_{k}": f(x) + 1 for name, x in at.items() for k, f in enumerate((F.floor, F.ceil))}
    few = placed(rows, by, value, weight).where(functools.reduce(Column.__or__, [holds(p) for p in sides.values()]))
    got = few.groupBy(*by, "_total").agg(*[F.max(F.when(holds(p), F.col("_x"))).alias(s) for s, p in sides.items()])
    return got.select(*by, *[(F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (x - F.floor(x))).alias(name) for name, x in at.items()])


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """by and the smallest value that a share q of the group does not exceed."""
    return placed(rows, by, value).where(holds(F.greatest(F.lit(1), F.ceil(q * F.col("_total"))))).select(*by, F.col("_x").alias(name))
