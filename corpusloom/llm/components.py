"""Connected components by alternating large-star and small-star steps.

Every step is a pre-aggregated minimum and an equi-join, both of which Spark can split when one node
has very many edges; no group is ever gathered, and nothing but one number goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: a key with more than this part of the rows is hot
SHARE = 1000

def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b, once each."""
    if small:  # every node a joins its lower neighbours to the least of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        out = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:  # every node joins its higher neighbours to the least of its neighbourhood and itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        # edges seen from their lower end: b's higher neighbour a goes to the least around b
        out = edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected `edges` (a, b); component is its least node.

    Self-links and repeated edges do no harm, edges with a null are left out; no edges give no rows.
    """
    now = checkpointed(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = None
    while True:
        now = checkpointed(_star(_star(now, small=False), small=True))
        # done when every node hangs on one centre and no centre hangs on another
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)


def with_hot_keys(rows: DataFrame, values: DataFrame, key: str, how: str = "inner", count: str | None = None) -> DataFrame:
    """`rows` joined to `values`, which has each key once; keys with over a `SHARE`th of the rows are broadcast.

    There are fewer than `SHARE` such keys, whatever the data, so the broadcast side is bounded, and no
    task of the other join gets more rows of one key. `rows` should be cheap to read twice. The rows of each
    key are counted, unless `values` has their number in column `count`.
    """
    if count:
        hot, values = values.where(F.col(count) * SHARE > rows.count()).drop(count), values.drop(count)
    else:
        counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_of_key"))
        hot = values.join(F.broadcast(counts.where(F.col("n_of_key") * SHARE > rows.count()).select(key)), key, "left_semi")
    hot = checkpointed(hot)
    if hot.isEmpty():
        return rows.join(values, key, how)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(values, key, how))


def named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id): for each row of `nodes` (node, least) the smallest `least` of its component."""
    found = components(edges).select("node", "component")
    own = checkpointed(nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("c")))
    several = own.where("c <> node").select("c").distinct()
    lowest = checkpointed(own.join(several, "c", "left_semi").groupBy("c").agg(F.min("least").alias("lowest")))
    return with_hot_keys(own, lowest, "c", "left").select("node", F.coalesce("lowest", "least").alias("component_id"))
