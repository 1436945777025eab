"""Near-duplicates by shared shingles, n-gram overlap, and components of the links."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

THRESHOLD = 0.9
SIZE = 5
#: rows of a list that is still broadcast
MAX_BROADCAST = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder of spark.checkpoint.dir and read from there; one machine alone may do without the setting."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def plain_ids(rows: DataFrame) -> DataFrame:
    """The distinct ids of `rows`, by an aggregate that passes on none of the filters Spark has inferred: a checkpoint keeps
    these, and in a loop that unites its rounds they would double with each."""
    return rows.groupBy("id").agg(F.min("id").alias("_id")).select(F.col("_id").alias("id"))


def grams(words, size: int):
    """Array of the distinct runs of `size` words, space-joined."""

    def of(w):
        n = F.size(w) - size + 1
        runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    # bound to a lambda variable, the words are found once and not again for every run
    return F.get(F.transform(F.array(words), of), 0)


def shingles(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """key and the sorted hashes of the distinct shingles of lower-cased words."""
    low = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.lower(w))
    return texts.select("key", F.array_sort(F.array_distinct(F.transform(grams(low, size), lambda s: F.xxhash64(s)))).alias("sh"))


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, j) with a < b for classes of equal sets whose Jaccard similarity is `threshold` or more, exactly.

    `sets` has id and sh (sorted distinct hashes). Shingles are ordered rarest first, and only the prefix that
    two similar sets must share is indexed; sizes filter candidates before they are verified.
    """
    rows = sets.where(F.size("sh") > 0)
    df = rows.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one set only are the rarest and meet nothing: they are counted, but not sent on
    ranked = rows.select("id", F.size("sh").alias("n"), F.explode("sh").alias("s")).join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    prefix = F.size("o") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    index = ranked.where(prefix > 0).select("id", "n", F.explode(F.slice("o", F.lit(1), prefix)).alias("x")).select("id", "n", F.col("x.s").alias("s"))
    a, b = index.alias("a"), index.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9)
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    x, y = rows.select(F.col("id").alias("a"), F.col("sh").alias("sa")), rows.select(F.col("id").alias("b"), F.col("sh").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    j = both / (F.size("sa") + F.size("sb") - both)
    return pairs.join(x, "a").join(y, "b").select("a", "b", j.alias("j")).where(F.col("j") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by minima over neighbours with label jumping."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.select(F.col("a").alias("node"), F.col("a").alias("l")).distinct())
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, label["node"] == near["a"], "left").select("node", F.col("l").alias("was"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = low.select(F.col("node").alias("l"), F.col("l").alias("further"))
        new = checkpointed(low.join(jump, "l", "left").select("node", "was", F.least("l", F.coalesce("further", "l")).alias("l")))
        label = new.select("node", "l")
        if new.where("was <> l").isEmpty():
            return label.select("node", F.col("l").alias("component"))


def near_duplicates(texts: DataFrame, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """key, n_links (other texts linked directly) and component (smallest key reachable) of every text.

    Texts with equal shingle sets are one class with a weight, so copies make no pairs.
    """
    own = checkpointed(shingles(texts, size).withColumn("id", F.xxhash64("sh")))
    classes = own.where(F.size("sh") > 0).groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.first("sh").alias("sh"))
    classes = checkpointed(classes)
    pairs = checkpointed(similar_sets(classes.select("id", "sh"), threshold))
    weight = classes.select("id", "n")
    sides = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = sides.join(weight.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "id")
    comp = components(pairs).withColumnRenamed("node", "id")
    named = classes.select("id", "n", "least").join(comp, "id", "left").join(links, "id", "left").withColumn("c", F.coalesce("component", "id"))
    lowest = named.groupBy("c").agg(F.min("least").alias("lowest"))
    by_class = named.join(lowest, "c").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "lowest")
    out = own.select("key", F.when(F.size("sh") > 0, F.col("id")).alias("id")).join(by_class, "id", "left")
    return out.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "key").alias("component"))


def overlaps(texts: DataFrame, passages: DataFrame, size: int = 4) -> DataFrame:
    """key, item, shared: distinct n-grams of a text that a passage has too; both have columns key and text."""
    def exploded(df: DataFrame, name: str) -> DataFrame:
        low = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.lower(w))
        return df.select(F.col("key").alias(name), F.explode(grams(low, size)).alias("g"))

    # few n-grams go to the texts; many meet them by a shuffle
    asked = checkpointed(exploded(passages, "item"))
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
    return exploded(texts, "key").join(asked, "g").groupBy("key", "item").agg(F.count("*").alias("shared"))


def top_passages(passages: DataFrame, briefs: DataFrame, stop: tuple, n: int = 3) -> DataFrame:
    """brief, key, rank, score: the n passages whose words match a brief best, by inverse document frequency; ties by key."""
    def tokens(df: DataFrame, name: str) -> DataFrame:
        low = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.lower(w))
        kept = F.filter(low, lambda w: (F.length(w) > 2) & ~w.isin(*stop))
        return df.select(F.col("key").alias(name), F.explode(F.array_distinct(kept)).alias("w"))

    docs = checkpointed(tokens(passages, "key"))
    total = passages.count()
    idf = docs.groupBy("w").agg(F.log(1 + F.lit(total) / F.count("*")).alias("idf"))
    asked = checkpointed(tokens(briefs, "brief").join(idf, "w"))
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
    scored = asked.join(docs, "w").groupBy("brief", "key").agg(F.round(F.sum("idf"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.expr("row_number() over (partition by brief order by score desc, key)"))
    return ranked.where(F.col("rank") <= n).select("brief", "key", F.col("rank").cast("long").alias("rank"), "score")


def jaccard_bound(n: int, threshold: float = THRESHOLD) -> int:
    """The size of the smallest set that can be similar to one of n."""
    return math.ceil(n * threshold)
