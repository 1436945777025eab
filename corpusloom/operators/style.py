"""Style metrics: sums by text, groups of texts (slots), pooling, bands, stability and confidence.

All metrics are quotients of sums, so a text is reduced to one row of sums once, and slots, pooled slots,
weights and leave-one-out references are plain aggregates of those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions import text as T
from ..functions.scan import scan
from . import ranks
from .similarity import checkpointed

SUMS = (
    "n_para", "n_sent", "sum_len", "sumsq_len", "n_short", "n_long", "commas", "semicolons", "colons", "dashes", "digits",
    "n_words", "long_words", "hedges", "openers", "contractions",
)
METRICS = tuple(packs.METRICS)


def sums(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """`texts` with the columns of SUMS; list counts are null where the language has no list.

    Rows that have the sums already come back as they are, so a query that needs them twice finds them once.
    """
    if set(SUMS) <= set(texts.columns):
        return texts
    found = texts.withColumn("_sums", scan(SUMS)(F.col(text), F.col(lang)))
    return found.select("*", "_sums.*").drop("_sums")


def sums_by_columns(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The same as `sums` by Column expressions alone, without Python workers."""
    paras = texts.withColumn("_paras", T.paragraphs(F.coalesce(F.col(text), F.lit(""))))
    return _counted(paras, lang)


def _counted(paras: DataFrame, lang: str) -> DataFrame:
    """Counts over the array column `_paras`, which goes."""
    rows = paras.withColumn("_body", F.array_join("_paras", "\n\n"))
    rows = rows.withColumns({"_sents": T.sentences(F.col("_body")), "_words": T.words(F.col("_body")), "_low": F.lower("_body")})
    rows = rows.withColumns(
        {
            "_len": F.transform("_sents", lambda s: T.n_words(s).cast("long")),
            "_first": F.transform("_sents", lambda s: F.lower(F.regexp_extract(T.straight(s), T.WORD, 0))),
        }
    )

    def total(of) -> Column:
        return F.aggregate("_len", F.lit(0).cast("long"), lambda a, x: a + of(x))

    body, low, code = F.col("_body"), F.col("_low"), F.col(lang)
    counted = {
        "n_para": F.size("_paras"),
        "n_sent": F.size("_sents"),
        "sum_len": total(lambda x: x),
        "sumsq_len": total(lambda x: x * x),
        "n_short": F.size(F.filter("_len", lambda x: x < 8)),
        "n_long": F.size(F.filter("_len", lambda x: x > 28)),
        "commas": F.regexp_count(body, F.lit(",")),
        "semicolons": F.regexp_count(body, F.lit(";")),
        "colons": F.regexp_count(body, F.lit(":(?!//)")),
        "dashes": F.regexp_count(body, F.lit("—|--| – ")),
        "digits": F.regexp_count(body, F.lit(r"(?U)\b\d+\b")),
        "n_words": F.size("_words"),
        "long_words": F.size(F.filter("_words", lambda w: F.length(w) >= 7)),
        "hedges": packs.hedges(low, code),
        "openers": packs.openers(F.col("_first"), code),
        "contractions": packs.contractions(low, code),
    }
    return rows.withColumns({k: v.cast("long") for k, v in counted.items()}).drop("_paras", "_body", "_sents", "_words", "_low", "_len", "_first")


def summed_once(texts: DataFrame) -> DataFrame:
    """`texts` with their sums in the place of the text, written once for all that a query does with them."""
    return texts if set(SUMS) <= set(texts.columns) else checkpointed(sums(texts).drop("text"))


def values(digits: int = 6) -> dict[str, Column]:
    """The metrics from the columns of SUMS. A text without sentences has one of length zero."""
    c = F.col
    sents, words, paras = F.greatest(c("n_sent"), F.lit(1)), F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_para"), F.lit(1))
    mean = c("sum_len") / sents
    none = F.when(c("n_sent") == 0, 1).otherwise(0)
    out = {
        "sentence_length_sd": F.sqrt(F.greatest(c("sumsq_len") / sents - mean * mean, F.lit(0.0))),
        "sentences_per_paragraph": c("n_sent") / paras,
        "long_sentence_share": c("n_long") / sents,
        "sentence_length_mean": mean,
        "commas_per_sentence": c("commas") / sents,
        "semicolons_per_1k": c("semicolons") * 1000 / words,
        "conjunction_opener_share": c("openers") / sents,
        "contractions_per_1k": c("contractions") * 1000 / words,
        "dashes_per_1k": c("dashes") * 1000 / words,
        "colons_per_1k": c("colons") * 1000 / words,
        "short_sentence_share": (c("n_short") + none) / sents,
        "long_word_share": c("long_words") / words,
        "hedges_per_1k": c("hedges") * 1000 / words,
        "digits_per_1k": c("digits") * 1000 / words,
    }
    return {k: F.round(v, digits).alias(k) for k, v in out.items()}


def text_metrics(texts: DataFrame) -> DataFrame:
    """key, lang, type and the metrics of every text."""
    return sums(texts).select("key", "lang", "type", *values().values())


def summed(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """SUMS added up over groups, and n_texts."""
    w = F.lit(1) if weight is None else weight
    return rows.groupBy(*by).agg(*[F.sum(F.col(s) * w).alias(s) for s in SUMS], F.count("*").alias("n_texts"))


def slot_metrics(texts: DataFrame, by: tuple[str, ...] = ("lang", "type"), weight: Column | None = None) -> DataFrame:
    """Metrics of every group of texts, measured as one body of text."""
    got = summed(sums(texts), list(by), weight)
    return got.select(*by, "n_texts", "n_words", *values().values())


def pooled_metrics(texts: DataFrame) -> DataFrame:
    """Slots, and slots with the last facet generalised to `_`; a key counts once in each."""
    rows = sums(texts).dropDuplicates(["key", "lang", "type"])
    exact = rows.withColumn("pooled", F.lit(False))
    pooled = rows.withColumn("type", F.lit("_")).dropDuplicates(["key", "lang"]).withColumn("pooled", F.lit(True))
    got = summed(exact.unionByName(pooled), ["lang", "type", "pooled"])
    return got.select(T.slot(F.col("lang"), F.col("type")).alias("slot"), "pooled", "n_texts", "n_words", *values().values())


def count_level(n_texts: Column, n_words: Column) -> Column:
    low = (n_texts < 3) | (n_words < 3000)
    return F.when(low, "low").when((n_texts >= 8) & (n_words >= 15000), "high").otherwise("medium")


def need(percent: int, n: int, least: int = 2) -> int:
    """How many of n metrics make a share, rounded up, but at least `least`."""
    return min(n, max(least, -(-percent * n // 100)))


def melted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, metric, value: one row for each metric that is not null."""
    return rows.unpivot(keep, list(METRICS), "metric", "value").where("value is not null")


def metric_table(spark) -> DataFrame:
    """metric, overshoot, shortfall, tolerance, floor, sparse, place: a fixed table of fourteen rows."""
    names = ("metric", "overshoot", "shortfall", "tolerance", "floor", "sparse", "place")
    rows = [(m, *map(float, v[:4]), v[4], i) for i, (m, v) in enumerate(packs.METRICS.items())]
    # as literals: rows from the driver's Python go through workers of their own, which stay beside those of the scan
    fixed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(fixed)))


def stability(texts: DataFrame, by: tuple[str, ...] = ("lang", "type"), splits: int = 5) -> DataFrame:
    """by, metric, over: in how many hash-drawn splits the halves of a slot differ by more than the tolerance."""
    rows = sums(texts)
    half = F.explode(F.transform(F.sequence(F.lit(1), F.lit(splits)), lambda k: F.struct(k.alias("k"), (F.conv(F.substring(F.md5(F.concat_ws("/", k, F.col("key"))), 1, 1), 16, 10).cast("int") % 2).alias("half"))))
    drawn = rows.withColumn("x", half).select("*", "x.k", "x.half").drop("x")
    sides = melted(summed(drawn, [*by, "k", "half"]).select(*by, "k", "half", *values().values()), [*by, "k", "half"])
    pair = sides.groupBy(*by, "k", "metric").agg(F.max(F.when(F.col("half") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("value"))).alias("b")).where("a is not null and b is not null")
    base = F.greatest("floor", (F.col("a") + F.col("b")) / 2)
    unstable = F.abs(F.col("a") - F.col("b")) / base > F.col("tolerance")
    return pair.join(metric_table(texts.sparkSession), "metric").groupBy(*by, "metric").agg(F.sum(unstable.cast("int")).cast("long").alias("over"))


def confidence(texts: DataFrame, by: tuple[str, ...] = ("lang", "type")) -> DataFrame:
    """by, n_texts, n_words (of the raw texts), count_level, n_unstable, level."""
    counts = texts.groupBy(*by).agg(F.count("*").alias("n_texts"), F.sum(T.n_words(F.col("text"))).cast("long").alias("n_words"))
    shaky = stability(texts, by).groupBy(*by).agg(F.sum((F.col("over") >= 2).cast("int")).cast("long").alias("n_unstable"), F.count("*").alias("n_metrics"))
    level = count_level(F.col("n_texts"), F.col("n_words"))
    rows = counts.withColumn("count_level", level).join(shaky, list(by), "left").fillna(0, ["n_unstable", "n_metrics"])
    bound = F.least(F.col("n_metrics"), F.greatest(F.lit(2), F.ceil(28 * F.col("n_metrics") / 100)))
    down = (F.col("n_texts") >= 2) & (F.col("n_metrics") > 0) & (F.col("n_unstable") >= bound)
    lower = F.when(F.col("count_level") == "high", "medium").otherwise("low")
    return rows.select(*by, "n_texts", "n_words", "count_level", "n_unstable", F.when(down, lower).otherwise(F.col("count_level")).alias("level"))


def windows(texts: DataFrame, size: int = 350) -> DataFrame:
    """key, lang, type, w, n_words, paras: paragraphs gathered until they hold `size` words; a short rest is dropped."""
    start = F.struct(F.array().cast("array<struct<n:long,paras:array<string>>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, p: Column) -> Column:
        now, n = F.concat(acc["now"], F.array(p)), acc["n"] + T.n_words(p)
        full = n >= size
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(n.alias("n"), now.alias("paras"))))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array().cast("array<string>")).otherwise(now).alias("now"),
            F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"),
        )

    done = F.aggregate(T.paragraphs(F.col("text")), start, step)["done"]
    rows = texts.select("key", "lang", "type", F.posexplode(done).alias("w", "x"))
    return rows.select("key", "lang", "type", F.col("w").cast("long").alias("w"), F.col("x.n").alias("window_words"), F.col("x.paras").alias("paras"))


def window_metrics(texts: DataFrame, size: int = 350) -> DataFrame:
    got = _counted(windows(texts, size).withColumnRenamed("paras", "_paras"), "lang")
    return got.select("key", "lang", "type", "w", "window_words", *values().values())


def windowed_once(texts: DataFrame, size: int = 350) -> DataFrame:
    """`texts` with their sums and those of their windows (an array of w, window_words and SUMS) in the place of the text, from
    one pass, written once."""
    found = texts.withColumn("_sums", scan(SUMS, size)(F.col("text"), F.col("lang")))
    return checkpointed(found.select("*", "_sums.*").drop("_sums", "text"))


def bands(texts: DataFrame, by: tuple[str, ...] = ("lang",), size: int = 350, least: int = 20) -> DataFrame:
    """by, metric, value, n_windows, overshoot, shortfall: the fixed bands, widened to a slot's own windows where there are enough.

    `texts` may come from `windowed_once`. Windows of equal values are counted before they meet their slot.
    """
    texts = texts if "windows" in texts.columns else windowed_once(texts, size)
    slots = melted(slot_metrics(texts, by), list(by))
    wins = texts.select(*by, F.explode("windows").alias("x")).select(*by, *[f"x.{s}" for s in SUMS])
    wins = melted(wins.select(*by, *values().values()), list(by)).groupBy(*by, "metric", F.col("value").alias("own")).agg(F.count("*").alias("n"))
    joined = slots.join(wins, [*by, "metric"], "left").withColumn("r", F.when(F.col("value") > 0, F.col("own") / F.col("value")))
    joined = checkpointed(joined)
    group = [*by, "metric"]
    got = joined.groupBy(*group, "value").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_windows"))
    q = ranks.quantiles(joined, group, "r", {"q95": 0.95, "q05": 0.05}, "n")
    got = got.join(q.select(*group, F.round("q95", 3).alias("q95"), F.round("q05", 3).alias("q05")), group, "left")
    rows = got.join(metric_table(texts.sparkSession), "metric")
    wide = (F.col("n_windows") >= least) & (F.col("value") >= F.col("floor"))
    over = F.when(wide, F.greatest("overshoot", "q95")).otherwise(F.col("overshoot"))
    short = F.when(wide & (F.col("shortfall") > 0.05), F.greatest(F.lit(0.05), F.least("shortfall", "q05"))).otherwise(F.col("shortfall"))
    return rows.select(*by, "metric", "value", "n_windows", over.alias("overshoot"), short.alias("shortfall"))
