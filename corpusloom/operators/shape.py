"""The shape of a piece: how paragraphs and sections vary, how it addresses and quotes, and small marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packs
from ..functions import text as T
from . import ranks
from .similarity import checkpointed

MIN_WORDS, MIN_TEXTS, MIN_PARAGRAPHS, MIN_SECTIONS = 300, 5, 5, 3
FEATURES = ("paragraph_length_cv", "paragraph_sentences", "one_sentence_paragraphs", "section_length_cv", "reader_address_per_1k", "long_quotes_per_1k", "quoted_share")
HIGH_ONLY = ("long_quotes_per_1k", "quoted_share")
#: The small marks that are counted.
QUIRKS = {
    "ellipses": r"…|(?<!\.)\.\.\.(?!\.)",
    "exclamations": r"!(?!=)",
    "questions": r"\?",
    "asides": r"(?<!\])\(",
    "emoji": r"[\x{1F300}-\x{1FAFF}☀-➿]",
}


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _cv(xs: Column) -> Column:
    n, total = F.size(xs), _sum(xs)
    mean = total / n
    var = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0)


def measures(texts: DataFrame) -> DataFrame:
    """key, lang, type and FEATURES, null where a text cannot show one; texts under 300 words of prose are left out."""
    rows = texts.withColumns({"_p": T.prose_blocks(F.col("text")), "_b": T.blocks(F.col("text"))})
    paras = F.transform(F.filter("_p", lambda b: ~b["heading"]), lambda b: b["block"])
    rows = rows.withColumn("_paras", paras).withColumns(
        {"_len": F.transform("_paras", lambda p: T.n_words(p).cast("double")), "_ns": F.transform("_paras", lambda p: F.greatest(F.lit(1), F.size(T.sentences(p))).cast("double"))}
    )
    rows = rows.withColumn("_words", _sum(F.col("_len"))).where(F.col("_words") >= MIN_WORDS)
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("now"))

    def section(acc: Column, b: Column) -> Column:
        close = F.when(acc["now"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(F.when(b["heading"], close).otherwise(acc["done"]).alias("done"), F.when(b["heading"], 0.0).otherwise(acc["now"] + T.n_words(b["block"])).alias("now"))

    cut = F.aggregate("_p", start, section, lambda acc: F.when(acc["now"] > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    address = r"(?U)(?<!\w)(?:" + "|".join(sorted(packs.ADDRESS["en"], key=lambda w: (-len(w), w))) + r")(?!\w)"
    body = F.lower(F.array_join("_paras", "\n"))

    def starts(block: Column, sign: str) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: T.strip(x) != "")
        return F.forall(lines, lambda x: T.strip(x).startswith(sign))

    ref = F.array_position(F.transform("_b", lambda b: b["heading"] & b["block"].rlike(T.REFERENCE_HEADING)), True).cast("int")
    mine = F.transform(F.when(ref > 0, F.slice("_b", F.lit(1), F.greatest(ref - 1, F.lit(0)))).otherwise(F.col("_b")), lambda b: b["block"])
    shown = F.filter(mine, lambda b: ~starts(b, "|"))
    long_quotes = lambda b: F.filter(F.regexp_extract_all(b, F.lit(T.QUOTED), F.lit(0)), lambda q: T.n_words(q) >= T.QUOTE_MIN_WORDS)
    n_all = _sum(F.transform(shown, lambda b: T.n_words(b).cast("double")))
    n_quotes = _sum(F.transform(shown, lambda b: F.when(starts(b, ">"), 1.0).otherwise(F.size(long_quotes(b)).cast("double"))))
    n_quoted = _sum(F.transform(shown, lambda b: F.when(starts(b, ">"), T.n_words(b).cast("double")).otherwise(_sum(F.transform(long_quotes(b), lambda q: T.n_words(q).cast("double"))))))
    rows = rows.withColumns({"_sec": cut, "_all": n_all, "_nq": n_quotes, "_q": n_quoted})
    enough = F.size("_paras") >= MIN_PARAGRAPHS
    return rows.select(
        "key",
        "lang",
        "type",
        F.round(F.when(enough, _cv(F.col("_len"))), 4).alias("paragraph_length_cv"),
        F.round(F.when(enough, _sum(F.col("_ns")) / F.size("_ns")), 4).alias("paragraph_sentences"),
        F.round(F.when(enough, F.size(F.filter("_ns", lambda x: x == 1)) / F.size("_ns")), 4).alias("one_sentence_paragraphs"),
        F.round(F.when(F.size("_sec") >= MIN_SECTIONS, _cv(F.col("_sec"))), 4).alias("section_length_cv"),
        F.round(F.when(F.col("lang") == "en", F.regexp_count(body, F.lit(address)) * 1000 / F.col("_words")), 4).alias("reader_address_per_1k"),
        F.round(F.when(F.col("_all") > 0, F.col("_nq") * 1000 / F.col("_all")), 4).alias("long_quotes_per_1k"),
        F.round(F.when(F.col("_all") > 0, F.col("_q") / F.col("_all")), 4).alias("quoted_share"),
    )


def ranges(shapes: DataFrame, by: list[str]) -> DataFrame:
    """by, feature, low, mid, high, texts for features that at least five texts show."""
    rows = checkpointed(shapes.unpivot([*by], list(FEATURES), "feature", "value").where("value is not null"))
    names = {"low": 0.1, "mid": 0.5, "high": 0.9}
    got = ranks.quantiles(rows, [*by, "feature"], "value", names).select(*by, "feature", *[F.round(n, 4).alias(n) for n in names])
    return got.join(rows.groupBy(*by, "feature").agg(F.count("*").alias("texts")).where(F.col("texts") >= MIN_TEXTS), [*by, "feature"])


def compared(shapes: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """key, feature, flag: low or high outside the writer's range; some features are never low."""
    rows = shapes.unpivot(["key", *by], list(FEATURES), "feature", "value").where("value is not null").join(spans, [*by, "feature"])
    flag = F.when(F.col("value") > F.col("high"), "high").when((F.col("value") < F.col("low")) & ~F.col("feature").isin(*HIGH_ONLY), "low").otherwise("ok")
    return rows.select("key", "feature", flag.alias("flag"))


def warned(flags: DataFrame, least: int = 4) -> DataFrame:
    """key, off, warned: texts with four features or more outside the writer's ranges."""
    off = F.count_if(F.col("flag") != "ok")
    return flags.groupBy("key").agg(off.alias("off"), (off >= least).alias("warned"))


def quirks(texts: DataFrame) -> DataFrame:
    """key, lang, n_words and the number of each mark in prose without inline code."""
    body = F.array_join(F.transform(T.paragraphs(F.col("text")), lambda p: F.regexp_replace(p, r"`[^`\n]*`", " ")), "\n")
    rows = texts.select("key", "lang", body.alias("_body"))
    return rows.select("key", "lang", T.n_words(F.col("_body")).cast("long").alias("n_words"), *[F.regexp_count("_body", F.lit(p)).cast("long").alias(k) for k, p in QUIRKS.items()])


def quirk_ranges(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, quirk, rate, high, share over texts of 300 words or more, where there are five."""
    rows = counts.where(F.col("n_words") >= MIN_WORDS).unpivot([*by, "n_words"], list(QUIRKS), "quirk", "uses")
    rows = checkpointed(rows.withColumn("per_1k", F.col("uses") * 1000 / F.col("n_words")))
    high = ranks.quantiles(rows, [*by, "quirk"], "per_1k", {"high": 0.9})
    return (
        rows.groupBy(*by, "quirk")
        .agg(
            F.round(F.sum("uses") * 1000 / F.sum("n_words"), 3).alias("rate"),
            F.round(F.avg((F.col("uses") > 0).cast("int")), 3).alias("share"),
            F.count("*").alias("texts"),
        )
        .where(F.col("texts") >= MIN_TEXTS)
        .join(high.withColumn("high", F.round("high", 3)), [*by, "quirk"])
        .select(*by, "quirk", "rate", "high", "share")
    )


def quirk_flags(counts: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """key, quirk, uses, allowed, flag: high above the allowance; low if none where two are expected and most texts show it."""
    rows = counts.where(F.col("n_words") >= MIN_WORDS).unpivot(["key", *by, "n_words"], list(QUIRKS), "quirk", "uses").join(spans, [*by, "quirk"])
    used = F.col("share") > 0
    expected = F.when(used, F.bround(F.col("rate") * F.col("n_words") / 1000, 0)).otherwise(0)
    allowed = F.when(used, F.greatest(F.lit(1), F.ceil(F.col("high") * F.col("n_words") / 1000))).otherwise(0)
    flag = F.when(F.col("uses") > allowed, "high").when((F.col("uses") == 0) & (expected >= 2) & (F.col("share") >= 0.5), "low").otherwise("ok")
    return rows.select("key", "quirk", "uses", allowed.cast("long").alias("allowed"), flag.alias("flag"))
