"""Traces of another language in a writer's prose: detectors, markers, their rates, and the check of a draft.

A detector is a row (id, lang, name, origins, pattern, examples, counters); its pattern is case-insensitive and read
within paragraphs. Detectors are a small table, so their patterns become columns of one scan.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as T

MAX_RATE, MIN_WORDS, FOUND = 10.0, 300, 5
ID, ORIGIN = "^[a-z0-9-]+$", "^[a-z]{2,3}$"


def _pattern(p: str) -> str:
    return f"(?imU){p}"


def paragraphs(text: Column) -> Column:
    return F.split(T.normal_quotes(text), r"\n[ \t]*\n")


def hits(text: Column, pattern: str) -> Column:
    """Matches within paragraphs; none spans a paragraph break."""
    return F.aggregate(F.transform(paragraphs(text), lambda p: F.regexp_count(p, F.lit(_pattern(pattern)))), F.lit(0).cast("long"), lambda a, n: a + n)


def scan(texts: DataFrame, detectors: list[dict]) -> DataFrame:
    """key, detector, count, found: what the detectors of a text's language find in it, with the first five matches."""

    def one(d: dict) -> Column:
        found = F.flatten(F.transform(paragraphs(F.col("text")), lambda p: F.regexp_extract_all(p, F.lit(_pattern(d["pattern"])), F.lit(0))))
        return F.when(F.col("lang") == d["lang"], F.struct(F.lit(d["id"]).alias("detector"), F.size(found).cast("long").alias("count"), F.slice(found, 1, FOUND).alias("found")))

    return texts.select("key", F.explode(F.array_compact(F.array(*map(one, detectors)))).alias("x")).select("key", "x.*").where("count > 0")


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def compiles(p: str) -> bool:
        try:
            return bool(regex.compile(p))
        except regex.error:
            return False

    return patterns.map(compiles, na_action="ignore")


def findings(detectors: DataFrame) -> DataFrame:
    """id, rule, value: each fault of a table of detectors (id, name, origins, pattern, examples, counters) is a row.

    Rules are set against the table as a whole: samples that a pattern ought to match and does not, or ought not to and
    does; values that are not spelled as keys are; fields without a value; ids that two rows claim. Only patterns that
    compile are tried on samples.
    """
    tried = detectors.withColumn("sound", F.coalesce(_compiles("pattern"), F.lit(True)))
    able = tried.where("sound and pattern is not null")

    def samples(field: str, rule: str, wrong) -> DataFrame:
        rows = able.select("id", "pattern", F.explode(field).alias("value"))
        return rows.where(wrong(F.rlike(T.normal_quotes(F.col("value")), F.concat(F.lit("(?imU)"), "pattern")))).select("id", F.lit(rule).alias("rule"), "value")

    def rows(rule: str, value: Column, fault: Column, source: DataFrame = tried) -> DataFrame:
        return source.where(fault).select("id", F.lit(rule).alias("rule"), value.cast("string").alias("value"))

    empty = [F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) == 0, F.lit(c)) for c in ("name", "pattern")]
    empty += [F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit(c)) for c in ("origins", "examples")]
    lacking = tried.select("id", F.explode(F.array_compact(F.array(*empty))).alias("value"))
    parts = [
        samples("examples", "example not matched", lambda hit: ~hit),
        samples("counters", "counter-example matched", lambda hit: hit),
        rows("pattern does not compile", F.col("pattern"), ~F.col("sound")),
        rows("not a language code", F.col("value"), ~F.col("value").rlike(ORIGIN), tried.select("id", F.explode("origins").alias("value"))),
        rows("not a key", F.col("id"), ~F.coalesce(F.col("id").rlike(ID), F.lit(False))),
        rows("no value", F.col("value"), F.lit(True), lacking),
        rows("key of several rows", F.col("n"), F.col("n") > 1, tried.groupBy("id").agg(F.count("*").alias("n"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def built(texts: DataFrame, detectors: list[dict], by: list[str]) -> DataFrame:
    """by, id, hits, texts, of, per_1k: markers of a group's texts, without those too broad to be a trace and those never met."""
    tests = {d["id"]: d["pattern"] for d in detectors}
    wide = texts.select("key", *by, T.n_words(F.col("text")).cast("long").alias("n_words"), *[hits(F.col("text"), p).alias(k) for k, p in tests.items()])
    rows = wide.unpivot(["key", *by, "n_words"], list(tests), "id", "hits")
    got = rows.groupBy(*by, "id").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("texts"), F.count("*").alias("of"), F.round(F.sum("hits") * 1000 / F.sum("n_words"), 2).alias("per_1k"))
    return got.where((F.col("hits") > 0) & (F.col("per_1k") <= MAX_RATE))


def rates(texts: DataFrame, detectors: list[dict], by: list[str]) -> DataFrame:
    """by, per_1k, max_per_1k of all markers together; the highest rate is taken over texts of 300 words or more, or over all."""
    n = T.n_words(F.col("text")).cast("long")
    total = sum((hits(F.col("text"), d["pattern"]) for d in detectors), F.lit(0).cast("long"))
    rows = texts.select("key", *by, n.alias("w"), total.alias("h")).where("w > 0").withColumn("r", F.col("h") * 1000 / F.col("w"))
    g = rows.groupBy(*by).agg(F.round(F.sum("h") * 1000 / F.sum("w"), 2).alias("per_1k"), F.max(F.when(F.col("w") >= MIN_WORDS, F.col("r"))).alias("m"), F.max("r").alias("any"))
    return g.select(*by, "per_1k", F.round(F.coalesce("m", "any"), 2).alias("max_per_1k"))


def checked(drafts: DataFrame, detectors: list[dict], rate: DataFrame, by: list[str], off: bool = False) -> DataFrame:
    """key, hits, allowed, flagged: drafts with more traces than the writer's highest rate gives (none, where they are off)."""
    total = sum((hits(F.col("text"), d["pattern"]) for d in detectors), F.lit(0).cast("long"))
    rows = drafts.select("key", *by, T.n_words(F.col("text")).cast("long").alias("w"), total.alias("hits")).join(rate, by)
    allowed = F.lit(0) if off else F.greatest(F.lit(1), F.bround(F.col("max_per_1k") * F.col("w") / 1000))
    return rows.select("key", "hits", allowed.cast("long").alias("allowed"), (F.col("hits") > allowed).alias("flagged"))


LINE_SIGNS = 200


def flagged_lines(drafts: DataFrame, detectors: list[dict], rate: DataFrame, by: list[str], off: bool = False) -> DataFrame:
    """key, line (from 1), detector, count, said: the lines with traces, of the drafts that have more of them than `checked` allows."""
    over = checked(drafts, detectors, rate, by, off).where("flagged").select("key")
    lines = drafts.join(over, "key", "left_semi").select("key", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    line = T.normal_quotes(F.col("raw"))
    each = F.array(*[F.struct(F.lit(d["id"]).alias("detector"), F.regexp_count(line, F.lit(_pattern(d["pattern"]))).cast("long").alias("count")) for d in detectors])
    hit = lines.select("key", (F.col("at") + 1).cast("long").alias("line"), F.substring(T.strip(F.col("raw")), 1, LINE_SIGNS).alias("said"), F.explode(each).alias("x")).where("x.count > 0")
    return hit.select("key", "line", "x.detector", "x.count", "said")


def examples_verified(texts: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples (id, key, quote) whose quote stands in the text they name, but for case and white space."""
    fold = lambda c: F.lower(F.trim(T.squeeze(c)))
    return examples.join(texts.select("key", "text"), "key").where(F.contains(fold(F.col("text")), fold(F.col("quote")))).select("id", "key", "quote")


