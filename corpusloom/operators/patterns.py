"""Counting patterns: rulings, signs of machine text, phrases and detectors, their rates and flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranks
from .similarity import checkpointed

PERCENTILE, MIN_HITS, RATE_FACTOR, THIN = 0.95, 2, 2.0, 5
#: Redaction patterns in their order, each with what takes its place.
REDACTIONS = (
    ("[email]", r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("[iban]", r"(?U)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"),
    ("[url]", r"(?iU)\bhttps?://\S*?/(?:users?|u|profile|people|~)[/\w.%-]*"),
    ("[phone]", r"(?U)(?<![\w/])(?:\+|00)\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?\d{1,4}(?:[\s.-]?\d{2,4}){2,4}\b|(?<![\w/])0\d{1,3}[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b"),
    (
        "[postcode]",
        r"(?U)(?<=\d,\s)[1-9]\d{3}\s?[A-Z]{2}\b|(?<=\d\s)[1-9]\d{3}\s?[A-Z]{2}\b(?=,?\s+[A-Z][a-z])"
        r"|(?i:(?<=postcode:\s)|(?<=postcode\s)|(?<=zip:\s)|(?<=zip\s))[1-9]\d{3}\s?[A-Z]{2}\b|\b[A-Z]{1,2}\d[A-Z\d]?\s\d[ABD-HJLNP-UW-Z]{2}\b",
    ),
)


def _quoted(x: str) -> str:
    """A literal for Java's regular expressions."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", x)


def _plain(x: str) -> str:
    return x.translate(str.maketrans("’‘“” ", "''\"\" "))


def _whole(alternatives) -> str:
    """Whole words or phrases, in any case; the longest that fits at a place is the one that counts there."""
    order = sorted(set(alternatives), key=lambda x: (-len(x), x))
    return rf"(?iU)(?<!\w)(?:{'|'.join(order)})(?!\w)"


def _spaced(phrase: str) -> str:
    return r"\s+".join(map(_quoted, _plain(phrase).split()))


#: for each form of a test what makes its values a pattern of Java's regular expressions
FORMS = {
    "chars": lambda signs: "|".join(_quoted(_plain(x)) for x in signs),
    "words": lambda words: _whole(_quoted(_plain(x)) for x in words),
    "phrases": lambda phrases: _whole(filter(None, map(_spaced, phrases))),
    "pattern": lambda pattern: f"(?iU){re.compile(pattern).pattern}",
}


def compiled(form: str, values) -> str:
    """The pattern of a test; a form that is not known is a KeyError, a pattern that does not compile a re.error."""
    return FORMS[form](values)


def lines(text: Column) -> Column:
    return F.split(T.normal_quotes(text), "\\R")


def hits(text: Column, pattern: str) -> Column:
    """Hits of a pattern, line by line, so that none spans a line break."""
    return F.aggregate(F.transform(lines(text), lambda x: F.regexp_count(x, F.lit(pattern))), F.lit(0).cast("long"), lambda a, n: a + n)


def hits_per_line(texts: DataFrame, pattern: str) -> DataFrame:
    """key, line (from 1), hits for lines with any."""
    rows = texts.select("key", F.posexplode(lines(F.col("text"))).alias("i", "x"))
    return rows.select("key", (F.col("i") + 1).cast("long").alias("line"), F.regexp_count("x", F.lit(pattern)).cast("long").alias("hits")).where("hits > 0")


def counted(texts: DataFrame, tests: dict[str, str]) -> DataFrame:
    """key, lang, type, n_words, id, hits: one column for each test in one scan, then unpivoted."""
    wide = texts.select("key", "lang", "type", T.n_words(F.col("text")).cast("long").alias("n_words"), *[hits(F.col("text"), p).alias(k) for k, p in tests.items()])
    return wide.unpivot(["key", "lang", "type", "n_words"], list(tests), "id", "hits")


def rates(texts: DataFrame, tests: dict[str, str], by: list[str]) -> DataFrame:
    """by, id, per_1k, texts with any, of: rates over a slot's texts together."""
    return counted(texts, tests).groupBy(*by, "id").agg(
        F.round(F.sum("hits") * 1000 / F.sum("n_words"), 2).alias("per_1k"), F.sum((F.col("hits") > 0).cast("long")).alias("texts"), F.count("*").alias("of")
    )


def allowances(texts: DataFrame, tests: dict[str, str], by: list[str]) -> DataFrame:
    """by, id, rate: nearest-rank 95th percentile of the texts' rates; the mean, at least .01, where that is 0 though used."""
    rows = checkpointed(counted(texts, tests).where("n_words > 0").withColumn("r", F.col("hits") * 1000 / F.col("n_words")))
    sums = rows.groupBy(*by, "id").agg(F.sum("hits").alias("h"), F.sum("n_words").alias("w"))
    got = sums.join(ranks.nearest_rank(rows, [*by, "id"], "r", PERCENTILE, "p"), [*by, "id"])
    p = F.when(F.col("h") == 0, 0.0).when(F.col("p") == 0, F.greatest(F.lit(0.01), F.col("h") * 1000 / F.col("w"))).otherwise(F.col("p"))
    return got.select(*by, "id", F.round(p, 2).alias("rate"))


def ruling_flags(drafts: DataFrame, tests: dict[str, str], rate: DataFrame, by: list[str]) -> DataFrame:
    """key, id, hits, flagged: any hit, or, where the writer uses it, two hits or more at over twice the writer's rate."""
    rows = counted(drafts, tests).where("hits > 0").join(rate, [*by, "id"], "left").fillna(0.0, ["per_1k"])
    own = F.col("hits") * 1000 / F.greatest("n_words", F.lit(1))
    flagged = (F.col("per_1k") <= 0) | ((F.col("hits") >= MIN_HITS) & (own > RATE_FACTOR * F.col("per_1k")))
    return rows.select("key", "id", "hits", flagged.alias("flagged"))


def sign_flags(drafts: DataFrame, tests: dict[str, str], rate: DataFrame, by: list[str], min_hits: int = 1) -> DataFrame:
    """key, id, hits, allowed, flagged: more hits than the writer's rate allows, at least one where they use it."""
    rows = counted(drafts, tests).where(F.col("hits") >= min_hits).join(rate, [*by, "id"], "left").fillna(0.0, ["rate"])
    allowed = F.when(F.col("rate") > 0, F.greatest(F.lit(1), F.ceil(F.col("rate") * F.col("n_words") / 1000))).otherwise(0)
    return rows.select("key", "id", "hits", allowed.cast("long").alias("allowed"), (F.col("hits") > allowed).alias("flagged"))


def _places(names: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """What is replaced, in order: the fixed patterns, then names, the longer ones first."""
    return [*REDACTIONS, *[(place, rf"(?U)(?<!\w){_quoted(name)}(?!\w)") for name, place in sorted(names, key=lambda n: (-len(n[0]), n))]]


def redaction(text: Column, names: list[tuple[str, str]] = ()) -> Column:
    """Struct of text (as `redacted` leaves it) and found, an array of (place, value): what was taken out, pattern by pattern.

    Each pattern sees what those before it left. What one step leaves is bound to a variable of the next, so every
    pattern is tried once.
    """

    def step(place: str, pattern: str):
        def run(state: Column) -> Column:
            values = F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0))
            taken = F.transform(values, lambda v: F.struct(F.lit(place).alias("place"), v.alias("value")))
            return F.struct(F.regexp_replace(state["text"], pattern, place).alias("text"), F.concat(state["found"], taken).alias("found"))

        return run

    state = F.struct(text.alias("text"), F.array().cast("array<struct<place:string,value:string>>").alias("found"))
    for place, pattern in _places(names):
        state = T.once(state, step(place, pattern))
    return state


def replacements(text: Column, names: list[tuple[str, str]] = ()) -> Column:
    """Array of (place, value): what `redacted` takes out."""
    return redaction(text, names)["found"]


def redacted(text: Column, names: list[tuple[str, str]] = ()) -> Column:
    """The text with addresses, numbers and names replaced; longer names first."""
    for place, pattern in _places(names):
        text = F.regexp_replace(text, pattern, place)
    return text


def without_placeholders(text: Column) -> Column:
    """Placeholders go; a paragraph that was nothing else becomes one word, so numbering stays."""
    parts = F.split(text, r"(?<=\n)\s*?(?=\n)")
    return F.array_join(
        F.transform(parts, lambda p: F.when(~p.rlike(T.PLACEHOLDER), p).otherwise(F.when(F.regexp_replace(F.regexp_replace(p, T.PLACEHOLDER, ""), r"[\s.,;:]", "") == "", "placeholder").otherwise(F.regexp_replace(F.regexp_replace(p, T.PLACEHOLDER, ""), "[ \t]{2,}", " ")))),
        "",
    )
