"""The twenty-eight measures of the metric trial, one row a text: all but one are Column expressions over one cleaned text.

The share of distinct words over moving windows slides over the words once, so a text costs its length, whatever the
window: a word that leaves and a word that comes in change one count each.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import packs
from ..functions import text as T

#: Words and sentence ends of the trial, words that connect formally, persons, and forms of to be.
WORD = "[A-Za-z][A-Za-z'-]*"
SENTENCE_END = r"""(?<=[.!?])["')\]]*\s+(?=["'(\[]?[A-Z0-9])"""
FORMAL = ("moreover", "furthermore", "additionally", "consequently", "nevertheless", "nonetheless", "therefore", "thus", "hence", "however", "in addition", "it is worth noting")
HEDGES = (
    "perhaps", "maybe", "might", "arguably", "somewhat", "possibly", "probably", "seem", "seems", "seemingly", "i suspect", "in some sense", "it may be",
    "likely", "rather", "fairly", "quite",
)
PERSONS = {"first_singular": ("i", "me", "my", "mine", "myself"), "first_plural": ("we", "us", "our", "ours", "ourselves"), "second_person": ("you", "your", "yours", "yourself")}
BE = ("is", "are", "was", "were", "be", "been", "being")
#: Signs that are counted for a thousand words, and patterns in lower-cased text.
SIGNS = {
    "semicolons": ";", "colons": ":(?!//)", "dashes": "—|--| – ", "parentheses": r"\(", "questions": r"\?", "exclamations": "!", "ellipses": r"\.\.\.|…", "quotes": '["“]', "digits": r"(?U)\b\d+\b",
}
PATTERNS = {"contractions": r"\b\w+'(?:s|re|ve|ll|d|t|m)\b", "ly_adverbs": r"\b\w{3,}ly\b", "passive": rf"\b(?:{'|'.join(BE)})\s+\w+ed\b"}
WINDOW, STEP = 100, 10


def moving_ttr(words: list[str], window: int = WINDOW, step: int = STEP) -> float:
    """The mean share of distinct words over windows that begin every `step` words; of all words, where they are fewer than a window."""
    n = len(words)
    if n < window:
        return len(set(words)) / max(1, n)
    counts = Counter(words[:window])
    total, steps = len(counts) / window, 1  # shares are summed, as a mean of them is told from a quotient of sums in its last digit
    for k in range(n - window):
        gone, came = words[k], words[k + window]
        counts[came] += 1
        counts[gone] -= 1
        if not counts[gone]:
            del counts[gone]
        if (k + 1) % step == 0:
            total, steps = total + len(counts) / window, steps + 1
    return total / steps


@F.pandas_udf(DoubleType())
def _moving(words: pd.Series) -> pd.Series:
    return pd.Series([moving_ttr(list(w)) for w in words], dtype="float64")


def _cleaned(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<!--.*?-->", "")
    return T.strip(T.straight(F.regexp_replace(t, r"(?s)\A---.*?---", "")))


def metrics(texts: DataFrame) -> DataFrame:
    """key and the 28 measures of every text; an empty text has zeros."""
    t, low = F.col("t"), F.lower("t")
    every = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    sentences = F.filter(F.split(T.squeeze(t), SENTENCE_END), lambda s: s.rlike(r"\S"))
    rows = texts.select("key", _cleaned(F.col("text")).alias("t")).select("key", "t", every.alias("ws"), sentences.alias("ss"))
    # sentence lengths, first words and lower-cased words are found once
    rows = rows.select(
        "key", "t", "ws", F.size("ss").cast("double").alias("n_s"), F.size(F.filter(F.split(t, "\n\n"), lambda p: p.rlike(r"\S"))).alias("n_p"),
        F.when(F.size("ss") > 0, F.transform("ss", lambda s: F.regexp_count(s, F.lit(WORD)).cast("double"))).otherwise(F.array(F.lit(0.0))).alias("sl"),
        F.transform("ss", lambda s: F.lower(F.regexp_extract(s, WORD, 0))).alias("firsts"), F.transform("ws", lambda w: F.lower(w)).alias("lw"),
    )
    add = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))
    nw, sl = F.greatest(F.size("ws"), F.lit(1)).cast("double"), F.col("sl")
    n_sl, some = F.size("sl"), F.greatest(F.col("n_s"), F.lit(1.0))
    mean = add("sl", lambda x: x) / n_sl
    share = lambda c, test, n: F.size(F.filter(c, test)) / n
    phrases = {**PERSONS, "hedges": HEDGES, "formal_connectives": FORMAL}
    per = {f"{k}_per_1k": F.regexp_count(t, F.lit(p)) * 1000 / nw for k, p in SIGNS.items()}
    per["quotes_per_1k"] = per["quotes_per_1k"] / 2
    per |= {f"{k}_per_1k": F.regexp_count(low, F.lit(rf"(?U)\b(?:{packs.alternatives(v)})\b")) * 1000 / nw for k, v in phrases.items()}
    per |= {f"{k}_per_1k": F.regexp_count(low, F.lit(f"(?U){p}")) * 1000 / nw for k, p in PATTERNS.items()}
    out = {
        "sentence_length_mean": mean, "sentence_length_sd": F.sqrt(F.greatest(add("sl", lambda x: x * x) / n_sl - mean * mean, F.lit(0.0))),
        "short_sentence_share": share(sl, lambda x: x < 8, n_sl), "long_sentence_share": share(sl, lambda x: x > 28, n_sl),
        "sentences_per_paragraph": F.col("n_s") / F.greatest(F.col("n_p"), F.lit(1)), "words_per_paragraph": nw / F.greatest(F.col("n_p"), F.lit(1)),
        "commas_per_sentence": F.regexp_count(t, F.lit(",")) / some, **per,
        "conjunction_opener_share": share(F.col("firsts"), lambda w: w.isin(*packs.OPENERS["en"]), some), "type_token_mattr": _moving("lw"),
        "word_length_mean": F.when(F.size("ws") > 0, add("ws", lambda w: F.length(w)) / nw).otherwise(0.0), "long_word_share": share(F.col("ws"), lambda w: F.length(w) >= 7, nw),
    }
    return rows.select("key", *[F.round(v, 6).alias(k) for k, v in out.items()])
