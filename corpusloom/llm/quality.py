"""Operator 6: quality rules by a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, runs of other signs) and pairs of neighbouring tokens are hashed
to a fixed number of buckets. One multinomial is
counted over the trusted documents, one over all documents; a document's score is the mean of
log(p_trusted / p_raw) over its n-grams, and it is kept if the score reaches a fixed threshold, the
base rules do not reject it and it shows no strong local evidence. Nothing is drawn by chance: the same
document always gets the same verdict for the same corpus.

A mean hides a few toxic words, so these decide by themselves. For the different tokens of a document and
their parts of `PART` bytes (which compounds share), log(p_toxic / p_trusted) comes from the numbers of
labelled documents that hold them; the evidence is the mean of the largest ones, one for each `PER` of the
document's different tokens and parts, `STRONGEST` at least, so that long documents do not gather it by
chance. A document whose evidence reaches a limit is rejected. The limit is calibrated on held-out labels:
the labelled rows are halved by a hash of doc_id, trusted rows of each half are judged by what the other half
says, and the limit leaves all but a share of `LOSS` of them (and is `LEAST_LIMIT` at least).

The trusted side comes from a sample of the labelled rows, bounded by `max_trusted`: those of good
quality and not toxic whose hashed doc_id is smallest. The toxic side covers every row labelled toxic,
the raw side every document.

Defined cases: a null text has no words and fails the base rules; an empty table has no rows; labels
that are missing, null or contradictory trust nothing and make nothing toxic, without toxic documents
there is no local evidence, and without trusted documents the base rules decide alone; repeated rows count as often as they occur; further columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

BUCKETS = 1 << 16
MAX_TRUSTED = 20_000
THRESHOLD = -0.25
#: pseudo-count of a bucket: where fewer n-grams than that are to be expected, a bucket says little
SMOOTH = 5.0
#: local evidence: bytes of a token's parts, least number of them that decide, how many share one, and their buckets
PART, STRONGEST, PER = 5, 5, 100
KINDS = 1 << 18
#: share of trusted rows that the limit may cost, and the least limit
LOSS, LEAST_LIMIT = 0.002, 1.0
#: labelled rows that are still broadcast; beyond it that join shuffles
MAX_BROADCAST = 200_000
SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\x00-\x20]+")


def tokens_of(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode())


def buckets(text: str | None, n: int = BUCKETS) -> np.ndarray:
    """Buckets of the tokens and of the pairs of neighbours."""
    return _buckets(tokens_of(text), n)


def _buckets(tokens: list[bytes], n: int) -> np.ndarray:
    one = np.fromiter(map(zlib.crc32, tokens), dtype=np.uint64, count=len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([(one * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40), two >> np.uint64(40)]) % np.uint64(n)).astype(np.int64)


def _kinds(tokens: list[bytes]) -> np.ndarray:
    """A bucket for each different token and each different part of one."""
    kinds = set(tokens)
    kinds |= {t[i : i + PART] for t in kinds for i in range(len(t) - PART + 1)}
    found = np.fromiter(map(zlib.crc32, kinds), dtype=np.uint64, count=len(kinds))
    return ((found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(KINDS)).astype(np.int64)


def local_evidence(toxic: np.ndarray, kinds: np.ndarray) -> float:
    """The mean of the strongest values of `toxic` among the document's kinds, more of them in a long document."""
    if not len(kinds):
        return 0.0
    k = min(len(kinds), max(STRONGEST, len(kinds) // PER))
    return float(np.partition(toxic[kinds], len(kinds) - k)[-k:].mean(dtype=np.float64))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    size = len(known) + 1
    pair = ids[:-1] * size + ids[1:]
    if size**3 >= 2**63:  # too many words for one number: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[list[bytes], tuple]:
    """The words and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    return words, (
        n,
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeat,
        n < 50 or 100 * repeat > 50 * n,
    )


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most `limit` ids of labelled rows that are good and not toxic, whatever their number."""
    good = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where((F.col("low") == 1) & (F.col("high") == 1) & (F.col("toxic") == 0))
    )
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """All ids whose labels say toxic and nothing else."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    return said.where((F.col("low") == 1) & (F.col("high") == 1)).select("doc_id")


class Fitted(NamedTuple):
    """log(p_trusted / p_raw) by bucket, log(p_toxic / p_trusted) by kind, and the limit of the evidence."""

    ratio: np.ndarray
    toxic: np.ndarray
    limit: float


def _against(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log(p_toxic / p_trusted) by kind; the last place of either side is its number of documents."""
    if not toxic[-1] or not clean[-1]:
        return np.zeros(KINDS, dtype=np.float32)
    return np.log((toxic[:-1] + 1) / (clean[:-1] * (toxic[-1] / clean[-1]) + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> Fitted | None:
    """What `judge` needs, or None if no document is trusted. Ratios are shrunk towards 0 where they are rare; the
    evidence is 0 everywhere if no document is toxic.

    The driver gets one row for each bucket and kind, so its share does not grow with the corpus.
    """
    sides = trusted_ids(labels, max_trusted).withColumn("side", F.lit(0)).unionByName(toxic_ids(labels).withColumn("side", F.lit(2)))
    # 0 and 1 are the halves of the trusted rows, 2 and 3 those of the toxic ones
    sides = checkpointed(sides.withColumn("side", F.col("side") + F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")))
    if sides.count() <= MAX_BROADCAST:
        sides = F.broadcast(sides)
    rows = docs.select("doc_id", "text").join(sides, "doc_id", "left").select("text", F.coalesce("side", F.lit(-1)).alias("side"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((4, n_buckets), dtype=np.int64)
        kinds = np.zeros((4, KINDS + 1), dtype=np.int64)  # the last place counts documents
        for b in batches:
            for text, side in zip(b["text"], b["side"], strict=True):
                tokens = tokens_of(text)
                found = np.bincount(_buckets(tokens, n_buckets))
                grams[1, : len(found)] += found
                if 0 <= side < 2:
                    grams[0, : len(found)] += found
                if side >= 0:
                    kinds[side, np.unique(_kinds(tokens))] += 1
                    kinds[side, KINDS] += 1
        for what, table in enumerate((grams, kinds)):
            at = np.flatnonzero(table.any(axis=0))
            yield pd.DataFrame({"what": what, "at": at, **{f"n{k}": table[k, at] for k in range(4)}})

    names = [f"n{k}" for k in range(4)]
    sums = rows.mapInPandas(count, "what int, at long, n0 long, n1 long, n2 long, n3 long").groupBy("what", "at").agg(*[F.sum(c).alias(c) for c in names])
    got = sums.toPandas()
    grams, kinds = np.zeros((4, n_buckets)), np.zeros((4, KINDS + 1))
    for what, table in enumerate((grams, kinds)):
        part = got[got["what"] == what]
        table[:, part["at"]] = part[names].to_numpy().T
    good, raw = grams[:2]
    if not good.sum():
        return None
    ratio = np.log((good + SMOOTH) / (raw * (good.sum() / raw.sum()) + SMOOTH)).astype(np.float32)
    return Fitted(ratio, _against(kinds[0] + kinds[1], kinds[2] + kinds[3]), _limit(rows.where("side in (0, 1)"), kinds))


def _limit(trusted: DataFrame, kinds: np.ndarray) -> float:
    """The evidence that all but a share of LOSS of the trusted rows stay under, each half judged by the other."""
    if not kinds[2:, -1].sum():
        return float("inf")
    other = trusted.sparkSession.sparkContext.broadcast([_against(kinds[1], kinds[3]), _against(kinds[0], kinds[2])])

    @F.pandas_udf("double")
    def evidence(texts: pd.Series, sides: pd.Series) -> pd.Series:
        return pd.Series([local_evidence(other.value[side], _kinds(tokens_of(t))) for t, side in zip(texts, sides, strict=True)], dtype="float64")

    most = trusted.select(evidence("text", "side").alias("e")).agg(F.percentile("e", F.lit(1 - LOSS)).alias("q")).first()["q"]
    return max(LEAST_LIMIT, most or 0.0)


def judge(docs: DataFrame, fitted: Fitted | None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` as struct `row`, and struct `found` with the columns of RESULT."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf(RESULT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        fitted, out = shared.value, []
        for text in texts:
            words, base = base_counts(text)
            score, toxic = 0.0, False
            if fitted is not None and (tokens := tokens_of(text)):
                score = float(fitted.ratio[_buckets(tokens, len(fitted.ratio))].mean(dtype=np.float64))
                if not base[-1] and score >= threshold:
                    toxic = local_evidence(fitted.toxic, _kinds(tokens)) >= fitted.limit
            out.append((*base, score, not base[-1] and score >= threshold and not toxic))
        return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return packed(docs).withColumn("found", verdict("row.text"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the columns of RESULT for every document."""
    return judge(docs.select("doc_id", "text"), fit(docs, labels), threshold).select("row.doc_id", "found.*")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are."""
    return unpacked(judge(docs, fit(docs, labels), threshold).where("found.kept"))
