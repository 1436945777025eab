"""Operator 13: target-distribution importance resampling, with overlap chunking for skewed long texts.

Features are all runs of 1 to `n` consecutive words, hashed into `buckets`. Counts over all documents and
over all target texts give each bucket a gain, a document's weight is the floored mean of its features'
gains, and weight plus Gumbel noise, drawn from the document's id alone, is its score: taking the highest
scores draws without replacement in proportion to the exponential of the weights.

Texts longer than `CHUNK` code points are split at word boundaries, and their chunks are dealt to tasks of
their own, so no task works long on one text. A chunk owns the features that start in it; it carries the
n-1 words that follow it, so a run that crosses the boundary is seen once and whole. Counts and gains of
the chunks are summed by document. All other texts are weighed where they lie, without a shuffle. Gains are
whole numbers and sums of them exact, so chunks change nothing.

What the driver holds is the table of gains, which has `buckets` rows at any size of the corpus. Ranks come
from range partitions numbered by themselves.

Defined cases: a null or empty text has no features and weight 0; a document without `min_words` words is
never drawn; a null doc_id takes part as the empty string and comes last among ties; rows that agree in
doc_id and text are weighed each for itself and draw the same noise; no documents give no rows; an empty
target gives every bucket a gain all the same, by the added one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked

BUCKETS = 10_000
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
#: code points of a chunk, before its last word is completed
CHUNK = 1 << 15
#: a word's signs, before A-Z are lower-cased, and all others
SIGN, GAP = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """The words of a text; A-Z are lower-cased word by word, as few words have a sign beyond ASCII."""

    def lowered(w: Column) -> Column:
        return F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))

    return F.transform(F.regexp_extract_all(text, F.lit(f"{SIGN}++"), F.lit(0)), lowered)


def chunks(text: Column, n: int = 1, size: int = CHUNK) -> Column:
    """Array of (own, carry): the text in parts that end where a word ends, each with the n-1 words that follow it."""
    part = rf"(?s)(.{{1,{size}}}+{SIGN}*+)" + rf"(?=((?:{GAP}*+{SIGN}++){{0,{n - 1}}}+))"
    own, carry = (F.regexp_extract_all(text, F.lit(part), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(own.alias("own"), (carry if n > 1 else F.transform(own, lambda _: F.lit(""))).alias("carry"))


def _buckets(own: Column, carry: Column, n: int, buckets: int) -> Column:
    """The bucket of every feature that starts in `own`."""

    def bucket(w: Column) -> Column:
        return (F.crc32(w) % buckets).cast("int")

    if n == 1:
        return F.transform(_words(own), bucket)

    def runs(both: Column, k: int) -> Column:
        starts = F.least(F.size(both["own"]), F.size(both["all"]) - k + 1)
        at = F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: bucket(F.array_join(F.slice(both["all"], i, k), " ")))

    words = F.transform(F.array(F.struct(_words(own).alias("own"), _words(carry).alias("carry"))), lambda x: F.struct(x["own"].alias("own"), F.concat(x["own"], x["carry"]).alias("all")))
    return F.flatten(F.transform(words, lambda x: F.concat(*[runs(x, k) for k in range(1, n + 1)])))


def _parts(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is one part, and those whose text is split."""
    long = F.length("text") > size
    return rows.where(~long), rows.where(long)


def _dealt(long: DataFrame, n: int, size: int, keys: list[str]) -> DataFrame:
    """keys, own and carry of every chunk, dealt to tasks by chunk."""
    cut = long.select(*keys, F.posexplode(chunks(F.col("text"), n, size)).alias("k", "x")).select(*keys, "k", "x.own", "x.carry")
    return cut.repartition(F.xxhash64("own"), F.col("k"))


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without one are left out."""
    short, long = _parts(texts.select("text"), size)
    cut = _dealt(long, n, size, []).select(_buckets(F.col("own"), F.col("carry"), n, buckets).alias("b"))
    return short.select(_buckets(F.col("text"), F.lit(""), n, buckets).alias("b")).union(cut).select(F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(bucket, gain) for every bucket."""
    both = bucket_counts(docs, n, buckets, size).withColumn("t", F.lit(0)).union(bucket_counts(target, n, buckets, size).withColumn("t", F.lit(1)))
    both = checkpointed(both.groupBy("bucket").agg(*[F.sum(F.when(F.col("t") == i, F.col("n")).otherwise(0)).alias(c) for i, c in ((0, "s"), (1, "t"))]))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    ratio = ((F.col("t") + 1.0) * (total[0] + buckets)) / ((F.col("s") + 1.0) * (total[1] + buckets))
    return every.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, table: DataFrame, n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, gain (summed over the features) of every row of `docs`."""
    rows = sorted(table.collect())  # as many as there are buckets
    values = F.split(F.lit(",".join(str(r["gain"]) for r in rows)), ",").cast("array<bigint>")  # a constant of the plan

    def sums(own: Column, carry: Column) -> list[Column]:
        b = _buckets(own, carry, n, buckets)
        n_words = F.lit(0).cast("long") if n == 1 else F.size(_words(own)).cast("long")
        pair = F.transform(F.array(b), lambda b: F.struct(F.size(b).cast("long").alias("n"), F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.get(values, x)).alias("g")))[0]
        return [n_words.alias("n_words"), pair.alias("p")]

    text = F.coalesce("text", F.lit(""))
    short, long = _parts(docs.select("doc_id", text.alias("text")), size)
    one = short.select("doc_id", *sums(F.col("text"), F.lit("")))
    # rows that agree are chunked together and divided again by their number
    cut = _dealt(long.withColumns({"tag": F.xxhash64("text"), "points": F.length("text")}), n, size, ["doc_id", "tag", "points"])
    whole = cut.select("doc_id", "tag", "points", "k", *sums(F.col("own"), F.col("carry"))).groupBy("doc_id", "tag", "points")
    whole = whole.agg(F.sum("n_words").alias("n_words"), F.sum("p.n").alias("n"), F.sum("p.g").alias("g"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("copies"))
    each = [F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n", "g")]
    many = whole.select("doc_id", *each, F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    both = one.select("doc_id", "n_words", F.col("p.n").alias("n"), F.col("p.g").alias("g")).union(many.select("doc_id", "n_words", "n", "g"))
    return both.select("doc_id", (F.col("n") if n == 1 else F.col("n_words")).alias("n_words"), F.col("n").alias("n_features"), F.col("g").alias("gain"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every document; rank is null for documents that are not drawn."""
    found = weighed(docs, gains(docs, target, n, buckets, size), n, buckets, size)
    weight = F.expr("(gain - pmod(gain, greatest(n_features, 1))) div greatest(n_features, 1)")  # pmod is never negative: floored
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    scored = checkpointed(found.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score")))
    able = F.col("n_words") >= min_words
    take = scored.where(able).count() * percent // 100
    order = scored.where(able).withColumns({"minus": -F.col("score"), "no_id": F.col("doc_id").isNull()})
    rank = F.when(F.col("rank") < take, F.col("rank") + 1)
    got = ranked(order, "minus", "no_id", "doc_id").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
    return got.union(scored.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are drawn, by doc_id, with all their columns; doc_ids should be unique."""
    ids = resampled(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["drawn_id"]), "left_semi")
