"""Resampling against a plain count of every feature, with chunks of any size."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import resample

SIGNS = "ab Z9é漢_-.\n\t🙂"


def features(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, percent, least):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, n)[1])

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        words, f = features(x, n)
        weight = sum(gain[zlib.crc32(i.encode()) % buckets] for i in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    take = len(able) * percent // 100
    out = [(d, f, w, z, i + 1 if i < take else None) for i, (d, _, f, w, z) in enumerate(able)]
    return out + [(d, f, w, z, None) for d, n_words, f, w, z in rows if n_words < least]


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    some = [(i, "".join(r.choice(SIGNS) for _ in range(r.choice([0, 5, 60, 400])))) for i in range(60)]
    return [*some, (None, "a b " * 30), (7, None), (3, some[3][1]), (61, "x" * 3000), (62, "  \n " * 900 + "end"), (63, "one Two ÉÀ " * 700), (63, "one Two ÉÀ " * 700)]


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 15), (1, 37), (3, 1 << 15), (3, 37), (2, 5)])
def test_against_a_plain_count(spark, docs, n, size):
    target = ["a b Zé", "one two", None, "", "9 9 9"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"k": F.lit(1), "tag": F.lit("x"), "copies": F.lit(0), "rank": F.lit(2)})
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resampled(df, other, percent=40, n=n, buckets=500, size=size).collect()
    want = plain(docs, target, n, 500, 40, 20)
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r["rank"] is not None for r in got) > 5


def test_chunks_own_each_word_once(spark):
    text = " ab,cd  ef gh\n" * 50 + "ij"
    got = spark.createDataFrame([(text,)], "text string").select(F.explode(resample.chunks(F.col("text"), 3, 16)).alias("x")).select("x.*").collect()
    assert "".join(r["own"] for r in got) == text and len(got) > 30
    words = re.findall("[a-z]+", text)
    at = 0
    for r in got:
        own, carry = re.findall("[a-z]+", r["own"]), re.findall("[a-z]+", r["carry"])
        assert own == words[at : at + len(own)] and carry == words[at + len(own) : at + len(own) + 2]
        at += len(own)


def test_target_like_documents_are_drawn_more_often(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(("good", "fine", "well") if i % 10 == 0 else ("bad", "poor", "ill")) for _ in range(30))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drawn_id", F.lit(1))
    got = resample.drawn(df, spark.createDataFrame([("good fine well " * 20,)], "text string"))
    ids = [x["doc_id"] for x in got.collect()]
    assert got.columns == df.columns and len(set(ids)) == len(ids) == 50 and sum(i % 10 == 0 for i in ids) >= 40


def test_empty_tables(spark, docs):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert resample.resampled(none, some).isEmpty()
    assert resample.resampled(some, none).count() == len(docs)
