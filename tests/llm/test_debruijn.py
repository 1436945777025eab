"""Substring dedup against the definition, word by word."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import debruijn, repeats

WORDS = "the of and to in is that was for with as his on be at by had not are but from or have an they which one you were all her she there would their".split()


def plain(docs, window=35):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(((d is None, d or 0), n, m, s) for d, n, m, s in rows)


def corpus(seed, words=WORDS):
    """Texts that share parts of any length with parts of others, with changes, and junk with short periods."""
    r = random.Random(seed)
    texts = []
    for i in range(60):
        out = []
        for _ in range(r.randint(1, 5)):
            if texts and r.random() < 0.6:
                other = r.choice(texts).split()
                at = r.randrange(len(other) + 1)
                part = other[at : at + r.choice([10, 33, 34, 35, 36, 60, 150])]
                if part and r.random() < 0.3:
                    part[r.randrange(len(part))] = "changed"
                out += part
            elif r.random() < 0.1:
                out += r.sample(words, r.randint(1, 3)) * r.randint(5, 40)
            else:
                out += [r.choice(words) for _ in range(r.randint(5, 120))]
        texts.append(r.choice([" ", "\n", " \t "]).join(out))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_against_the_definition(spark, seed):
    docs = corpus(seed, WORDS if seed % 2 else WORDS[:3])
    docs += [docs[5], (None, docs[6][1]), (None, "a b"), (90, None), (91, ""), (92, "x " * 3000), (93, "x y " * 40), (94, "x" * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "tag", "places", "anchor", "at")}).repartition(3)
    got = debruijn.substring_dedup(df).collect()
    want = plain(docs)
    assert key(r[:4] for r in got) == key(want) and 0 < sum(w[2] for w in want) < sum(w[1] for w in want)
    left = debruijn.without_repeats(df)
    assert left.columns == df.columns
    joined = [(r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in left.collect()]
    assert sorted(((d is None, d or 0), s) for d, s in joined) == sorted(((d is None, d or 0), s) for d, _, _, s in want)


def test_other_windows(spark):
    docs = corpus(7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (16, 120):
        assert key(r[:4] for r in debruijn.substring_dedup(df, window).collect()) == key(plain(docs, window))
    with pytest.raises(ValueError):
        debruijn.substring_dedup(df, 15)


def test_copies_are_one_passage(spark):
    r = random.Random(1)
    text = [" ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(400)) for _ in range(3)]
    docs = [(i, f"{text[0]} {'own' + str(i)} {text[1]}") for i in range(5)] + [(9, text[2])]
    got = {r["doc_id"]: r for r in debruijn.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all((got[i]["n_words"], got[i]["n_removed"], got[i]["n_passages"]) == (801, 800, 2) for i in range(5)) and got[9]["n_removed"] == got[9]["n_passages"] == 0


def test_paths_end_at_branches_and_circles_stay(spark):
    rows = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 13, 14), (5, 13, 15), (6, 15, 16), (7, 20, 21), (8, 21, 20), (9, 30, 30)]
    df = spark.createDataFrame(rows, "id long, u long, v long")
    assert sorted(tuple(r) for r in debruijn.compacted(df).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9)]
    chain = spark.createDataFrame([(i, i, i + 1) for i in range(700)], "id long, u long, v long").repartition(4)
    assert {r["path"] for r in debruijn.compacted(chain).collect()} == {0}


def test_long_texts_in_parts(spark, monkeypatch):
    docs = [(1, "alpha " * 500_000 + "end"), (2, "beta gamma")]
    got = {r[0]: r[1:4] for r in debruijn.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {r[0]: tuple(r[1:]) for r in plain(docs)}


def test_empty_table(spark):
    assert debruijn.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_the_filter_is_bounded_on_the_driver(spark, monkeypatch):
    assert repeats.MOST_BITS // 8 <= 16 << 20
    monkeypatch.setattr(repeats, "MOST_BITS", 1 << 20)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)  # a Python object for each word of the filter
    filled = repeats._bitmap(spark.range(200_000).select(F.xxhash64("id").alias("anchor")))
    anchors = [r[0] for r in spark.range(500).select(F.xxhash64("id")).collect()]
    assert len(filled) == 1 << 14 and all(filled[(a & 0xFFFFF) >> 6] >> (a & 63) & 1 for a in anchors)


def test_covered_words_against_the_definition():
    r = np.random.default_rng(3)
    for n, window in ((35, 35), (200, 35), (90, 50), (40_000, 16)):
        at = np.sort(r.integers(0, n - window + 1, 1 + n // 3))
        mask = np.array([int(r.integers(0, 1 << 62)) & (1 << min(62, n - window + 1 - a)) - 1 for a in at.tolist()], dtype=np.int64)
        want = np.zeros(n, dtype=bool)
        for a, m in zip(at.tolist(), mask.tolist(), strict=True):
            for i in range(m.bit_length()):
                if m >> i & 1:
                    want[a + i : a + i + window] = True
        assert (repeats.covered(n, at.astype(np.int32), mask, window) == want).all()
