"""Pieces of texts, traces of other languages and stores against hand-made cases and plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import flavour, pieces
from corpusloom.sources import stores


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


def test_masks_keep_line_numbers(spark):
    text = 'One.\n| a | b |\n> quoted\nHe said "one two three four" and "no".\n## References\nBook'
    assert value(spark, text, pieces.prose_mask) == 'One.\n\n\nHe said                      and "no".\n\n'
    assert value(spark, "---\ntitle: x\n---\nBody\n---", pieces.without_front_matter) == "\n\n\nBody\n---"
    assert value(spark, "Body\n---\nx\n---", pieces.without_front_matter) == "Body\n---\nx\n---" and value(spark, None, pieces.without_front_matter) == ""


def test_exclusions_of_a_brief(spark):
    brief = "# Brief\nUse wit.\n**Do not use:** jargon\n- Avoid: lists\n## Claims we won't make\nIt cures all.\n\nIt is free.\n## Style\nBe brief."
    assert value(spark, brief, pieces.exclusions) == ["**Do not use:** jargon", "- Avoid: lists", "It cures all.", "It is free."]
    assert value(spark, None, pieces.exclusions) == []


def test_sentence_at_a_match(spark):
    long = " ".join(f"w{i}" for i in range(40)) + " HERE " + " ".join(f"v{i}" for i in range(40)) + "."
    got = value(spark, "First one. " + "X" + long + " Last one.", lambda c: pieces.sentence_at(c, "HERE"))
    assert "HERE" in got and len(got.split()) == 25 and value(spark, "No. Yes here. No.", lambda c: pieces.sentence_at(c, "here")) == "Yes here."


def words(p):
    return len(re.findall(T.WORD.replace(r"\p{L}\p{No}\p{Nl}", "A-Za-z"), p))


@pytest.mark.parametrize("seed", range(3))
def test_passages_and_chunks_against_a_loop(spark, seed):
    r = random.Random(seed)
    paras = [r.choice(["A short heading", "", " ".join(r.choice(["dog", "cat's", "ox"]) for _ in range(r.randint(1, 60))) + "."]) for _ in range(30)]
    text, lo, hi, size = "\n\n".join(paras), 20, 50, 60
    out, cur = [], []
    for p in paras:
        if p == "" or p == "A short heading" or words(p) > hi:
            cur = []
            continue
        if cur and sum(map(words, cur)) + words(p) > hi:
            cur = []
        cur.append(p)
        if sum(map(words, cur)) >= lo:
            out.append("\n\n".join(cur))
            cur = []
    assert value(spark, text, lambda c: pieces.passages(c, lo, hi)) == out
    out, cur = [], []
    for p in paras:
        cur.append(p)
        if sum(len(x.split()) for x in cur) >= size:
            out.append("\n\n".join(cur))
            cur = []
    if cur and sum(len(x.split()) for x in cur) >= 0.6 * size:
        out.append("\n\n".join(cur))
    assert value(spark, text, lambda c: pieces.chunks(c, size)) == out


def test_rates_in_words(spark):
    said = [(0.0, "never"), (2.0, "about once every 500 words"), (0.31, "about once every 3,200 words"), (7.3, "about once every 140 words")]
    rows = spark.createDataFrame(said, "r double, said string")
    assert rows.where(pieces.described_rate(F.col("r")) != F.col("said")).isEmpty()


def test_detectors_find_their_own_faults(spark):
    good = {"id": "a-b", "lang": "en", "name": "n", "origins": ["de"], "pattern": r"\bhandy\b", "examples": ["my Handy"], "counters": ["handyman"]}
    schema = "id string, name string, origins array<string>, pattern string, examples array<string>, counters array<string>"

    def found(rows):
        return {(x["id"], x["rule"], x["value"]) for x in flavour.findings(spark.createDataFrame([{"name": None, "examples": None, "counters": None} | r for r in rows], schema)).collect()}

    assert found([good]) == set()
    bad = [good, good | {"counters": ["handy"]}, {"id": "X", "pattern": "(", "origins": ["german"]}, good | {"id": "c", "examples": ["none"]}, good | {"id": None, "examples": []}]
    assert found(bad) == {
        ("a-b", "key of several rows", "2"), ("a-b", "counter-example matched", "handy"), ("c", "example not matched", "none"), ("X", "no value", "name"), ("X", "no value", "examples"),
        ("X", "pattern does not compile", "("), ("X", "not a language code", "german"), ("X", "not a key", "X"), (None, "not a key", None), (None, "no value", "examples"),
    }
    rows = spark.createDataFrame([(1, "en", "My handy. HANDY\n\nmy"), (2, "de", "handy"), (3, "en", None)], "key int, lang string, text string")
    two = good | {"id": "two", "pattern": r"handy\s+my"}
    assert [tuple(x)[:3] + (x["found"],) for x in flavour.scan(rows, [good, two]).collect()] == [(1, "a-b", 2, ["handy", "HANDY"])]


def test_draft_with_more_traces_than_the_writer(spark):
    d = [{"id": "a", "lang": "en", "pattern": r"\bhandy\b"}]
    own = spark.createDataFrame([(1, "en", "word " * 499 + "handy"), (2, "en", "word " * 500)], "key int, lang string, text string")
    drafts = spark.createDataFrame([(1, "en", "handy " * 3 + "word " * 400), (2, "en", "handy " + "word " * 10)], "key int, lang string, text string")
    got = {x["key"]: (x["hits"], x["allowed"], x["flagged"]) for x in flavour.checked(drafts, d, flavour.rates(own, d, ["lang"]), ["lang"]).collect()}
    assert got == {1: (3, 1, True), 2: (1, 1, False)}
    assert all(x["allowed"] == 0 for x in flavour.checked(drafts, d, flavour.rates(own, d, ["lang"]), ["lang"], off=True).collect())


def test_stores_are_read_as_declared_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.write_store(spark.createDataFrame([(1, "a")], "id int, name string"), path, 2)
    assert stores.read_store(spark, path, "id int, name string", 2).collect()[0]["name"] == "a"
    with pytest.raises(Exception, match="expected version 3"):
        stores.read_store(spark, path, "id int, name string", 3).collect()
    with pytest.raises(Exception):
        stores.read_store(spark, path, "id int, name int", 2).collect()
    profile = spark.createDataFrame([("rule", "r", False, None), ("vocabulary", "v", True, None), ("example", "e", None, True)], "kind string, text string, private boolean, reviewed boolean")
    assert sorted(x["text"] for x in stores.exported(profile).collect()) == ["e", "r"]
    with pytest.raises(Exception, match="not reviewed"):
        stores.exported(profile.withColumn("reviewed", F.lit(False))).collect()
