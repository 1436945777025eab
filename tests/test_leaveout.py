"""Leave-one-out references, moving slots, lessons and samples against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import decisions as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import leaveout, style

WORDS = "perhaps the old house; stood -- as they say: quite near a river, and everybody knew its 12 rooms don't".split()
BY = ["lang", "type"]


def texts(spark, n=40):
    r = random.Random(2)
    rows = []
    for k in range(n):
        paras = [" ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(3, 30))).capitalize() + "." for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4))]
        rows.append((k, "\n\n".join(paras), r.choice(["en", "de"]), r.choice("ab") if k else "alone"))
    return spark.createDataFrame([*rows, (90, None, "en", "a"), (91, "", "de", "b")], "key long, text string, lang string, type string").repartition(3)


def table(df):
    return sorted((tuple((v is None, v) for v in r) for r in df.collect()), key=str)


def test_a_text_is_held_against_its_slot_without_it(spark):
    df = texts(spark).cache()
    got = {(x["key"], x["metric"]): x["rest"] for x in leaveout.without_own(df, BY).collect()}
    for row in df.collect():
        others = df.where((F.col("key") != row["key"]) & (F.col("lang") == row["lang"]) & (F.col("type") == row["type"]))
        want = {x["metric"]: x["value"] for x in style.melted(style.slot_metrics(others, tuple(BY)), BY).collect()}
        assert {m: v for (k, m), v in got.items() if k == row["key"]} == want
        if row["key"] > 6:
            break
    counts = leaveout.counted(leaveout.flags(style.sums(df).withColumn("unit", F.lit(0)), df, BY), BY)
    sim = leaveout.simulated(counts, ["lang"], (1, 3)).collect()
    rows = [(x["lang"], x["flagged"]) for x in counts.collect()]
    for x in sim:
        mine = [n for lang, n in rows if lang == x["lang"]]
        assert (x["units"], x["fails"], x["any_flag"]) == (len(mine), round(sum(n >= x["k"] for n in mine) / len(mine), 6), round(sum(n > 0 for n in mine) / len(mine), 6))


def test_moved_slots_equal_those_built_anew(spark):
    df = texts(spark).cache()
    old, come, gone = df.where("key % 5 <> 0"), df.where("key % 5 = 0 and type <> 'alone'"), df.where("key % 4 = 1 and key % 5 <> 0")
    before, hist = leaveout.state(old, BY), leaveout.histogram(old, BY)
    got = leaveout.rederived(before, hist, gone, come, BY)
    now = old.join(gone.select("key"), "key", "left_anti").unionByName(come)
    touched = gone.select(*BY).union(come.select(*BY)).distinct()
    assert table(got) == table(leaveout.fingerprints(now, BY).join(touched, BY, "left_semi").select(got.columns)) and got.count() > 20
    # a slot that loses its last text is no more, and moving back restores the state
    last = df.where("type = 'alone'")
    state = leaveout.state(df, BY)
    less = leaveout.moved(state, last, df.limit(0), BY)
    assert less.where("type = 'alone'").isEmpty() and table(leaveout.moved(less, df.limit(0), last, BY).select(state.columns)) == table(state)


def test_lessons_are_rebuilt_from_the_stored_pairs(spark):
    pairs = "slot string, pair int, change int, kind string"
    stored = [("en", 1, 1, "cut-hedge"), ("en", 2, 1, "cut-hedge"), ("en", 2, 2, "split"), ("en", 2, 3, "other"), ("en", 3, 1, "no-hype"), ("de", 4, 1, "split")]
    lessons = spark.createDataFrame([("en", 7, "cut-hedge", "Cut hedges.", [1])], "slot string, id long, kind string, text string, pairs array<int>")
    described = spark.createDataFrame([("en", "split", "Split long sentences. "), ("en", "no-hype", "No hype!"), ("de", "split", "Kurz.")], "slot string, kind string, text string")
    rejected = spark.createDataFrame([("en", "  no HYPE")], "slot string, text string")

    def rebuilt(rows, had):
        got = D.rebuilt_lessons(spark.createDataFrame(rows, pairs), had, described, rejected)
        return got, {(x["slot"], x["kind"]): (x["id"], x["pairs"], x["seen_once"], x["op"]) for x in got.collect()}

    first, got = rebuilt(stored, lessons)
    assert got == {("en", "cut-hedge"): (7, [1, 2], False, "modify"), ("en", "split"): (8, [2], True, "add"), ("de", "split"): (1, [4], True, "add"), ("en", "no-hype"): (None, [3], True, "refused")}
    have = first.where("op <> 'refused'").drop("seen_once", "op")
    # the second pair is taken out again: what it brought goes, what it changed is as before
    _, got = rebuilt([r for r in stored if r[1] != 2], have)
    assert got[("en", "cut-hedge")] == (7, [1], True, "modify") and got[("en", "split")][3] == "drop" and got[("de", "split")][3] == "keep"
    faults = D.kind_faults(spark.createDataFrame([*stored, ("en", 5, 1, None), ("en", 5, 2, "Bad Kind"), ("de", 5, 3, "new")], pairs), lessons, described)
    assert {tuple(x) for x in faults.collect()} == {("en", None, "a change has no kind"), ("en", "Bad Kind", "not a slug"), ("de", "new", "not described")}


def test_seeded_samples(spark):
    names = spark.createDataFrame([(f"a{k}",) for k in range(50)], "author string")
    got = E.distractors(names, "author", 3).collect()
    by = {}
    for x in got:
        by.setdefault(x["author"], []).append(x["other"])
    assert len(by) == 50 and all(len(set(v)) == 3 and k not in v for k, v in by.items()) and len({o for v in by.values() for o in v}) == 50
    assert E.distractors(names.limit(2), "author", 3).count() == 2 and E.distractors(names.limit(0), "author", 3).isEmpty()
    asks = spark.createDataFrame([(k, f"a{k}" if k % 3 else None) for k in range(30)] + [(99, "stranger")], "key int, author string")
    rows = E.recognition(asks, names, 5).collect()
    assert sorted(x["ask"] for x in rows) == list(range(1, 32)) and [x["key"] for x in sorted(rows, key=lambda x: x["ask"])] != sorted(x["key"] for x in rows)
    for x in rows:
        author = None if x["key"] == 99 or x["key"] % 3 == 0 else f"a{x['key']}"
        assert x["truth"] == (author or "none") and len(x["candidates"]) == len(set(x["candidates"])) == 5 and x["candidates"] == sorted(x["candidates"]) and (author is None or author in x["candidates"])
    packets = spark.createDataFrame([(k, "real" if k % 2 else "synthetic") for k in range(40)], "key int, group string")
    twice = E.judged_twice(packets, "real", 5).collect()
    assert len(twice) == 10 and len({x["key"] for x in twice}) == 5 and all(x["key"] % 2 for x in twice)


def test_quantiles_that_end_in_a_five_are_those_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(1)
    rows = [(str(g), "m", round(r.uniform(0, 20), 6), 1) for g in range(400) for _ in range(r.choice([5, 7, 11, 21, 31]))]
    hist = spark.createDataFrame(rows, "lang string, metric string, value double, n long").groupBy("lang", "metric", "value").agg(F.sum("n").alias("n"))
    got = {x["lang"]: (x["q05"], x["q95"]) for x in leaveout.quantiles(hist, ["lang"], {"q05": 0.05, "q95": 0.95}).collect()}
    for g in got:
        want = duckdb.execute("SELECT round(quantile_cont(x, 0.05), 6), round(quantile_cont(x, 0.95), 6) FROM (SELECT unnest(?) AS x)", [[x[2] for x in rows if x[0] == g]]).fetchone()
        assert got[g] == want
