"""The ledger's operators on hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import ledger as L
from corpusloom.operators import ranks

M = "key string, path string, folder string, lang string, type string, words int, status string, ownership string, holdout boolean, cached boolean, year int"


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [("a", "w/a.md", "w", "en", "t", 200, "active", "own", False, True, 2020), ("b", "w/b.md", "w", "en", "t", 200, "forgotten", "own", False, True, 2020),
            ("c", "w/c.md", "w", "en", "t", 200, "active", "own", True, True, 2020), ("d", "w/d.md", "w", "en", "t", 200, "superseded", "own", False, True, 2020),
            ("e", "w/e.md", "w", "en", "t", 200, "active", "other", False, True, 2020), ("g", "gone.md", "", "en", "t", 200, "active", "own", False, False, 2020)]
    return spark.createDataFrame(rows, M)


def test_inventory_tells_all_results(spark, manifest):
    text = lambda k: " ".join(k + chr(97 + i // 26) + chr(97 + i % 26) for i in range(160))
    files = [("a", "w/a.md", 200, "en"), ("b", "w/b.md", 200, "en"), ("c", "w/c.md", 200, "en"), ("d", "w/d.md", 200, "en"), ("e", "moved/e.md", 200, "en"), ("x", "W/A.md", 200, "en"), ("n1", "n/1.md", 160, "en"),
             ("n2", "n/2.md", 161, "en"), ("n3", "n/3.md", 160, "en"), ("s", "n/s.md", 20, "en"), ("j", "n/j.md", 500, "ja")]
    found = spark.createDataFrame([(k, p, w, lang, "t", 2021 if k == "n2" else 2020) for k, p, w, lang in files], "key string, path string, words int, lang string, type string, year int")
    same = text("q")
    texts = spark.createDataFrame([(k, {"n1": same, "n2": same + " more", "n3": text("z")}.get(k, text(k))) for k, *_ in files], "key string, text string")
    got = {r["key"]: r["result"] for r in L.inventory(found, manifest, texts).collect()}
    assert got == {"a": "unchanged", "b": "forgotten", "c": "holdout", "d": "reverted", "e": "renamed", "x": "changed", "n1": "skipped: near-duplicate", "n2": "new", "n3": "new", "s": "skipped: too short", "j": "skipped: language not supported"}
    assert [tuple(r) for r in L.unreachable(manifest, found).collect()] == [("g", "gone.md")]
    staged = {r["key"]: r["change"] for r in L.staged(spark.createDataFrame(list(got.items()), "key string, result string"), spark.createDataFrame([("n3", "question")], "key string, decision string")).collect()}
    assert staged["n3"] == "ask" and staged["n2"] == "create" and staged["e"] == "repath" and staged["x"] == "supersede" and staged["a"] == "nothing"


def test_deepest_rule_decides_and_equal_ones_ask(spark):
    files = spark.createDataFrame([("1", "a/b/c.md"), ("2", "a/x.md"), ("3", "ab/x.md")], "key string, path string")
    rules = spark.createDataFrame([(".", "p", "other"), ("a", "p", "own"), ("a/b", "p", "other"), ("a/b/c.md", "p", "own"), ("a", "q", "own"), ("a", "q", "other")], "rule_path string, profile string, ownership string")
    got = {(r["key"], r["profile"]): (r["ownership"], r["asks"]) for r in L.decided(files, rules).collect()}
    assert got == {("1", "p"): ("own", False), ("2", "p"): ("own", False), ("3", "p"): ("other", False), ("1", "q"): ("other", True), ("2", "q"): ("other", True)}
    assert {(r["rule_path"], r["profile"]): r["texts"] for r in L.coverage(files, rules, ["c.md"]).collect()}["a", "p"] == 1


def test_chains_end_at_cycles_and_overrides_win(spark):
    profiles = spark.createDataFrame([("x", "y", "self"), ("y", "z", "given"), ("z", "x", "self")], "profile string, parent string, consent string")
    links = L.chain(profiles)
    assert sorted((r["start"], r["profile"], r["depth"]) for r in links.collect() if r["start"] == "x") == [("x", "x", 0), ("x", "y", 1), ("x", "z", 2)]
    entries = spark.createDataFrame([("z", "1", None, "Tea"), ("y", "2", "1", "Coffee"), ("x", "3", None, "tea")], "profile string, id string, overrides string, text string")
    assert sorted((r["id"], r["text"]) for r in L.merged(links, entries).where("start = 'x'").collect()) == [("2", "Coffee"), ("3", "tea")]


def test_cascade_restore_and_rejections(spark):
    items = spark.createDataFrame([(2, 1), (3, 2), (4, None), (5, 4), (6, 3)], "id int, requires int")
    assert sorted(r["id"] for r in L.cascade(items, spark.createDataFrame([(1,)], "id int")).collect()) == [1, 2, 3, 6]
    now, old = spark.createDataFrame([(1, "a"), (9, "z")], "id int, body string"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, body string")
    no = spark.createDataFrame([(2, True), (1, False)], "id int, permanent boolean")
    assert [tuple(r) for r in L.restored(now, old, no).collect()] == [(1, "a", 10)]
    rows = L.rejections(spark.createDataFrame([(1, "example", "private words", "rejected"), (2, "lesson", "be brief", "rejected"), (3, "lesson", "x", "kept")], "id int, kind string, body string, decision string")).collect()
    assert {(r["id"], r["body"]) for r in rows} == {(1, None), (2, "be brief")} and all(len(r["digest"]) == 64 for r in rows)


def test_quotes_short_and_long(spark):
    texts = spark.createDataFrame([(1, "The  quick brown Fox\njumps over"), (2, "quickly browned"), (3, None)], "key int, text string")
    quotes = spark.createDataFrame([(1, "quick BROWN fox jumps"), (2, "fox"), (3, "row"), (4, ""), (5, None), (6, "ick brow")], "item int, quote string")
    assert sorted((r["item"], r["key"]) for r in L.quotes_found(texts, quotes).collect()) == [(1, 1), (2, 1), (3, 1), (3, 2), (6, 1)]
    assert {r["item"]: r["found_in"] for r in L.guide_rules(texts, quotes).collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0, 6: 1}


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_do_not_depend_on_partitions(spark, parts):
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(9)) for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {x["k"]: x["upto"] for x in ranks.running(spark.createDataFrame(rows, "g string, k int, v int").repartition(3), ["g"], ["k"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total: dict = {}
    for g, k, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[k] == total[g]


def test_statistics_of_an_evaluation(spark):
    wins = spark.createDataFrame([("a", 1.0)] * 8 + [("a", 0.0)] * 2 + [("a", 0.5), ("b", 0.5)], "arm string, win double")
    got = {r["arm"]: (r["n"], r["ties"], r["rate"], r["p"]) for r in E.win_rates(wins, "arm", "win").collect()}
    assert got == {"a": (11, 1, 0.772727, 0.109375), "b": (1, 1, 0.5, 1.0)}
    pairs = spark.createDataFrame([("x", 100, 200)] * 5 + [("y", 100, 110)] * 5, "author string, before int, after int")
    assert {r["author"]: r["separates"] for r in E.separation(pairs).collect()} == {"x": True, "y": False}
    same = L.compared(spark.createDataFrame([("p", None), ("q", 1), ("r", 2)], "path string, key int"), spark.createDataFrame([("p", 7), ("q", 3), ("s", 4)], "path string, key int"))
    assert {r["path"]: r["outcome"] for r in same.collect()} == {"p": "equal", "q": "differs", "r": "missing", "s": "extra"}
    old = spark.createDataFrame([("en", "m", 1.0)], "lang string, metric string, value double")
    new = old.withColumn("overshoot", F.lit(2.0))
    assert E.rebanded(old, new, ["lang"]).count() == 1
    with pytest.raises(Exception, match="value has changed"):
        E.rebanded(old, new.withColumn("value", F.lit(3.0)), ["lang"]).collect()


def test_cascade_of_many_rounds_keeps_no_filters(spark):
    items = spark.range(1, 3000).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("requires"))
    out = L.cascade(items, items.where("id % 13 = 5").select("id"))
    down = set()
    for i in range(1, 3000):
        if i % 13 == 5 or i // 2 in down:
            down.add(i)
    assert {r["id"] for r in out.collect()} == down and out.count() == len(down)
    assert len(out._jdf.queryExecution().optimizedPlan().constraints().mkString(" ")) < 200
