"""Never-lists, tones, replacements, and what slots measure otherwise than one joined text."""

import math
import random

from pyspark.sql import functions as F

from corpusloom.functions import packs
from corpusloom.operators import evaluation as E
from corpusloom.operators import patterns, style


def test_never_list_against_a_loop(spark):
    r = random.Random(2)
    words = "the of red dog blue cat runs far".split()
    rewrites = [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(9)]
    corpus = [(i, " ".join(r.choice(words) for _ in range(8))) for i in range(4)]
    stop = ("the", "of")

    def grams(t):
        w = t.split()
        return {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}

    used = set().union(*(grams(t) for _, t in corpus))
    counts: dict = {}
    for _, t in rewrites:
        for g in grams(t):
            if not all(w in stop for w in g.split()):
                counts[g] = counts.get(g, 0) + 1
    out = []
    for c, g in sorted((-c, g) for g, c in counts.items() if c >= 3 and g not in used):
        if not any(g in o or o in g for o, _ in out) and len(out) < 15:
            out.append((g, -c))
    schema = "key int, text string"
    got = E.never_list(spark.createDataFrame(rewrites, schema), spark.createDataFrame(corpus, schema), stop)
    assert sorted(tuple(x) for x in got.collect()) == sorted(out) and out


def test_the_tone_named_first_decides():
    pulls, conflicts = E.tone_pulls(["firm", "formal"])
    assert pulls["sentence_length_mean"] == (-1, "firm") and ("sentence_length_mean", "firm", "formal") in conflicts
    assert E.tone_pulls(["formal"]) == ({m: (d, "formal") for m, d in packs.TONES["formal"].items()}, [])


def test_replacements_are_what_was_taken_out(spark):
    text = "Ann Lee wrote to ann@x.org and Ann."
    names = [("Ann", "[first]"), ("Ann Lee", "[person]")]
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(patterns.redacted(df.text, names).alias("r"), patterns.replacements(df.text, names).alias("x")).first()
    assert row["r"] == "[person] wrote to [email] and [first]."
    assert [tuple(x) for x in row["x"]] == [("[email]", "ann@x.org"), ("[person]", "Ann Lee"), ("[first]", "Ann")]


def test_a_reference_list_ends_its_own_text_only(spark):
    """Slots add up their texts' sums; one joined text would stop at the first reference list."""
    first, second = "One thing happened here.\n\nReferences\n\nA book about it.", "Then another thing happened."
    rows = spark.createDataFrame([(1, first, "en", "t"), (2, second, "en", "t")], "key int, text string, lang string, type string")
    joined = spark.createDataFrame([(1, first + "\n\n" + second, "en", "t")], rows.schema)
    assert style.slot_metrics(rows).first()["n_words"] == 8 and style.slot_metrics(joined).first()["n_words"] == 4


def test_interval_of_clusters_against_a_loop(spark):
    import hashlib
    import random

    r = random.Random(1)
    rows = [(f"c{r.randrange(7)}", float(r.random() < 0.6)) for _ in range(90)]
    df = spark.createDataFrame(rows, "cluster string, win double").repartition(3)
    by = {}
    for c, w in rows:
        by.setdefault(c, []).append(w)
    keys = sorted(by)
    boots = []
    for b in range(200):
        pick = [by[keys[int(hashlib.md5(f"5/{b}/{k}".encode()).hexdigest()[:12], 16) % len(keys)]] for k in range(len(keys))]
        boots.append(sum(map(sum, pick)) / sum(map(len, pick)))
    boots.sort()
    got = E.cluster_interval(df, "cluster", "win", 200, 5).collect()[0]
    assert (got["low"], got["high"], got["clusters"], got["n"]) == (round(boots[5], 6), round(boots[194], 6), 7, 90)
    assert got["rate"] == round(sum(w for _, w in rows) / 90, 6)
    assert E.cluster_interval(df.limit(0), "cluster", "win", 50).collect()[0]["rate"] is None


def test_repeated_passages_count_in_their_first_run(spark):
    from math import comb

    rows = [(f"r{k % 3}", k, f"Passage  {k % 20}" if k % 2 else f"passage {k % 20}", "g" if k % 20 < 14 else "h", k % 20 == 5, k % 4 != 0) for k in range(60)]
    df = spark.createDataFrame(rows, "run string, id int, text string, group string, recognised boolean, won boolean").repartition(3)
    seen, counts = set(), {}
    for run, i, text, g, known, won in sorted(rows):
        said = " ".join(text.lower().split())
        if said not in seen and not known:
            n, w = counts.get(g, (0, 0))
            counts[g] = (n + 1, w + won)
        seen.add(said)
    passed = spark.createDataFrame([("r0", "g", True), ("r1", "g", True), ("r0", "h", True), ("r1", "h", False)], "run string, group string, passed boolean")
    got = {x["group"]: x for x in E.pooled(df, passed, ["won"]).collect()}
    for g, (n, w) in counts.items():
        tail = sum(comb(n, i) for i in range(w, n + 1)) / 2**n
        assert (got[g]["n"], got[g]["p_won"]) == (n, round(tail, 6)) and got[g]["all_runs"] == (g == "g") and got[g]["passes"] == (g == "g" and tail < 0.05)


def test_parts_of_a_text_add_up(spark):
    from corpusloom.operators import ledger

    said = [(1, p, lang, w) for p, (lang, w) in enumerate([("en", 50), ("de", 60), ("en", 9), ("de", 45), ("de", 41), ("fr", 44), ("en", 80), ("fr", 3)])]
    said += [(2, 0, "de", 5), (2, 1, "en", 9), (3, 0, "de", 50), (3, 1, "en", 50)]
    got = [tuple(x) for x in ledger.segments(spark.createDataFrame(said, "key int, pos int, lang string, words int")).orderBy("key", "part").collect()]
    assert got == [("1", 1, "de", 5, 158), ("1#2", 2, "en", 1, 50), ("1#3", 3, "fr", 1, 44), ("1#4", 4, "en", 1, 80), ("2", 1, "en", 2, 14), ("3", 1, "de", 1, 50), ("3#2", 2, "en", 1, 50)]


def test_binomial_tail_costs_little_for_many_tosses(spark):
    cases = [(k, n) for n in (0, 1, 2, 15, 16, 17, 40, 500) for k in {0, 1, n // 2, n // 2 + 3, n - 1, n} if 0 <= k <= n] + [(150_400, 300_000), (1_000, 300_000), (299_990, 300_000), (5_001_000, 10_000_000)]
    got = spark.createDataFrame(cases, "k int, n int").select("k", "n", E.binomial_tail(F.col("k"), F.col("n")).alias("p")).collect()
    for k, n, p in got:
        if n <= 500:
            want = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        else:
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k, min(n + 1, k + 400_000)))
        assert math.isclose(p, want, rel_tol=1e-6 if n > 500 else 1e-11), (k, n, p, want)
