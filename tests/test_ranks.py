"""Quantiles and leave-one-out medians sort each value of a group once, however often it occurs."""

import random
from statistics import median, quantiles

from corpusloom.operators import outliers, ranks


def test_equal_values_are_counted_before_they_are_sorted(spark, monkeypatch):
    sorted_rows = []
    monkeypatch.setattr(ranks, "running", lambda rows, *a, f=ranks.running: sorted_rows.append(rows.count()) or f(rows, *a))
    r = random.Random(8)
    rows = [(g, i, m, float(r.choice([0, 0, 1, 2, 5]))) for g, n in (("a", 30), ("b", 31), ("c", 2), ("d", 3), ("e", 1)) for m in ("x", "y") for i in range(n)]
    df = spark.createDataFrame(rows, "slot string, key long, metric string, value double")
    got = {(x["slot"], x["key"], x["metric"]): x["ref"] for x in outliers.without_self(df, ["slot"]).collect()}
    want = {(g, i, m): median([v for h, j, o, v in rows if (h, o) == (g, m) and j != i]) for g, i, m, _ in rows if g != "e"}
    assert got == want
    found = {(x["slot"], x["metric"]): [x["a"], x["b"]] for x in ranks.quantiles(df, ["slot", "metric"], "value", {"a": 0.25, "b": 0.5}).collect()}
    for (g, m), x in found.items():
        own = [v for h, _, o, v in rows if (h, o) == (g, m)]
        assert x == (quantiles(own, n=4, method="inclusive")[:2] if len(own) > 1 else own * 2)
    distinct = len({(g, m, v) for g, _, m, v in rows})
    assert sorted_rows == [distinct, distinct] and distinct < len(rows)


def test_weights_count_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 4.0, 2), ("a", None, 5), (None, 7.0, 1)], "g string, v double, n long")
    got = {x["g"]: x["q"] for x in ranks.quantiles(df, ["g"], "v", {"q": 0.5}, "n").collect()}
    assert got == {"a": 1.5, None: 7.0}
