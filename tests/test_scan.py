"""The style scan stays small whatever a batch holds, and one pass gives texts and windows."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions.scan import scan
from corpusloom.operators import style

DATA = "/root/testdata/sf0.001"


def test_a_batch_is_not_held_as_strings(spark):
    texts = ["It’s long. " + "Word after word, it goes on. " * 400] * 2000
    batch, langs = pa.array(texts), pa.array(["en"] * len(texts))
    del texts
    tracemalloc.start()
    got = scan(style.SUMS).func(batch, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 2000 and got[0].as_py()["n_sent"] == 401
    assert peak < batch.nbytes / 4


def test_the_table_of_metrics_needs_no_python_worker(spark):
    plan = style.metric_table(spark)._jdf.queryExecution().executedPlan().toString()
    assert "RDD" not in plan and "Python" not in plan
    assert style.metric_table(spark).count() == len(style.METRICS)


def test_window_sums_equal_columns(spark):
    r = random.Random(3)
    words = "It's perhaps However, done. said Next (we) “a b c d e” 12 -- semi; colon: a-b ends! why? longerword".split(" ")
    rows = [(i, "\n\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 12))), r.choice(["en", "de", "xx"]), "t") for i in range(60)]
    texts = spark.createDataFrame([*rows, (99, None, "en", "t")], "key long, text string, lang string, type string")
    one = style.windowed_once(texts, 40)
    got = one.select("key", "lang", "type", F.explode("windows").alias("x")).select("key", "lang", "type", "x.*").select("key", "lang", "type", "w", "window_words", *style.values().values())
    want = style.window_metrics(texts, 40)
    assert got.count() > 50 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, one.select("key", *style.SUMS).collect())) == sorted(map(str, style.sums(texts).select("key", *style.SUMS).collect()))


def passes(monkeypatch, spark, name):
    """How many scans of texts a query sets up, besides those by Column expressions."""
    made, by_columns = [], []
    monkeypatch.setattr(style, "scan", lambda *a: made.append(a) or scan(*a))
    monkeypatch.setattr(style, "_counted", lambda *a, f=style._counted: by_columns.append(a) or f(*a))
    assert catalog.QUERIES[name](spark, DATA).count()
    return len(made), len(by_columns)


def test_bands_take_one_pass(spark, monkeypatch):
    assert passes(monkeypatch, spark, "o174_rebanded") == (1, 0)


def test_verification_scans_texts_once(spark, monkeypatch):
    assert passes(monkeypatch, spark, "o116_verify") == (2, 0)  # of the texts and of the drafts
