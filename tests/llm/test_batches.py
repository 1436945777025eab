"""Workers of line dedup hold few texts of a batch as Python strings, and ranks need no workers of their own."""

import tracemalloc

import numpy as np
import pyarrow as pa

from corpusloom.llm import linededup
from corpusloom.llm.common import ranked


def test_a_batch_is_not_held_as_strings(spark):
    text = "a word and another one\n" * 400
    n = len(text.split())
    texts = pa.array([text] * 3000 + [None, ""])
    at = pa.array([[0]] * 1500 + [None] * 1502, pa.list_(pa.int32()))
    mask = pa.array([[1]] * 1500 + [None] * 1502, pa.list_(pa.int64()))
    tracemalloc.start()
    got = linededup._without(50).func(texts, at, mask)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 2
    removed = np.array(got.field("n_removed_words"))
    assert (removed[:1500] == 50).all() and (removed[1500:] == 0).all()
    assert got[0].as_py()["n_words"] == n and len(got[0].as_py()["text"].split()) == n - 50
    assert [got[k].as_py()["text"] for k in (2000, 3000, 3001)] == [text, None, ""]


def test_ranks_bring_their_starts_by_arrow(spark):
    got = ranked(spark.range(50).selectExpr("id % 25 as x", "id as y").repartition(3), "x", "y")
    assert "LocalRelation" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["rank"] for r in got.orderBy("x", "y").collect()] == list(range(50))
    assert ranked(spark.range(0), "id").count() == 0
