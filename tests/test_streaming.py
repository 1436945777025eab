"""Matching of drafts with published texts, in one batch and as a stream."""

import datetime as dt

from corpusloom.streaming import published

NOW = dt.datetime(2024, 1, 10)
KNOWN = [("sam", "draft", "d1", NOW, "one two three four five"), ("sam", "draft", "d2", NOW, "one two three four six"), ("sam", "draft", "old", dt.datetime(2023, 1, 1), "seven eight nine ten")]
NEW = [("sam", "text", "t1", NOW + dt.timedelta(days=1), "one two three four six"), ("sam", "text", "t2", NOW + dt.timedelta(days=2), "one two three four five"),
       ("sam", "text", "t3", NOW + dt.timedelta(days=3), "seven eight nine ten"), ("kim", "text", "t4", NOW, "one two three")]
SCHEMA = "profile string, kind string, id string, ts timestamp, text string"


def test_stream_matches_like_a_batch(spark, tmp_path):
    """Two batches: what the first has used the second does not get, and a draft beyond its time matches nothing."""
    for rows in (NEW[:2], [*NEW[2:], ("sam", "text", "t5", NOW + dt.timedelta(days=4), "one two three four five")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = published.run_matching(spark, stream, spark.createDataFrame(KNOWN, SCHEMA), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["draft"], r["text_id"], r["share"], r["batch"]) for r in rows) == [("d1", "t2", 1.0, 0), ("d2", "t1", 1.0, 0)]
    assert spark.read.schema("draft string").parquet(str(tmp_path / "out" / "batch=1")).isEmpty()


def test_lives_of_drafts(spark, tmp_path):
    """A draft is kept in one batch and claimed in another; of two claims the earlier text has it; timers end the others."""
    day = lambda n: NOW + dt.timedelta(days=n)
    batches = [
        [("w", "a", "kept", day(0), None), ("w", "b", "kept", day(0), None), ("w", "c", "kept", day(1), None)],
        [("w", "a", "claim", day(6), "t2"), ("w", "a", "claim", day(5), "t1"), ("w", "x", "claim", day(5), "t3")],
        [("w", "a", "claim", day(7), "t4"), ("v", "z", "kept", day(200), None)],
        [("w", "b", "claim", day(201), "t5"), ("v", "z", "claim", day(202), "t6")],
    ]
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "profile string, draft string, what string, ts timestamp, text_id string"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = published.lives(stream, late="0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(120)
        got = sorted((r["draft"], r["status"], r["text_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.set(name, before)
    assert got == [("a", "matched", "t1"), ("a", "taken", "t2"), ("a", "taken", "t4"), ("b", "expired", None), ("b", "late", "t5"), ("c", "expired", None), ("x", "unknown", "t3"), ("z", "matched", "t6")]


def test_weekly_windows_start_on_mondays(spark, tmp_path):
    events = [(1, dt.datetime(2024, 1, 7, 23), "a"), (2, dt.datetime(2024, 1, 8, 1), "a"), (3, dt.datetime(2024, 1, 14, 1), "a")]
    spark.createDataFrame(events, "user_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    query = published.weekly(stream).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["window"]["start"].isoformat()[:10], r["n"]) for r in spark.table("weeks").collect())
    assert got == [("2024-01-01", 1), ("2024-01-08", 2)]
