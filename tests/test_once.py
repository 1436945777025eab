"""Queries that measure texts once."""

from test_scan import passes

from corpusloom import catalog

DATA = "/root/testdata/sf0.001"


def test_the_check_report_takes_one_pass(spark, monkeypatch):
    assert passes(monkeypatch, spark, "o149_check_report") == (1, 0)


def test_small_marks_are_counted_once(spark):
    plan = catalog.QUERIES["o148_quirk_flags"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "regexp" not in plan
