"""Registered queries give the rows of their SQL in another engine, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from corpusloom import catalog

DATA = "/root/testdata/sf0.001"
PICKED = [
    "o023_words", "o025_sentences", "o030_prose_blocks", "o082_talk_metrics", "o083_slot_fingerprint", "o090_split_half", "o071_near_duplicates", "o113_leave_one_out",
    "o117_top_passages", "o138_metric_flags", "o094_sign_allowance", "o067_classify_known", "o069_most_specific_rule", "o073_inheritance", "o153_manifest_patch",
    "o155_effective_decisions", "o108_cluster_bootstrap", "o108_pooled_runs", "o159_composed_changes", "o153_merged_patches", "o137_language_segments", "o157_rederived_fingerprints", "o171_left_out_flags",
    "o169_trial_metrics", "o135_rebuilt_lessons", "o217_recognition", "o041_front_matter",
]


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        try:
            return f"{float(v):.5f}" if not isinstance(v, (str, bool)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in "events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, other, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = other.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want) and len(got)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_slots_do_not_depend_on_partitions(spark):
    run = lambda: normal(catalog.QUERIES["o083_slot_fingerprint"](spark, DATA).toPandas())
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
