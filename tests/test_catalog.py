"""A sample of registered queries against their SQL, on the smallest tables."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from agentmetrics.catalog import adapters

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["q_spend_rollup", "q_a_units", "q_b_sessions", "q_segments_full", "q_rules", "q_survival",
          "q_rework_commits", "q_upsert_outcome", "q_fix_subjects", "q_savings"]
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    return round(float(value), 9) if isinstance(value, float) or hasattr(value, "as_tuple") else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sql, name):
    df = driver.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = sql.execute(driver.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_every_twin_names_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_log_lines_are_dealt_by_count(spark):
    """Tables of one row group are parsed by as many tasks as their rows ask for."""
    rows = spark.range(0, 120_000, 1, 1).select(
        F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"), F.timestamp_seconds("id").alias("ts"))
    for log in (adapters.log_a, adapters.log_b):
        assert log(SimpleNamespace(events=rows)).rdd.getNumPartitions() == 3
