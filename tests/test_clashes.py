"""Queries on tables with rows that the given small tables do not hold, against their SQL."""

import duckdb
import pytest

from agentmetrics.catalog import QUERIES, SQL
from tests.test_catalog import plain


def check(spark, folder, name, **tables):
    """Writes the tables and compares the query over them with its SQL; returns the number of rows."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    found = sorted(repr([plain(r[c]) for c in names]) for r in got.collect())
    assert found == sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
    return len(found)


@pytest.mark.parametrize("name", ["q_unit_labels", "q_unit_coverage"])
def test_sessions_that_share_their_first_characters(spark, tmp_path, name):
    ids = [4 * session + turn for session in (35097, 40686, 7) for turn in range(4)]  # the first two share c7b2880d
    documents = spark.createDataFrame([(i, i % 6000) for i in ids], "doc_id long, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in ids], "doc_id long, quality int, toxic int")
    assert check(spark, tmp_path, name, documents=documents, labels=labels) >= 2


def orders_of_one_nation(spark, n):
    """Orders of few days in one repo, many of them merges, with lines that are removed early."""
    orders = spark.range(n).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "CASE WHEN id % 3 = 0 THEN 'P' ELSE 'F' END AS o_orderstatus",
        "CAST(id * 1000 AS DOUBLE) AS o_totalprice", "TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(id % 20) AS o_orderdate",
        "CASE id % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS o_orderpriority")
    customer = spark.range(7).selectExpr("id AS c_custkey", "CAST(0 AS INT) AS c_nationkey")
    lineitem = spark.range(2 * n).selectExpr(
        "id div 2 AS l_orderkey", "id % 5 AS l_partkey",
        "CASE WHEN id % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag",
        "TIMESTAMP_NTZ '1995-01-05 00:00:00' + make_dt_interval(id % 30) AS l_shipdate")
    return dict(orders=orders, customer=customer, lineitem=lineitem)


@pytest.mark.parametrize("name", ["q_pr_numbers", "q_survival", "q_repo_summary"])
def test_days_with_many_commits(spark, tmp_path, name):
    assert check(spark, tmp_path, name, **orders_of_one_nation(spark, 300)) >= 1


def test_a_commit_has_one_merge_row(spark):
    """Rows of merges grow with the commits, not with commits times merges."""
    from agentmetrics.catalog.history import members
    commits = spark.range(600).selectExpr(
        "'r' AS repo", "sha1(string(id)) AS sha", "TIMESTAMP '1995-01-01' + make_dt_interval(id % 4) AS at",
        "id % 2 = 0 AS is_merge", "'Merge pull request #' || id || ' from x' AS body")
    rows = members(commits)
    assert rows.count() == rows.select("sha").distinct().count() == 150  # those of the last day have no later merge


def test_cells_with_missing_keys_and_dates(spark, tmp_path):
    lineitem = spark.range(600).selectExpr(
        "id AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "nullif(id % 5, 4) AS l_partkey", "nullif(id % 7, 6) AS l_suppkey",
        "CASE id % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' END AS l_returnflag", "'F' AS l_linestatus", "CAST(id AS DOUBLE) AS l_quantity",
        "CASE WHEN id % 11 > 2 THEN TIMESTAMP_NTZ '1994-01-01 00:00:00' + make_dt_interval(id) END AS l_shipdate")
    undated = spark.range(600, 620).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "'R' AS l_returnflag", "'F' AS l_linestatus",
        "CAST(id AS DOUBLE) AS l_quantity", "CAST(NULL AS TIMESTAMP_NTZ) AS l_shipdate")
    assert check(spark, tmp_path, "q_eval_cells", lineitem=lineitem.unionByName(undated)) == 5 * 7 * 3 + 20
