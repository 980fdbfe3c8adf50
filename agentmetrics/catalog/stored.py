"""Reports over stored tables, and the sinks of labels and evaluated cells."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import upsert
from ..plans import reporting
from ..session import scratch_folder
from .money import names, order_sessions, sheet
from .registry import SQL, Tables, query


def place(t: Tables) -> str:
    return f"{scratch_folder(t.spark)}/stored-{uuid.uuid4().hex}"


@query("q_stored_report", SQL["q_spend_rollup"])
def stored_report(t: Tables) -> DataFrame:
    """Orders as stored sessions, rolled up by the job. Every session that is not of the first tool
    is also stored, with other tokens and models, under the tools before its own; the last one counts."""
    own = order_sessions(t).withColumn("session_id", F.col("session_id").cast("string"))
    earlier = F.explode(F.when(F.col("source_tool") == "codex", F.array(F.lit("claude_code"), F.lit("cursor"))).when(
        F.col("source_tool") == "cursor", F.array(F.lit("claude_code"))))
    others = own.withColumn("source_tool", earlier).withColumns(
        {b: F.coalesce(b, F.lit(0)) + 7 for b in fixed.TOKEN_BUCKETS}).withColumn("model_list", F.array(F.lit("1-URGENT")))
    every = own.unionByName(others)
    unknown = {c: F.lit(None).cast("long") for c in ("files_touched", "lines_added", "lines_removed", "interrupted_tool_calls")}
    sessions = every.drop("model_list", "cohort").withColumns(unknown).withColumn(
        "languages", F.lit(None).cast("array<string>"))
    data = place(t)
    paths = every.select("source_tool", "session_id", F.when(F.col("cohort") == "organic", "/x/human").otherwise(
        "/x/eval").alias("source_path"))
    upsert.replace_table(sessions.join(paths, reporting.KEY), f"{data}/sessions")
    upsert.replace_table(every.select(
        *reporting.KEY, F.explode("model_list").alias("model_id"), F.lit(1).alias("assistant_messages")), f"{data}/models")
    return t.spark.read.parquet(reporting.report(t.spark, data, place(t), sheet(t), "/eval", names(t))["rollup"])


@query("q_eval_cells", """
SELECT run_id, task_id, model_id, tests, written FROM (SELECT 'run' || (l_suppkey % 10) AS run_id, 'task' || l_partkey AS task_id,
    l_returnflag || l_linestatus AS model_id, CAST(l_quantity AS BIGINT) AS tests, l_orderkey * 10 + l_linenumber AS written,
    row_number() OVER (PARTITION BY run_id, task_id, model_id
      ORDER BY l_shipdate >= DATE '1995-01-01' DESC, l_orderkey * 10 + l_linenumber DESC) AS nth
  FROM lineitem) WHERE nth = 1""")
def eval_cells(t: Tables) -> DataFrame:
    """Line items as evaluated cells, saved in two batches of which the second is sent twice."""
    cells = t.lineitem.select(
        F.concat(F.lit("run"), (F.col("l_suppkey") % 10).cast("string")).alias("run_id"),
        F.concat(F.lit("task"), F.col("l_partkey").cast("string")).alias("task_id"),
        F.concat("l_returnflag", "l_linestatus").alias("model_id"), F.col("l_quantity").cast("long").alias("tests"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("written"),
        (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).alias("late"))
    path = place(t)
    for batch in ("late IS NOT TRUE", "late", "late"):  # a row without a date comes before all others
        reporting.save_cells(t.spark, cells.where(batch), path, ["late", "written"])
    return reporting.read_cells(t.spark, path).drop("late")
