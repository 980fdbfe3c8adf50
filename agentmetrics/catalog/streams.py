"""The streaming jobs, drained over the given tables in several micro-batches.

A table is landed as files and read as a stream; ``availableNow`` takes all of it
and stops, so what the stream leaves behind can be held against the batch result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import buckets
from ..plans import sessions_a
from ..session import durable, scratch_folder
from ..sources import logs_a
from ..sources.appended import write_files
from ..streaming import jobs
from .money import PRICED_SQL, order_sessions, sheet
from .records import KEYS, UPSERT_SQL, batch, stored, usage_records
from . import adapters as D
from .registry import SQL, Tables, query
from .traffic import GAP, a_tables

#: Micro-batches that a table is drained in.
BATCHES = 2


def place(t: Tables) -> str:
    return f"{scratch_folder(t.spark)}/{uuid.uuid4().hex}"


def as_stream(t: Tables, df: DataFrame) -> DataFrame:
    """The rows as files, dealt anew, as many as the table's size asks for; read in BATCHES parts."""
    folder = place(t)
    dealt = durable(df)
    files = max(2 * BATCHES, dealt.rdd.getNumPartitions())
    dealt.repartition(files).write.parquet(folder)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(folder)


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """All groups of an aggregating stream, the open ones included."""
    target = place(t)

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(target)

    jobs.run(stream, place(t), keep, mode="complete", drain=True).awaitTermination()
    return t.spark.read.parquet(target)


@query("q_stream_gaps", """
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR
      THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, grp""")
def stream_gaps(t: Tables) -> DataFrame:
    """Gap segments of a user's events; files come in any order, so none is late."""
    events = as_stream(t, t.events.select("user_id", "ts"))
    return drained(t, jobs.gap_segments(events, "user_id", "ts", "6 hours", "10000 days"))


@query("q_stream_spend", PRICED_SQL + """
SELECT CAST(tm AS DATE) AS day, tool AS source_tool, count(*) AS sessions,
  CAST(sum(CAST(trunc(cost * 1000) AS BIGINT)) AS BIGINT) AS cost_x1000, CAST(sum(input) AS BIGINT) AS input,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_creation) AS BIGINT) AS cache_creation FROM pr GROUP BY 1, 2""")
def stream_spend(t: Tables) -> DataFrame:
    """Spend per day and tool, at rates resolved before the stream starts."""
    sessions = order_sessions(t).select(
        "source_tool", "started_at", F.get("model_list", F.lit(0)).alias("model_id"), *fixed.TOKEN_BUCKETS)
    rates = jobs.resolved_rates(sessions, sheet(t))
    return drained(t, jobs.daily_spend(as_stream(t, sessions), rates, "10000 days"))


@query("q_stream_upsert", UPSERT_SQL + """
SELECT o_orderkey AS session_id, o_totalprice + CASE WHEN outcome IN ('new', 'updated') AND o_orderpriority = '5-LOW'
  THEN 1 ELSE 0 END AS price,
  CASE WHEN outcome IN ('new', 'updated') AND o_orderpriority = '2-HIGH' THEN '0.3.1' ELSE '0.3.0' END AS connector_version
FROM m""")
def stream_upsert(t: Tables) -> DataFrame:
    """A batch merged into the stored table as micro-batches, the first of them twice."""
    table = place(t)
    parts = buckets.Parts(KEYS, 16)
    buckets.create(stored(t), table, parts)
    write = jobs.upsert_into(table, parts, "started_at")

    def twice(rows: DataFrame, batch_id: int) -> None:
        for _ in range(2 if batch_id == 0 else 1):
            write(rows, batch_id)

    jobs.run(as_stream(t, batch(t)), place(t), twice, drain=True).awaitTermination()
    return buckets.read(t.spark, table, parts).select("session_id", "price", "connector_version")


def appended(t: Tables, stream: DataFrame, clocked: bool = False) -> DataFrame:
    """What a stream leaves in append mode, drained."""
    target = place(t)
    jobs.run(stream, place(t), target, drain=True, clocked=clocked).awaitTermination()
    return t.spark.read.parquet(target)


@query("q_stream_segments", SQL["q_segments_full"])
def stream_segments(t: Tables) -> DataFrame:
    """All five rules over units that come in any order, in several micro-batches."""
    tables = a_tables(t)
    files = tables["files"].groupBy("session_id", "turn_index").agg(
        F.collect_set("file_ref").alias("file_refs"), F.collect_set("top_dir_ref").alias("dir_refs"))
    none = F.array().cast("array<string>")
    units = tables["units"].select("session_id", "turn_index", "gap_ms_before", "git_branch", "interrupted").join(
        files, ["session_id", "turn_index"], "left").withColumns(
        {c: F.coalesce(c, none) for c in ("file_refs", "dir_refs")})
    out = appended(t, jobs.segments(as_stream(t, units), GAP), clocked=True)
    return out.select(F.col("session_id").alias("sid"), F.col("turn_index").alias("turn"), "opened_by", "segment_no")


@query("q_stream_lines", "WITH " + D.LOG_A_SQL + """
SELECT sid, CAST(count(*) FILTER (is_prompt) AS BIGINT) AS prompts, CAST(count(*) FILTER (opens) AS BIGINT) AS units,
  CAST(count(*) FILTER (patched) AS BIGINT) AS patches FROM ra GROUP BY sid HAVING count(*) FILTER (is_prompt) > 0""")
def stream_lines(t: Tables) -> DataFrame:
    """Log files read as a stream of appended lines, typed and landed by micro-batch."""
    folder, table = place(t), place(t)
    sid = F.lpad(F.regexp_extract("path", r"/u(\d+)\.jsonl$", 1), 8, "0").alias("sid")
    write_files(D.log_a(t).select(sid, "split", "pos", "value"), folder, "sid", ["split", "pos"])
    lines = jobs.log_lines(t.spark, folder)
    jobs.run(lines, place(t), jobs.land(logs_a.records, table), drain=True).awaitTermination()
    landed = t.spark.read.parquet(table).withColumn("sid", F.regexp_extract("path", r"/(\d+)\.jsonl$", 1))
    return landed.groupBy("sid").agg(
        F.count_if("is_prompt").alias("prompts"), F.count_if("opens_unit").alias("units"),
        F.count_if("patched").alias("patches")).where("prompts > 0")


@query("q_stream_usage", SQL["q_usage_dedupe"])
def stream_usage(t: Tables) -> DataFrame:
    """One usage a message, the first in its file, though records arrive in any order."""
    table = place(t)
    changes = jobs.first_usage(as_stream(t, usage_records(t)))
    jobs.run(changes, place(t), jobs.changes_into(table), mode="update", drain=True).awaitTermination()
    totals = sessions_a.message_totals(jobs.earliest(t.spark.read.parquet(table)), ["path"])
    return totals.select(F.col("path").alias("user_id"), "assistant_messages", "input")
