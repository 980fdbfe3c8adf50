"""The batch jobs' continuous forms, as Structured Streaming queries.

Each function takes a streaming DataFrame and returns one; ``run`` starts it.
State is bounded by the watermark, and checkpoints live in the folder the
caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..operators.buckets import Parts, upsert_parts
from ..operators.upsert import VERSIONS
from ..plans import pricing
from ..plans.spend import thousandths
from ..sources.appended import appended_lines
from ..sources.lines import ORDER
from .segments import segments  # noqa: F401  one of the jobs

LATENESS = "1 day"


def log_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New lines of log files, those appended to known files included, in the shape of a batch read."""
    return appended_lines(spark, path, **options)


def land(parse: Callable[[DataFrame], DataFrame], table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that types a micro-batch's lines and lands them.

    Each batch owns one folder and overwrites it, so a replay leaves no copies.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    return write


def first_usage(records: DataFrame) -> DataFrame:
    """Per message the record that stands first in its file, in whatever order records arrive.

    Run it in update mode: a message is emitted when it is first seen and once more when an
    earlier record of it arrives. Of what was emitted for a message the least position
    counts (``earliest``), so repeats and replays change nothing. Messages without a time
    are treated like any other. State is one narrow row a message and does not expire,
    as a file may be read again at any time.
    """
    kept = [c for c in records.columns if c not in ("path", "message_id", *ORDER)]
    first = F.min(F.struct(*ORDER, *kept)).alias("r")
    return records.where(F.col("rtype") == "assistant").groupBy("path", "message_id").agg(first).select(
        "path", "message_id", "r.*")


def changes_into(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that lands what a micro-batch changed; a replay overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    return write


def earliest(changes: DataFrame) -> DataFrame:
    """The standing record of each message, of all that ``first_usage`` emitted."""
    kept = [c for c in changes.columns if c not in ("path", "message_id", "batch", *ORDER)]
    return changes.groupBy("path", "message_id").agg(F.min(F.struct(*ORDER, *kept)).alias("r")).select(
        "path", "message_id", "r.*")


def gap_segments(events: DataFrame, key: str, at: str, gap: str = "30 minutes",
                 lateness: str = LATENESS) -> DataFrame:
    """Segments split by idle gaps alone; a gap of exactly the limit stays inside."""
    window = F.session_window(at, gap)
    return (events.withWatermark(at, lateness).groupBy(key, window)
            .agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
            .drop("session_window"))


def resolved_rates(models: DataFrame, sheet: DataFrame) -> DataFrame:
    """Rates per model id, resolved once in batch for joins with a stream."""
    listed = models.select(F.array("model_id").alias("model_list")).distinct()
    return pricing.with_rates(listed, sheet).where(F.col("priced_as").isNotNull()).select(
        F.get("model_list", F.lit(0)).alias("model_id"), "priced_as",
        *[f"rate_{r}" for r in fixed.RATES])


def daily_spend(sessions: DataFrame, rates: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Spend per day and tool; a day is final when the watermark has passed it."""
    day = F.window("started_at", "1 day")
    cost = pricing.session_price()
    return (sessions.withWatermark("started_at", lateness).join(rates, "model_id", "left")
            .groupBy(day, "source_tool").agg(
                F.count("*").alias("sessions"), F.sum(thousandths(cost)).alias("cost_x1000"),
                *[F.sum(t).alias(t) for t in fixed.TOKEN_BUCKETS])
            .select(F.to_date("window.start").alias("day"), "source_tool", "sessions",
                    "cost_x1000", *fixed.TOKEN_BUCKETS))


def upsert_into(path: str, parts: Parts, order: str,
                versions: list[str] = VERSIONS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each micro-batch into a table in parts, of
    which it rewrites those it changes. A batch that is replayed after a failure changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*parts.keys).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r"))
        kept = last.select("r.*").persist()  # read three times; a lost block is computed again
        try:
            upsert_parts(batch.sparkSession, path, kept, parts, versions)
        finally:
            kept.unpersist()
    return write


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run(stream: DataFrame, checkpoint: str, sink: str | Callable, mode: str = "append",
        drain: bool = False, clocked: bool = False) -> StreamingQuery:
    """Start a stream into a parquet folder or a foreachBatch function. With
    ``drain`` it processes what is there and stops; a ``clocked`` stream, whose state goes
    by the wall clock, would ask for batches without data for ever, so it gets none."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if drain:
        writer = writer.trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format("parquet").option("path", sink)
    idle = spark.conf.get(IDLE_BATCHES)
    if drain and clocked:
        spark.conf.set(IDLE_BATCHES, "false")  # a query keeps the settings it was started with
    try:
        return writer.start()
    finally:
        spark.conf.set(IDLE_BATCHES, idle)
