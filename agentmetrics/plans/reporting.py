"""From the tables that ``ingest.extract`` stored to labels, prices and reports.

``load`` reads them as one population, ``report`` labels, prices and rolls them up in one
job, and ``save_labels`` and ``save_cells`` are sinks that a repeated run leaves as they are.

Defined cases: a session id that several tools stored is one session, that of the tool
named last in ``fixed.SOURCE_TOOLS`` (an unknown tool comes before all); its models, tools and
prompt sources are that tool's, while units of all of them stay under the id. A table that no source wrote
is empty. A null session id is left out. Of several cells with one (run, task, model)
in a batch the last by ``order`` counts, and one stored before is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import buckets, upsert
from ..operators.keyed import by_shuffle, last_per_key
from ..session import durable, job_scratch
from . import classify, pricing, spend

KEY = ["source_tool", "session_id"]
CELL = ["run_id", "task_id", "model_id"]
_SESSION = "source_tool string, session_id string"
#: Stored tables, and the columns of one that no source has written.
EMPTY = {
    "models": f"{_SESSION}, model_id string, assistant_messages bigint",
    "tools": f"{_SESSION}, tool_name string, calls bigint",
    "prompt_sources": f"{_SESSION}, source_name string, prompts bigint",
    "units": f"{_SESSION}, turn_index bigint, started_at timestamp, window_ended_at timestamp, "
             "gap_ms_before bigint, git_branch string, interrupted boolean, lines_added bigint, lines_removed bigint",
    "unit_tools": f"{_SESSION}, turn_index bigint, tool_name string, calls bigint",
    "unit_files": f"{_SESSION}, turn_index bigint, file_ref string, top_dir_ref string, is_new_file boolean, "
                  + ", ".join(f"{flag} boolean" for flag in classify.FLAGS.values())}
OF_SESSION = ["models", "tools", "prompt_sources"]


def one_per_id(sessions: DataFrame) -> DataFrame:
    """Each session id once: the last tool that has it, found on the narrow columns."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.SOURCE_TOOLS]), F.col("source_tool"))
    named = sessions.where("session_id IS NOT NULL AND source_tool IS NOT NULL")
    best = named.groupBy("session_id").agg(
        F.max_by("source_tool", F.struct(rank.alias("rank"), "source_tool")).alias("source_tool"))
    return named.join(by_shuffle(best), KEY, "left_semi")


def load(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    """``sessions`` and the child tables under the folder ``data``."""
    at = data.rstrip("/")
    sessions = one_per_id(spark.read.parquet(f"{at}/sessions"))
    tables = {name: upsert.read_or_empty(spark, f"{at}/{name}", ddl) for name, ddl in EMPTY.items()}
    chosen = by_shuffle(sessions.select(*KEY))
    return {"sessions": sessions, **{
        name: df.join(chosen, KEY, "left_semi") if name in OF_SESSION else df for name, df in tables.items()}}


def priced(tables: dict[str, DataFrame], sheet: DataFrame, eval_marker: str,
           names: DataFrame | None = None) -> DataFrame:
    """Sessions with their models, most used first, cohort by source path, cost and project name."""
    lists = pricing.dominant_models(tables["models"], KEY)
    sessions = tables["sessions"].join(by_shuffle(lists), KEY, "left").withColumn(
        "model_list", F.coalesce("model_list", F.array().cast("array<string>"))).withColumn(
        "cohort", spend.cohort(F.coalesce("source_path", F.lit("")), eval_marker))
    return spend.priced(sessions, sheet, names)


def labels(tables: dict[str, DataFrame]) -> DataFrame:
    """Labels at all three grains."""
    return classify.classify_all(*[tables[n] for n in ("sessions", "tools", "units", "unit_tools", "unit_files")])


def save_labels(spark: SparkSession, classes: DataFrame, path: str,
                version: str = fixed.CLASSIFIER_VERSION) -> None:
    """Replace the labels of one classifier version; those of other versions stay."""
    parts = buckets.Parts(["classifier_version"], spread=F.col("classifier_version"))
    of = spark.createDataFrame([(version,)], "classifier_version string")
    buckets.replace_parts(spark, path, classes.where(F.col("classifier_version") == version), of, parts)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(buckets.PART)


def save_cells(spark: SparkSession, cells: DataFrame, path: str, order: list[str]) -> list[str]:
    """Put evaluated cells in place, one row per run, task and model; returns the runs rewritten."""
    parts = buckets.Parts(CELL, spread=F.col("run_id"))
    batch = durable(last_per_key(cells, CELL, order))
    return buckets.replace_parts(spark, path, batch, batch.select(*CELL), parts)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(buckets.PART)


def report(spark: SparkSession, data: str, out: str, sheet: DataFrame, eval_marker: str = "eval",
           names: DataFrame | None = None) -> dict[str, str]:
    """Label, price and roll up what is stored under ``data``; returns the paths of the tables written.

    ``labels`` keeps other classifier versions; ``rollup``, ``headline``, ``task_mix``, ``origin_mix``
    and ``coverage`` are replaced by a swap each.
    """
    paths = {n: f"{out.rstrip('/')}/{n}" for n in (
        "labels", "rollup", "headline", "task_mix", "origin_mix", "coverage")}
    with job_scratch(spark):
        tables = load(spark, data)
        cost = durable(priced(tables, sheet, eval_marker, names))
        classes = durable(labels(tables))
        save_labels(spark, classes, paths["labels"])
        for name, rows in (
                ("rollup", spend.rollup(cost)), ("headline", spend.headline(cost)),
                ("task_mix", spend.task_mix(classes, cost)), ("origin_mix", spend.origin_mix(classes, cost)),
                ("coverage", spend.coverage(cost, tables["units"]))):
            upsert.replace_table(rows, paths[name])
    return paths
