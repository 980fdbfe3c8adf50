"""From raw sources to upserted session, unit and child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators import upsert
from ..session import durable, job_scratch
from ..sources import lines, logs_a, logs_b
from ..sources.registry import Extract, extract_from, normalise, register
from . import sessions_a, sessions_b, sessions_c

KEY = ["source_tool", "session_id"]


def _named(child: DataFrame | None, sessions: DataFrame) -> DataFrame | None:
    """Child rows keyed by session in place of the file path."""
    if child is None:
        return None
    return child.join(sessions.select("path", *KEY), "path").drop("path")


@register("claude-code")
def from_logs_a(spark: SparkSession, path: str, salt: str) -> Extract:
    raw = lines.read_lines(spark, path)
    records = durable(logs_a.records(raw))
    found = sessions_a.mark_forks(sessions_a.sessions(records, salt)).join(
        lines.file_digests(raw), "path")
    sessions, turned = durable(found), durable(sessions_a.turns(records))
    return Extract(
        sessions.drop("first_prompt_uuid"), _named(sessions_a.units(turned), sessions),
        _named(sessions_a.unit_tools(turned), sessions),
        _named(sessions_a.unit_files(turned, salt), sessions),
        _named(sessions_a.models(records), sessions),
        _named(sessions_a.tool_calls(records, ["path"]), sessions),
        _named(sessions_a.prompt_sources(records), sessions),
        logs_a.content_rows(records, sessions), lines.rejects(raw))


@register("codex")
def from_logs_b(spark: SparkSession, path: str, salt: str) -> Extract:
    raw = lines.read_lines(spark, path)
    records = durable(logs_b.records(raw))
    found = sessions_b.sessions(records, salt).join(lines.file_digests(raw), "path")
    sessions, turned = durable(found), durable(sessions_b.turns(records))
    # units of this format carry their session's branch
    units = sessions_b.units(turned).join(sessions.select("path", "git_branch"), "path")
    return Extract(
        sessions, _named(units, sessions), _named(sessions_b.unit_tools(turned), sessions),
        _named(sessions_b.unit_files(turned, salt), sessions),
        _named(sessions_b.models(sessions_b.with_model(records)), sessions),
        _named(sessions_b.tool_calls(records, ["path"]), sessions),
        content=logs_b.content_rows(records, sessions), rejects=lines.rejects(raw))


@register("cursor")
def from_tables_c(spark: SparkSession, headers: DataFrame, attributions: DataFrame,
                  salt: str) -> Extract:
    """Headers and attribution rows are landed tables, e.g. from ``read_database``."""
    found = sessions_c.sessions(headers, attributions, salt)
    models = found.where("models is not null").select(
        *KEY, F.explode("models").alias("model_id"))
    return Extract(found.withColumn("path", F.col("log_format")).drop("models"), models=models)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an exported database, where its driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def session_rules() -> dict[str, Column]:
    """Checks of a session row; absent measures pass, negative ones do not."""
    def measured(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) >= 0

    return {
        "session_id: required": C.blank_to_null(F.col("session_id")).isNotNull(),
        "source_tool: known": F.col("source_tool").isin(fixed.SOURCE_TOOLS),
        "started_at: required": F.col("started_at").isNotNull(),
        "content_hash: required": F.col("content_hash").isNotNull(),
        **{f"{c}: not negative": measured(c) for c in (
            "wall_clock_ms", "user_messages", "assistant_messages", "tool_calls",
            *fixed.TOKEN_BUCKETS, "files_touched", "lines_added", "lines_removed")}}


#: Columns of a stored session; a source that cannot measure one leaves it null.
SESSION_TYPES = {
    **{c: "string" for c in (
        "source_tool", "session_id", "log_format", "source_format_version", "project_ref", "git_branch",
        "parent_session_id", "fork_of", "source_path", "content_hash")},
    **{c: "timestamp" for c in ("started_at", "ended_at")},
    **{c: "bigint" for c in (
        "wall_clock_ms", "active_duration_ms", "user_messages", "assistant_messages", "tool_calls",
        "interrupted_tool_calls", *fixed.TOKEN_BUCKETS, "reasoning_output", "files_touched", "lines_added",
        "lines_removed", "hunks", "user_modified_edits", "subagent_count", "attribution_rows")},
    "automated": "boolean", "languages": "array<string>"}
UNIT_TYPES = {"git_branch": "string", "interrupt_marker": "boolean"}


def projected(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """With every named column, null where the source has none; others stay."""
    lacking = [F.lit(None).cast(kind).alias(c) for c, kind in types.items() if c not in df.columns]
    return df.select("*", *lacking)


def union_all(frames: list[DataFrame | None]) -> DataFrame | None:
    present = [f for f in frames if f is not None]
    if not present:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def extract(spark: SparkSession, sources: dict[str, dict], out: str, salt: str,
            include_content: bool = False) -> DataFrame:
    """Read sources, upsert their tables under ``out`` and return the manifest.

    Any set of sources gives the same columns. Sessions keep their stored row
    while their content and both versions are unchanged; the child rows of a
    session in the batch are replaced as a whole. Invalid sessions, with the rules
    they fail, and lines that could not be read are written to ``errors`` and
    counted in the manifest. What is landed on the way, text included, is deleted
    when the job ends.
    """
    with job_scratch(spark):
        parts = [extract_from(spark, name, salt=salt, **where) for name, where in sources.items()]
        every = union_all([projected(p.sessions.withColumn("source_path", F.col("path")), SESSION_TYPES)
                           for p in parts]).drop("path", "cwd")
        stamped = every.select(
            "*", F.lit(fixed.SESSION_SCHEMA_VERSION).alias("schema_version"),
            F.lit(fixed.CONNECTOR_VERSION).alias("connector_version"),
            F.current_timestamp().alias("extracted_at"))
        checked = durable(upsert.check(stamped, session_rules()))
        good = upsert.valid(checked)
        stored = upsert.read_or_empty(spark, f"{out}/sessions", good.schema)
        merged = durable(upsert.merge(stored, good, KEY))

        children = {
            "units": [p.units and projected(p.units, UNIT_TYPES) for p in parts],
            "unit_tools": [p.unit_tools for p in parts], "unit_files": [p.unit_files for p in parts],
            "models": [p.models for p in parts], "tools": [p.tools for p in parts],
            "prompt_sources": [p.prompt_sources for p in parts]}
        accepted = good.select(*KEY)
        for name, frames in children.items():
            batch = union_all(frames)
            if batch is not None:
                batch = durable(batch.join(accepted, KEY, "left_semi"))
                held = upsert.read_or_empty(spark, f"{out}/{name}", batch.schema)
                upsert.replace_table(upsert.replace_by_key(held, batch, KEY, accepted), f"{out}/{name}")
        if include_content:
            upsert.append_new(spark, f"{out}/content", union_all([p.content for p in parts]))
        # sessions last: until they are swapped a job that died is done again from the start,
        # and no reader sees a session whose units are older than itself
        upsert.replace_table(merged.drop("outcome"), f"{out}/sessions")
        unread = union_all([p.rejects and p.rejects.withColumn("source_tool", F.lit(normalise(name)))
                            for name, p in zip(sources, parts)])
        bad = upsert.invalid(checked).select(
            "source_tool", F.col("source_path").alias("path"), F.lit(None).cast("long").alias("line_no"),
            F.explode("errors").alias("reason"))
        (bad if unread is None else bad.unionByName(unread.select(
            "source_tool", "path", F.col("line_no").cast("long"), "reason"))).write.mode("append").parquet(
            f"{out}/errors")
        report = durable(upsert.manifest(merged, checked, "source_tool", "started_at", "ended_at", unread))
        report.write.mode("append").parquet(f"{out}/manifests")
        return spark.createDataFrame(report.collect(), report.schema)  # a row for each source


def session_records(sessions: DataFrame, models: DataFrame, tools: DataFrame,
                    prompt_sources: DataFrame) -> DataFrame:
    """Nested session records. Written as JSON, null parts are absent; arrays
    hold one entry per distinct model or tool of the session."""
    used = models.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "model_id", "assistant_messages", "effort", "speed", "service_tier"))).alias("models"))
    calls = tools.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(
        "tool_name", F.col("calls").alias("count")))).alias("tool_call_pattern"))
    origins = prompt_sources.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct(
        "source_name", "prompts"))).alias("prompt_source_counts"))

    def part(name: str, *fields: str) -> Column:
        return F.when(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull(),
                      F.struct(*fields)).alias(name)

    return (sessions.join(used, KEY, "left").join(calls, KEY, "left").join(origins, KEY, "left")
            .select(
                "schema_version", *KEY, "project_ref", "git_branch",
                C.iso_text(F.col("started_at")).alias("started_at"),
                C.iso_text(F.col("ended_at")).alias("ended_at"),
                F.lit(False).alias("end_observed"), "wall_clock_ms", "active_duration_ms",
                part("turns", "user_messages", "assistant_messages", "tool_calls",
                     "interrupted_tool_calls"),
                part("tokens", *fixed.TOKEN_BUCKETS, "reasoning_output"),
                part("diff_stats", "files_touched", "lines_added", "lines_removed", "hunks",
                     "user_modified_edits"),
                "models", "tool_call_pattern", "prompt_source_counts", "languages",
                "parent_session_id", "fork_of", "automated",
                F.struct("content_hash", "connector_version", "source_format_version")
                .alias("provenance")))


def name_map(candidates: DataFrame, cwd_to_repo: DataFrame, salt: str,
             eval_marker: str) -> DataFrame:
    """Display names of project references, from the directories logs mention."""
    in_repo = cwd_to_repo.select("cwd", F.lit(True).alias("in_repo"))
    return candidates.join(in_repo, "cwd", "left").groupBy(
        C.project_ref(salt, F.col("cwd")).alias("project_ref")).agg(F.min(C.display_name(
            F.col("cwd"), F.coalesce("in_repo", F.lit(False)), eval_marker)).alias("display_name"))
