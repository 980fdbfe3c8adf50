"""Log format B: one {timestamp, type, payload} envelope per line, one file per
thread, kept in a YYYY/MM/DD tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .lines import parsed

TOKEN_FIELDS = {"raw_input": "input_tokens", "cached": "cached_input_tokens",
                "cache_write": "cache_write_input_tokens", "output": "output_tokens",
                "reasoning": "reasoning_output_tokens"}
USAGE = "STRUCT<" + ", ".join(f"{f}: DOUBLE" for f in TOKEN_FIELDS.values()) + ">"
SHAPE = f"""
  timestamp STRING, type STRING, payload STRUCT<
    type: STRING, id: STRING, session_id: STRING, cwd: STRING, cli_version: STRING,
    git: STRUCT<branch: STRING>, parent_thread_id: STRING, thread_source: STRING,
    model: STRING, effort: STRING, message: STRING,
    info: STRUCT<total_token_usage: {USAGE}, last_token_usage: {USAGE}>,
    duration_ms: DOUBLE, invocation: STRUCT<server: STRING, tool: STRING>, stdout: STRING,
    name: STRING>"""


def _usage(path: str) -> Column:
    """Token counts of one usage object; null when it is absent or empty."""
    present = F.coalesce(*[F.col(f"{path}.{f}") for f in TOKEN_FIELDS.values()]).isNotNull()
    return F.when(present, F.struct(*[
        F.coalesce(F.col(f"{path}.{name}").cast("long"), F.lit(0).cast("long")).alias(alias)
        for alias, name in TOKEN_FIELDS.items()]))


def records(lines: DataFrame) -> DataFrame:
    """Typed records; malformed lines left out."""
    rtype, ptype = F.col("rec.type"), F.col("rec.payload.type")

    def p(name: str) -> Column:
        return C.blank_to_null(F.col(f"rec.payload.{name}"))

    event, item = rtype == "event_msg", rtype == "response_item"
    is_meta, is_context = rtype == "session_meta", rtype == "turn_context"
    unnamed = F.lit("?")
    tool = (F.when(item & ptype.isin("function_call", "custom_tool_call"),
                   F.coalesce(p("name"), unnamed))
            .when(item & ptype.isin("web_search_call", "tool_search_call"), ptype)
            .when(event & (ptype == "mcp_tool_call_end"), F.concat(
                F.lit("mcp__"), F.coalesce("rec.payload.invocation.server", unnamed),
                F.lit("__"), F.coalesce("rec.payload.invocation.tool", unnamed))))

    def on(kind: str) -> Column:
        return F.coalesce(event & (ptype == kind), F.lit(False))

    rows = parsed(lines, SHAPE).where(F.coalesce("rec.type", "rec.timestamp").isNotNull())
    ts_text = C.blank_to_null(F.col("rec.timestamp"))
    return rows.select(
        "path", "split", "pos", rtype.alias("rtype"), ts_text.alias("ts_text"),
        C.instant(ts_text).alias("at"),
        F.when(is_meta, F.struct(
            F.coalesce(p("id"), p("session_id")).alias("thread_id"), p("cwd").alias("cwd"),
            p("cli_version").alias("cli_version"), p("git.branch").alias("git_branch"),
            p("parent_thread_id").alias("parent_thread_id"),
            F.col("rec.payload.thread_source").alias("thread_source"))).alias("meta"),
        F.coalesce(is_context, F.lit(False)).alias("is_context"),
        F.when(is_context, p("model")).alias("context_model"),
        F.when(is_context, p("effort")).alias("context_effort"),
        on("user_message").alias("is_prompt"),
        F.when(on("user_message"), p("message")).alias("body"),
        on("agent_message").alias("is_agent_message"),
        F.when(on("token_count"), _usage("rec.payload.info.total_token_usage")).alias("total_usage"),
        F.when(on("token_count"), _usage("rec.payload.info.last_token_usage")).alias("request_usage"),
        F.when(on("task_complete"), F.col("rec.payload.duration_ms").cast("long"))
        .alias("duration_ms"),
        on("turn_aborted").alias("aborted"), tool.alias("tool_name"),
        F.when(on("patch_apply_end"), p("stdout")).alias("patch_output"))


def patched_files(records_b: DataFrame, keep: list[str]) -> DataFrame:
    """``A path``, ``M path`` and ``D path`` lines of patch output."""
    line = F.explode(F.split("patch_output", r"\r\n|[\n\r]"))
    entry = (records_b.where(F.col("patch_output").isNotNull()).select(*keep, line.alias("line"))
             .select(*keep, F.regexp_extract("line", r"^\s*([AMD])\s+(.*\S)\s*$", 1).alias("change"),
                     F.regexp_extract("line", r"^\s*([AMD])\s+(.*\S)\s*$", 2).alias("file_path")))
    return entry.where(F.col("change") != "")


def content_rows(records_b: DataFrame, sessions: DataFrame) -> DataFrame:
    """Opt-in prompt text. This is the only output that carries text."""
    prompts = records_b.where(F.col("is_prompt") & F.col("body").isNotNull()).select(
        "path", F.lit("user_prompt").alias("role"), F.col("ts_text").alias("timestamp"),
        F.col("body").alias("text"))
    return prompts.join(sessions.select("path", "source_tool", "session_id"), "path").drop("path")
