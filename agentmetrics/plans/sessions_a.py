"""Sessions and prompt units from format A records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.keyed import count_if, earliest, final, first_per_key
from ..operators.scan import ROWS_PER_BLOCK, latest_before, running, running_sum
from ..sources.lines import ORDER, position
from ..sources.logs_a import file_identity

TOKENS = fixed.TOKEN_BUCKETS



def messages(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per message: a message repeats once per content block with the
    same usage, and only its first record counts."""
    return first_per_key(
        records.where(F.col("rtype") == "assistant"), [*keys, "message_id"], ORDER,
        [*ORDER, "model_id", "has_usage", *TOKENS, "effort", "speed", "service_tier"])


def message_totals(per_message: DataFrame, keys: list[str]) -> DataFrame:
    return per_message.groupBy(*keys).agg(
        F.count("*").alias("assistant_messages"),
        *[F.sum(F.when(F.col("has_usage"), F.col(t))).alias(t) for t in TOKENS])


def tool_calls(records: DataFrame, keys: list[str]) -> DataFrame:
    """Calls per tool, counted over all records rather than per message."""
    return (records.where(F.size("tool_names") > 0)
            .select(*keys, F.explode("tool_names").alias("tool_name"))
            .groupBy(*keys, "tool_name").agg(F.count("*").alias("calls")))


def sessions(records: DataFrame, salt: str) -> DataFrame:
    """One row per file that has a timestamped record."""
    per_file = records.groupBy("path").agg(
        earliest(F.col("log_session_id"), position()).alias("log_session_id"),
        earliest(F.col("cwd"), position()).alias("cwd"),
        earliest(F.col("git_branch"), position()).alias("git_branch"),
        earliest(F.col("tool_version"), position()).alias("source_format_version"),
        F.min_by("uuid", F.when(F.col("is_prompt"), position())).alias("first_prompt_uuid"),
        F.min("at").alias("started_at"),
        F.max("at").alias("ended_at"),
        F.sum("duration_ms").alias("active_duration_ms"),
        count_if(F.col("is_prompt")).alias("user_messages"),
        count_if(F.col("interrupted")).alias("interrupted_tool_calls"),
        F.bool_or("is_sidechain").alias("is_sidechain"),
        F.sum("hunks").alias("hunks"),
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_removed").alias("lines_removed"),
        count_if(F.col("patched") & F.col("user_modified")).alias("user_modified_edits"),
    ).where(F.col("started_at").isNotNull())
    edited = (records.where(F.col("file_path").isNotNull()).select("path", "file_path").distinct()
              .groupBy("path").agg(
                  F.count("*").alias("files_touched"),
                  F.array_sort(F.collect_set(C.language_of_path(F.col("file_path"))))
                  .alias("languages")))
    totals = message_totals(messages(records, ["path"]), ["path"])
    calls = tool_calls(records, ["path"]).groupBy("path").agg(F.sum("calls").alias("tool_calls"))
    named = per_file.select("*", *file_identity(F.col("path")))
    subagents = (named.where("is_subagent").groupBy(F.col("owner_path").alias("path"))
                 .agg(F.count("*").alias("subagent_count")))

    def zero(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    changed = (zero("files_touched") > 0) | (F.col("hunks") > 0)
    return (named.join(edited, "path", "left").join(totals, "path", "left")
            .join(calls, "path", "left").join(subagents, "path", "left")
            .select(
                "path", F.lit("claude_code").alias("source_tool"),
                F.when(F.col("is_subagent"), F.concat_ws("/", "parent_session_id", "stem"))
                .otherwise(F.coalesce("log_session_id", "stem")).alias("session_id"),
                "source_format_version",
                C.project_ref(salt, F.col("cwd")).alias("project_ref"),
                "cwd", "git_branch", "started_at", "ended_at",
                C.ms_between(F.col("started_at"), F.col("ended_at")).alias("wall_clock_ms"),
                "active_duration_ms", "user_messages",
                zero("assistant_messages").alias("assistant_messages"),
                zero("tool_calls").alias("tool_calls"),
                "interrupted_tool_calls", *TOKENS,
                *[F.when(changed, zero(c)).alias(c)
                  for c in ("files_touched", "lines_added", "lines_removed", "hunks",
                            "user_modified_edits")],
                F.when(F.size("languages") > 0, F.col("languages")).alias("languages"),
                F.when(~F.col("is_subagent"), zero("subagent_count")).alias("subagent_count"),
                "is_sidechain", "parent_session_id",
                F.when(F.col("is_subagent"), F.lit(True)).alias("automated"),
                "first_prompt_uuid"))


def models(records: DataFrame) -> DataFrame:
    """Message count and first known settings per file and model."""
    return (messages(records, ["path"]).where(F.col("model_id").isNotNull())
            .groupBy("path", "model_id").agg(
                F.count("*").alias("assistant_messages"),
                *[earliest(F.col(c), position()).alias(c)
                  for c in ("effort", "speed", "service_tier")]))


def prompt_sources(records: DataFrame) -> DataFrame:
    """Prompts per recorded source and per recorded origin."""
    named = records.where("is_prompt").select("path", F.explode(F.array_compact(F.array(
        "prompt_source", F.concat(F.lit("origin_"), F.col("origin_kind"))))).alias("source_name"))
    return named.groupBy("path", "source_name").agg(F.count("*").alias("prompts"))


def mark_forks(sessions_a: DataFrame) -> DataFrame:
    """Point the later members of a fork family at its earliest session.

    A family shares the id of its first prompt record.
    """
    keyed = sessions_a.where(F.col("first_prompt_uuid").isNotNull())
    original = keyed.groupBy("first_prompt_uuid").agg(
        F.min_by("session_id", F.struct("started_at", "session_id")).alias("original_id"))
    return (sessions_a.join(original, "first_prompt_uuid", "left")
            .withColumn("fork_of", F.when(F.col("original_id") != F.col("session_id"),
                                          F.col("original_id")))
            .drop("original_id"))


def turns(records: DataFrame, limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """Give each record the 0-based index of the prompt it follows; records
    before the first prompt are dropped."""
    scanned = running(records, ["path"], ORDER, {
        "prompts": running_sum(F.col("opens_unit").cast("int")),
        "ts_before": latest_before(F.col("ts_text")),
    }, limit=limit)
    return (scanned.withColumn("turn_index", F.col("prompts") - 1)
            .where(F.col("turn_index") >= 0).drop("prompts"))


UNIT = ["path", "turn_index"]


def units(in_turns: DataFrame) -> DataFrame:
    """One row per prompt and its response window, without the child tables."""
    window = in_turns.where(~F.col("opens_unit"))
    has_file = F.col("file_path").isNotNull()
    folded = in_turns.groupBy(*UNIT).agg(
        F.max(F.when(F.col("opens_unit"), F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("opens_unit"), F.col("ts_text"))).alias("ts_text"),
        F.max(F.when(F.col("opens_unit"), F.col("ts_before"))).alias("ts_before"),
        F.max(F.when(F.col("opens_unit"), F.col("git_branch"))).alias("git_branch"),
        F.max(F.when(F.col("opens_unit"), F.col("prompt_source"))).alias("prompt_source"),
        F.max(F.when(F.col("opens_unit"), F.col("origin_kind"))).alias("origin_kind"),
        final(F.col("ts_text"), position()).alias("last_ts"),
        F.bool_or(~F.col("opens_unit") & F.col("interrupted")).alias("interrupted"),
        F.bool_or(~F.col("opens_unit") & F.col("interrupt_marker")).alias("interrupt_marker"),
        F.sum(F.when(~F.col("opens_unit"), F.col("duration_ms"))).alias("active_ms"),
        F.sum(F.when(~F.col("opens_unit") & has_file, F.col("lines_added")).otherwise(0))
        .alias("lines_added"),
        F.sum(F.when(~F.col("opens_unit") & has_file, F.col("lines_removed")).otherwise(0))
        .alias("lines_removed"),
    )
    per_message = messages(window, UNIT)
    totals = message_totals(per_message, UNIT)
    calls = tool_calls(window, UNIT).groupBy(*UNIT).agg(F.sum("calls").alias("tool_calls"))
    used = (per_message.where(F.col("model_id").isNotNull()).groupBy(*UNIT)
            .agg(F.array_sort(F.collect_set("model_id")).alias("models")))
    return (folded.join(totals, UNIT, "left").join(calls, UNIT, "left").join(used, UNIT, "left")
            .select(*UNIT, "started_at", C.instant(F.col("last_ts")).alias("window_ended_at"),
                    C.ms_between(C.instant(F.col("ts_before")), F.col("started_at"))
                    .alias("gap_ms_before"),
                    "git_branch", "prompt_source", "origin_kind",
                    F.coalesce("assistant_messages", F.lit(0)).alias("assistant_messages"),
                    F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
                    "interrupted", "interrupt_marker", "active_ms", *TOKENS,
                    F.coalesce("models", F.array().cast("array<string>")).alias("models"),
                    "lines_added", "lines_removed"))


def unit_tools(in_turns: DataFrame) -> DataFrame:
    return tool_calls(in_turns.where(~F.col("opens_unit")), UNIT)


def unit_files(in_turns: DataFrame, salt: str) -> DataFrame:
    """Files edited per unit; the first edit of a path in the window speaks for it."""
    edits = in_turns.where(~F.col("opens_unit") & F.col("file_path").isNotNull())
    path = F.col("file_path")
    return first_per_key(edits, [*UNIT, "file_path"], ORDER, ["is_new_file"]).select(
        *UNIT, C.file_ref(salt, path).alias("file_ref"),
        C.top_dir_ref(salt, path).alias("top_dir_ref"),
        C.path_extension(path).alias("extension"), *C.path_flag_columns(path), "is_new_file")
