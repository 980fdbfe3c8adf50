"""Sessions and prompt units from format B records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.keyed import count_if, earliest, final
from ..operators.scan import ROWS_PER_BLOCK, latest, latest_before, rows_per_key, running, running_sum
from ..sources.lines import ORDER, position
from ..sources.logs_a import file_identity
from ..sources.logs_b import patched_files

TOKENS = fixed.TOKEN_BUCKETS

UNIT = ["path", "turn_index"]


def uncached_input(usage: str) -> Column:
    """Vendor input counts include cached tokens; buckets here do not overlap."""
    return F.greatest(F.lit(0), F.col(f"{usage}.raw_input") - F.col(f"{usage}.cached"))


def with_model(records: DataFrame, limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """Carry the last named model forward over the file."""
    return running(records, ["path"], ORDER, {"current_model": latest(F.col("context_model"))},
                   limit=limit)


def sessions(records: DataFrame, salt: str) -> DataFrame:
    """One row per file with a meta record and a timestamp."""
    is_meta = F.col("meta").isNotNull()
    per_file = records.groupBy("path").agg(
        F.min_by("meta", F.when(is_meta, position())).alias("first_meta"),
        F.max_by("meta", F.when(is_meta, position())).alias("last_meta"),
        count_if(is_meta).alias("meta_count"),
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"),
        count_if(F.col("is_prompt")).alias("user_messages"),
        count_if(F.col("is_agent_message")).alias("assistant_messages"),
        count_if(F.col("tool_name").isNotNull()).alias("tool_calls"),
        count_if(F.col("aborted")).alias("turn_aborts"),
        F.sum("duration_ms").alias("active_duration_ms"),
        final(F.col("total_usage"), position()).alias("total"),
    ).where(F.col("first_meta").isNotNull() & F.col("started_at").isNotNull())
    edited = (patched_files(records, ["path"]).select("path", "file_path").distinct()
              .groupBy("path").agg(
                  F.count("*").alias("files_touched"),
                  F.array_sort(F.collect_set(C.language_of_path(F.col("file_path"))))
                  .alias("languages")))
    return (per_file.join(edited, "path", "left")
            .select("*", *file_identity(F.col("path"))[:1])
            .select(
                "path", F.lit("codex").alias("source_tool"),
                F.coalesce("first_meta.thread_id", "stem").alias("session_id"),
                F.col("last_meta.cli_version").alias("source_format_version"),
                C.project_ref(salt, F.col("first_meta.cwd")).alias("project_ref"),
                F.col("first_meta.cwd").alias("cwd"),
                F.col("first_meta.git_branch").alias("git_branch"),
                "started_at", "ended_at",
                C.ms_between(F.col("started_at"), F.col("ended_at")).alias("wall_clock_ms"),
                "active_duration_ms", "user_messages", "assistant_messages", "tool_calls",
                F.when(F.col("total").isNotNull(), uncached_input("total")).alias("input"),
                F.col("total.output").alias("output"),
                F.col("total.cached").alias("cache_read"),
                F.col("total.cache_write").alias("cache_creation"),
                F.col("total.reasoning").alias("reasoning_output"),
                "files_touched",
                F.when(F.size("languages") > 0, F.col("languages")).alias("languages"),
                F.col("first_meta.parent_thread_id").alias("parent_session_id"),
                (F.col("first_meta.thread_source") != "user").alias("automated"),
                "meta_count", "turn_aborts"))


def models(in_model: DataFrame) -> DataFrame:
    """Every model a turn named, with its messages (null when none) and the
    first effort given for it."""
    named = in_model.where(F.col("context_model").isNotNull()).groupBy(
        "path", F.col("context_model").alias("model_id")).agg(
        earliest(F.col("context_effort"), position()).alias("effort"))
    said = (in_model.where(F.col("is_agent_message") & F.col("current_model").isNotNull())
            .groupBy("path", F.col("current_model").alias("model_id"))
            .agg(F.count("*").alias("assistant_messages")))
    return named.join(said, ["path", "model_id"], "left")


def tool_calls(records: DataFrame, keys: list[str]) -> DataFrame:
    return (records.where(F.col("tool_name").isNotNull()).groupBy(*keys, "tool_name")
            .agg(F.count("*").alias("calls")))


def turns(records: DataFrame, limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """Turn index and the model in force for each record.

    A turn starts with the model of the nearest context record at or before its
    prompt, even if that names none; later context records in the turn count
    only if they name one.
    """
    top, _ = rows_per_key(records, ["path"])
    first = running(records, ["path"], ORDER, {
        "prompts": running_sum(F.col("is_prompt").cast("int")),
        "ts_before": latest_before(F.col("ts_text")),
        "context": latest(F.when(F.col("is_context"), F.struct(F.col("context_model").alias("m")))),
    }, limit=limit, top=top)
    first = (first.withColumn("turn_index", F.col("prompts") - 1)
             .where(F.col("turn_index") >= 0).drop("prompts"))
    second = running(first, ["path"], ORDER, {
        "named": latest(F.when(F.col("context_model").isNotNull(),
                               F.struct("turn_index", F.col("context_model").alias("m")))),
        "seed": latest(F.when(F.col("is_prompt"), F.struct(F.col("context.m").alias("m")))),
    }, limit=limit, top=top)
    in_force = (F.when(F.col("named.turn_index") == F.col("turn_index"), F.col("named.m"))
                .otherwise(F.col("seed.m")))
    return second.withColumn("turn_model", in_force).drop("named", "seed", "context")


def units(in_turns: DataFrame) -> DataFrame:
    request = F.col("request_usage").isNotNull()
    folded = in_turns.groupBy(*UNIT).agg(
        F.max(F.when(F.col("is_prompt"), F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("is_prompt"), F.col("ts_before"))).alias("ts_before"),
        final(F.col("ts_text"), position()).alias("last_ts"),
        count_if(F.col("is_agent_message")).alias("assistant_messages"),
        count_if(F.col("tool_name").isNotNull()).alias("tool_calls"),
        F.bool_or("aborted").alias("interrupted"),
        F.sum("duration_ms").alias("active_ms"),
        F.sum(F.when(request, uncached_input("request_usage"))).alias("input"),
        F.sum("request_usage.output").alias("output"),
        F.sum("request_usage.cached").alias("cache_read"),
        F.sum("request_usage.cache_write").alias("cache_creation"),
        F.array_sort(F.collect_set(F.when(F.col("is_agent_message"), F.col("turn_model"))))
        .alias("models"))
    return folded.select(
        *UNIT, "started_at", C.instant(F.col("last_ts")).alias("window_ended_at"),
        C.ms_between(C.instant(F.col("ts_before")), F.col("started_at")).alias("gap_ms_before"),
        "assistant_messages", "tool_calls", "interrupted", "active_ms", *TOKENS, "models",
        F.lit(None).cast("long").alias("lines_added"),
        F.lit(None).cast("long").alias("lines_removed"))


def unit_tools(in_turns: DataFrame) -> DataFrame:
    return tool_calls(in_turns, UNIT)


def unit_files(in_turns: DataFrame, salt: str) -> DataFrame:
    """Files patched per unit; the first line naming a path speaks for it."""
    path = F.col("file_path")
    rows = patched_files(in_turns, [*UNIT, *ORDER])
    first = rows.groupBy(*UNIT, "file_path").agg(F.min_by("change", position()).alias("change"))
    return first.select(
        *UNIT, C.file_ref(salt, path).alias("file_ref"),
        C.top_dir_ref(salt, path).alias("top_dir_ref"),
        C.path_extension(path).alias("extension"), *C.path_flag_columns(path),
        (F.col("change") == "A").alias("is_new_file"))
