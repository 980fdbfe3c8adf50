"""Sessions from format C: conversation headers and line-attribution rows.

Both are landed tables. ``headers`` has composer_id, created_at, updated_at
(epoch numbers), is_subagent and ``value``, the header's JSON text;
``attributions`` has hash, source, file_extension, conversation_id, model,
created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources import variant as V


def attribution_totals(attributions: DataFrame) -> DataFrame:
    """Rows, span, languages and models per conversation."""
    by_tool = F.col("source").isin("composer", "tab")
    return (attributions.where(C.blank_to_null(F.col("conversation_id")).isNotNull())
            .groupBy(F.col("conversation_id").alias("session_id")).agg(
        F.count("*").alias("attribution_rows"),
        F.min(F.when(F.col("created_at") != 0, F.col("created_at"))).alias("first_at"),
        F.max(F.when(F.col("created_at") != 0, F.col("created_at"))).alias("last_at"),
        F.array_sort(F.collect_set(C.language_of_extension(F.col("file_extension"))))
        .alias("languages"),
        F.array_sort(F.collect_set(F.when(by_tool, C.blank_to_null(F.col("model")))))
        .alias("models"),
        # order-free digest of the rows, for change detection
        F.bit_xor(F.xxhash64("hash", "source", "model", "file_extension", "created_at"))
        .alias("rows_digest"),
    ))


def _number(value: Column, path: str) -> Column:
    """A field that is a whole number; anything else counts as absent."""
    whole = V.kind_of(V.field(value, path, "variant")).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    return F.when(whole, V.field(value, path, "long"))


def sessions(headers: DataFrame, attributions: DataFrame, salt: str) -> DataFrame:
    """Header sessions with their attribution totals, and attribution-only
    sessions for conversations without a header."""
    v = F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}")))
    repos = V.items(v, "trackedGitRepos")
    branches = V.items(F.get(repos, F.lit(0)), "branches")
    added, removed, files = (_number(v, k) for k in (
        "totalLinesAdded", "totalLinesRemoved", "filesChangedCount"))

    def positive(value: Column) -> Column:
        return F.coalesce(value > 0, F.lit(False))

    changed = positive(added) | positive(removed) | positive(files)
    known = headers.select(
        F.col("composer_id").alias("session_id"), F.sha2("value", 256).alias("header"),
        C.epoch_instant(F.col("created_at")).alias("header_start"),
        C.epoch_instant(F.col("updated_at")).alias("header_end"),
        F.coalesce(V.text(v, "workspaceIdentifier.uri.fsPath"),
                   V.text(v, "workspaceIdentifier.uri.path")).alias("cwd"),
        F.when((F.size(repos) == 1) & (F.size(branches) == 1),
               V.field(F.get(branches, F.lit(0)), "branchName", "string")).alias("git_branch"),
        F.when(changed, files).alias("files_touched"),
        F.when(changed, added).alias("lines_added"),
        F.when(changed, removed).alias("lines_removed"),
        _number(v, "numSubComposers").alias("subagent_count"),
        F.coalesce(F.col("is_subagent") != 0, F.lit(False)).alias("is_subagent"),
        F.lit(True).alias("has_header"))
    joined = known.join(attribution_totals(attributions), "session_id", "full")
    from_header = F.coalesce(F.col("has_header"), F.lit(False))
    start = F.when(from_header, F.col("header_start")).otherwise(C.epoch_instant(F.col("first_at")))
    end = F.when(from_header, F.col("header_end")).otherwise(C.epoch_instant(F.col("last_at")))
    return joined.select(
        "session_id", F.lit("cursor").alias("source_tool"),
        F.when(from_header, F.lit("cursor_state_db")).otherwise(F.lit("cursor_tracking_db"))
        .alias("log_format"),
        C.project_ref(salt, F.col("cwd")).alias("project_ref"), "cwd", "git_branch",
        start.alias("started_at"), end.alias("ended_at"),
        C.ms_between(start, end).alias("wall_clock_ms"),
        F.when(F.size("models") > 0, F.col("models")).alias("models"),
        "files_touched", "lines_added", "lines_removed",
        F.when(F.size("languages") > 0, F.col("languages")).alias("languages"),
        "subagent_count",
        F.when(F.col("is_subagent"), F.lit(True)).alias("automated"),
        F.coalesce("attribution_rows", F.lit(0)).alias("attribution_rows"),
        # every part under its name, so that a missing one cannot stand for another
        F.sha2(F.to_json(F.struct(
            "session_id", start.cast("string").alias("start"), end.cast("string").alias("end"),
            "header", "attribution_rows", "rows_digest")), 256).alias("content_hash"),
    ).where(F.col("started_at").isNotNull())
