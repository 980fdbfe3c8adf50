"""Log format A: one JSON object per line, one file per session.

``records`` types the lines once; land its result as a table and run the folds
over that, so the text is parsed a single time and each fold reads only the
columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .lines import parsed

SUBAGENT_PATTERN = r"/([^/]+)/subagents/(agent-[^/]+)\.jsonl$"
BLOCK = "struct<type:string,text:string,name:string>"
SHAPE = """
  type STRING, subtype STRING, uuid STRING, sessionId STRING, timestamp STRING, cwd STRING,
  gitBranch STRING, version STRING, isMeta BOOLEAN, isSidechain BOOLEAN, promptSource STRING,
  origin STRUCT<kind: STRING>, durationMs DOUBLE, effort STRING,
  message STRUCT<id: STRING, model: STRING, content: VARIANT,
    usage: STRUCT<input_tokens: DOUBLE, output_tokens: DOUBLE, cache_read_input_tokens: DOUBLE,
      cache_creation_input_tokens: DOUBLE, speed: STRING, service_tier: STRING, effort: STRING>>,
  toolUseResult STRUCT<interrupted: BOOLEAN, userModified: BOOLEAN, filePath: STRING, type: STRING,
    structuredPatch: ARRAY<STRUCT<lines: ARRAY<STRING>>>>"""


def _of_kind(kind: str, value: str, default: str) -> Column:
    """One field of the content blocks of one kind."""
    return F.transform(F.filter("blocks", lambda b: b["type"] == kind),
                       lambda b: F.coalesce(b[value], F.lit(default)))


def _signed_lines(sign: str) -> Column:
    """Patch lines that start with the sign, over all hunks."""
    every = F.flatten(F.transform("patch", lambda h: F.coalesce(
        h["lines"], F.array().cast("array<string>"))))
    return F.size(F.filter(every, lambda line: F.coalesce(line.startswith(sign), F.lit(False))))


def records(lines: DataFrame) -> DataFrame:
    """Typed records, bookkeeping types and malformed lines left out."""
    r, m, u, t = (lambda c, p=p: F.col(f"rec.{p}{c}") for p in (
        "", "message.", "message.usage.", "toolUseResult."))
    known = F.coalesce(r("type"), r("timestamp"), r("sessionId"), r("uuid"), r("cwd"))
    kept = parsed(lines, SHAPE).where(
        known.isNotNull() & ~F.coalesce(r("type").isin(fixed.BOOKKEEPING_TYPES), F.lit(False)))

    def count(column: Column) -> Column:
        return F.coalesce(column.cast("long"), F.lit(0).cast("long"))

    usage_fields = [u(c).cast("string") for c in (
        "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
        "speed", "service_tier", "effort")]
    content = m("content")
    is_user = F.coalesce(r("type") == "user", F.lit(False))
    typed = kept.select(
        "path", "split", "pos", r("type").alias("rtype"), C.blank_to_null(r("uuid")).alias("uuid"),
        C.blank_to_null(r("sessionId")).alias("log_session_id"),
        C.blank_to_null(r("timestamp")).alias("ts_text"), C.blank_to_null(r("cwd")).alias("cwd"),
        C.blank_to_null(r("gitBranch")).alias("git_branch"),
        C.blank_to_null(r("version")).alias("tool_version"),
        F.coalesce(r("isSidechain"), F.lit(False)).alias("is_sidechain"),
        C.blank_to_null(r("promptSource")).alias("prompt_source"),
        C.blank_to_null(r("origin.kind")).alias("origin_kind"),
        F.when((r("type") == "system") & (r("subtype") == "turn_duration"),
               r("durationMs").cast("long")).alias("duration_ms"),
        F.coalesce(C.blank_to_null(m("id")), C.blank_to_null(r("uuid"))).alias("message_id"),
        C.blank_to_null(m("model")).alias("model_id"),
        F.coalesce(*usage_fields).isNotNull().alias("has_usage"),
        count(u("input_tokens")).alias("input"), count(u("output_tokens")).alias("output"),
        count(u("cache_read_input_tokens")).alias("cache_read"),
        count(u("cache_creation_input_tokens")).alias("cache_creation"),
        F.coalesce(C.blank_to_null(r("effort")), C.blank_to_null(u("effort"))).alias("effort"),
        C.blank_to_null(u("speed")).alias("speed"),
        C.blank_to_null(u("service_tier")).alias("service_tier"),
        is_user.alias("is_user"), F.coalesce(r("isMeta"), F.lit(False)).alias("is_meta"),
        # content is text or an array of blocks
        F.when(F.schema_of_variant(content) == "STRING",
               F.try_variant_get(content, "$", "string")).alias("content_text"),
        F.transform(F.try_variant_get(content, "$", "array<variant>"),
                    lambda b: F.try_variant_get(b, "$", BLOCK)).alias("blocks"),
        (is_user & F.coalesce(t("interrupted"), F.lit(False))).alias("interrupted"),
        F.coalesce(t("userModified"), F.lit(False)).alias("user_modified"),
        C.blank_to_null(t("filePath")).alias("file_path"), t("type").alias("result_type"),
        F.when(is_user & (F.size(t("structuredPatch")) > 0), t("structuredPatch")).alias("patch"))

    texts = _of_kind("text", "text", "")
    is_result = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    body = F.coalesce(F.col("content_text"), F.when(F.size(texts) > 0, F.array_join(texts, "\n")))
    marker = F.coalesce(F.col("content_text"), F.array_join(texts, " "))
    patched = F.col("patch").isNotNull()

    def of_patch(value: Column) -> Column:
        return F.when(patched, value).otherwise(0).cast("long")

    flat = typed.select(
        *[c for c in typed.columns if c not in (
            "is_user", "is_meta", "content_text", "blocks", "file_path", "result_type", "patch")],
        C.instant(F.col("ts_text")).alias("at"),
        F.when(F.col("is_user") & ~F.col("is_meta") & ~is_result, body).alias("body"),
        F.when(F.col("is_user"), C.strip(marker)).alias("marker"),
        F.when(F.col("rtype") == "assistant", _of_kind("tool_use", "name", "?")).alias("tool_names"),
        patched.alias("patched"), F.when(patched, F.col("file_path")).alias("file_path"),
        (F.col("result_type") == "create").alias("is_new_file"),
        of_patch(F.size(F.array_compact("patch"))).alias("hunks"),
        of_patch(_signed_lines("+")).alias("lines_added"),
        of_patch(_signed_lines("-")).alias("lines_removed"))
    plain = C.strip(F.col("body"))
    opening = fixed.COMMAND_MARKERS + fixed.INTERRUPT_MARKERS
    prompt = F.coalesce((plain != "") & ~C.starts_with_any(plain, opening), F.lit(False))
    notice = F.coalesce(F.col("origin_kind") == fixed.TASK_NOTIFICATION, F.lit(False))
    return flat.select(
        *[c for c in flat.columns if c != "marker"],
        F.coalesce(C.starts_with_any(F.col("marker"), fixed.INTERRUPT_MARKERS), F.lit(False))
        .alias("interrupt_marker"),
        prompt.alias("is_prompt"), (prompt & ~notice).alias("opens_unit"))


def file_identity(path: Column) -> list[Column]:
    """What the path alone says: file stem, parent session and file kind."""
    parent = C.blank_to_null(F.regexp_extract(path, SUBAGENT_PATTERN, 1))
    return [F.regexp_extract(path, r"([^/]+)\.jsonl$", 1).alias("stem"),
            parent.alias("parent_session_id"),
            parent.isNotNull().alias("is_subagent"),
            F.regexp_replace(path, r"/subagents/agent-[^/]+\.jsonl$", ".jsonl").alias("owner_path")]


def content_rows(records_a: DataFrame, sessions: DataFrame) -> DataFrame:
    """Opt-in prompt text. This is the only output that carries text."""
    prompts = records_a.where("is_prompt").select(
        "path", F.lit("user_prompt").alias("role"), F.col("uuid").alias("turn_uuid"),
        F.col("ts_text").alias("timestamp"), F.col("body").alias("text"))
    return prompts.join(sessions.select("path", "source_tool", "session_id"), "path").drop("path")
