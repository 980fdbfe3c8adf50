"""Log ingest, prompt units, segments and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import segment
from ..plans import classify, sessions_a, sessions_b, sessions_c
from ..sources import lines, logs_a, logs_b
from ..session import durable
from . import adapters as D
from .registry import SQL, Tables, query

A = "WITH " + D.LOG_A_SQL
B = "WITH " + D.LOG_B_SQL


def with_sid(df: DataFrame) -> DataFrame:
    """Short session id in place of the path the logs are keyed by."""
    number = F.regexp_extract("path", r"/(?:rollout-)?u(\d+)\.jsonl$", 1)
    return df.withColumn("sid", F.lpad(number, 8, "0")).drop("path")


def ms(a: str, b: str) -> str:
    return D.MS_SQL.format(a=a, b=b)


def records_a(t: Tables) -> DataFrame:
    return durable(logs_a.records(D.log_a(t)))


def turns_a(t: Tables) -> DataFrame:
    return durable(sessions_a.turns(records_a(t)))


def records_b(t: Tables) -> DataFrame:
    return durable(logs_b.records(D.log_b(t)))


def turns_b(t: Tables) -> DataFrame:
    return durable(sessions_b.turns(records_b(t)))


# -- format A --------------------------------------------------------------------------

@query("q_a_sessions", A + f"""
SELECT s.sid, first_branch AS git_branch, first_version AS version,
  epoch_ms(started_at) AS started_ms, epoch_ms(ended_at) AS ended_ms,
  {ms('started_at', 'ended_at')} AS wall_clock_ms, active_ms, user_messages,
  coalesce(n_msg, 0) AS assistant_messages, tool_calls, interrupted_tools, input, output, cache_read,
  cache_creation,
  CASE WHEN hunks > 0 THEN files END AS files_touched, CASE WHEN hunks > 0 THEN la END AS lines_added,
  CASE WHEN hunks > 0 THEN lr END AS lines_removed, CASE WHEN hunks > 0 THEN hunks END AS hunks,
  CASE WHEN hunks > 0 THEN um END AS user_modified, langs,
  'p_' || left(sha256('salt|/w/p' || (CAST(s.sid AS BIGINT) % 7)), 16) AS project_ref
FROM (SELECT sid, 'b' || (arg_min(k, event_id) % 3) AS first_branch,
        '2.' || (arg_min(k, event_id) % 5) AS first_version, min(tm) AS started_at, max(tm) AS ended_at,
        sum(CASE WHEN event_type = 'signup' THEN k * 100 END) AS active_ms,
        count(*) FILTER (is_prompt) AS user_messages,
        count(*) FILTER (event_type = 'view' AND tool IS NOT NULL) AS tool_calls,
        count(*) FILTER (interrupted) AS interrupted_tools,
        count(*) FILTER (patched) AS hunks, count(DISTINCT CASE WHEN patched THEN fp END) AS files,
        sum(CASE WHEN patched THEN k % 6 ELSE 0 END) AS la,
        sum(CASE WHEN patched THEN k % 4 ELSE 0 END) AS lr,
        count(*) FILTER (patched AND k % 7 = 0) AS um,
        array_to_string(list_sort(list_distinct(list(CASE WHEN patched THEN
          CASE regexp_extract(fp, '\\.([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'md' THEN 'markdown'
            WHEN 'yaml' THEN 'yaml' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' END END))), ',')
          AS langs
      FROM ra GROUP BY sid) s
LEFT JOIN (SELECT sid, count(*) AS n_msg, sum(CASE WHEN k % 11 <> 0 THEN k * 10 END) AS input,
        sum(CASE WHEN k % 11 <> 0 THEN floor(value) END)::BIGINT AS output,
        sum(CASE WHEN k % 11 <> 0 THEN k * 100 END) AS cache_read,
        sum(CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 3 = 0 THEN k ELSE 0 END END) AS cache_creation
      FROM msg GROUP BY sid) m ON s.sid = m.sid""")
def a_sessions(t: Tables) -> DataFrame:
    s = sessions_a.sessions(records_a(t), D.SALT)
    return s.select(
        F.col("session_id").alias("sid"), "git_branch", F.col("source_format_version").alias("version"),
        F.unix_millis("started_at").alias("started_ms"), F.unix_millis("ended_at").alias("ended_ms"),
        "wall_clock_ms", F.col("active_duration_ms").alias("active_ms"), "user_messages",
        "assistant_messages", "tool_calls", F.col("interrupted_tool_calls").alias("interrupted_tools"),
        "input", "output", "cache_read", "cache_creation", "files_touched", "lines_added",
        "lines_removed", "hunks", F.col("user_modified_edits").alias("user_modified"),
        F.array_join(F.coalesce("languages", F.array().cast("array<string>")), ",").alias("langs"),
        "project_ref")


@query("q_a_models", A + """
SELECT sid, model AS model_id, count(*) AS messages,
  max(CASE WHEN k % 11 <> 0 AND k % 6 = 0 THEN 'fast' END) AS speed
FROM msg GROUP BY sid, model""")
def a_models(t: Tables) -> DataFrame:
    m = sessions_a.models(records_a(t))
    return with_sid(m).select("sid", "model_id", F.col("assistant_messages").alias("messages"), "speed")


@query("q_a_tools", A + """
SELECT sid, tool AS tool_name, count(*) AS calls FROM ra
WHERE event_type = 'view' AND tool IS NOT NULL GROUP BY sid, tool""")
def a_tools(t: Tables) -> DataFrame:
    return with_sid(sessions_a.tool_calls(records_a(t), ["path"]))


@query("q_a_prompt_sources", A + """
SELECT sid, source_name, count(*) AS prompts FROM (
  SELECT sid, CASE WHEN k % 2 = 1 THEN 'typed' ELSE 'queued' END AS source_name FROM ra
    WHERE is_prompt AND k % 4 <> 0
  UNION ALL SELECT sid, CASE WHEN k % 10 = 3 THEN 'origin_task-notification' ELSE 'origin_human' END FROM ra
    WHERE is_prompt AND k % 10 <> 5) GROUP BY sid, source_name""")
def a_prompt_sources(t: Tables) -> DataFrame:
    return with_sid(sessions_a.prompt_sources(records_a(t)))


@query("q_a_content", A + """
SELECT sid, 'e' || event_id AS turn_uuid, 'do ' || k AS text FROM ra WHERE is_prompt""")
def a_content(t: Tables) -> DataFrame:
    recs = records_a(t)
    side = logs_a.content_rows(recs, sessions_a.sessions(recs, D.SALT))
    return side.select(F.col("session_id").alias("sid"), "turn_uuid", "text")


@query("q_rejects", A + """
SELECT sid, line_no, 'malformed JSON line' AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY event_id) AS line_no FROM ev)
WHERE event_type = 'signup' AND k % 4 = 2""")
def rejects(t: Tables) -> DataFrame:
    in_block = Window.partitionBy("path", "split").orderBy("pos")
    numbered = D.log_a(t).withColumn("pos", F.row_number().over(in_block).cast("long"))  # as read_lines gives it
    return with_sid(lines.rejects(numbered))


UNIT_SQL = f"""
un AS (SELECT sid, turn, epoch_ms(max(CASE WHEN opens THEN tm END)) AS started_ms,
         epoch_ms(arg_max(tm, event_id)) AS ended_ms,
         max(CASE WHEN opens THEN {ms('prev_at', 'tm')} END) AS gap_ms,
         max(CASE WHEN opens THEN 'b' || (k % 3) END) AS branch,
         bool_or(NOT opens AND interrupted) AS cut, bool_or(NOT opens AND marker) AS marked,
         sum(CASE WHEN event_type = 'signup' THEN k * 100 END) AS active_ms,
         sum(CASE WHEN patched THEN k % 6 ELSE 0 END) AS lines_added,
         sum(CASE WHEN patched THEN k % 4 ELSE 0 END) AS lines_removed,
         count(*) FILTER (event_type = 'view' AND tool IS NOT NULL) AS tool_calls
       FROM tr GROUP BY sid, turn)"""


@query("q_a_units", A + "," + UNIT_SQL + """
SELECT un.sid, CAST(un.turn AS BIGINT) AS turn, started_ms, ended_ms, gap_ms, branch, cut, marked, active_ms,
  lines_added, lines_removed, tool_calls, coalesce(n_msg, 0) AS messages, input, cache_read,
  coalesce(models, '') AS models
FROM un LEFT JOIN (SELECT sid, turn, count(*) AS n_msg, sum(CASE WHEN k % 11 <> 0 THEN k * 10 END) AS input,
    sum(CASE WHEN k % 11 <> 0 THEN k * 100 END) AS cache_read,
    array_to_string(list_sort(list(DISTINCT model)), ',') AS models
  FROM tmsg GROUP BY sid, turn) m ON un.sid = m.sid AND un.turn = m.turn""")
def a_units(t: Tables) -> DataFrame:
    u = sessions_a.units(turns_a(t))
    return with_sid(u).select(
        "sid", F.col("turn_index").cast("long").alias("turn"),
        F.unix_millis("started_at").alias("started_ms"),
        F.unix_millis("window_ended_at").alias("ended_ms"), F.col("gap_ms_before").alias("gap_ms"),
        F.col("git_branch").alias("branch"), F.col("interrupted").alias("cut"),
        F.col("interrupt_marker").alias("marked"), "active_ms", "lines_added", "lines_removed",
        "tool_calls", F.col("assistant_messages").alias("messages"), "input", "cache_read",
        F.array_join("models", ",").alias("models"))


@query("q_a_unit_files", A + f"""
SELECT sid, CAST(turn AS BIGINT) AS turn, 'f_' || left(sha256('salt|' || fp), 12) AS file_ref,
  'f_' || left(sha256('salt|dir:' || CASE WHEN fp LIKE '%/%' THEN split_part(fp, '/', 1) ELSE '<root>' END), 12)
    AS top_dir_ref,
  is_test, is_docs, is_agent, conf_like AND NOT is_docs AND NOT is_agent AS is_config,
  CASE WHEN k % 5 <> 1 THEN k % 5 = 0 END AS is_new_file
FROM (SELECT sid, turn, fp, k, {D.FLAGS_SQL} FROM tfile)""")
def a_unit_files(t: Tables) -> DataFrame:
    f = sessions_a.unit_files(turns_a(t), D.SALT)
    return with_sid(f).select(
        "sid", F.col("turn_index").cast("long").alias("turn"), "file_ref", "top_dir_ref",
        F.col("is_test_path").alias("is_test"), F.col("is_docs_path").alias("is_docs"),
        F.col("is_agent_config_path").alias("is_agent"), F.col("is_config_path").alias("is_config"),
        "is_new_file")


# -- format B --------------------------------------------------------------------------------

@query("q_b_sessions", B + f"""
SELECT sid, 'b' || (meta_k % 3) AS git_branch, '0.' || last_meta_k AS version,
  epoch_ms(started_at) AS started_ms, {ms('started_at', 'ended_at')} AS wall_clock_ms, active_ms,
  user_messages, assistant_messages, tool_calls,
  CASE WHEN tk IS NOT NULL THEN greatest(0, tk * 700 - tk * 1000 % 911) END AS input, tk * 100 AS output, tk * 1000 % 911 AS cache_read,
  tk % 9 AS cache_creation, tk % 5 AS reasoning_output, files_touched,
  CASE WHEN CAST(sid AS INT) % 9 = 0 THEN 'parent' END AS parent_id,
  CASE CAST(sid AS INT) % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS automated, meta_count
FROM (SELECT sid, arg_min(k, event_id) FILTER (is_meta) AS meta_k,
    arg_max(k, event_id) FILTER (is_meta) AS last_meta_k, min(tm) AS started_at, max(tm) AS ended_at,
    sum(dur) AS active_ms, count(*) FILTER (is_prompt) AS user_messages,
    count(*) FILTER (is_agent) AS assistant_messages, count(tool) AS tool_calls,
    arg_max(k, event_id) FILTER (has_total) AS tk, count(*) FILTER (is_meta) AS meta_count,
    CASE WHEN bool_or(patched) THEN count(DISTINCT CASE WHEN patched THEN fp END) + 1 END AS files_touched
  FROM rb GROUP BY sid) WHERE meta_k IS NOT NULL""")
def b_sessions(t: Tables) -> DataFrame:
    s = sessions_b.sessions(records_b(t), D.SALT)
    return s.select(
        F.col("session_id").alias("sid"), "git_branch", F.col("source_format_version").alias("version"),
        F.unix_millis("started_at").alias("started_ms"), "wall_clock_ms",
        F.col("active_duration_ms").alias("active_ms"), "user_messages", "assistant_messages",
        "tool_calls", "input", "output", "cache_read", "cache_creation", "reasoning_output",
        "files_touched", F.col("parent_session_id").alias("parent_id"), "automated", "meta_count")


@query("q_b_models", B + """
SELECT n.sid, n.model_id, effort, messages FROM
 (SELECT sid, ctx_model AS model_id, arg_min(ctx_effort, event_id) FILTER (ctx_effort IS NOT NULL) AS effort
  FROM rm WHERE ctx_model IS NOT NULL GROUP BY sid, ctx_model) n
 LEFT JOIN (SELECT sid, cur AS model_id, count(*) AS messages FROM rm WHERE is_agent AND cur IS NOT NULL
  GROUP BY sid, cur) s ON n.sid = s.sid AND n.model_id = s.model_id""")
def b_models(t: Tables) -> DataFrame:
    m = sessions_b.models(sessions_b.with_model(records_b(t)))
    return with_sid(m).select("sid", "model_id", "effort", F.col("assistant_messages").alias("messages"))


@query("q_b_units", B + f"""
SELECT sid, CAST(turn AS BIGINT) AS turn, epoch_ms(max(CASE WHEN is_prompt THEN tm END)) AS started_ms,
  epoch_ms(arg_max(tm, event_id)) AS ended_ms,
  max(CASE WHEN is_prompt THEN {ms('prev_at', 'tm')} END) AS gap_ms,
  count(*) FILTER (is_agent) AS messages, count(tool) AS tool_calls, bool_or(aborted) AS cut,
  sum(dur) AS active_ms, sum(CASE WHEN has_last THEN greatest(0, k * 7 - k * 10 % 911) END) AS input,
  sum(CASE WHEN has_last THEN k END) AS output, sum(CASE WHEN has_last THEN k * 10 % 911 END) AS cache_read,
  coalesce(array_to_string(list_sort(list(DISTINCT unit_model) FILTER (is_agent AND unit_model IS NOT NULL)), ','), '')
    AS models
FROM tb GROUP BY sid, turn""")
def b_units(t: Tables) -> DataFrame:
    u = sessions_b.units(turns_b(t))
    return with_sid(u).select(
        "sid", F.col("turn_index").cast("long").alias("turn"),
        F.unix_millis("started_at").alias("started_ms"),
        F.unix_millis("window_ended_at").alias("ended_ms"), F.col("gap_ms_before").alias("gap_ms"),
        F.col("assistant_messages").alias("messages"), "tool_calls", F.col("interrupted").alias("cut"),
        "active_ms", "input", "output", "cache_read", F.array_join("models", ",").alias("models"))


@query("q_b_unit_files", B + """
SELECT sid, CAST(turn AS BIGINT) AS turn, 'f_' || left(sha256('salt|' || fp), 12) AS file_ref,
  is_new AS is_new_file FROM (
  SELECT sid, turn, fp, arg_min(k % 2 = 0, event_id) AS is_new FROM tb WHERE patched GROUP BY sid, turn, fp
  UNION ALL SELECT DISTINCT sid, turn, 'old/x.txt', false FROM tb WHERE patched)""")
def b_unit_files(t: Tables) -> DataFrame:
    f = sessions_b.unit_files(turns_b(t), D.SALT)
    return with_sid(f).select("sid", F.col("turn_index").cast("long").alias("turn"), "file_ref",
                              "is_new_file")


# -- format C ----------------------------------------------------------------------------------

def headers_c(t: Tables) -> DataFrame:
    """Customers outside one market segment have a conversation header."""
    c = t.customer.where(F.col("c_mktsegment") != "BUILDING")
    whole = F.floor("c_acctbal")
    branch = F.struct(F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("branchName"))
    repo = F.struct(F.when(F.col("c_nationkey") % 2 == 0, F.array(branch))
                    .otherwise(F.array(branch, branch)).alias("branches"))
    value = F.to_json(F.struct(
        whole.alias("totalLinesAdded"), (F.col("c_custkey") % 50).alias("totalLinesRemoved"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 4).alias("filesChangedCount"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(2)).alias("numSubComposers"),
        F.array(repo).alias("trackedGitRepos")))
    start = F.lit(1_700_000_000_000) + F.col("c_custkey") * 1001
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("composer_id"),
                    start.alias("created_at"), (start + whole * 10).alias("updated_at"),
                    (F.col("c_nationkey") == 3).cast("int").alias("is_subagent"), value.alias("value"))


def attributions_c(t: Tables) -> DataFrame:
    """Orders are attribution rows of their customer's conversation."""
    source = F.when(F.col("o_orderstatus") == "F", "composer").when(
        F.col("o_orderstatus") == "O", "tab").otherwise("human")
    ext = D.pick(F.left("o_orderpriority", F.lit(1)).cast("int"), [None, "py", ".TS", None, "md", "zig"])
    return t.orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hash"), source.alias("source"),
        ext.alias("file_extension"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("conversation_id"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("g-"), (F.col("o_orderkey") % 3).cast("string"))).alias("model"),
        F.unix_millis("o_orderdate").alias("created_at"))


@query("q_c_sessions", """
WITH tm AS (SELECT 'c' || o_custkey AS sid, count(*) AS n, min(o_orderdate) AS t0, max(o_orderdate) AS t1,
    array_to_string(list_sort(list(DISTINCT CASE left(o_orderpriority, 1) WHEN '1' THEN 'python'
      WHEN '2' THEN 'typescript' WHEN '4' THEN 'markdown' WHEN '5' THEN 'zig' END)
      FILTER (left(o_orderpriority, 1) <> '3')), ',') AS langs,
    array_to_string(list_sort(list(DISTINCT 'g-' || (o_orderkey % 3))
      FILTER (o_orderstatus IN ('F', 'O') AND o_orderkey % 4 <> 0)), ',') AS models
  FROM orders GROUP BY o_custkey),
hd AS (SELECT 'c' || c_custkey AS sid, 1700000000000 + c_custkey * 1001 AS m0,
    CAST(floor(c_acctbal) AS BIGINT) AS added, c_custkey % 50 AS removed,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS files, c_nationkey,
    CASE WHEN c_custkey % 5 = 0 THEN 2 END AS subs FROM customer WHERE c_mktsegment <> 'BUILDING'),
j AS (SELECT coalesce(hd.sid, tm.sid) AS sid, hd.sid IS NOT NULL AS has_header, hd.*, tm.* FROM hd
  FULL JOIN tm ON hd.sid = tm.sid)
SELECT sid, CASE WHEN has_header THEN 'cursor_state_db' ELSE 'cursor_tracking_db' END AS log_format,
  CASE WHEN has_header THEN m0 ELSE epoch_ms(t0) END AS started_ms,
  CASE WHEN has_header THEN greatest(0, CAST(trunc(added * 10000 / 1e6 * 1000) AS BIGINT))
  ELSE CAST(trunc((epoch_us(t1) - epoch_us(t0)) / 1e6 * 1000) AS BIGINT) END AS wall_clock_ms,
  CASE WHEN added > 0 OR removed > 0 OR files > 0 THEN files END AS files_touched,
  CASE WHEN added > 0 OR removed > 0 OR files > 0 THEN added END AS lines_added,
  CASE WHEN added > 0 OR removed > 0 OR files > 0 THEN removed END AS lines_removed,
  CASE WHEN c_nationkey % 2 = 0 THEN 'b' || c_nationkey END AS git_branch, subs AS subagent_count,
  CASE WHEN c_nationkey = 3 THEN true END AS automated, coalesce(n, 0) AS attribution_rows,
  coalesce(langs, '') AS langs, coalesce(models, '') AS models FROM j""")
def c_sessions(t: Tables) -> DataFrame:
    s = sessions_c.sessions(headers_c(t), attributions_c(t), D.SALT)
    empty = F.array().cast("array<string>")
    return s.select(
        F.col("session_id").alias("sid"), "log_format", F.unix_millis("started_at").alias("started_ms"),
        "wall_clock_ms", "files_touched", "lines_added", "lines_removed", "git_branch",
        "subagent_count", "automated", "attribution_rows",
        F.array_join(F.coalesce("languages", empty), ",").alias("langs"),
        F.array_join(F.coalesce("models", empty), ",").alias("models"))


# -- segments ------------------------------------------------------------------------------------

def a_tables(t: Tables) -> dict[str, DataFrame]:
    """Units, tools and files of the format A log, keyed by session_id."""
    turned = turns_a(t)

    def keyed(df: DataFrame) -> DataFrame:
        return durable(with_sid(df).withColumnRenamed("sid", "session_id"))

    return {"units": keyed(sessions_a.units(turned)), "tools": keyed(sessions_a.unit_tools(turned)),
            "files": keyed(sessions_a.unit_files(turned, D.SALT))}


GAP = 6 * 3600 * 1000  # events are hours apart, so segments use a wider gap here

SEGMENT_SQL = f"""
su AS (SELECT un.*, lag(branch) OVER w AS pb, lag(cut) OVER w AS pc,
         coalesce(f.files, []) AS files, coalesce(f.dirs, []) AS dirs
       FROM un LEFT JOIN (SELECT sid, turn, list(DISTINCT fp) AS files, list(DISTINCT
           CASE WHEN fp LIKE '%/%' THEN split_part(fp, '/', 1) ELSE '<root>' END) AS dirs
         FROM tfile GROUP BY sid, turn) f ON un.sid = f.sid AND un.turn = f.turn
       WINDOW w AS (PARTITION BY un.sid ORDER BY un.turn)),
sg AS (SELECT sid, turn, 'session_start' AS opened, files AS sf, dirs AS sd, 0 AS seg FROM su WHERE turn = 0
  UNION ALL
  SELECT sid, turn, opened, CASE WHEN opened IS NULL THEN list_concat(sf, files) ELSE files END,
    CASE WHEN opened IS NULL THEN list_concat(sd, dirs) ELSE dirs END,
    seg + CASE WHEN opened IS NULL THEN 0 ELSE 1 END FROM (
    SELECT su.sid, su.turn, su.files, su.dirs, sg.sf, sg.sd, sg.seg,
      CASE WHEN su.gap_ms > {GAP} THEN 'turn_gap' WHEN su.branch <> su.pb THEN 'branch_change'
        WHEN len(su.files) > 0 AND len(sg.sf) > 0 AND NOT list_has_any(su.files, sg.sf)
          AND NOT list_has_any(su.dirs, sg.sd) THEN 'file_set_jump'
        WHEN su.pc THEN 'interrupt' END AS opened
    FROM sg JOIN su ON su.sid = sg.sid AND su.turn = sg.turn + 1))"""
RECURSIVE_A = A.replace("WITH ", "WITH RECURSIVE ", 1)


def a_segmented(t: Tables, tables: dict[str, DataFrame]) -> DataFrame:
    return segment.assign_segments(tables["units"], tables["files"], ["session_id"], gap_ms=GAP)


@query("q_segments_full", RECURSIVE_A + "," + UNIT_SQL + "," + SEGMENT_SQL + """
SELECT sid, CAST(turn AS BIGINT) AS turn, opened AS opened_by, CAST(seg AS BIGINT) AS segment_no FROM sg""")
def segments_full(t: Tables) -> DataFrame:
    return a_segmented(t, a_tables(t)).select(
        F.col("session_id").alias("sid"), F.col("turn_index").alias("turn"), "opened_by", "segment_no")


@query("q_segment_table", RECURSIVE_A + "," + UNIT_SQL + "," + SEGMENT_SQL + """
SELECT sg.sid || '-seg' || seg AS segment_id, CAST(min(sg.turn) AS BIGINT) AS start_turn,
  CAST(max(sg.turn) AS BIGINT) AS end_turn, min(started_ms) AS started_ms,
  arg_max(ended_ms, sg.turn) AS ended_ms, count(*) AS n_units
FROM sg JOIN un ON sg.sid = un.sid AND sg.turn = un.turn GROUP BY sg.sid, seg""")
def segment_table(t: Tables) -> DataFrame:
    s = segment.segments(a_segmented(t, a_tables(t)), ["session_id"])
    return s.select(
        segment.segment_id(F.col("session_id"), F.col("segment_no")).alias("segment_id"), "start_turn",
        "end_turn", F.unix_millis("started_at").alias("started_ms"),
        F.unix_millis("ended_at").alias("ended_ms"), "n_units")


@query("q_segments_gap", A + "," + UNIT_SQL + f"""
SELECT sid, CAST(turn AS BIGINT) AS turn, opened_by,
  CAST(sum((opened_by IS NOT NULL)::INT) OVER (PARTITION BY sid ORDER BY turn) - 1 AS BIGINT) AS segment_no
FROM (SELECT *, CASE WHEN turn = 0 THEN 'session_start' WHEN gap_ms > {GAP} THEN 'turn_gap'
    WHEN branch <> lag(branch) OVER w THEN 'branch_change' WHEN lag(cut) OVER w THEN 'interrupt' END AS opened_by
  FROM un WINDOW w AS (PARTITION BY sid ORDER BY turn))""")
def segments_gap(t: Tables) -> DataFrame:
    """Boundaries that need no file sets."""
    units = a_tables(t)["units"]
    return segment.assign_segments(units, None, ["session_id"], gap_ms=GAP).select(
        F.col("session_id").alias("sid"), F.col("turn_index").alias("turn"), "opened_by", "segment_no")


@query("q_session_window", """
SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM (
  SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR
      THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, grp""")
def session_window(t: Tables) -> DataFrame:
    """Gap-only segments in batch. A gap of exactly the limit stays inside."""
    runs = segment.gap_sessions(t.events, "user_id", "ts", "event_id", GAP)
    return runs.select("user_id", F.unix_millis("first_at").alias("first_ms"),
                       F.unix_millis("last_at").alias("last_ms"), "n")


# -- features and labels ----------------------------------------------------------------------------

def features_sql(keys: str, on: str, src: str = "u") -> str:
    """Features per group; ``seg`` is joined in where the group is a segment."""
    return f"""
ft AS (SELECT {keys}, sum(n) AS calls, sum(n) FILTER (tool = 'mcp__playwright__click') AS browser,
         sum(n) FILTER (tool = 'WebSearch') AS web, sum(n) FILTER (tool IN ('Read', 'Grep')) AS rd,
         sum(n) FILTER (tool = 'Bash') AS sh
       FROM (SELECT sid, turn, tool, count(*) AS n FROM tr WHERE event_type = 'view' AND tool IS NOT NULL
             GROUP BY sid, turn, tool) x {on.format(a='x')} GROUP BY {keys}),
fl AS (SELECT {keys}, fp, arg_max(k, x.turn) AS k FROM tfile x {on.format(a='x')} GROUP BY {keys}, fp),
ff AS (SELECT {keys}, count(*) AS files, count(*) FILTER (k % 5 = 0) AS fresh,
         count(DISTINCT CASE WHEN fp LIKE '%/%' THEN split_part(fp, '/', 1) ELSE '<root>' END) AS dirs,
         avg(is_test::INT) AS ftest, avg(is_docs::INT) AS fdocs, avg(is_agent::INT) AS fagent,
         avg((conf_like AND NOT is_docs AND NOT is_agent)::INT) AS fconf
       FROM (SELECT *, {D.FLAGS_SQL} FROM fl) GROUP BY {keys}),
fu AS (SELECT {keys}, count(*) AS n_units, sum(lines_added) AS la, sum(lines_removed) AS lr,
         bool_or(cut) AS cut FROM un x {on.format(a='x')} GROUP BY {keys}),
fe AS (SELECT {", ".join("fu." + k for k in keys.split(", "))}, n_units, la, lr, cut, coalesce(calls, 0) AS calls,
         coalesce(browser, 0) AS browser, coalesce(web, 0) AS web, coalesce(rd, 0) AS rd,
         coalesce(sh, 0) AS sh, coalesce(files, 0) AS files, coalesce(fresh, 0) AS fresh,
         coalesce(dirs, 0) AS dirs, coalesce(ftest, 0) AS ftest, coalesce(fdocs, 0) AS fdocs,
         coalesce(fagent, 0) AS fagent, coalesce(fconf, 0) AS fconf
       FROM fu LEFT JOIN ft USING ({keys}) LEFT JOIN ff USING ({keys}))"""


RULE_SQL = """CASE WHEN browser >= 3 AND browser >= calls * 0.3 THEN 'R01-browser-loop'
  WHEN files > 0 AND browser >= 1 THEN 'R01b-browser-present-edits'
  WHEN files > 0 AND fagent >= 0.5 THEN 'R02-agent-config-paths'
  WHEN files > 0 AND fdocs >= 0.99 THEN 'R03-docs-paths-only'
  WHEN files > 0 AND ftest >= 0.6 THEN 'R04-test-paths-majority'
  WHEN files > 0 AND fconf >= 0.99 THEN 'R05-config-paths-only'
  WHEN files = 0 AND calls = 0 THEN 'R06-no-activity'
  WHEN files = 0 AND rd + web > 0 AND sh <= rd + web THEN 'R07-read-search-no-edits'
  WHEN files = 0 THEN 'R08-shell-only-unclassified'
  WHEN fresh >= 3 AND (la IS NULL OR lr IS NULL OR lr <= 0.15 * greatest(la, 1)) THEN 'R09-new-file-burst'
  WHEN files = 1 AND la + lr > 0 AND la + lr <= 40 AND lr > 0 THEN 'R10-single-small-balanced'
  WHEN files >= 3 AND fresh = 0 AND lr > 0 AND la <= 1.5 * lr THEN 'R11-balanced-multifile'
  ELSE 'R12-edit-default' END"""
LABEL_SQL = """CASE left(rule_id, 3) WHEN 'R01' THEN 'ui_verification_loop' WHEN 'R02' THEN 'agent_meta_work'
  WHEN 'R03' THEN 'documentation' WHEN 'R04' THEN 'test_authoring' WHEN 'R05' THEN 'config_infra'
  WHEN 'R06' THEN 'exploratory_qa' WHEN 'R07' THEN 'exploratory_qa' WHEN 'R09' THEN 'boilerplate_scaffolding'
  WHEN 'R10' THEN 'single_file_bug_fix' WHEN 'R11' THEN 'multi_file_refactor'
  WHEN 'R12' THEN 'feature_implementation' END"""
CONFIDENCE_SQL = """CASE left(rule_id, 4) WHEN 'R01-' THEN 0.7 WHEN 'R01b' THEN 0.55 WHEN 'R02-' THEN 0.7
  WHEN 'R03-' THEN 0.75 WHEN 'R04-' THEN 0.65 WHEN 'R05-' THEN 0.7 WHEN 'R06-' THEN 0.7
  WHEN 'R07-' THEN CASE WHEN web > 0 THEN 0.75 ELSE 0.6 END WHEN 'R08-' THEN 0.5 WHEN 'R09-' THEN 0.6
  WHEN 'R10-' THEN 0.45 WHEN 'R11-' THEN 0.5 ELSE 0.55 END"""


@query("q_features", A + "," + UNIT_SQL + "," + features_sql("sid", "") + """
SELECT sid, n_units, la, lr, cut, calls, browser, web, rd, sh, files, fresh, dirs, ftest, fdocs, fagent, fconf
FROM fe""")
def features(t: Tables) -> DataFrame:
    a = a_tables(t)
    f = classify.unit_features(a["units"], a["tools"], a["files"], ["session_id"])
    return f.select(
        F.col("session_id").alias("sid"), "n_units", F.col("lines_added").alias("la"),
        F.col("lines_removed").alias("lr"), F.col("interrupted").alias("cut"),
        F.col("tool_calls").alias("calls"), F.col("calls_browser").alias("browser"),
        F.col("calls_web").alias("web"), F.col("calls_read").alias("rd"), F.col("calls_shell").alias("sh"),
        F.col("files_edited").alias("files"), F.col("new_files").alias("fresh"),
        F.col("top_dirs").alias("dirs"), F.col("frac_test").alias("ftest"),
        F.col("frac_docs").alias("fdocs"), F.col("frac_agent").alias("fagent"),
        F.col("frac_config").alias("fconf"))


def verdict_columns(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in classify.VERDICT], "rule_id", "task_type",
                     "status", "confidence", "context_breadth")


VERDICT_SQL = f"""rule_id, {LABEL_SQL} AS task_type,
  CASE left(rule_id, 3) WHEN 'R08' THEN 'unclassified' WHEN 'R10' THEN 'ambiguous' ELSE 'classified' END AS status,
  CAST({CONFIDENCE_SQL} AS DOUBLE) AS confidence,
  CASE WHEN files > 0 AND dirs >= 2 THEN 'cross_module' WHEN files > 0 AND dirs = 1 THEN 'localized'
    ELSE 'unknown' END AS context_breadth"""


@query("q_rules", A + "," + UNIT_SQL + "," + features_sql("sid, turn", "") + f"""
SELECT sid, CAST(turn AS BIGINT) AS turn, {VERDICT_SQL} FROM (SELECT *, {RULE_SQL} AS rule_id FROM fe)""")
def rules(t: Tables) -> DataFrame:
    """Labels at prompt grain."""
    a = a_tables(t)
    f = classify.unit_features(a["units"], a["tools"], a["files"], ["session_id", "turn_index"])
    return classify.label(f).select(
        F.col("session_id").alias("sid"), F.col("turn_index").cast("long").alias("turn"), "rule_id",
        "task_type", "status", "confidence", "context_breadth")


SEGMENT_FEATURES = features_sql(
    "sid, seg", "JOIN (SELECT sid AS s1, turn AS t1, seg FROM sg) g ON {a}.sid = s1 AND {a}.turn = t1")


@query("q_rules_segment", RECURSIVE_A + "," + UNIT_SQL + "," + SEGMENT_SQL + "," + SEGMENT_FEATURES + f"""
SELECT sid, CAST(seg AS BIGINT) AS segment_no, {VERDICT_SQL} FROM (SELECT *, {RULE_SQL} AS rule_id FROM fe)""")
def rules_segment(t: Tables) -> DataFrame:
    """Labels at segment grain."""
    a = a_tables(t)
    assigned = a_segmented(t, a)
    member = assigned.select("session_id", "turn_index", "segment_no")
    on = ["session_id", "turn_index"]
    f = classify.unit_features(assigned, a["tools"].join(member, on), a["files"].join(member, on),
                               ["session_id", "segment_no"])
    return classify.label(f).select(F.col("session_id").alias("sid"), "segment_no", "rule_id",
                                    "task_type", "status", "confidence", "context_breadth")


def c_tools(t: Tables) -> DataFrame:
    """Orders as tool calls of their customer's session."""
    name = D.pick(F.left("o_orderpriority", F.lit(1)).cast("int"),
                  [None, "Read", "Bash", "WebFetch", "exec", "browser_open"])
    return t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("session_id"),
                           name.alias("tool_name")).groupBy("session_id", "tool_name").agg(
        F.count("*").alias("calls"))


@query("q_rules_fallback", """
WITH tl AS (SELECT 'c' || o_custkey AS sid, count(*) AS calls,
    count(*) FILTER (left(o_orderpriority, 1) = '5') AS browser,
    count(*) FILTER (left(o_orderpriority, 1) = '3') AS web, count(*) FILTER (left(o_orderpriority, 1) = '1') AS rd,
    count(*) FILTER (left(o_orderpriority, 1) IN ('2', '4')) AS sh,
    count(*) FILTER (left(o_orderpriority, 1) <> '3') > 0 AS any_lang,
    bool_and(left(o_orderpriority, 1) IN ('3', '4')) AS docs_only
  FROM orders GROUP BY o_custkey),
hd AS (SELECT 'c' || c_custkey AS sid, c_mktsegment <> 'BUILDING' AS has_header,
    CAST(floor(c_acctbal) AS BIGINT) AS added, c_custkey % 50 AS removed,
    CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 4 END AS nfiles FROM customer),
fe AS (SELECT hd.sid, coalesce(calls, 0) AS calls, coalesce(browser, 0) AS browser, coalesce(web, 0) AS web,
    coalesce(rd, 0) AS rd, coalesce(sh, 0) AS sh,
    CASE WHEN has_header AND (added > 0 OR removed > 0 OR nfiles > 0) THEN coalesce(nfiles, 0) ELSE 0 END AS files,
    0 AS fresh, 0 AS dirs, 0 AS ftest, 0 AS fagent, 0 AS fconf,
    CASE WHEN has_header AND nfiles > 0 AND any_lang AND docs_only THEN 1 ELSE 0 END AS fdocs,
    CASE WHEN has_header AND (added > 0 OR removed > 0 OR nfiles > 0) THEN added END AS la,
    CASE WHEN has_header AND (added > 0 OR removed > 0 OR nfiles > 0) THEN removed END AS lr
  FROM hd LEFT JOIN tl ON hd.sid = tl.sid WHERE has_header OR calls > 0)
SELECT sid, """ + VERDICT_SQL + f" FROM (SELECT *, {RULE_SQL} AS rule_id FROM fe)")
def rules_fallback(t: Tables) -> DataFrame:
    """Labels of sessions that have no units, from their own aggregates."""
    s = sessions_c.sessions(headers_c(t), attributions_c(t), D.SALT).withColumn(
        "interrupted_tool_calls", F.lit(None).cast("long"))
    f = classify.session_features(s, c_tools(t), ["session_id"])
    return classify.label(f).select(F.col("session_id").alias("sid"), "rule_id", "task_type", "status",
                                    "confidence", "context_breadth")


def all_classes(t: Tables) -> DataFrame:
    a = a_tables(t)
    sessions = sessions_c.sessions(headers_c(t), attributions_c(t), D.SALT).withColumn(
        "interrupted_tool_calls", F.lit(None).cast("long"))
    # one population: the sessions of the logs with units, and the header sessions without
    logged = a["units"].select("session_id").distinct()
    return classify.classify_all(sessions.unionByName(logged, allowMissingColumns=True), c_tools(t),
                                 a["units"], a["tools"], a["files"])


def summary_sql(unit: str, labelled: str) -> str:
    return f"""SELECT '{unit}' AS unit, count(*) AS records, count(*) FILTER (task_type IS NULL) AS unclassified,
  count(*) FILTER (task_type IS NULL) / count(*) AS unclassified_share FROM ({labelled})"""


BY_RULE = f"SELECT {VERDICT_SQL} FROM (SELECT *, {RULE_SQL} AS rule_id FROM fe)"


@query("q_class_summary", " UNION ALL ".join([
    summary_sql("prompt", A + "," + UNIT_SQL + "," + features_sql("sid, turn", "") + BY_RULE),
    summary_sql("segment", RECURSIVE_A + "," + UNIT_SQL + "," + SEGMENT_SQL.replace(
        f"> {GAP}", "> 1800000") + "," + SEGMENT_FEATURES + BY_RULE),
    summary_sql("session", f"""SELECT task_type FROM ({A + "," + UNIT_SQL + "," + features_sql("sid", "") + BY_RULE})
      UNION ALL SELECT task_type FROM ({SQL["q_rules_fallback"]})""")]))
def class_summary(t: Tables) -> DataFrame:
    """Labels at all grains, counted. The gap is the 30 minutes of the rule set."""
    return classify.summary(all_classes(t))


@query("q_dominant_label", RECURSIVE_A + "," + UNIT_SQL + "," + SEGMENT_SQL + "," + features_sql("sid, turn", "") + f"""
, lb AS (SELECT sid, turn, la, {LABEL_SQL} AS task FROM (SELECT *, {RULE_SQL} AS rule_id FROM fe)),
ct AS (SELECT lb.sid, seg, task, count(*) AS n, sum(la) AS vol FROM lb JOIN sg ON lb.sid = sg.sid
  AND lb.turn = sg.turn WHERE task IS NOT NULL GROUP BY lb.sid, seg, task),
mx AS (SELECT *, rank() OVER (PARTITION BY sid, seg ORDER BY n DESC, vol DESC) AS r FROM ct)
SELECT sid, CAST(seg AS BIGINT) AS segment_no, min(task) AS task_type, max(n) AS n,
  CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'classified' END AS status
FROM mx WHERE r = 1 GROUP BY sid, seg""")
def dominant_label(t: Tables) -> DataFrame:
    a = a_tables(t)
    on = ["session_id", "turn_index"]
    f = classify.label(classify.unit_features(a["units"], a["tools"], a["files"], on))
    member = a_segmented(t, a).select(*on, "segment_no")
    labelled = f.where(F.col("task_type").isNotNull()).join(member, on)
    out = classify.dominant_label(labelled, ["session_id", "segment_no"], "lines_added")
    return out.select(F.col("session_id").alias("sid"), "segment_no", "task_type", "n", "status")


@query("q_tool_family", """
SELECT fam, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'browser'
  WHEN 'purchase' THEN 'edit' WHEN 'error' THEN 'shell' ELSE 'other' END AS fam FROM events) GROUP BY fam""")
def tool_family(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    name = (F.when(kind == "view", "Read").when(kind == "click", "My_Computer")
            .when(kind == "purchase", "apply_patch").when(kind == "error", "exec").otherwise(kind))
    return t.events.groupBy(C.tool_family(name).alias("fam")).agg(F.count("*").alias("n"))


@query("q_path_flags", f"""
SELECT page_id, is_test, is_docs, is_agent, conf_like AND NOT is_docs AND NOT is_agent AS is_config
FROM (SELECT page_id, {D.FLAGS_SQL} FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS fp FROM pages))""")
def path_flags(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", r"[?#].*$", "")
    return t.pages.select("page_id", C.is_test_path(path).alias("is_test"),
                          C.is_docs_path(path).alias("is_docs"),
                          C.is_agent_config_path(path).alias("is_agent"),
                          C.is_config_path(path).alias("is_config"))


@query("q_salted_refs", """
SELECT page_id, 'p_' || left(sha256('salt|' || url), 16) AS project_ref,
  'r_' || left(sha256('salt|' || url), 16) AS repo_ref, 'f_' || left(sha256('salt|' || url), 12) AS file_ref,
  'f_' || left(sha256('salt|dir:' || split_part(url, '/', 1)), 12) AS top_dir_ref FROM pages""")
def salted_refs(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", C.project_ref(D.SALT, u).alias("project_ref"),
                          C.repo_ref(D.SALT, u).alias("repo_ref"), C.file_ref(D.SALT, u).alias("file_ref"),
                          C.top_dir_ref(D.SALT, u).alias("top_dir_ref"))


@query("q_fork_families", """
SELECT doc_id, CASE WHEN orig <> doc_id THEN orig END AS fork_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS orig FROM documents)""")
def fork_families(t: Tables) -> DataFrame:
    """Copies of a document as sessions that share their first prompt."""
    s = t.documents.select(F.col("doc_id").alias("session_id"), F.lit(0).alias("started_at"),
                           F.sha2("text", 256).alias("first_prompt_uuid"))
    return sessions_a.mark_forks(s).select(F.col("session_id").alias("doc_id"), "fork_of")
