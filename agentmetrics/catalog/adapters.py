"""Agent logs, commits and runs derived from the given tables.

Each event becomes one log line, each order one commit, each line item one
line of code. Shapes depend on the rows' own values, so every case the jobs
distinguish occurs, and the volume grows with the tables. The ``*_SQL`` texts
state the same derivation for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import latest_before, running
from .registry import Tables

SALT = "salt"
LINES_PER_SPLIT = 65_536
EVENTS_PER_TASK = 50_000


def _k(events: DataFrame) -> DataFrame:
    """Events with their number, dealt to tasks by count: a line costs far more to write and parse
    than an event to read, so a few row groups would leave most cores idle."""
    tasks = -(-events.count() // EVENTS_PER_TASK)
    return (events.repartition(tasks) if tasks > 1 else events).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def pick(number: Column, values: list[str | None]) -> Column:
    """values[number], as one CASE."""
    out = None
    for i, v in enumerate(values):
        value = F.lit(v).cast("string")
        out = F.when(number == i, value) if out is None else out.when(number == i, value)
    return out


def file_of(k: Column) -> Column:
    """File a given number stands for; every path class occurs."""
    n = k.cast("string")
    shapes = [("src/app/f", ".py"), ("tests/test_f", ".py"), ("docs/f", ".md"),
              (".claude/f", ".md"), ("config/f", ".yaml"), ("lib/f", ".ts"), None,
              ("web/ui/f", ".tsx"), None, ("pkg/f", "")]
    fixed = {6: "README.md", 8: "Dockerfile"}
    tens = F.floor(k / 10)
    out = None
    for i, shape in enumerate(shapes):
        value = F.lit(fixed[i]) if shape is None else F.concat(F.lit(shape[0]), n, F.lit(shape[1]))
        out = F.when(tens == i, value) if out is None else out.when(tens == i, value)
    return out


TOOL_NAMES = ["Read", "Bash", "WebSearch", "Edit", "mcp__playwright__click", "Grep", "custom", None]
MODELS = ["big-5", "mid-4-2025", "small-4", "g-5.5", "nobody"]


def log_a(t: Tables) -> DataFrame:
    """Format A lines: clicks are prompts, views assistant messages, errors and
    purchases tool results, signups everything else, broken lines included."""
    e = _k(t.events)
    k = F.col("k")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    common = [
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("sessionId"),
        stamp.alias("timestamp"), F.concat(F.lit("b"), (k % 3).cast("string")).alias("gitBranch"),
        F.concat(F.lit("/w/p"), (F.col("user_id") % 7).cast("string")).alias("cwd"),
        F.concat(F.lit("2."), (k % 5).cast("string")).alias("version"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("uuid")]
    body = (F.when(k % 13 == 0, F.lit("<command-name>x"))
            .when(k % 17 == 1, F.lit("[Request interrupted by user]"))
            .when(k % 19 == 2, F.lit("   ")).otherwise(F.concat(F.lit("do "), k.cast("string"))))
    prompt = [
        F.lit("user").alias("type"),
        F.when(k % 4 != 0, F.when(k % 2 == 1, F.lit("typed")).otherwise(F.lit("queued")))
        .alias("promptSource"),
        F.struct(F.when(k % 10 == 3, F.lit("task-notification"))
                 .when(k % 10 != 5, F.lit("human")).alias("kind")).alias("origin"),
        F.when(k % 23 == 0, F.lit(True)).alias("isMeta")]
    as_text = F.to_json(F.struct(*common, *prompt, F.struct(body.alias("content")).alias("message")))
    as_blocks = F.to_json(F.struct(*common, *prompt, F.struct(F.array(F.struct(
        F.lit("text").alias("type"), body.alias("text"))).alias("content")).alias("message")))
    usage = F.when(k % 11 != 0, F.struct(
        (k * 10).alias("input_tokens"), F.floor("value").alias("output_tokens"),
        (k * 100).alias("cache_read_input_tokens"),
        F.when(k % 3 == 0, k).alias("cache_creation_input_tokens"),
        F.when(k % 6 == 0, F.lit("fast")).alias("speed")))
    tool = pick(k % 8, TOOL_NAMES)
    assistant = F.to_json(F.struct(*common, F.lit("assistant").alias("type"), F.struct(
        F.concat(F.lit("m"), (k % 40).cast("string")).alias("id"),
        pick(k % 5, MODELS).alias("model"), usage.alias("usage"),
        F.array_compact(F.array(
            F.struct(F.lit("text").alias("type"), F.lit("ok").alias("text"),
                     F.lit(None).cast("string").alias("name")),
            F.when(tool.isNotNull(), F.struct(
                F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"),
                tool.alias("name"))))).alias("content")).alias("message")))
    result_block = F.struct(F.array(F.struct(F.lit("tool_result").alias("type")))
                            .alias("content")).alias("message")
    error = F.to_json(F.struct(*common, F.lit("user").alias("type"), result_block, F.struct(
        (k % 3 == 0).alias("interrupted")).alias("toolUseResult")))
    lines = F.concat(F.array_repeat(F.lit("+a"), k % 6), F.array_repeat(F.lit("-b"), k % 4),
                     F.array(F.lit(" c")))
    hunk = F.struct(lines.alias("lines"))
    purchase = F.to_json(F.struct(*common, F.lit("user").alias("type"), result_block, F.struct(
        file_of(k).alias("filePath"), (k % 7 == 0).alias("userModified"),
        F.when(k % 5 == 0, F.lit("create")).when(k % 5 != 1, F.lit("update")).alias("type"),
        F.when(k % 12 == 0, F.array().cast("array<struct<lines:array<string>>>"))
        .otherwise(F.array(hunk)).alias("structuredPatch")).alias("toolUseResult")))
    other = (F.when(k % 4 == 0, F.lit('{"type":"mode"}'))
             .when(k % 4 == 1, F.to_json(F.struct(
                 *common, F.lit("system").alias("type"), F.lit("turn_duration").alias("subtype"),
                 (k * 100).alias("durationMs"))))
             .when(k % 4 == 2, F.concat(F.lit('{"broken '), F.col("event_id").cast("string")))
             .otherwise(F.lit("   ")))
    kind = F.col("event_type")
    value = (F.when((kind == "click") & (k % 2 == 0), as_text).when(kind == "click", as_blocks)
             .when(kind == "view", assistant).when(kind == "error", error)
             .when(kind == "purchase", purchase).otherwise(other))
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("/logs/proj"), (F.col("user_id") % 7).cast("string"), F.lit("/u"), user,
                 F.lit(".jsonl")).alias("path"),
        F.floor(F.col("event_id") / LINES_PER_SPLIT).alias("split"),
        F.col("event_id").alias("pos"), value.alias("value"))


# one row per parsed record of log_a
LOG_A_SQL = """
ev AS (SELECT event_id, user_id, event_type, value, date_trunc('millisecond', ts) AS tm,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         lpad(CAST(user_id AS VARCHAR), 8, '0') AS sid FROM events),
ra AS (SELECT *,
         event_type = 'click' AND k % 23 <> 0 AND k % 13 <> 0 AND k % 17 <> 1 AND k % 19 <> 2
           AS is_prompt,
         event_type = 'click' AND k % 23 <> 0 AND k % 13 <> 0 AND k % 17 <> 1 AND k % 19 <> 2
           AND k % 10 <> 3 AS opens,
         event_type = 'click' AND k % 13 <> 0 AND k % 17 = 1 AS marker,
         event_type = 'error' AND k % 3 = 0 AS interrupted,
         event_type = 'purchase' AND k % 12 <> 0 AS patched,
         CASE k // 10 WHEN 0 THEN 'src/app/f' || k || '.py' WHEN 1 THEN 'tests/test_f' || k || '.py'
           WHEN 2 THEN 'docs/f' || k || '.md' WHEN 3 THEN '.claude/f' || k || '.md'
           WHEN 4 THEN 'config/f' || k || '.yaml' WHEN 5 THEN 'lib/f' || k || '.ts'
           WHEN 6 THEN 'README.md' WHEN 7 THEN 'web/ui/f' || k || '.tsx'
           WHEN 8 THEN 'Dockerfile' ELSE 'pkg/f' || k END AS fp,
         'm' || (k % 40) AS mid,
         CASE k % 5 WHEN 0 THEN 'big-5' WHEN 1 THEN 'mid-4-2025' WHEN 2 THEN 'small-4'
           WHEN 3 THEN 'g-5.5' ELSE 'nobody' END AS model,
         CASE k % 8 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'WebSearch' WHEN 3 THEN 'Edit'
           WHEN 4 THEN 'mcp__playwright__click' WHEN 5 THEN 'Grep' WHEN 6 THEN 'custom' END AS tool
       FROM ev WHERE NOT (event_type = 'signup' AND k % 4 <> 1)),
msg AS (SELECT sid, mid, arg_min(k, event_id) AS k, arg_min(value, event_id) AS value,
          arg_min(model, event_id) AS model FROM ra WHERE event_type = 'view' GROUP BY sid, mid),
tr AS (SELECT * FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY sid ORDER BY event_id) - 1 AS turn,
         lag(tm) OVER (PARTITION BY sid ORDER BY event_id) AS prev_at FROM ra) WHERE turn >= 0),
tmsg AS (SELECT sid, turn, mid, arg_min(k, event_id) AS k, arg_min(value, event_id) AS value,
          arg_min(model, event_id) AS model FROM tr WHERE event_type = 'view' GROUP BY sid, turn, mid),
tfile AS (SELECT sid, turn, fp, arg_min(k, event_id) AS k FROM tr WHERE patched GROUP BY sid, turn, fp)
"""

# flags of a path, as SQL over a column named fp
FLAGS_SQL = """
  regexp_matches(lower(fp), '(^|/)(tests?|__tests__|spec|specs)(/|$)')
    OR regexp_matches(regexp_extract(lower(fp), '([^/]*)$', 1), '(_test|\\.test|_spec|\\.spec|test_)[^/]*$')
    OR lower(fp) LIKE '%test.java' AS is_test,
  regexp_matches(lower(fp), '\\.(md|mdx|rst|txt|adoc)$')
    OR regexp_matches(lower(fp), '(^|/)(docs?|documentation)(/|$)') AS is_docs,
  lower(fp) LIKE '%.claude/%' OR lower(fp) LIKE '%claude.md%' OR lower(fp) LIKE '%.cursorrules%'
    OR lower(fp) LIKE '%.cursor/%' OR lower(fp) LIKE '%.mcp.json%' OR lower(fp) LIKE '%.codex/%'
    OR regexp_extract(lower(fp), '([^/]*)$', 1) IN ('claude.md', 'agents.md', '.claude', '.cursor', '.codex')
    AS is_agent,
  regexp_matches(lower(fp), '\\.(json|jsonl|yaml|yml|toml|ini|cfg|conf|properties|env|lock|gradle|xml)$')
    OR regexp_extract(lower(fp), '([^/]*)$', 1) IN ('dockerfile', 'makefile', 'gemfile', 'rakefile',
      'procfile', '.gitignore', '.gitattributes', '.editorconfig', '.env')
    OR regexp_matches(lower(fp), '(^|/)(\\.github|\\.circleci|config|configs)(/|$)') AS conf_like
"""

MS_SQL = "CAST(trunc((epoch_us({b}) - epoch_us({a})) / 1e6 * 1000) AS BIGINT)"


def log_b(t: Tables) -> DataFrame:
    """Format B lines from the same events."""
    e = _k(t.events)
    k, uid = F.col("k"), F.col("user_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")

    def line(kind: str, *payload: Column) -> Column:
        return F.to_json(F.struct(stamp, F.lit(kind).alias("type"),
                                  F.struct(*payload).alias("payload")))

    def event(kind: str, *payload: Column) -> Column:
        return line("event_msg", F.lit(kind).alias("type"), *payload)

    def usage(scale: int) -> Column:
        return F.struct((k * 7 * scale).alias("input_tokens"), (k * 10 * scale % 911)
                        .alias("cached_input_tokens"), (k * scale).alias("output_tokens"),
                        (k % 9).alias("cache_write_input_tokens"),
                        (k % 5).alias("reasoning_output_tokens"))

    meta = line("session_meta", F.lpad(uid.cast("string"), 8, "0").alias("id"),
                F.concat(F.lit("/w/p"), (uid % 7).cast("string")).alias("cwd"),
                F.concat(F.lit("0."), k.cast("string")).alias("cli_version"),
                F.struct(F.concat(F.lit("b"), (k % 3).cast("string")).alias("branch")).alias("git"),
                F.when(uid % 9 == 0, F.lit("parent")).alias("parent_thread_id"),
                pick(uid % 4, [None, "user", "subagent", "subagent"]).alias("thread_source"))
    context = line("turn_context",
                   F.when(k % 7 != 0, F.concat(F.lit("g-"), (k % 4).cast("string"))).alias("model"),
                   pick(k % 3, [None, "high", "low"]).alias("effort"))
    item = line("response_item", F.when(k % 6 == 5, F.lit("web_search_call"))
                .otherwise(F.lit("function_call")).alias("type"),
                pick(k % 3, ["exec_command", "shell", "apply_patch"]).alias("name"))
    tokens = event("token_count", F.struct(
        F.when(k % 2 == 0, usage(100)).alias("total_token_usage"),
        F.when(k % 4 != 1, usage(1)).alias("last_token_usage")).alias("info"))
    patch = event("patch_apply_end", F.concat(
        F.lit("Success\n"), pick(k % 2, ["A ", "M "]), file_of(k), F.lit("\nD old/x.txt\n"))
        .alias("stdout"))
    mcp = event("mcp_tool_call_end", F.struct(
        F.lit("repl").alias("server"), F.when(k % 2 == 0, F.lit("js")).alias("tool"))
        .alias("invocation"))
    kind = F.col("event_type")
    value = (F.when((kind == "signup") & (k % 5 == 0), meta).when(kind == "signup", context)
             .when(kind == "click", event("user_message", F.lit("hello").alias("message")))
             .when((kind == "view") & (k % 2 == 0), event("agent_message"))
             .when(kind == "view", item)
             .when((kind == "purchase") & (k % 3 == 0), tokens)
             .when((kind == "purchase") & (k % 3 == 1), patch).when(kind == "purchase", mcp)
             .when(k % 2 == 0, event("turn_aborted"))
             .otherwise(event("task_complete", (k * 10).alias("duration_ms"))))
    return e.select(
        F.concat(F.lit("/rollouts/2024/01/01/rollout-u"), uid.cast("string"), F.lit(".jsonl"))
        .alias("path"),
        F.floor(F.col("event_id") / LINES_PER_SPLIT).alias("split"),
        F.col("event_id").alias("pos"), value.alias("value"))


LOG_B_SQL = """
ev AS (SELECT event_id, user_id, event_type, date_trunc('millisecond', ts) AS tm,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         lpad(CAST(user_id AS VARCHAR), 8, '0') AS sid FROM events),
rb AS (SELECT *,
         event_type = 'signup' AND k % 5 = 0 AS is_meta,
         event_type = 'signup' AND k % 5 <> 0 AS is_ctx,
         CASE WHEN event_type = 'signup' AND k % 5 <> 0 AND k % 7 <> 0 THEN 'g-' || (k % 4) END AS ctx_model,
         CASE WHEN event_type = 'signup' AND k % 5 <> 0 THEN CASE k % 3 WHEN 1 THEN 'high'
           WHEN 2 THEN 'low' END END AS ctx_effort,
         event_type = 'click' AS is_prompt,
         event_type = 'view' AND k % 2 = 0 AS is_agent,
         CASE WHEN event_type = 'view' AND k % 2 = 1 THEN CASE WHEN k % 6 = 5 THEN 'web_search_call'
                WHEN k % 3 = 0 THEN 'exec_command' WHEN k % 3 = 1 THEN 'shell' ELSE 'apply_patch' END
              WHEN event_type = 'purchase' AND k % 3 = 2 THEN 'mcp__repl__' ||
                CASE WHEN k % 2 = 0 THEN 'js' ELSE '?' END END AS tool,
         event_type = 'purchase' AND k % 3 = 0 AND k % 2 = 0 AS has_total,
         event_type = 'purchase' AND k % 3 = 0 AND k % 4 <> 1 AS has_last,
         event_type = 'purchase' AND k % 3 = 1 AS patched,
         event_type = 'error' AND k % 2 = 0 AS aborted,
         CASE WHEN event_type = 'error' AND k % 2 = 1 THEN k * 10 END AS dur,
         CASE k // 10 WHEN 0 THEN 'src/app/f' || k || '.py' WHEN 1 THEN 'tests/test_f' || k || '.py'
           WHEN 2 THEN 'docs/f' || k || '.md' WHEN 3 THEN '.claude/f' || k || '.md'
           WHEN 4 THEN 'config/f' || k || '.yaml' WHEN 5 THEN 'lib/f' || k || '.ts'
           WHEN 6 THEN 'README.md' WHEN 7 THEN 'web/ui/f' || k || '.tsx'
           WHEN 8 THEN 'Dockerfile' ELSE 'pkg/f' || k END AS fp
       FROM ev),
rm AS (SELECT *, last_value(ctx_model IGNORE NULLS) OVER (PARTITION BY sid ORDER BY event_id) AS cur
       FROM rb),
t0 AS (SELECT *, sum(is_prompt::INT) OVER (PARTITION BY sid ORDER BY event_id) - 1 AS turn,
         lag(tm) OVER (PARTITION BY sid ORDER BY event_id) AS prev_at,
         last_value(CASE WHEN is_ctx THEN coalesce(ctx_model, '') END IGNORE NULLS)
           OVER (PARTITION BY sid ORDER BY event_id) AS ctx_any FROM rb),
tb AS (SELECT *, coalesce(
         last_value(ctx_model IGNORE NULLS) OVER (PARTITION BY sid, turn ORDER BY event_id),
         nullif(first_value(ctx_any) OVER (PARTITION BY sid, turn ORDER BY event_id), '')) AS unit_model
       FROM t0 WHERE turn >= 0)
"""


# -- commits from orders ------------------------------------------------------------------

GIT_NOW = "2001-06-01"


def commits(t: Tables) -> DataFrame:
    """Each order is a commit to the repo of its customer's nation."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"),
                      "o_custkey")
    o = running(o, ["o_custkey"], ["o_orderkey"], {"before": latest_before(F.col("o_orderkey"))})
    key, before = F.col("o_orderkey").cast("string"), F.sha1(F.col("before").cast("string"))
    cut = F.when(F.col("o_orderkey") % 2 == 0, before).otherwise(F.left(before, F.lit(9)))
    body = (F.when(F.col("o_orderstatus") == "P",
                   F.concat(F.lit("Merge pull request #"), key, F.lit(" from x")))
            .when(F.col("o_orderpriority") == "1-URGENT",
                  F.concat(F.lit("Fix part "), key, F.lit(" (#"), key, F.lit(")")))
            .when(F.col("o_orderpriority") == "2-HIGH",
                  F.concat(F.lit("Add "), key, F.lit("\n\nCo-Authored-By: Codex <x@y.z>")))
            .when((F.col("o_orderpriority") == "5-LOW") & before.isNotNull(),
                  F.concat(F.lit("Revert\n\nThis reverts commit "), cut, F.lit(".")))
            .otherwise(F.concat(F.lit("Work on "), key)))
    return o.select(
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("repo"),
        F.sha1(key).alias("sha"), F.col("o_orderdate").alias("at"),
        (F.col("o_orderstatus") == "P").alias("is_merge"), body.alias("body"), "o_orderkey")


def code_lines(t: Tables, commit_rows: DataFrame) -> DataFrame:
    """Each line item is one line its order's commit added to a file."""
    li = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.concat(F.lit("src/p"), (F.col("l_partkey") % 200).cast("string"), F.lit(".py")).alias("path"),
        F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("removed_at"))
    return li.join(commit_rows.select("repo", "sha", "o_orderkey"), "o_orderkey").select(
        "repo", "sha", "path", "removed_at")


def numstat(lines: DataFrame) -> DataFrame:
    """Rows of a commit in one task, so that what is summed up per commit is not shuffled again."""
    return lines.select("repo", "sha", "path").repartition("repo", "sha").groupBy("repo", "sha", "path").agg(
        F.count("*").cast("string").alias("ins"), F.lit("0").alias("del"))


def spans(lines: DataFrame) -> DataFrame:
    return lines.select("repo", F.col("sha").alias("commit_sha"), "path", "removed_at")


COMMITS_SQL = """
oc AS (SELECT o.*, 'nation' || c_nationkey AS repo, sha1(CAST(o_orderkey AS VARCHAR)) AS sha,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bk
       FROM orders o JOIN customer ON o_custkey = c_custkey),
co AS (SELECT repo, sha, o_orderdate AS tm, o_orderstatus = 'P' AS is_merge, o_orderkey, o_orderpriority,
         CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' AND bk IS NOT NULL THEN
           CASE WHEN o_orderkey % 2 = 0 THEN sha1(CAST(bk AS VARCHAR))
                ELSE left(sha1(CAST(bk AS VARCHAR)), 9) END END AS target
       FROM oc),
cl AS (SELECT repo, sha, tm, is_merge, 'src/p' || (l_partkey % 200) || '.py' AS path,
         CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS removed_at
       FROM lineitem JOIN co ON l_orderkey = o_orderkey),
sz AS (SELECT repo, sha, count(*) AS added FROM cl GROUP BY repo, sha),
tl AS (SELECT repo, tm, max(sha) AS snapshot_sha FROM co GROUP BY repo, tm),
pb AS (SELECT repo, sha, tm, d AS days, tm + to_days(d) AS target_at
       FROM co, (SELECT unnest([14, 30, 60, 90]) AS d) WHERE NOT is_merge),
sn AS (SELECT pb.*, tl.tm AS snapshot_at, tl.snapshot_sha FROM pb ASOF LEFT JOIN tl
         ON pb.repo = tl.repo AND pb.target_at >= tl.tm),
sv AS (SELECT sn.repo, sn.sha, days, count(*) FILTER (removed_at IS NULL OR removed_at > snapshot_at) AS n
       FROM sn JOIN cl ON sn.repo = cl.repo AND sn.sha = cl.sha GROUP BY sn.repo, sn.sha, days),
ms AS (SELECT sn.*, coalesce(added, 0) AS lines_original,
         CASE WHEN coalesce(added, 0) = 0 THEN 'unmeasurable'
              WHEN TIMESTAMP '2001-06-01' < target_at THEN 'not_yet_measurable'
              WHEN snapshot_sha IS NULL THEN 'unmeasurable' ELSE 'measured' END AS status,
         coalesce(n, 0) AS kept
       FROM sn LEFT JOIN sz ON sn.repo = sz.repo AND sn.sha = sz.sha
         LEFT JOIN sv ON sn.repo = sv.repo AND sn.sha = sv.sha AND sn.days = sv.days),
rw AS (SELECT repo, sha, tm, target_at,
         CASE WHEN status = 'not_yet_measurable' THEN status ELSE 'measured' END AS status,
         CASE WHEN status <> 'not_yet_measurable' THEN CASE WHEN status = 'measured'
           THEN lines_original - kept ELSE 0 END END AS lines_reworked
       FROM ms WHERE days = 14 AND lines_original > 0)
"""
