"""Commit outcomes, session joins and fix mining."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import asof, latest, latest_before, running, running_sum
from ..plans import mining, outcome_store, outcomes
from ..session import durable, scratch_folder
from . import adapters as D
from .registry import Tables, query

GIT = "WITH " + D.COMMITS_SQL
NOW = datetime(2001, 6, 1)


def git(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Commits and their lines, landed once for the joins that follow."""
    commits = durable(D.commits(t))
    return commits, durable(D.code_lines(t, commits))


def facts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    commits, lines = git(t)
    kept, _ = outcomes.newest_commits(commits, cap=None)
    sizes = outcomes.change_sizes(D.numstat(lines))
    return commits, lines, outcomes.measured_by_spans(
        outcomes.counted_spans(kept, commits, sizes, D.spans(lines)), NOW)


@query("q_asof_snapshot", """
WITH f AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
p AS (SELECT o_custkey, o_orderkey AS probe_key, d AS days, o_orderdate + to_days(d) AS target
  FROM orders, (SELECT unnest([30, 60, 90]) AS d))
SELECT p.o_custkey, probe_key, days, f.o_orderkey AS snapshot_key FROM p ASOF LEFT JOIN f
  ON p.o_custkey = f.o_custkey AND p.target >= f.o_orderdate""")
def asof_snapshot(t: Tables) -> DataFrame:
    """Each customer's latest order 30, 60 and 90 days after each order."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    probes = o.select("o_custkey", F.col("o_orderkey").alias("probe_key"), "o_orderdate",
                      F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))).alias("days")).select(
        "o_custkey", "probe_key", "days",
        outcomes.days_after(F.col("o_orderdate"), F.col("days")).alias("target"))
    return asof(probes, o, ["o_custkey"], "target", "o_orderdate", {"snapshot_key": "o_orderkey"},
                tie="o_orderkey").drop("target")


@query("q_running_blocks", """
WITH o AS (SELECT nullif(o_orderpriority, '5-LOW') AS lane, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS mark FROM orders)
SELECT o_orderkey, CAST(sum(price) OVER w AS BIGINT) AS spent, last_value(mark IGNORE NULLS) OVER w AS last_mark,
  last_value(mark IGNORE NULLS) OVER (PARTITION BY lane ORDER BY o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark_before
FROM o WINDOW w AS (PARTITION BY lane ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_blocks(t: Tables) -> DataFrame:
    """Running values in blocks of at most a thousand rows, one key being null."""
    o = t.orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("lane"), "o_orderkey",
                        F.floor("o_totalprice").cast("long").alias("price"),
                        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("mark"))
    return running(o, ["lane"], ["o_orderkey"], {
        "spent": running_sum(F.col("price")), "last_mark": latest(F.col("mark")),
        "mark_before": latest_before(F.col("mark"))}, limit=1000).select(
        "o_orderkey", "spent", "last_mark", "mark_before")


@query("q_survival", GIT + """
SELECT repo, sha, days AS horizon_days, status, lines_original,
  CASE WHEN status = 'measured' THEN kept END AS lines_surviving,
  CASE WHEN status = 'measured' THEN round_even(kept / lines_original, 4) END AS surviving_fraction
FROM ms WHERE days <> 14""")
def survival(t: Tables) -> DataFrame:
    return outcomes.survival(facts(t)[2]).drop("at", "target_at")


@query("q_rework", GIT + """
SELECT repo, sha, status, lines_reworked, lines_reworked > 0 AS occurred FROM rw""")
def rework(t: Tables) -> DataFrame:
    return outcomes.rework(facts(t)[2]).select("repo", "sha", "status", "lines_reworked", "occurred")


@query("q_rework_commits", GIT + """
, fl AS (SELECT DISTINCT repo, sha, tm, is_merge, path FROM cl),
pr AS (SELECT DISTINCT rw.repo, rw.sha, t.sha AS other, t.tm AS t_at FROM rw
  JOIN fl f ON f.repo = rw.repo AND f.sha = rw.sha
  JOIN fl t ON t.repo = f.repo AND t.path = f.path AND NOT t.is_merge
    AND t.tm >= rw.tm + INTERVAL 1 SECOND AND t.tm <= rw.target_at AND t.sha <> rw.sha
  WHERE rw.lines_reworked > 0)
SELECT repo, sha, other AS rework_sha, row_number() OVER (PARTITION BY repo, sha ORDER BY t_at DESC, other DESC) AS nth,
  count(*) OVER (PARTITION BY repo, sha) AS "of" FROM pr""")
def rework_commits(t: Tables) -> DataFrame:
    commits, lines, measured = facts(t)
    measured = durable(measured)
    stats = D.numstat(lines)
    return outcomes.rework_commits(outcomes.rework(measured), outcomes.added_files(stats),
                                   outcomes.touched_files(stats), commits)


@query("q_blame_survival", GIT + """
SELECT sn.repo, sn.sha, count(*) AS surviving FROM sn JOIN cl ON sn.repo = cl.repo AND sn.sha = cl.sha
WHERE days = 30 AND (removed_at IS NULL OR removed_at > snapshot_at) GROUP BY sn.repo, sn.sha""")
def blame_survival(t: Tables) -> DataFrame:
    """The count from blame rows, here of the 30-day snapshots."""
    commits, lines = git(t)
    kept, _ = outcomes.newest_commits(commits, cap=None)
    snaps = outcomes.snapshots(kept, commits, [30])
    there = F.col("removed_at").isNull() | (F.col("removed_at") > F.col("snapshot_at"))
    blame = lines.join(snaps.select("repo", "sha", "snapshot_sha", "snapshot_at"), ["repo", "sha"]).where(
        there).select("repo", "snapshot_sha", "path", F.col("sha").alias("commit_sha"))
    files = outcomes.added_files(D.numstat(lines))
    return outcomes.surviving_by_blame(snaps, files, blame).drop("days")


@query("q_repo_survival", GIT + """
SELECT repo, days AS horizon_days, count(*) AS commits_measured, sum(lines_original) AS lines_original,
  sum(kept) AS lines_surviving, round_even(sum(kept) / sum(lines_original), 3) AS line_survival_rate
FROM ms WHERE days <> 14 AND status = 'measured' GROUP BY repo, days""")
def repo_survival(t: Tables) -> DataFrame:
    return outcomes.repo_survival(outcomes.survival(facts(t)[2]))


@query("q_upper_median", GIT + """
SELECT repo, list_sort(list(round_even(kept / lines_original, 4)))[count(*) // 2 + 1] AS upper_median,
  count(*) AS n FROM ms WHERE days = 30 AND status = 'measured' GROUP BY repo""")
def upper_median(t: Tables) -> DataFrame:
    s = outcomes.survival(facts(t)[2]).where("horizon_days = 30 AND status = 'measured'")
    return outcomes.upper_median(s, ["repo"], "surviving_fraction")


REVERT_SQL = """, mk AS (SELECT repo, target, max(struct_pack(tm := tm, sha := sha)) AS m FROM co
  WHERE target IS NOT NULL GROUP BY repo, target),
rv AS (SELECT c.repo, c.sha, coalesce(e.m.sha, p.m.sha) AS revert_sha FROM co c
  LEFT JOIN mk e ON e.repo = c.repo AND e.target = c.sha
  LEFT JOIN mk p ON p.repo = c.repo AND len(p.target) < 40 AND p.target = left(c.sha, 9)
  WHERE NOT c.is_merge)"""


@query("q_reverts", GIT + REVERT_SQL + """
SELECT repo, sha, revert_sha AS revert_commit_sha, revert_sha IS NOT NULL AS reverted,
  CASE WHEN revert_sha IS NOT NULL THEN 'git_revert_marker' END AS revert_detection FROM rv""")
def reverts(t: Tables) -> DataFrame:
    commits = durable(D.commits(t))
    kept, _ = outcomes.newest_commits(commits, cap=None)
    return outcomes.reverts(kept, outcomes.revert_markers(commits))


def members(commits: DataFrame) -> DataFrame:
    """The first merge that brought a commit in: here those of the same repo bring in all commits
    up to a week older. Only the first counts, so merges are reduced to it per repo and day before commits join."""
    def first(merges: DataFrame, *by: str) -> DataFrame:
        row = F.struct("merged_at", "merge_sha", "pr_number")
        return merges.groupBy(*by).agg(F.min_by(row, F.struct("merged_at", "merge_sha")).alias("first"))

    merges = outcomes.merge_numbers(commits).withColumnRenamed("sha", "merge_sha")
    days = first(merges, "repo", "merged_at").select("repo", "first.*").withColumn(
        "day", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(
        "at", F.col("merged_at") - F.make_dt_interval("day"))
    opening = durable(first(days, "repo", "at").select("repo", "at", "first.*"))
    return commits.where(~F.col("is_merge")).select("repo", "sha", "at").join(opening, ["repo", "at"]).drop("at")


@query("q_pr_numbers", GIT + """
, mg AS (SELECT c.repo, c.sha, min(struct_pack(tm := m.tm, s := m.sha, pr := m.o_orderkey)).pr AS pr
  FROM co c JOIN co m ON m.is_merge AND m.repo = c.repo AND m.tm >= c.tm AND m.tm <= c.tm + INTERVAL 7 DAY
  WHERE NOT c.is_merge GROUP BY c.repo, c.sha)
SELECT co.repo, co.sha, coalesce(mg.pr, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS pr_number
FROM co LEFT JOIN mg ON co.repo = mg.repo AND co.sha = mg.sha WHERE NOT is_merge""")
def pr_numbers(t: Tables) -> DataFrame:
    """The first of the merges that brought a commit in names its PR."""
    commits = durable(D.commits(t))
    kept, _ = outcomes.newest_commits(commits)
    return outcomes.pull_requests(kept, members(commits))


def scores(t: Tables) -> DataFrame:
    """Vendor scores of orders above a price, of some on two branches; the dearest
    lack the counts."""
    price = F.floor("o_totalprice").cast("long")
    known = F.col("o_totalprice") < 400_000
    branch = F.explode(F.when(price % 5 == 0, F.array(F.lit("main"), F.lit("topic"))).otherwise(F.array(F.lit("main"))))
    return t.orders.where("o_totalprice > 250000").withColumn("branch", branch).select(
        F.sha1(F.col("o_orderkey").cast("string")).alias("sha"), "branch",
        F.when(known, price % 10 + F.when(F.col("branch") == "topic", 1).otherwise(0)).alias("tab"),
        (price % 7).alias("composer"), (price % 4).alias("human"),
        F.when(price % 3 == 0, "1").alias("v1"), F.when(price % 2 == 0, "2").alias("v2"))


ATTRIBUTION_SQL = """, sc AS (SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS sha, CAST(floor(o_totalprice) AS BIGINT) AS p,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS x,
    o_totalprice < 400000 AS known FROM orders WHERE o_totalprice > 250000),
ab AS (SELECT co.repo, co.sha, co.tm,
    CASE WHEN known THEN 'known' WHEN sc.sha IS NOT NULL OR (NOT is_merge AND o_orderpriority = '2-HIGH')
      THEN 'partial' ELSE 'unknown' END AS status,
    CASE WHEN sc.sha IS NOT NULL THEN 'vendor_tracking_db' WHEN o_orderpriority = '2-HIGH' THEN 'self_report'
      ELSE 'none' END AS evidence_source,
    CASE WHEN known THEN p % 10 + x + p % 7 END AS ai_lines, CASE WHEN known THEN p % 4 END AS human_lines,
    CASE WHEN known AND p % 10 + x + p % 7 + p % 4 > 0
      THEN round_even((p % 10 + x + p % 7) / (p % 10 + x + p % 7 + p % 4), 4) END AS ai_fraction,
    CASE WHEN known THEN CASE WHEN p % 2 = 0 THEN 'v2' WHEN p % 3 = 0 THEN 'v1' END END AS vendor_score_version
  FROM co LEFT JOIN sc ON co.sha = sc.sha WHERE NOT is_merge)"""


@query("q_attribution", GIT + ATTRIBUTION_SQL + " SELECT * EXCLUDE (tm) FROM ab")
def attribution(t: Tables) -> DataFrame:
    kept, _ = outcomes.newest_commits(D.commits(t), cap=None)
    return outcomes.attribution(kept, scores(t))


def outcome_tables(t: Tables, lists: bool = True) -> dict[str, DataFrame]:
    commits, lines = git(t)
    return outcomes.signals(commits, D.numstat(lines), members(commits), scores(t), NOW,
                            line_spans=D.spans(lines), cap=None, lists=lists)


def field_sql(*names: str) -> str:
    """The texts of several fields as one, null apart from empty."""
    return " || '|' || ".join(
        f"CASE WHEN {n} IS NULL THEN '-' ELSE length(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR) END" for n in names)


def sums_sql(source: str, *names: str) -> str:
    """Number and lane sums of the digests of a commit's rows."""
    lanes = " || ':' || ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT))" for i in range(8))
    return f"SELECT repo, sha, count(*) || ':' || {lanes} AS s FROM (SELECT repo, sha, sha256({field_sql(*names)}) AS h FROM {source}) GROUP BY ALL"


OUTCOME_SQL = GIT + REVERT_SQL + ATTRIBUTION_SQL + f"""
, mg AS (SELECT c.repo, c.sha, min(struct_pack(tm := m.tm, s := m.sha, pr := m.o_orderkey)).pr AS pr
  FROM co c JOIN co m ON m.is_merge AND m.repo = c.repo AND m.tm >= c.tm AND m.tm <= c.tm + INTERVAL 7 DAY
  WHERE NOT c.is_merge GROUP BY c.repo, c.sha),
fl AS (SELECT DISTINCT repo, sha, tm, is_merge, path FROM cl),
rp AS (SELECT DISTINCT rw.repo, rw.sha, t.sha AS other, t.tm AS t_at FROM rw
  JOIN fl f ON f.repo = rw.repo AND f.sha = rw.sha
  JOIN fl t ON t.repo = f.repo AND t.path = f.path AND NOT t.is_merge
    AND t.tm >= rw.tm + INTERVAL 1 SECOND AND t.tm <= rw.target_at AND t.sha <> rw.sha
  WHERE rw.lines_reworked > 0),
c1 AS ({sums_sql("(SELECT *, CASE WHEN status = 'measured' THEN kept END AS n FROM ms WHERE days <> 14)",
                 "days", "status", "lines_original", "n")}),
c2 AS ({sums_sql("(SELECT *, 14 AS w, lines_reworked > 0 AS occurred FROM rw)", "w", "status", "lines_reworked", "occurred")}),
c3 AS ({sums_sql('(SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY t_at DESC, other DESC) AS nth, '
                 'count(*) OVER (PARTITION BY repo, sha) AS n FROM rp)', "other", "nth", "n")}),
oh AS (SELECT b.repo, b.sha, b.tm, b.evidence_source, sha256({field_sql(
    "epoch_us(b.tm)", "coalesce(added, 0)", "0",
    "coalesce(mg.pr, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END)", "b.status", "b.evidence_source",
    "ai_lines", "human_lines", "vendor_score_version", "(revert_sha IS NOT NULL)", "revert_sha")}
    || '/' || coalesce(c1.s, '0') || '/' || coalesce(c2.s, '0') || '/' || coalesce(c3.s, '0')) AS content_hash
  FROM ab b JOIN co ON co.repo = b.repo AND co.sha = b.sha JOIN rv ON rv.repo = b.repo AND rv.sha = b.sha
  LEFT JOIN sz ON sz.repo = b.repo AND sz.sha = b.sha LEFT JOIN mg ON mg.repo = b.repo AND mg.sha = b.sha
  LEFT JOIN c1 ON c1.repo = b.repo AND c1.sha = b.sha LEFT JOIN c2 ON c2.repo = b.repo AND c2.sha = b.sha
  LEFT JOIN c3 ON c3.repo = b.repo AND c3.sha = b.sha)
"""


@query("q_outcome_hash", OUTCOME_SQL + "SELECT repo, sha, content_hash FROM oh")
def outcome_hash(t: Tables) -> DataFrame:
    """The hash of each commit over its own facts, survival, rework and rework list."""
    return outcome_store.records(outcome_tables(t)).select("repo", "sha", "content_hash")


@query("q_outcome_store", OUTCOME_SQL + """
SELECT repo, count(*) AS emitted, 0 AS new, count(*) FILTER (evidence_source = 'vendor_tracking_db') AS updated,
  count(*) FILTER (evidence_source <> 'vendor_tracking_db') AS unchanged, 0 AS invalid FROM oh GROUP BY repo""")
def stored_outcomes(t: Tables) -> DataFrame:
    """Outcomes stored before any vendor score was known, and again with the scores: counts of the second run."""
    commits, lines = git(t)
    stats = D.numstat(lines)
    tables = {name: durable(rows) for name, rows in outcomes.signals(
        commits, stats, members(commits), scores(t), NOW, line_spans=D.spans(lines), lists=False).items() if name != "commits_cut"}
    lists = outcomes.rework_lists(tables["rework"], outcomes.added_files(stats), outcomes.touched_files(stats), commits)
    tables = outcome_store.digested({**tables, "rework_commits": lists})
    kept, _ = outcomes.newest_commits(commits)
    unscored = outcomes.attribution(kept, scores(t).where("false"))
    facts_only = tables["changes"].drop(*[c for c in unscored.columns if c not in outcomes.KEY])
    folder = f"{scratch_folder(t.spark)}/outcomes-{uuid.uuid4().hex}"
    outcome_store.save(t.spark, {**tables, "changes": facts_only.join(unscored, outcomes.KEY)}, folder, parts=16)
    return outcome_store.save(t.spark, tables, folder, parts=16)


@query("q_repo_summary", GIT + REVERT_SQL + ATTRIBUTION_SQL + """
SELECT a.repo, commits, reverted_commits, attr_known, attr_partial, attr_unknown,
  coalesce(rm, 0) AS rework_measured, coalesce(ro, 0) AS rework_occurred, round_even(ro / rm, 3) AS rework_rate
FROM (SELECT repo, count(*) AS commits, count(*) FILTER (status = 'known') AS attr_known,
    count(*) FILTER (status = 'partial') AS attr_partial, count(*) FILTER (status = 'unknown') AS attr_unknown
  FROM ab GROUP BY repo) a
JOIN (SELECT repo, count(revert_sha) AS reverted_commits FROM rv GROUP BY repo) r ON a.repo = r.repo
LEFT JOIN (SELECT repo, count(*) AS rm, count(*) FILTER (lines_reworked > 0) AS ro FROM rw
  WHERE status = 'measured' GROUP BY repo) w ON a.repo = w.repo""")
def repo_summary(t: Tables) -> DataFrame:
    out = outcome_tables(t, lists=False)
    return outcomes.repo_summary(out["changes"], out["rework"])


@query("q_rework_split", GIT + REVERT_SQL + ATTRIBUTION_SQL + """
SELECT CASE WHEN ab.status = 'known' THEN CASE WHEN ai_fraction >= 0.5 THEN 'known_ai' ELSE 'known_human' END
    ELSE ab.status END AS attribution, count(*) AS commits, count(revert_sha) AS reverted,
  count(w.sha) AS rework_measured, count(*) FILTER (lines_reworked > 0) AS rework_occurred,
  CASE WHEN count(w.sha) > 0 THEN count(*) FILTER (lines_reworked > 0) / count(w.sha) END AS rework_rate
FROM ab JOIN rv ON ab.repo = rv.repo AND ab.sha = rv.sha
LEFT JOIN (SELECT * FROM rw WHERE status = 'measured') w ON ab.repo = w.repo AND ab.sha = w.sha GROUP BY 1""")
def rework_split(t: Tables) -> DataFrame:
    out = outcome_tables(t, lists=False)
    return outcomes.rework_by_attribution(out["changes"], out["rework"])


@query("q_commit_cap", GIT + """
SELECT repo, count(*) FILTER (nth <= 50) AS kept, greatest(count(*) - 50, 0) AS commits_cut FROM (
  SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY tm DESC, sha DESC) AS nth FROM co
  WHERE NOT is_merge) GROUP BY repo""")
def commit_cap(t: Tables) -> DataFrame:
    """Newest commits per repo under a cap, and how many it cuts."""
    kept, cut = outcomes.newest_commits(D.commits(t), cap=50)
    return kept.groupBy("repo").agg(F.count("*").alias("kept")).join(cut, "repo")


@query("q_without_generated", GIT + """
SELECT repo, sha, count(*) AS lines_added, 0 AS lines_deleted FROM cl
WHERE NOT regexp_matches(path, 'p1[0-9]*\\.py$') GROUP BY repo, sha""")
def without_generated(t: Tables) -> DataFrame:
    _, lines = git(t)
    kept = outcomes.without_generated(D.numstat(lines), r"p1[0-9]*\.py$")
    return outcomes.change_sizes(kept)


# -- sessions to repos -----------------------------------------------------------------------

@query("q_candidate_paths", """
WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'codex' WHEN user_id % 3 = 1 THEN 'cursor' ELSE 'claude_code' END AS tool,
    '/w/' || arg_min(k, event_id) AS cwd FROM e WHERE event_type <> 'error' GROUP BY user_id)
SELECT cwd, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools FROM f GROUP BY cwd""")
def candidate_paths(t: Tables) -> DataFrame:
    """First directory per log file, with the tools that mention it."""
    k = F.get_json_object("props", "$.k")
    mentions = t.events.select(
        D.pick(F.col("user_id") % 3, ["codex", "cursor", "claude_code"]).alias("source_tool"),
        F.col("user_id").alias("file"), F.col("event_id").alias("order"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("/w/"), k)).alias("cwd"))
    return outcomes.candidate_paths(mentions).select("cwd", F.array_join("tools", ",").alias("tools"))


WINDOW_SQL = """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS t0, max(ts) AS t1,
    CASE WHEN user_id % 2 = 0 THEN 'codex' ELSE 'cursor' END AS source_tool
  FROM events WHERE event_type <> 'purchase' GROUP BY user_id, CAST(ts AS DATE)),
p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
j AS (SELECT s.*, user_id % 5 <> 0 AND user_id IN (SELECT user_id FROM p) AS repo_joined, user_id % 5 <> 0
    AND EXISTS (SELECT 1 FROM p WHERE p.user_id = s.user_id AND p.ts BETWEEN t0 AND t1) AS commit_in_window FROM s)"""


def user_days(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Non-purchase events of a user and day are a session, purchases commits of
    the user's repo; the directories of every fifth user are in no known repo."""
    e = t.events
    s = e.where("event_type <> 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).select(
        D.pick(F.col("user_id") % 2, ["codex", "cursor"]).alias("source_tool"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("session_id"),
        F.col("user_id").cast("string").alias("project_ref"), "started_at", "ended_at")
    buys = e.where("event_type = 'purchase'")
    refs = buys.select("user_id").distinct().select(F.col("user_id").cast("string").alias("project_ref"), F.when(
        F.col("user_id") % 5 != 0, F.concat(F.lit("r"), F.col("user_id").cast("string"))).alias("repo"))
    commits = buys.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo"),
                          F.col("ts").alias("at"))
    return s, refs, commits


@query("q_window_semi", WINDOW_SQL + """
SELECT user_id || '/' || day AS session_id, repo_joined, commit_in_window FROM j""")
def window_semi(t: Tables) -> DataFrame:
    return outcomes.session_joins(*user_days(t)).select("session_id", "repo_joined", "commit_in_window")


@query("q_join_rates", WINDOW_SQL + """
, r AS (SELECT source_tool, count(*) AS n, count(*) FILTER (repo_joined) AS a,
    count(*) FILTER (commit_in_window) AS b FROM j GROUP BY source_tool)
SELECT source_tool, n AS sessions, a AS repo_join, round_even(a / n, 3) AS repo_join_rate,
  b AS commit_in_session_window, round_even(b / n, 3) AS commit_window_rate FROM r""")
def join_rates(t: Tables) -> DataFrame:
    return outcomes.join_rates(outcomes.session_joins(*user_days(t)))


# -- mining ---------------------------------------------------------------------------------------

def subjects(t: Tables) -> DataFrame:
    """Documents as commits: an edit verb by length, then the first line."""
    verb = D.pick(F.col("n_chars") % 4, ["Fix ", "Fix typo in ", "bug: ", "Add "])
    return t.documents.select(
        F.col("source").alias("repo"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("sha"),
        F.timestamp_seconds("doc_id").alias("at"), F.lit(False).alias("is_merge"),
        F.concat(verb, F.split_part("text", F.lit("\n"), F.lit(1))).alias("subject"))


SUBJECT_SQL = """
WITH d AS (SELECT source AS repo, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sha, doc_id,
    CASE n_chars % 4 WHEN 0 THEN 'Fix ' WHEN 1 THEN 'Fix typo in ' WHEN 2 THEN 'bug: ' ELSE 'Add ' END
      || split_part(text, chr(10), 1) AS subject FROM documents),
f AS (SELECT repo, regexp_replace(lower(subject), '[^a-z0-9]', '', 'g') AS subject_key, max(sha) AS sha
  FROM d WHERE regexp_matches(subject, '\\b(fix|Fix|LANG-\\d+|bug|Bug)\\b') AND NOT regexp_matches(subject,
    'Bump|dependabot|[Jj]avadoc|[Tt]ypo|spelling|checkstyle|CHANGES|README|[Tt]est coverage|[Aa]dd missing test|[Ss]implify|[Rr]efactor|[Dd]eprecate|[Rr]ename|[Ff]ormat|[Ss]tyle|PMD|SpotBugs|[Cc]omment')
  GROUP BY ALL)"""


@query("q_fix_subjects", SUBJECT_SQL + " SELECT repo, sha FROM f")
def fix_subjects(t: Tables) -> DataFrame:
    return mining.fix_subjects(subjects(t)).select("repo", "sha")


@query("q_fix_candidates", SUBJECT_SQL + """
, w AS (SELECT source AS repo, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS sha, unnest(range(n_chars % 9)) AS i,
    n_chars, doc_id FROM documents),
n AS (SELECT repo, sha, CASE WHEN i % 3 = 0 THEN 'src/main/java/a/B' || i || '.java'
    WHEN i % 3 = 1 THEN 'src/test/java/a/B' || i || 'Test.java' ELSE 'doc/' || i END AS path,
    (n_chars + i * 31) % 120 AS ins, doc_id % 20 AS del FROM w),
s AS (SELECT repo, sha, count(*) FILTER (path LIKE 'src/main/%') AS main_files,
    count(*) FILTER (path LIKE 'src/test/%') AS test_files, count(*) FILTER (path LIKE 'doc/%') AS other_files,
    coalesce(sum(ins + del) FILTER (path LIKE 'src/main/%'), 0) AS main_churn,
    array_to_string(list_sort(list(DISTINCT replace(regexp_extract(path, '^src/test/java/(.+)\\.java$', 1), '/', '.'))
      FILTER (path LIKE 'src/test/%')), ',') AS test_classes FROM n GROUP BY repo, sha)
SELECT repo, sha, main_files, main_churn, test_classes,
  CASE WHEN main_files = 1 THEN 'single_file_bug_fix' ELSE 'multi_file_bug_fix' END AS kind
FROM s JOIN f USING (repo, sha) WHERE main_files BETWEEN 1 AND 5 AND test_files > 0 AND main_churn <= 250
  AND other_files <= 2""")
def fix_candidates(t: Tables) -> DataFrame:
    i = F.col("i")
    path = (F.when(i % 3 == 0, F.concat(F.lit("src/main/java/a/B"), i.cast("string"), F.lit(".java")))
            .when(i % 3 == 1, F.concat(F.lit("src/test/java/a/B"), i.cast("string"), F.lit("Test.java")))
            .otherwise(F.concat(F.lit("doc/"), i.cast("string"))))
    files = t.documents.where("n_chars % 9 > 0").select(
        F.col("source").alias("repo"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("sha"),
        "n_chars", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n_chars") % 9 - 1)).alias("i")).select(
        "repo", "sha", path.alias("path"),
        ((F.col("n_chars") + i * 31) % 120).cast("string").alias("ins"),
        (F.col("doc_id") % 20).cast("string").alias("del"))
    found = mining.candidates(mining.fix_subjects(subjects(t)), files)
    return found.select("repo", "sha", "main_files", "main_churn",
                        F.array_join("test_classes", ",").alias("test_classes"),
                        mining.task_kind(F.col("main_files")).alias("kind"))


@query("q_accept_gate", """
WITH r AS (SELECT l_partkey AS task_id, l_linestatus AS side, sum(CAST(l_quantity AS BIGINT)) AS total,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_linenumber ELSE 0 END) AS failed
  FROM lineitem GROUP BY ALL),
p AS (SELECT task_id, max(total) FILTER (side = 'O') AS pt, max(failed) FILTER (side = 'O') AS pf,
  max(total) FILTER (side = 'F') AS ft, max(failed) FILTER (side = 'F') AS ff FROM r GROUP BY task_id)
SELECT task_id, pt - pf AS pre_passed, pt AS pre_total, ft - ff AS fix_passed, ft AS fix_total FROM p
WHERE pt > 0 AND pf > 0 AND ft > 0 AND ff = 0""")
def accept_gate(t: Tables) -> DataFrame:
    """Line items as test reports of their part: open before the fix, filled after."""
    pre = F.col("l_linestatus") == "O"
    reports = t.lineitem.select(
        F.col("l_partkey").alias("task_id"), F.when(pre, "pre").otherwise("fix").alias("side"),
        F.col("l_quantity").cast("long").alias("tests"),
        F.when((F.col("l_returnflag") == "R") & pre, F.col("l_linenumber")).otherwise(0).alias("failures"),
        F.lit(0).alias("errors"))
    return mining.accepted(mining.test_totals(reports))
