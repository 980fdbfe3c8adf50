"""Links from sessions to outcomes, verified savings, and the gates on evidence.

These follow written contracts that have no published implementation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.interval import POINTS_PER_CELL, stabs
from ..operators.keyed import count_if
from . import pricing

# fixed values: link methods, strongest first, and the class each establishes
METHODS = ["explicit_id_reference", "vendor_tracking", "branch_name_match",
           "timestamp_correlation", "human_assertion"]
METHOD_CLASS = {"explicit_id_reference": "known", "vendor_tracking": "known",
                "branch_name_match": "inferred", "timestamp_correlation": "speculative",
                "human_assertion": "inferred"}
JUDGE_GATE = 0.8
# fixed values: branches that many sessions share, whose name says nothing about one of them
SHARED_BRANCHES = ["main", "master", "develop", "trunk", "HEAD"]
TICKET = r"\b([A-Z][A-Z0-9]+-[0-9]+)\b"
#: How long after a session's end a commit on its branch may still be its work.
REACH = "14 days"


def method_rank(method: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), method)


def strongest_edges(*links: DataFrame) -> DataFrame:
    """One edge per pair of nodes, by its strongest link method.

    Each input holds from_kind, from_id, to_kind, to_id, method.
    """
    ends = ["from_kind", "from_id", "to_kind", "to_id"]
    every = links[0].select(*ends, "method")
    for more in links[1:]:
        every = every.unionByName(more.select(*ends, "method"))
    best = every.groupBy(*ends).agg(F.min(method_rank(F.col("method"))).alias("rank"))
    names = F.array(*[F.lit(m) for m in METHODS])
    classes = F.array(*[F.lit(METHOD_CLASS[m]) for m in METHODS])
    return best.select(*ends, F.element_at(names, F.col("rank").cast("int")).alias("method"),
                       F.element_at(classes, F.col("rank").cast("int")).alias("confidence_class"))


def edge(df: DataFrame, from_kind: str, from_id: Column, to_kind: str, to_id: Column, method: Column) -> DataFrame:
    return df.select(F.lit(from_kind).alias("from_kind"), from_id.cast("string").alias("from_id"),
                     F.lit(to_kind).alias("to_kind"), to_id.cast("string").alias("to_id"), method.alias("method"))


def commit_links(sessions: DataFrame, commits: DataFrame, reach: str = REACH,
                 limit: int = POINTS_PER_CELL) -> DataFrame:
    """Links from sessions to commits, found in what the two tables hold.

    ``sessions``: session_id, repo, branch, started_at, ended_at; ``commits``: repo, sha,
    branch, at, and session_id where the vendor's own record names one, else null. A
    commit links to a session of its repo by

    - vendor_tracking: its session_id is a known session's, in whatever repo;
    - branch_name_match: both are on one branch that is not a shared one, and the commit
      lies between the session's start and ``reach`` after its end;
    - timestamp_correlation: the commit lies between the session's start and end.

    A session without an end ends at its start. A pair may come by several methods;
    ``strongest_edges`` keeps one. Both windows are one join.
    """
    until = F.coalesce("ended_at", "started_at")
    own_branch = F.when(~F.col("branch").isin(SHARED_BRANCHES), F.col("branch"))
    branch, plain = F.lit("branch_name_match"), F.lit("timestamp_correlation")
    rules = [(branch, own_branch, until + F.expr(f"INTERVAL {reach}")), (plain, F.lit(""), until)]

    def under(kind: Column, scope: Column, *more: Column) -> Column:
        return F.struct(kind.alias("method"), scope.alias("scope"), *more)

    spans = sessions.select("session_id", "repo", "started_at", F.inline(F.array(*[
        under(kind, scope, end.alias("until_at")) for kind, scope, end in rules])))
    points = commits.select("repo", "sha", "at", F.inline(F.array(*[under(kind, scope) for kind, scope, _ in rules])))
    met = stabs(points.where("scope IS NOT NULL"), spans.where("scope IS NOT NULL"), ["repo", "method", "scope"],
                "at", "started_at", "until_at", ["session_id"], limit)
    told = commits.where(F.col("session_id").isNotNull()).select("sha", "session_id").join(
        sessions.select("session_id"), "session_id", "left_semi")
    ends = ("session", F.col("session_id"), "commit", F.col("sha"))
    return edge(met, *ends, F.col("method")).unionByName(edge(told, *ends, F.lit("vendor_tracking")))


def ticket_links(rows: DataFrame, kind: str, node: str, named: str | None, branch: str,
                 projects: list[str] | None = None) -> DataFrame:
    """Links from sessions or commits to the tickets whose keys they name.

    A key in the text of column ``named`` is an explicit reference, one in the branch
    name a branch match. ``projects`` lists the known project names, so that words
    such as UTF-8 are no tickets; without it every word of a key's form is one.
    """
    def named_in(column: str, method: str) -> Column:
        found = F.coalesce(F.regexp_extract_all(column, F.lit(TICKET), 1), F.array().cast("array<string>"))
        return F.transform(F.array_distinct(found), lambda key: F.struct(F.lit(method).alias("method"), key.alias("ticket")))

    found = named_in(branch, "branch_name_match")
    if named is not None:
        found = F.concat(found, named_in(named, "explicit_id_reference"))
    keys = rows.select(F.col(node).alias("node"), F.inline(found))
    if projects is not None:
        keys = keys.where(F.substring_index("ticket", "-", 1).isin(projects))
    return edge(keys, kind, F.col("node"), "ticket", F.col("ticket"), F.col("method"))


def savings_with_outcomes(savings: DataFrame, edges: DataFrame, measures: DataFrame) -> DataFrame:
    """Savings of sessions with survival and rework of their commits beside them.

    ``measures``: sha, lines_original, lines_kept, lines_reworked; a null was not
    measured. Figures stand beside the saving and are never netted with it. A commit
    that several sessions led to stands beside each. Sessions without a measured commit
    have null rates, and every rate carries its count of commits.
    """
    own = edges.where("from_kind = 'session' AND to_kind = 'commit'").select(
        F.col("from_id").alias("__session"), F.col("to_id").alias("sha"))
    joined = own.join(measures, "sha")
    original = F.col("lines_original")
    per = joined.groupBy("__session").agg(
        F.count("lines_kept").alias("survival_n"), F.sum("lines_kept").alias("__kept"),
        F.sum(F.when(F.col("lines_kept").isNotNull(), original)).alias("__kept_of"),
        F.count("lines_reworked").alias("rework_n"), F.sum("lines_reworked").alias("__reworked"),
        F.sum(F.when(F.col("lines_reworked").isNotNull(), original)).alias("__reworked_of"))
    out = savings.join(per, F.col("session_id").cast("string") == F.col("__session"), "left")
    return out.select(
        *savings.columns, F.coalesce("survival_n", F.lit(0)).alias("survival_n"),
        C.ratio(F.col("__kept"), F.col("__kept_of")).alias("survival_rate"),
        F.coalesce("rework_n", F.lit(0)).alias("rework_n"),
        C.ratio(F.col("__reworked"), F.col("__reworked_of")).alias("rework_rate"))


def without_speculative(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("confidence_class") != "speculative")


def broken_at(nodes: DataFrame, edges: DataFrame, kind: str, next_kind: str) -> DataFrame:
    """Nodes of one kind with no edge to the next: where the chain breaks."""
    out = edges.where((F.col("from_kind") == kind) & (F.col("to_kind") == next_kind))
    return nodes.where(F.col("kind") == kind).join(
        out.select(F.col("from_id").alias("id")), "id", "left_anti")


def verified_savings(sessions: DataFrame, sheets: DataFrame, at: str,
                     baseline_list: str = "baseline_list") -> DataFrame:
    """Each session at the models that served it and at those the frozen
    baseline would have used, both by the sheet in force on its day. A session
    lacking either price has no saving."""
    dated = pricing.effective_version(sessions, sheets, at)
    own = pricing.with_dated_rates(dated, sheets, "model_list", "_own").withColumn(
        "actual_cost", pricing.session_price("_own"))
    both = pricing.with_dated_rates(own, sheets, baseline_list, "_base", dated).withColumn(
        "baseline_cost", pricing.session_price("_base"))
    return both.select(*sessions.columns, "pricing_version", "actual_cost", "baseline_cost",
                       (F.col("baseline_cost") - F.col("actual_cost")).alias("saving"))


def triangulate(replay: DataFrame, production: DataFrame, min_n: int = 10) -> DataFrame:
    """Verdict per class from two tracks (task_type, supports, n each).

    The tracks are compared, never averaged.
    """
    both = replay.select("task_type", F.col("supports").alias("replay_supports"),
                         F.col("n").alias("replay_n")).join(
        production.select("task_type", F.col("supports").alias("production_supports"),
                          F.col("n").alias("production_n")), "task_type", "full")
    has_replay = F.coalesce("replay_n", F.lit(0)) >= min_n
    has_production = F.coalesce("production_n", F.lit(0)) >= min_n
    verdict = (F.when(has_replay & has_production, F.when(
        F.col("replay_supports") == F.col("production_supports"), "tracks_agree")
        .otherwise("tracks_disagree"))
        .when(has_replay | has_production, "single_track_only").otherwise("insufficient_data"))
    return both.withColumn("verdict", verdict)


def judge_verdicts(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per compared pair from both presentation orders.

    ``verdict`` is already from the candidate's side. Orders that disagree give
    ``inconsistent``; a pair judged in one order only is not swapped.
    """
    return comparisons.groupBy(*keys).agg(
        F.count_distinct("swapped").alias("orders"), F.min("verdict").alias("low"),
        F.max("verdict").alias("high")).select(
        *keys, (F.col("orders") == 2).alias("position_swapped"),
        F.when(F.col("orders") == 2, F.col("low") == F.col("high")).alias("position_consistent"),
        F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("inconsistent")
        .alias("verdict"))


def judge_gate(verdicts: DataFrame, human: DataFrame, keys: list[str],
               threshold: float = JUDGE_GATE) -> DataFrame:
    """Agreement with human verdicts per class, and whether it clears the gate."""
    joined = verdicts.join(human.withColumnRenamed("verdict", "human_verdict"), keys)
    by_class = joined.groupBy("task_type").agg(
        F.count("*").alias("calibration_n"),
        count_if(F.col("verdict") == F.col("human_verdict")).alias("agreed"))
    return by_class.withColumn("agreement_value", C.ratio(
        F.col("agreed"), F.col("calibration_n"))).withColumn(
        "cleared_agreement_gate", F.col("agreement_value") >= threshold)


def decision_bucket(work: DataFrame, high_spend: float, low_rework: float) -> DataFrame:
    """Name the decision each piece of work calls for; null where none does."""
    costly = F.col("cost") >= high_spend
    bucket = (F.when(costly & F.col("delivery_status").isin("abandoned"),
                     "high_spend_abandoned")
              .when(costly & F.col("priority").isin("low", "lowest"), "high_spend_low_priority")
              .when(F.col("priority").isin("highest", "high") & (F.col("ai_contribution") == "known"),
                    "high_priority_strong_ai")
              .when((F.col("delivery_status") == "deployed")
                    & (F.col("rework_rate") <= low_rework)
                    & (F.col("ai_contribution") != "unknown"), "shipped_low_rework"))
    return work.withColumn("bucket", bucket)


def team_level(df: DataFrame, team: str, member: str, measures: dict[str, Column],
               min_members: int = 5) -> DataFrame:
    """Figures per team; teams with too few members are withheld."""
    grouped = df.groupBy(team).agg(F.count_distinct(member).alias("members"),
                                   *[m.alias(n) for n, m in measures.items()])
    return grouped.where(F.col("members") >= min_members)
