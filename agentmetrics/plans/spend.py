"""Spend, task mix, coverage and headline figures over sessions.

``priced`` sessions carry source_tool, started_at, tokens, model_list, project,
cohort and cost (null when unpriced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.keyed import by_shuffle, count_if
from . import pricing

TOKENS = fixed.TOKEN_BUCKETS


def cohort(paths: Column, eval_marker: str) -> Column:
    """``eval_harness`` when a source path carries the marker, else ``organic``."""
    return F.when(F.contains(paths, F.lit(eval_marker)), "eval_harness").otherwise("organic")


def priced(sessions: DataFrame, sheet: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Sessions with cost, lead model and project display name.

    ``names`` maps project_ref to display_name; a session without one is
    ``(unmapped)``.
    """
    rated = pricing.with_rates(sessions, sheet)
    if names is not None:
        rated = rated.join(names, "project_ref", "left")
    else:
        rated = rated.withColumn("display_name", F.lit(None).cast("string"))
    return rated.select(
        *sessions.columns, pricing.session_price().alias("cost"),
        F.coalesce(F.get("model_list", F.lit(0)), F.lit("unknown")).alias("model"),
        F.coalesce(C.blank_to_null(F.col("display_name")), F.lit("(unmapped)")).alias("project"),
        has_tokens().alias("has_tokens"))


def has_tokens() -> Column:
    return F.coalesce(*[F.col(t) for t in TOKENS]).isNotNull()


def thousandths(cost: Column) -> Column:
    """Cost in whole thousandths, cut per session before any sum."""
    return (cost * 1000).cast("long")


def rollup(priced_sessions: DataFrame) -> DataFrame:
    """Spend by model, tool, project and day in one pass.

    One Expand feeds four groupings with partial aggregation; a row's
    ``dimension`` tells them apart, so a null key is not a rolled-up one.
    Sessions without tokens count only in their tool and day side counters.
    """
    dims = {"model": "model", "tool": "source_tool", "project": "project", "day": "day"}
    base = priced_sessions.withColumn("day", C.day_text(F.col("started_at")))
    counted = F.col("has_tokens")
    is_eval = F.col("cohort") == "eval_harness"
    names = list(dims.values())
    grouped = base.groupingSets([[n] for n in names], *names).agg(
        F.grouping_id(*names).alias("gid"),
        count_if(counted).alias("sessions"),
        *[F.sum(F.when(counted, F.coalesce(t, F.lit(0)))).alias(t) for t in TOKENS],
        F.sum(thousandths(F.col("cost"))).alias("cost_x1000"),
        count_if(~counted).alias("no_tokens"),
        count_if(is_eval).alias("evals"))
    dimension, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (label, name) in enumerate(dims.items()):
        here = F.col("gid") == (2 ** len(dims) - 1) - 2 ** (len(dims) - 1 - i)
        dimension = F.when(here, label).otherwise(dimension)
        key = F.when(here, F.col(name)).otherwise(key)
    out = grouped.select(
        dimension.alias("dimension"), key.alias("key"), "sessions", *TOKENS, "cost_x1000",
        F.when(F.col("gid") == _gid(1), F.col("no_tokens")).alias("sessions_no_tokens"),
        F.when(F.col("gid") == _gid(3), F.col("evals")).alias("eval_sessions"))
    empty = ((F.col("sessions") == 0) & (F.coalesce("sessions_no_tokens", F.lit(0)) == 0)
             & (F.coalesce("eval_sessions", F.lit(0)) == 0))
    return out.where(~empty)


def _gid(position: int, n: int = 4) -> int:
    return (2 ** n - 1) - 2 ** (n - 1 - position)


def headline(priced_sessions: DataFrame) -> DataFrame:
    """One row of totals and shares. Unpriced tokens include those of reasoning,
    where sessions report them."""
    counted = [c for c in (*TOKENS, "reasoning_output") if c in priced_sessions.columns]
    total = sum((F.coalesce(c, F.lit(0)) for c in counted), F.lit(0))
    unpriced = F.col("has_tokens") & F.col("cost").isNull()
    review = unpriced & F.exists(
        "model_list", lambda m: m.startswith(fixed.AUTO_REVIEW_PREFIX))
    figures = priced_sessions.agg(
        F.count("*").alias("n_sessions"),
        F.coalesce(F.sum(thousandths(F.col("cost"))), F.lit(0)).alias("cost_x1000"),
        count_if(F.col("cost").isNotNull()).alias("priced_sessions"),
        count_if(unpriced).alias("unpriced_sessions"),
        count_if(~F.col("has_tokens")).alias("no_token_sessions"),
        F.coalesce(F.sum(F.when(unpriced, total)), F.lit(0)).alias("unpriced_tokens"),
        count_if(review).alias("autoreview_sessions"),
        F.coalesce(F.sum(F.when(review, total)), F.lit(0)).alias("autoreview_tokens"),
        count_if(F.col("source_tool") == "cursor").alias("cursor_sessions"),
        count_if(F.col("cohort") == "organic").alias("organic_sessions"))
    return figures.withColumn("total_cost", F.col("cost_x1000") / 1000).withColumn(
        "cursor_share_all", F.coalesce(
            C.ratio(F.col("cursor_sessions"), F.col("n_sessions")), F.lit(0.0))).withColumn(
        "cursor_share_organic", F.coalesce(
            C.ratio(F.col("cursor_sessions"), F.col("organic_sessions")), F.lit(0.0)))


def task_mix(classes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Labels per grain, tool and cohort, with their share of the group.

    Classes of unknown sessions drop out.
    """
    counted = classes.join(by_shuffle(sessions.select("session_id", "source_tool", "cohort")), "session_id") \
        .groupBy("unit", "source_tool", "cohort",
                 F.coalesce("task_type", F.lit("unclassified")).alias("label")) \
        .agg(F.count("*").alias("n"))
    group = Window.partitionBy("unit", "source_tool", "cohort")
    return counted.withColumn("group_n", F.sum("n").over(group)).withColumn(
        "share", C.ratio(F.col("n"), F.col("group_n")))


def origin_mix(classes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Session labels by automated, human or unmarked origin; organic only."""
    origin = (F.when(F.col("automated"), "automated").when(~F.col("automated"), "human")
              .otherwise("unmarked"))
    organic = sessions.where(F.col("cohort") == "organic").select("session_id", "automated")
    return (classes.where(F.col("unit") == "session").join(by_shuffle(organic), "session_id")
            .groupBy(origin.alias("origin"),
                     F.coalesce("task_type", F.lit("unclassified")).alias("label"))
            .agg(F.count("*").alias("n")))


def coverage(priced_sessions: DataFrame, units: DataFrame) -> DataFrame:
    """Per tool: sessions, named projects, token and unit coverage, date range."""
    with_units = (units.groupBy("source_tool")
                  .agg(F.count_distinct("session_id").alias("with_units")))
    return priced_sessions.groupBy("source_tool").agg(
        F.count("*").alias("sessions"),
        count_if(F.col("project") != "(unmapped)").alias("repo_join"),
        count_if(F.col("has_tokens")).alias("with_tokens"),
        C.day_text(F.min("started_at")).alias("first_day"),
        C.day_text(F.max("started_at")).alias("last_day"),
    ).join(with_units, "source_tool", "left").fillna(0, subset=["with_units"])


def top_and_rest(totals: DataFrame, key: str, measure: str, k: int,
                 tie: str | None = None) -> DataFrame:
    """The k largest groups, the others summed into one ``rest`` row.

    ``totals`` is already aggregated. The top k is a take-ordered, and only its
    k-th row is compared with the others, so nothing is ranked in one task.
    """
    order = [F.desc_nulls_last(measure), F.asc(tie or key)]
    top = totals.orderBy(*order).limit(k)
    rest = totals.join(F.broadcast(top.select(key)), key, "left_anti")  # k rows
    folded = rest.agg(F.lit("rest").alias(key), F.sum(measure).alias(measure),
                      F.count("*").alias("groups"),
                      count_if(F.col(measure).isNull()).alias("unpriced_groups"))
    return (top.select(key, measure, F.lit(1).cast("long").alias("groups"),
                       F.col(measure).isNull().cast("long").alias("unpriced_groups"))
            .unionByName(folded.where(F.col("groups") > 0)))


def listed_and_rest(totals: DataFrame, key: str, measures: list[str], order: list[Column],
                    k: int) -> DataFrame:
    """The first k groups in order; all others are summed into one ``rest`` row."""
    listed = totals.orderBy(*order).limit(k)
    others = totals.join(F.broadcast(listed.select(key)), key, "left_anti")  # k rows
    rest = others.agg(F.lit("rest").alias(key), *[F.sum(m).alias(m) for m in measures],
                      F.count("*").alias("groups"))
    return listed.select(key, *measures, F.lit(1).cast("long").alias("groups")).unionByName(
        rest.where(F.col("groups") > 0))


def largest_groups(rollup_rows: DataFrame, dimension: str, k: int) -> DataFrame:
    """The k groups of one dimension with most tokens, and the rest."""
    total = sum((F.coalesce(t, F.lit(0)) for t in TOKENS[1:]), F.coalesce(TOKENS[0], F.lit(0)))
    groups = rollup_rows.where(F.col("dimension") == dimension).withColumn("total_tokens", total)
    return listed_and_rest(groups, "key", ["total_tokens"], [F.desc("total_tokens"), F.asc("key")], k)


def first_days(rollup_rows: DataFrame, k: int) -> DataFrame:
    """The k earliest days, and all later ones as the rest."""
    days = rollup_rows.where(F.col("dimension") == "day")
    return listed_and_rest(days, "key", ["sessions", "cost_x1000"], [F.asc("key")], k)


def highlights(rollup_rows: DataFrame, classes: DataFrame, repos: DataFrame, k: int) -> DataFrame:
    """The k models and projects that cost most, task types of organic sessions with most labels, and measured
    repos with most commits, each kind with the sum of its rest.

    ``classes``: task_type (null is unclassified), cohort. ``repos``: repo, commits, measured, the commits whose
    survival is known; repos without any are left out. What was never priced ranks as nothing. Placeholder
    model names, written by tools for turns without a model, are no models.
    """
    spent = rollup_rows.where(F.col("dimension").isin("model", "project") & ~(
        (F.col("dimension") == "model") & (F.col("key") == fixed.SYNTHETIC_MODEL))).select(
        F.col("dimension").alias("kind"), "key", F.coalesce("cost_x1000", F.lit(0)).alias("amount"))
    tasks = classes.where("cohort = 'organic'").groupBy(
        F.coalesce("task_type", F.lit("unclassified")).alias("key")).agg(
        F.count("*").alias("amount")).select(F.lit("task_type").alias("kind"), "key", "amount")
    known = repos.where("measured > 0").select(
        F.lit("repo").alias("kind"), F.col("repo").alias("key"), F.col("commits").alias("amount"))
    every = spent.unionByName(tasks).unionByName(known)
    # the limit is taken in each task before the shuffle, the rest summed by kind
    order = Window.partitionBy("kind").orderBy(F.desc("amount"), "key")
    listed = every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")
    rest = every.join(listed.select("kind", "key"), ["kind", "key"], "left_anti").groupBy("kind").agg(
        F.lit("rest").alias("key"), F.sum("amount").alias("amount"))
    return listed.unionByName(rest)


def outcomes_beside_spend(repos: DataFrame, rollup_rows: DataFrame) -> DataFrame:
    """Repo outcomes with the spend of the project of the same name; a project
    never priced keeps a null cost."""
    cost = rollup_rows.where(F.col("dimension") == "project").select(
        F.col("key").alias("repo_name"), (F.col("cost_x1000") / 1000).alias("project_cost"))
    return repos.join(cost, "repo_name", "left")
