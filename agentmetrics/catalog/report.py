"""Reports over sessions read from logs: lists of several models, fallback down
the list, an unpriced lead, cohorts from the source path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans import mining, pricing, sessions_b, spend
from . import adapters as D
from .money import PRICED_SQL, names, order_sessions, sheet
from .registry import SQL, Tables, query
from .traffic import records_b, with_sid

REVIEWER = fixed.AUTO_REVIEW_PREFIX + "-1"
RATES = [("g-2", 4.0, 20.0, 0.5, 5.0, 8.0), ("g-3", 1.0, 6.0, 0.125, 1.5, 2.0)]


def logged_sessions(t: Tables) -> DataFrame:
    """Sessions of format B logs with their models, most used first."""
    records = records_b(t)
    models = sessions_b.models(sessions_b.with_model(records)).withColumn("model_id", F.when(
        F.col("model_id") == "g-0", REVIEWER).otherwise(F.col("model_id")))
    lists = pricing.dominant_models(models, ["path"])
    found = sessions_b.sessions(records, D.SALT).join(lists, "path", "left")
    return found.withColumn("model_list", F.coalesce("model_list", F.array().cast("array<string>"))).withColumn(
        "cohort", spend.cohort(F.col("path"), "-u1"))


def priced_logs(t: Tables) -> DataFrame:
    return spend.priced(logged_sessions(t), sheet(t, RATES))


LOGS_SQL = f"""
WITH sb AS ({SQL["q_b_sessions"]}), mb AS ({SQL["q_b_models"]}),
ml AS (SELECT sid, list(m ORDER BY n DESC, m) AS models FROM (SELECT sid, coalesce(messages, 0) AS n,
    CASE model_id WHEN 'g-0' THEN '{REVIEWER}' ELSE model_id END AS m FROM mb) GROUP BY sid),
rt(m, ri, ro, rc, rw) AS (VALUES ('g-2', 4.0::DOUBLE, 20.0::DOUBLE, 0.5::DOUBLE, 8.0::DOUBLE), ('g-3', 1, 6, 0.125, 2)),
pr AS (SELECT sb.*, coalesce(models, []) AS models, input IS NOT NULL AS has_tokens,
    CASE WHEN starts_with(CAST(CAST(sb.sid AS INT) AS VARCHAR), '1') THEN 'eval_harness' ELSE 'organic' END AS cohort,
    CASE WHEN input IS NOT NULL THEN 0.0::DOUBLE + input / 1000000::DOUBLE * ri + output / 1000000::DOUBLE * ro
      + cache_read / 1000000::DOUBLE * rc + cache_creation / 1000000::DOUBLE * rw END AS cost,
    input + output + cache_read + cache_creation + coalesce(reasoning_output, 0) AS tokens
  FROM sb LEFT JOIN ml ON sb.sid = ml.sid
  LEFT JOIN rt ON rt.m = list_filter(models, lambda x: x IN ('g-2', 'g-3'))[1])
"""


@query("q_model_lists", LOGS_SQL + """
SELECT sid, array_to_string(models, ',') AS models, len(models) AS n FROM pr""")
def model_lists(t: Tables) -> DataFrame:
    """Models of each logged session, most messages first."""
    return with_sid(logged_sessions(t)).select(
        "sid", F.array_join("model_list", ",").alias("models"), F.size("model_list").alias("n"))


@query("q_log_prices", LOGS_SQL + """
SELECT sid, coalesce(models[1], 'unknown') AS model, cohort, has_tokens, round(cost, 9) AS cost FROM pr""")
def log_prices(t: Tables) -> DataFrame:
    """Each session at the rates of the first model of its list that has any."""
    return with_sid(priced_logs(t)).select("sid", "model", "cohort", "has_tokens", F.round("cost", 9).alias("cost"))


@query("q_log_headline", LOGS_SQL + f"""
SELECT count(*) AS n_sessions, sum(CAST(trunc(cost * 1000) AS BIGINT)) AS cost_x1000, count(cost) AS priced_sessions,
  count(*) FILTER (has_tokens AND cost IS NULL) AS unpriced_sessions, count(*) FILTER (NOT has_tokens) AS no_token_sessions,
  sum(tokens) FILTER (has_tokens AND cost IS NULL) AS unpriced_tokens,
  count(*) FILTER (has_tokens AND cost IS NULL AND list_contains(models, '{REVIEWER}')) AS autoreview_sessions,
  coalesce(sum(tokens) FILTER (has_tokens AND cost IS NULL AND list_contains(models, '{REVIEWER}')), 0) AS autoreview_tokens,
  0 AS cursor_sessions, count(*) FILTER (cohort = 'organic') AS organic_sessions,
  sum(CAST(trunc(cost * 1000) AS BIGINT)) / 1000 AS total_cost, 0.0::DOUBLE AS cursor_share_all,
  0.0::DOUBLE AS cursor_share_organic FROM pr""")
def log_headline(t: Tables) -> DataFrame:
    return spend.headline(priced_logs(t))


@query("q_tier_table", """
SELECT c_mktsegment AS segment, m.tier, count(*) AS customers FROM customer JOIN (VALUES ('AUTOMOBILE', 'open_weight'),
  ('BUILDING', 'frontier'), ('HOUSEHOLD', 'mid'), ('MACHINERY', 'small')) m(segment, tier) ON m.segment = c_mktsegment
GROUP BY ALL""")
def tier_table(t: Tables) -> DataFrame:
    """Market segments as model names, by the fixed tiers; a name outside them drops out."""
    models = {"AUTOMOBILE": "kimi-x", "BUILDING": "claude-opus-x", "HOUSEHOLD": "claude-sonnet-x",
              "MACHINERY": "claude-haiku-x", "FURNITURE": "x-claude-opus"}
    named = F.create_map(*[F.lit(x) for item in models.items() for x in item])
    counted = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count("*").alias("customers")).withColumn("id", named[F.col("segment")])
    tiers = pricing.tier_of(counted.where("id IS NOT NULL").select("id"), "id", pricing.tier_table(t.spark))
    return counted.join(tiers, "id").select("segment", "tier", "customers")


@query("q_first_tasks", """
SELECT o_orderkey, sha1(CAST(o_orderkey AS VARCHAR)) AS sha FROM orders
ORDER BY o_orderdate DESC, sha LIMIT 25""")
def first_tasks(t: Tables) -> DataFrame:
    """The newest orders as the tasks of a replay."""
    tasks = t.orders.select(
        "o_orderkey", F.sha1(F.col("o_orderkey").cast("string")).alias("sha"), F.col("o_orderdate").alias("at"))
    return mining.first_tasks(tasks, 25).select("o_orderkey", "sha")


@query("q_highlights", PRICED_SQL + """
, e AS (SELECT 'model' AS kind, model AS key, coalesce(sum(CAST(trunc(cost * 1000) AS BIGINT)), 0) AS amount FROM pr
  WHERE model <> '3-MEDIUM' GROUP BY model
  UNION ALL SELECT 'project', project, coalesce(sum(CAST(trunc(cost * 1000) AS BIGINT)) FILTER (model <> '3-MEDIUM'), 0)
  FROM pr GROUP BY project
  UNION ALL SELECT 'task_type', CASE WHEN lang <> 'es' THEN lang ELSE 'unclassified' END, count(*) FROM documents
  WHERE n_chars % 7 <> 0 GROUP BY 2
  UNION ALL SELECT 'repo', source, count(*) FROM documents WHERE regexp_matches(source, '[02468]$') GROUP BY source),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY amount DESC, key) AS nth FROM e)
SELECT kind, CASE WHEN nth <= 2 THEN key ELSE 'rest' END AS key, CAST(sum(amount) AS BIGINT) AS amount FROM r GROUP BY 1, 2""")
def highlights(t: Tables) -> DataFrame:
    """Two of each kind and the rest; languages stand for task types, one of them for no label, some texts
    for sessions of an evaluation, and document sources for repos, of which every other one is measured."""
    s = order_sessions(t).withColumn("model_list", F.transform("model_list", lambda m: F.when(
        m == "3-MEDIUM", fixed.SYNTHETIC_MODEL).otherwise(m)))
    classes = t.documents.select(F.expr("nullif(lang, 'es')").alias("task_type"), F.when(
        F.col("n_chars") % 7 == 0, "eval_harness").otherwise("organic").alias("cohort"))
    repos = t.documents.groupBy(F.col("source").alias("repo")).agg(
        F.count("*").alias("commits"), F.count_if(F.col("source").rlike("[02468]$")).alias("measured"))
    return spend.highlights(spend.rollup(spend.priced(s, sheet(t), names(t))), classes, repos, 2)
