"""Record keeping: upserts, row checks, run manifests, sidecars and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import upsert
from ..operators.scan import latest, latest_before, running, running_sum
from ..plans import pricing, sessions_a, trace
from ..session import durable
from . import adapters as D
from .registry import Tables, query


def stored(t: Tables) -> DataFrame:
    """Earlier state: all but the urgent orders, under the old versions."""
    return record(t.orders.where("o_orderpriority <> '1-URGENT'"), F.col("o_totalprice"), F.lit("0.3.0"))


def batch(t: Tables) -> DataFrame:
    """A later batch without pending orders: some prices changed, and high
    priority orders were read by a newer connector."""
    price = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(
        F.col("o_totalprice"))
    version = F.when(F.col("o_orderpriority") == "2-HIGH", "0.3.1").otherwise("0.3.0")
    return record(t.orders.where("o_orderstatus <> 'P'"), price, version)


def record(orders: DataFrame, price, version) -> DataFrame:
    return orders.select(
        F.col("o_orderstatus").alias("source_tool"), F.col("o_orderkey").alias("session_id"),
        F.col("o_orderdate").alias("started_at"), price.alias("price"),
        F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.floor(price).cast("string")), 256)
        .alias("content_hash"), F.lit("0.4.0").alias("schema_version"), version.alias("connector_version"))


UPSERT_SQL = """
WITH o AS (SELECT *, o_orderpriority <> '1-URGENT' AS was, o_orderstatus <> 'P' AS comes FROM orders),
m AS (SELECT *, CASE WHEN NOT comes THEN 'kept' WHEN NOT was THEN 'new'
    WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN 'updated' ELSE 'unchanged' END AS outcome
  FROM o WHERE was OR comes)
"""
KEYS = ["source_tool", "session_id"]


@query("q_upsert_outcome", UPSERT_SQL + """
SELECT o_orderkey AS session_id, outcome, o_totalprice + CASE WHEN outcome IN ('new', 'updated')
  AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS price,
  CASE WHEN outcome IN ('new', 'updated') AND o_orderpriority = '2-HIGH' THEN '0.3.1' ELSE '0.3.0' END AS connector_version
FROM m""")
def upsert_outcome(t: Tables) -> DataFrame:
    return upsert.merge(stored(t), batch(t), KEYS).select(
        "session_id", "outcome", "price", "connector_version")


@query("q_replace_units", UPSERT_SQL + """
SELECT o_orderkey AS session_id, o_totalprice + CASE WHEN comes AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS price
FROM m""")
def replace_units(t: Tables) -> DataFrame:
    """Unlike sessions, units of the batch always replace the stored ones."""
    return upsert.replace_by_key(stored(t), batch(t), KEYS).select("session_id", "price")


@query("q_sidecar_append", """
SELECT DISTINCT lang, source, text FROM documents WHERE (lang, source, text) NOT IN (
  SELECT lang, source, text FROM documents WHERE n_chars % 5 = 0)""")
def sidecar_append(t: Tables) -> DataFrame:
    """Text rows that are new to the sidecar, each once; whole texts compared."""
    rows = t.documents.select("lang", "source", "text", "n_chars")
    held = rows.where("n_chars % 5 = 0").drop("n_chars")
    return upsert.new_rows(held, rows.drop("n_chars"))


@query("q_pending_anti", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def pending_anti(t: Tables) -> DataFrame:
    """Drafts (customers) without an applied decision (urgent order)."""
    drafts = t.customer.select("c_custkey")
    decisions = t.orders.select(F.col("o_custkey").alias("c_custkey"),
                                (F.col("o_orderpriority") == "1-URGENT").alias("applied"))
    return upsert.pending(drafts, decisions, "c_custkey")


@query("q_latest_policy", """
SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_suppkey DESC LIMIT 1""")
def latest_policy(t: Tables) -> DataFrame:
    return upsert.latest_record(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")


def checked(t: Tables) -> DataFrame:
    return upsert.check(t.events, {
        "value: at least 1": F.col("value") >= 1, "value: at most 40": F.col("value") <= 40,
        "event_type: known": F.col("event_type").isin("click", "view", "purchase", "error"),
        "user_id: even": F.col("user_id") % 2 == 0, "props: has k": F.col("props").contains("k"),
        "event_id: not a multiple of 3": F.col("event_id") % 3 != 0})


@query("q_validate_split", """
SELECT event_id, array_to_string(list_filter([CASE WHEN value < 1 THEN 'value: at least 1' END,
    CASE WHEN value > 40 THEN 'value: at most 40' END, CASE WHEN event_type = 'signup' THEN 'event_type: known' END,
    CASE WHEN user_id % 2 <> 0 THEN 'user_id: even' END,
    CASE WHEN event_id % 3 = 0 THEN 'event_id: not a multiple of 3' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM events WHERE value < 1 OR value > 40 OR event_type = 'signup' OR user_id % 2 <> 0 OR event_id % 3 = 0""")
def validate_split(t: Tables) -> DataFrame:
    return upsert.invalid(checked(t)).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("q_manifest", UPSERT_SQL + """
, w AS (SELECT o_orderstatus AS source_tool, count(*) AS emitted, count(*) FILTER (outcome = 'new') AS new,
    count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged,
    strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day
  FROM m WHERE outcome <> 'kept' GROUP BY 1),
b AS (SELECT o_orderstatus AS source_tool, count(*) AS invalid FROM orders WHERE o_totalprice > 450000 GROUP BY 1)
SELECT coalesce(w.source_tool, b.source_tool) AS source_tool, coalesce(emitted, 0) AS emitted, coalesce(new, 0) AS new,
  coalesce(updated, 0) AS updated, coalesce(unchanged, 0) AS unchanged, coalesce(invalid, 0) AS invalid, first_day, last_day
FROM w FULL JOIN b ON w.source_tool = b.source_tool""")
def manifest(t: Tables) -> DataFrame:
    merged = upsert.merge(stored(t), batch(t), KEYS)
    rows = upsert.check(t.orders.select(F.col("o_orderstatus").alias("source_tool"), "o_totalprice"),
                        {"price: at most 450000": F.col("o_totalprice") <= 450_000})
    m = upsert.manifest(merged, rows, "source_tool", "started_at", "started_at")
    return m.select("source_tool", "emitted", "new", "updated", "unchanged", "invalid",
                    C.day_text(F.col("earliest_started_at")).alias("first_day"),
                    C.day_text(F.col("latest_ended_at")).alias("last_day"))


@query("q_add_snapshot", """
SELECT p_type AS pricing_version, p_partkey FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_brand = 'Brand#1' AND p_size < 10)""")
def add_snapshot(t: Tables) -> DataFrame:
    """Parts as snapshot rows of their type; types already held add nothing."""
    rows = t.part.select(F.col("p_type").alias("pricing_version"), "p_partkey", "p_brand", "p_size")
    held = rows.where("p_brand = 'Brand#1' AND p_size < 10").select("pricing_version")
    return pricing.add_snapshot(held, rows).select("pricing_version", "p_partkey")


# -- ordered scans over other tables -------------------------------------------------------------

@query("q_turn_windows", """
WITH c AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS w FROM conversations
  WHERE role <> 'system')
SELECT conv_id, CAST(w AS BIGINT) AS turn_index, count(*) FILTER (role = 'assistant') AS replies,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS reply_chars, max(turn) AS last_turn
FROM c WHERE w >= 0 GROUP BY conv_id, w""")
def turn_windows(t: Tables) -> DataFrame:
    """User turns open windows, system rows are bookkeeping."""
    rows = t.conversations.where("role <> 'system'").select("conv_id", "turn", "role",
                                                            F.length("text").alias("chars"))
    scanned = running(rows, ["conv_id"], ["turn"],
                      {"prompts": running_sum((F.col("role") == "user").cast("int"))})
    reply = F.col("role") == "assistant"
    return scanned.where("prompts > 0").groupBy(
        "conv_id", (F.col("prompts") - 1).alias("turn_index")).agg(
        F.count(F.when(reply, 1)).alias("replies"),
        F.sum(F.when(reply, F.col("chars")).otherwise(0)).alias("reply_chars"), F.max("turn").alias("last_turn"))


@query("q_gap_before", """
SELECT event_id, CAST(trunc((epoch_us(date_trunc('millisecond', ts)) - epoch_us(date_trunc('millisecond', lag(ts)
  OVER (PARTITION BY user_id ORDER BY event_id)))) / 1e6 * 1000) AS BIGINT) AS gap_ms FROM events""")
def gap_before(t: Tables) -> DataFrame:
    at = F.date_trunc("millisecond", "ts")
    e = t.events.select("user_id", "event_id", at.alias("at"))
    scanned = running(e, ["user_id"], ["event_id"], {"before": latest_before(F.col("at"))})
    return scanned.select("event_id", C.ms_between(F.col("before"), F.col("at")).alias("gap_ms"))


@query("q_carry_model", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'model-' || json_extract_string(props, '$.k') END
  IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS model FROM events""")
def carry_model(t: Tables) -> DataFrame:
    named = F.when(F.col("event_type") == "signup",
                   F.concat(F.lit("model-"), F.get_json_object("props", "$.k")))
    e = t.events.select("user_id", "event_id", named.alias("named"))
    return running(e, ["user_id"], ["event_id"], {"model": latest(F.col("named"))}).select(
        "event_id", "model")


def usage_records(t: Tables) -> DataFrame:
    """Events as message records."""
    return t.events.select(
        F.col("user_id").alias("path"), F.lit(0).alias("split"), F.col("event_id").alias("pos"),
        F.lit("assistant").alias("rtype"), F.get_json_object("props", "$.k").alias("message_id"),
        F.lit("m").alias("model_id"), F.lit(True).alias("has_usage"),
        F.floor(F.col("value") * 100).alias("input"),
        *[F.lit(0).alias(c) for c in ("output", "cache_read", "cache_creation")],
        *[F.lit(None).cast("string").alias(c) for c in ("effort", "speed", "service_tier")])


@query("q_usage_dedupe", """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (SELECT user_id, k, arg_min(CAST(floor(value * 100) AS BIGINT), event_id) AS v FROM e GROUP BY user_id, k)
SELECT user_id, count(*) AS assistant_messages, sum(v) AS input FROM f GROUP BY user_id""")
def usage_dedupe(t: Tables) -> DataFrame:
    """One usage per message id, the first counts."""
    e = usage_records(t)
    totals = sessions_a.message_totals(sessions_a.messages(e, ["path"]), ["path"])
    return totals.select(F.col("path").alias("user_id"), "assistant_messages", "input")


# -- traces ------------------------------------------------------------------------------------------

def links(t: Tables) -> list[DataFrame]:
    """Users, orders and nations as sessions, commits and tickets."""
    def edge(df, a, a_id, b, b_id, method):
        return df.select(F.lit(a).alias("from_kind"), a_id.cast("string").alias("from_id"),
                         F.lit(b).alias("to_kind"), b_id.cast("string").alias("to_id"),
                         F.lit(method).alias("method"))

    o = t.orders
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    return [
        edge(o, "session", cust, "commit", key, "timestamp_correlation"),
        edge(o.where("o_orderpriority = '1-URGENT'"), "session", cust, "commit", key, "explicit_id_reference"),
        edge(o.where("o_orderstatus = 'F'"), "session", cust, "commit", key, "branch_name_match"),
        edge(o.where("o_totalprice > 300000").join(
            t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"),
            "commit", key, "ticket", F.col("c_nationkey"), "vendor_tracking")]


EDGE_SQL = """
WITH ed AS (SELECT 'session' AS from_kind, CAST(o_custkey AS VARCHAR) AS from_id, 'commit' AS to_kind,
    CAST(o_orderkey AS VARCHAR) AS to_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'explicit_id_reference'
      WHEN o_orderstatus = 'F' THEN 'branch_name_match' ELSE 'timestamp_correlation' END AS method FROM orders
  UNION ALL SELECT 'commit', CAST(o_orderkey AS VARCHAR), 'ticket', CAST(c_nationkey AS VARCHAR), 'vendor_tracking'
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000),
cl AS (SELECT *, CASE method WHEN 'branch_name_match' THEN 'inferred' WHEN 'timestamp_correlation' THEN 'speculative'
  ELSE 'known' END AS confidence_class FROM ed)
"""


@query("q_trace_edges", EDGE_SQL + "SELECT * FROM cl")
def trace_edges(t: Tables) -> DataFrame:
    return trace.strongest_edges(*links(t))


@query("q_trace_certain", EDGE_SQL + "SELECT * FROM cl WHERE confidence_class <> 'speculative'")
def trace_certain(t: Tables) -> DataFrame:
    return trace.without_speculative(trace.strongest_edges(*links(t)))


@query("q_chain_breaks", EDGE_SQL + """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'commit' AS kind FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (
  SELECT from_id FROM ed WHERE from_kind = 'commit')""")
def chain_breaks(t: Tables) -> DataFrame:
    """Commits that no edge links onward to a ticket."""
    nodes = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("commit").alias("kind"))
    return trace.broken_at(nodes, trace.strongest_edges(*links(t)), "commit", "ticket")


# -- links found in sessions and commits ---------------------------------------------------------

def worked(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders are sessions in their customer's repo, line items commits there."""
    o = t.orders
    key = F.col("o_orderkey")
    branch = D.pick(key % 3, ["main", None, "feature/PROJ-"])
    sessions = o.select(
        key.cast("string").alias("session_id"), F.col("o_custkey").cast("string").alias("repo"),
        F.when(key % 3 == 2, F.concat(branch, (key % 5).cast("string"))).otherwise(branch).alias("branch"),
        F.col("o_orderdate").alias("started_at"),
        F.when(key % 7 != 0, F.timestamp_add("DAY", key % 100, "o_orderdate")).alias("ended_at"))
    li = t.lineitem.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    commits = li.select(
        F.col("o_custkey").cast("string").alias("repo"),
        F.sha1(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("sha"),
        F.when(line % 3 == 0, "main").when(line % 3 == 1, F.concat(F.lit("feature/PROJ-"), (part % 5).cast("string")))
        .alias("branch"), F.col("l_shipdate").alias("at"),
        F.when((F.col("l_returnflag") == "R") & (line == 2), F.col("l_orderkey").cast("string")).alias("session_id"),
        F.when(part % 4 == 0, F.concat(F.lit("Close OPS-"), (part % 20).cast("string"), F.lit(", as UTF-8")))
        .when(part % 4 == 1, F.lit("Tidy")).alias("body"))
    return sessions, commits


FOUND_SQL = """
WITH se AS (SELECT CAST(o_orderkey AS VARCHAR) AS sid, o_custkey AS repo, CASE o_orderkey % 3 WHEN 0 THEN 'main'
    WHEN 2 THEN 'feature/PROJ-' || (o_orderkey % 5) END AS br, o_orderdate AS a,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 100 AS INT)) ELSE o_orderdate END AS z FROM orders),
cm AS (SELECT o_custkey AS repo, sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS sha, l_shipdate AS tm,
    CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/PROJ-' || (l_partkey % 5) END AS br,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN CAST(l_orderkey AS VARCHAR) END AS told,
    CASE WHEN l_partkey % 4 = 0 THEN 'OPS-' || (l_partkey % 20) END AS ops
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fd AS (SELECT 'session' AS fk, sid AS fi, 'commit' AS tk, sha AS ti, 2 AS r FROM cm JOIN se ON told = sid
  UNION ALL SELECT 'session', sid, 'commit', sha, 3 FROM cm JOIN se ON cm.repo = se.repo AND cm.br = se.br
    AND cm.br <> 'main' AND tm BETWEEN a AND z + INTERVAL 14 DAY
  UNION ALL SELECT 'session', sid, 'commit', sha, 4 FROM cm JOIN se ON cm.repo = se.repo AND tm BETWEEN a AND z
  UNION ALL SELECT 'commit', sha, 'ticket', ops, 1 FROM cm WHERE ops IS NOT NULL
  UNION ALL SELECT 'commit', sha, 'ticket', br[9:], 3 FROM cm WHERE br <> 'main'
  UNION ALL SELECT 'session', sid, 'ticket', br[9:], 3 FROM se WHERE br <> 'main'),
ed AS (SELECT fk, fi, tk, ti, min(r) AS r FROM fd GROUP BY ALL)
"""


def found_edges(t: Tables) -> DataFrame:
    sessions, commits = worked(t)
    commits = durable(commits)  # read by four kinds of links
    projects = ["OPS", "PROJ"]
    return trace.strongest_edges(
        trace.commit_links(sessions, commits),
        trace.ticket_links(commits, "commit", "sha", "body", "branch", projects),
        trace.ticket_links(sessions, "session", "session_id", None, "branch", projects))


@query("q_trace_found", FOUND_SQL + """
SELECT fk AS from_kind, fi AS from_id, tk AS to_kind, ti AS to_id, CASE r WHEN 1 THEN 'explicit_id_reference'
    WHEN 2 THEN 'vendor_tracking' WHEN 3 THEN 'branch_name_match' ELSE 'timestamp_correlation' END AS method,
  CASE r WHEN 3 THEN 'inferred' WHEN 4 THEN 'speculative' ELSE 'known' END AS confidence_class FROM ed""")
def trace_found(t: Tables) -> DataFrame:
    """Edges from sessions, commits and their texts alone."""
    return found_edges(t)


@query("q_savings_outcomes", FOUND_SQL + """
, ms AS (SELECT sha, CAST(sum(q) AS BIGINT) AS orig, CAST(sum(CASE WHEN flag <> 'N' THEN q END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN flag = 'R' THEN 1 WHEN flag = 'A' THEN 0 END) AS BIGINT) AS redone FROM (
  SELECT sha1(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS sha, CAST(l_quantity AS BIGINT) AS q,
    l_returnflag AS flag FROM lineitem) GROUP BY sha),
pr AS (SELECT fi, count(kept) AS sn, sum(kept) / sum(CASE WHEN kept IS NOT NULL THEN orig END) AS sr,
    count(redone) AS rn, sum(redone) / sum(CASE WHEN redone IS NOT NULL THEN orig END) AS rr
  FROM ed JOIN ms ON ti = sha WHERE fk = 'session' AND tk = 'commit' AND r < 4 GROUP BY fi)
SELECT o_orderkey AS session_id, o_totalprice AS saving, coalesce(sn, 0) AS survival_n, round(sr, 9) AS survival_rate,
  coalesce(rn, 0) AS rework_n, round(rr, 9) AS rework_rate FROM orders LEFT JOIN pr ON fi = CAST(o_orderkey AS VARCHAR)""")
def savings_outcomes(t: Tables) -> DataFrame:
    """Savings with survival and rework of the commits that are linked by more than time."""
    lines = F.col("l_quantity").cast("long")
    flag = F.col("l_returnflag")
    measures = t.lineitem.select(
        F.sha1(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("sha"), lines.alias("lines"),
        F.when(flag != "N", lines).alias("kept"), F.when(flag == "R", 1).when(flag == "A", 0).alias("redone")) \
        .groupBy("sha").agg(F.sum("lines").alias("lines_original"), F.sum("kept").alias("lines_kept"),
                            F.sum("redone").alias("lines_reworked"))
    savings = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_totalprice").alias("saving"))
    out = trace.savings_with_outcomes(savings, trace.without_speculative(found_edges(t)), measures)
    return out.withColumns({c: F.round(c, 9) for c in ("survival_rate", "rework_rate")})
