"""Mixing sources to target weights; DataFrame functions only.

The sources are the leaves of a tree, here domain, language and source. A token
budget goes down the tree: the children of a node share its budget by weight, none
gets more than the tokens below it times ``max_epochs``, and what one cannot use
goes to its siblings by weight. As a node's own budget never exceeds what lies
below it, a shortage reaches the siblings of an ancestor only when all siblings
are full. With children sorted by supply over weight, those that are full come
first, so each level is a few window sums over the nodes, not a loop.

A leaf's budget is some whole epochs and a prefix of one more. An epoch's order is
the MD5 of seed, epoch and id; the prefix is the rows before the first whose
predecessors reach the rest of the budget. Tokens are summed per leaf and bucket
(the first hex digits of the MD5) before a prefix is sought; only the bucket in
which a prefix ends is ordered by row. The end of each leaf's prefix is one string,
so rows are chosen where they are. Texts are never shuffled.

Budgets are whole tokens, rounded down at each node; a token is a run of characters
that are not white space, [^\\x20\\x09-\\x0D]+.

Defined cases: null and empty texts hold no tokens; they follow their place in the
order like any row, and a leaf without tokens gives nothing; a null in a tree
column is a node named ''; rows of a leaf with the same id are chosen together; a
node without a weight in ``weights`` has weight 1, one with weight 0 gets nothing;
an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import maybe_broadcast, whole_text

BUCKET_DIGITS = 3
LEAF_BYTES = 400
TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
DOMAINS = ("web", "books", "forum")
#: Weights of the registered query and the pipeline.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def domain_of(source: str = "source") -> Column:
    """The domain of a numbered source: its number picks one of DOMAINS."""
    number = F.coalesce(F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), number % len(DOMAINS) + 1)


def with_leaf(docs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    return docs.select(
        *[F.coalesce(column.cast("string"), F.lit("")).alias(f"_{name}") for name, column in levels.items()],
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def budgets(leaves: DataFrame, names: list[str], weights: dict[str, dict[str, int]], total: int | None,
            max_epochs: int) -> DataFrame:
    """Leaves (_names..., _tokens) with their budget, as _budget."""
    wide = "decimal(38,0)"
    nodes = leaves.withColumn("_supply", (F.col("_tokens") * max_epochs).cast("decimal(20,0)"))
    top = nodes.groupBy().agg(F.sum("_tokens").alias("_all"), F.sum("_supply").alias("_most"))
    asked = F.col("_all") if total is None else F.lit(total)
    given = top.select(F.least(asked.cast("decimal(20,0)"), F.col("_most").cast("decimal(20,0)")).alias("_given")).first()
    current = nodes.withColumn("_budget", F.lit(given[0] or 0).cast("decimal(20,0)"))
    for depth, name in enumerate(names):
        key = [f"_{n}" for n in names[:depth + 1]]
        parent = Window.partitionBy(*(key[:-1] or [F.lit(0)]))
        chosen = weights.get(name, {})
        weight = F.lit(1).cast("decimal(10,0)")
        if chosen:
            pairs = F.create_map(*[F.lit(x) for item in chosen.items() for x in item])
            weight = F.coalesce(pairs[F.col(f"_{name}")], F.lit(1)).cast("decimal(10,0)")
        children = current.groupBy(*key).agg(
            F.sum("_supply").cast("decimal(20,0)").alias("_supply"), F.first("_budget").alias("_budget")) \
            .withColumn("_weight", weight)
        order = parent.orderBy(F.try_divide(F.col("_supply").cast("double"), F.col("_weight").cast("double")).asc_nulls_last(), f"_{name}")
        before = F.coalesce(F.sum("_supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)")
        behind = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(14,0)")
        children = children.withColumn("_full", F.coalesce(
            (F.col("_weight") > 0) & ((F.col("_supply") * behind).cast(wide)
                                      <= (F.col("_weight") * (F.col("_budget") - before)).cast(wide)), F.lit(False)))
        used = F.sum(F.when(F.col("_full"), F.col("_supply")).otherwise(0)).over(parent).cast("decimal(20,0)")
        shares = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_weight"))).over(parent).cast("decimal(14,0)")
        children = children.withColumn("_rest", F.col("_budget") - used).withColumn("_shares", shares)
        children = children.withColumn("_own", F.expr(
            "CASE WHEN _full THEN _supply WHEN _weight = 0 THEN 0 "
            "ELSE cast((cast(_weight AS decimal(10,0)) * cast(_rest AS decimal(20,0))) div _shares AS decimal(20,0)) END"))
        given_below = children.select(*key, F.col("_own").cast("decimal(20,0)").alias("_budget"))
        current = current.drop("_budget").join(given_below, key)
    return current.withColumn("_budget", F.col("_budget").cast("long"))


def place(seed: int, epoch: Column, doc_id: str) -> Column:
    """Where a row stands in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def plan(rows: DataFrame, names: list[str], weights: dict[str, dict[str, int]], total: int | None = None,
         max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """Per leaf: its names, _tokens, _budget, whole epochs (_whole) and the end of the prefix (_end).

    ``rows`` holds the leaf columns, _id and _n, the tokens of a row. A row is in the
    prefix of a leaf if its place in epoch _whole is at most _end; null: none is.
    """
    key = [f"_{n}" for n in names]
    leaves = durable(rows.groupBy(*key).agg(F.sum("_n").alias("_tokens")))
    leaves = durable(budgets(leaves, names, weights, total, max_epochs).where("_tokens > 0").select(
        *key, "_tokens", "_budget", F.expr("_budget div _tokens").alias("_whole"),
        (F.col("_budget") % F.col("_tokens")).alias("_part")))
    count = leaves.count()
    asked = rows.join(maybe_broadcast(leaves.where("_part > 0"), count, LEAF_BYTES), key)
    placed = asked.withColumn("_place", place(seed, F.col("_whole"), "_id"))
    bucket = F.substring("_place", 1, BUCKET_DIGITS)
    sums = placed.groupBy(*key, "_part", bucket.alias("_bucket")).agg(F.sum("_n").alias("_n"))
    # a leaf has at most 16 ** BUCKET_DIGITS buckets
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = durable(sums.withColumn("_before", upto - F.col("_n"))
                   .where((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_n") >= F.col("_part")))
                   .select(*key, "_bucket", "_before"))
    last = placed.join(maybe_broadcast(ends, count, LEAF_BYTES), key).where(bucket == F.col("_bucket"))
    per_place = last.groupBy(*key, "_part", "_before", "_place").agg(F.sum("_n").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(*key).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    end = per_place.withColumn("_run", F.col("_before") + run - F.col("_n")).where(F.col("_run") < F.col("_part")) \
        .groupBy(*key).agg(F.max("_place").alias("_end"))
    return durable(leaves.join(end, key, "left"))


def repeated(rows: DataFrame, leaves: DataFrame, names: list[str], seed: int = 0) -> DataFrame:
    """Every chosen copy of a row, with its epoch as _epoch."""
    leaves = maybe_broadcast(leaves, leaves.count(), LEAF_BYTES)
    more = F.when(place(seed, F.col("_whole"), "_id") <= F.col("_end"), 1).otherwise(0)
    copies = rows.join(leaves, [f"_{n}" for n in names]).withColumn("_copies", F.col("_whole") + more)
    return copies.where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))


def tree(levels: dict[str, Column] | None) -> dict[str, Column]:
    return levels or {"domain": domain_of(), "lang": F.col("lang"), "source": F.col("source")}


def measured(docs: DataFrame, levels: dict[str, Column], text: str, doc_id: str) -> DataFrame:
    """One narrow row per document, written down: leaf, id and number of tokens."""
    return durable(with_leaf(docs, levels).select(
        *[f"_{n}" for n in levels], F.col(f"_doc.`{doc_id}`").alias("_id"),
        F.regexp_count(whole_text(f"_doc.`{text}`"), F.lit(TOKEN)).cast("long").alias("_n")))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, levels: dict[str, Column] | None = None,
        total: int | None = None, max_epochs: int = 4, seed: int = 0, text: str = "text",
        doc_id: str = "doc_id") -> DataFrame:
    """The mixture as rows of ``docs``, a row for each epoch that takes it.

    ``total`` is the number of tokens to give out; by default as many as there are.
    """
    levels = tree(levels)
    leaves = plan(measured(docs, levels, text, doc_id), list(levels), weights, total, max_epochs, seed)
    rows = with_leaf(docs, levels).withColumn("_id", F.col(f"_doc.`{doc_id}`"))
    return repeated(rows, leaves, list(levels), seed).select("_doc.*")


def mix_table(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS,
              levels: dict[str, Column] | None = None, total: int | None = None, max_epochs: int = 4,
              seed: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mixture without texts: doc_id, epoch, the leaf's columns, n_tokens and the leaf's budget."""
    levels = tree(levels)
    rows = measured(docs, levels, text, doc_id)
    leaves = plan(rows, list(levels), weights, total, max_epochs, seed)
    return repeated(rows, leaves, list(levels), seed).select(
        F.col("_id").alias("doc_id"), F.col("_epoch").alias("epoch"), *[F.col(f"_{n}").alias(n) for n in levels],
        F.col("_n").alias("n_tokens"), F.col("_budget").alias("leaf_budget"))


def mix_sql(weights: dict[str, dict[str, int]] = WEIGHTS, max_epochs: int = 4, seed: int = 0) -> str:
    """The registered query in DuckDB's SQL; one block of steps for each level of the tree."""
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    steps = [f"""
rows AS (SELECT doc_id, list_extract([{domains}], CAST(coalesce(
                  TRY_CAST(regexp_extract(source, '(\\d{{1,9}})$', 1) AS INT), 0) % {len(DOMAINS)} + 1 AS INT)) AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS n FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens,
             CAST(sum(n) AS HUGEINT) * {max_epochs} AS supply FROM rows GROUP BY ALL),
given0 AS (SELECT *, (SELECT sum(tokens) FROM leaves) AS budget FROM leaves)"""]
    for d, name in enumerate(LEVELS, 1):
        key, parent = ", ".join(LEVELS[:d]), ", ".join(LEVELS[:d - 1])
        part = f"PARTITION BY {parent}" if parent else ""
        weight = "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in weights[name].items()) \
            + " ELSE 1 END" if weights.get(name) else "1"
        order = f"{part} ORDER BY CAST(supply AS DOUBLE) / weight, {name}"
        steps.append(f"""
node{d} AS (SELECT {key}, sum(supply) AS supply, any_value(budget) AS budget, {weight} AS weight
          FROM given{d - 1} GROUP BY {key}),
full{d} AS (SELECT *, supply * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= weight * (budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            AS is_full FROM node{d}),
rest{d} AS (SELECT *, budget - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER ({part}) AS rest,
            sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS shares FROM full{d}),
own{d} AS (SELECT {key}, CASE WHEN is_full THEN supply ELSE CAST(weight AS HUGEINT) * CAST(rest AS HUGEINT)
            // CAST(shares AS HUGEINT) END AS budget FROM rest{d}),
given{d} AS (SELECT g.* EXCLUDE (budget), o.budget FROM given{d - 1} g JOIN own{d} o USING ({key}))""")
    last = f"given{len(LEVELS)}"
    steps.append(f"""
placed AS (SELECT r.*, CAST(g.budget AS BIGINT) AS leaf_budget, CAST(g.budget // g.tokens AS BIGINT) AS whole,
             g.budget % g.tokens AS part, md5('{seed}:' || (g.budget // g.tokens) || ':' || doc_id) AS place
           FROM rows r JOIN {last} g USING (domain, lang, source) WHERE g.tokens > 0),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place) - n AS before FROM placed),
copies AS (SELECT *, unnest(range(whole + CASE WHEN before < part THEN 1 ELSE 0 END)) AS epoch FROM run)
SELECT doc_id, epoch, domain, lang, source, n AS n_tokens, leaf_budget FROM copies""")
    return "WITH " + ",".join(steps)
