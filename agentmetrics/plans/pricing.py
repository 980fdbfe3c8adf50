"""Dated price sheets and list-price equivalents.

A sheet row is (pricing_version, ordinal, model_key, five rates in $ per million
tokens, any of them null). A bucket with traffic but no rate makes the whole
price null: unknown is not a partial sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import fixed
from ..operators.prefix import first_in_list, match_prefix
from ..operators.scan import asof
from ..session import durable

MILLION = 1_000_000


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots of a folder of JSON files {pricing_version, models: {...}}.

    The version that pins and orders snapshots is the file name. ``ordinal``
    keeps the order of the keys in the file, which decides prefix matches.
    """
    raw = (spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
           .select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("snapshot"),
                   "value"))
    rate = T.StructType([T.StructField(r, T.DoubleType()) for r in fixed.RATES])
    shape = T.StructType([
        T.StructField("pricing_version", T.StringType()),
        T.StructField("effective_date", T.StringType()),
        T.StructField("models", T.MapType(T.StringType(), rate))])
    sheet = raw.select("snapshot", F.from_json("value", shape).alias("s"))
    return sheet.select(
        "snapshot", "s.pricing_version", "s.effective_date",
        F.posexplode(F.map_entries("s.models")).alias("ordinal", "e")).select(
        "snapshot", "pricing_version", "effective_date", "ordinal",
        F.col("e.key").alias("model_key"), "e.value.*")


def pick_sheet(sheets: DataFrame, contains: str | None = None) -> DataFrame:
    """The latest snapshot by name, or the latest whose name contains a text."""
    pool = sheets.where(F.contains("snapshot", F.lit(contains))) if contains else sheets
    newest = pool.agg(F.max("snapshot").alias("snapshot"))
    return pool.join(F.broadcast(newest), "snapshot", "left_semi")  # one row by construction


def price(buckets: dict[str, str]) -> Column:
    """Sum of tokens times rate over {token column: rate column}."""
    total = F.lit(0.0)
    for tokens, rate in buckets.items():
        n = F.coalesce(F.col(tokens), F.lit(0))
        total = total + F.when(n == 0, F.lit(0.0)).otherwise(n / F.lit(MILLION) * F.col(rate))
    return total


def dominant_models(model_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Model ids per session, most messages first, ties by model id."""
    entry = F.struct((-F.coalesce("assistant_messages", F.lit(0))).alias("neg"), "model_id")
    return model_rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["model_id"])
        .alias("model_list"))


def with_rates(sessions: DataFrame, sheet: DataFrame, list_col: str = "model_list",
               suffix: str = "", lists_of: DataFrame | None = None) -> DataFrame:
    """Attach the rates of the first model in the list that the sheet knows.

    Distinct model lists are resolved once and landed, so the join back is
    planned by the real size of that table: broadcast while it is small, which
    keeps sessions where they are, and a shuffle join beyond. ``lists_of`` names a cheaper table that
    holds the same lists, such as the sessions before an earlier attachment.
    """
    lists = (lists_of if lists_of is not None else sessions).select(list_col).distinct()
    keyed = match_prefix(lists.select(F.explode(list_col).alias("id")), "id", sheet,
                         "model_key", "ordinal")
    resolved = first_in_list(lists, list_col, keyed, "matched").join(
        sheet.select(F.col("model_key").alias("matched"),
                     *[F.col(r).alias(f"rate_{r}{suffix}") for r in fixed.RATES]), "matched")
    table = durable(resolved.withColumnRenamed("ids", list_col)
                    .withColumnRenamed("matched", f"priced_as{suffix}"))
    return sessions.join(table, list_col, "left")


def session_price(suffix: str = "") -> Column:
    """List price of the four session buckets at attached rates; cache writes
    are priced at the one-hour rate."""
    has_tokens = F.coalesce(*[F.col(b) for b in fixed.TOKEN_BUCKETS]).isNotNull()
    known = F.col(f"priced_as{suffix}").isNotNull()
    return F.when(has_tokens & known, price(
        {b: f"rate_{r}{suffix}" for b, r in fixed.BUCKET_RATE.items()}))


def usage_price(usage: DataFrame, sheet: DataFrame) -> DataFrame:
    """Price reported usage by exact model id, splitting cache writes by their
    lifetime where reported; six digits."""
    rated = usage.join(sheet.select(F.col("model_key").alias("model_id"), F.lit(True).alias("known"),
                                    *[F.col(r).alias(f"rate_{r}") for r in fixed.RATES]),
                       "model_id", "left")
    split = F.col("cache_5m").isNotNull() | F.col("cache_1h").isNotNull()
    base = {"input": "rate_input", "output": "rate_output", "cache_read": "rate_cache_read"}
    cost = F.when(split, price({**base, "cache_5m": "rate_cache_write_5m",
                                "cache_1h": "rate_cache_write_1h"})).otherwise(
        price({**base, "cache_creation": "rate_cache_write_1h"}))
    return (rated.withColumn("cost", F.when(F.col("known"), C.rounded(cost, 6)))
            .drop("known", *[f"rate_{r}" for r in fixed.RATES]))


def tier_of(ids: DataFrame, id_col: str, tiers: DataFrame) -> DataFrame:
    """(id, tier) by the first matching prefix in tier order; no exact rule."""
    ranked = match_prefix(ids, id_col, tiers.withColumn("rank", F.col("ordinal")),
                          "prefix", "rank")
    spread = ranked.where(~F.col("exact")).unionByName(
        _exact_by_order(ranked.where("exact"), tiers))
    return spread.join(tiers.select(F.col("prefix").alias("matched"), "tier"), "matched").select(
        "id", "tier")


def _exact_by_order(exact: DataFrame, tiers: DataFrame) -> DataFrame:
    """An id equal to a prefix may still start with an earlier one."""
    again = exact.select("id", F.explode(F.sequence(F.lit(1), F.length("id"))).alias("upto")).select(
        "id", F.substring("id", F.lit(1), F.col("upto")).alias("prefix"))
    return (again.join(tiers, "prefix").groupBy("id")
            .agg(F.min_by("prefix", "ordinal").alias("matched")).withColumn("exact", F.lit(True)))


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, p, t) for i, (p, t) in enumerate(fixed.TIER_PREFIXES)],
        "ordinal int, prefix string, tier string")


def build_sheet(price_list: DataFrame, models: DataFrame) -> DataFrame:
    """Per-token vendor prices to $ per million, for the wanted models.

    ``price_list`` is (ordinal, price_key, per-token fields), ``models`` is
    (ordinal, model_id). A key resolves as the model itself, else the first
    unprefixed key that starts with it, else the first such key under each
    provider prefix in turn. Unresolved models stay, with a null key.
    """
    provider = F.lit(None).cast("int")
    bare = F.col("price_key")
    for rank, prefix in enumerate(fixed.PROVIDER_PREFIXES):
        under = F.col("price_key").startswith(prefix)
        provider = F.when(under, F.lit(rank + 2)).otherwise(provider)
        bare = F.when(under, F.substring("price_key", len(prefix) + 1, 1 << 20)).otherwise(bare)
    provider = F.coalesce(provider, F.when(~F.contains("price_key", F.lit("/")), F.lit(1)))
    ranked = price_list.select("price_key", F.col("ordinal").alias("at"),
                               provider.alias("provider"), bare.alias("bare"))
    spread = ranked.where("provider is not null").select(
        "*", F.explode(F.sequence(F.lit(1), F.length("bare"))).alias("upto")).select(
        "price_key", "at", "provider", F.substring("bare", F.lit(1), F.col("upto")).alias("model_id"))
    exact = price_list.select("price_key", F.col("ordinal").alias("at"), F.lit(0).alias("provider"),
                              F.col("price_key").alias("model_id"))
    hits = (spread.unionByName(exact).join(models.select("model_id"), "model_id", "left_semi")
            .groupBy("model_id").agg(
                F.min_by("price_key", F.struct("provider", "at")).alias("price_key")))
    rates = [C.rounded(F.col(src) * MILLION, 6).alias(ours)
             for ours, src in fixed.PER_TOKEN_FIELDS.items()]
    return (models.join(hits, "model_id", "left")
            .join(price_list.select("price_key", *rates), "price_key", "left")
            .select("ordinal", F.col("model_id").alias("model_key"), "price_key", *fixed.RATES))


def cross_check(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rates that differ between two sheets, or vanished from the new one."""
    stacked = ", ".join(f"'{r}', `{r}`" for r in fixed.RATES)

    def tall(sheet: DataFrame, name: str) -> DataFrame:
        return sheet.selectExpr("model_key", f"stack({len(fixed.RATES)}, {stacked}) as (bucket, {name})")

    newer = tall(new, "new_rate").withColumn("old_key", F.split("model_key", "-2025").getItem(0))
    older = tall(old, "old_rate")
    direct = newer.join(older, ["model_key", "bucket"], "left_semi")
    indirect = newer.join(older, ["model_key", "bucket"], "left_anti")
    pairs = direct.join(older, ["model_key", "bucket"]).select(
        "model_key", "bucket", "old_rate", "new_rate").unionByName(
        indirect.join(older.withColumnRenamed("model_key", "old_key"), ["old_key", "bucket"])
        .select("model_key", "bucket", "old_rate", "new_rate"))
    differs = F.abs(F.col("old_rate") - F.col("new_rate")) > 1e-9
    return pairs.where(F.col("old_rate").isNotNull()
                       & (F.col("new_rate").isNull() | differs)).withColumn(
        "finding", F.when(F.col("new_rate").isNull(), "absent").otherwise("differs"))


def add_snapshot(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of an incoming snapshot whose version is new. Snapshots are never
    rewritten: a version that exists already adds nothing."""
    return incoming.join(existing.select("pricing_version").distinct(), "pricing_version",
                         "left_anti")


def effective_version(sessions: DataFrame, sheets: DataFrame, at: str) -> DataFrame:
    """Attach the pricing_version in force on a session's day.

    Only the distinct days are looked up, then joined back.
    """
    dates = sheets.select(
        F.lit(0).alias("all"), "pricing_version",
        F.to_date("effective_date").alias("from_day")).distinct()
    day = F.to_date(at)
    days = sessions.select(F.lit(0).alias("all"), day.alias("on_day")).distinct()
    in_force = asof(days, dates, ["all"], "on_day", "from_day",
                    {"pricing_version": "pricing_version"}, tie="pricing_version").drop("all")
    return sessions.withColumn("on_day", day).join(in_force, "on_day", "left").drop("on_day")


def with_dated_rates(sessions: DataFrame, sheets: DataFrame, list_col: str = "model_list",
                     suffix: str = "", lists_of: DataFrame | None = None) -> DataFrame:
    """As ``with_rates``, each session by the sheet of its own pricing_version.

    The version becomes part of the id and of the key, so one prefix lookup
    serves all sheets.
    """
    def tagged(name: Column) -> Column:
        return F.concat(F.col("pricing_version"), F.lit("\x01"), name)

    ids = F.transform(list_col, tagged)
    source = (lists_of if lists_of is not None else sessions).select(ids.alias("__ids"))
    keyed = sheets.withColumn("model_key", tagged(F.col("model_key")))
    return with_rates(sessions.withColumn("__ids", ids), keyed, "__ids", suffix, source).drop("__ids")
