"""First-match lookup of an id by prefix, as equality joins.

``id LIKE key%`` against a table of keys is a nested loop. Instead every
distinct id is expanded to its own prefixes (at most its length), which meet
the keys by equality; the ordered first match is then one aggregate. Ids are
made distinct first, so the work follows the number of ids, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_prefix(ids: DataFrame, id_col: str, keys: DataFrame, key_col: str,
                 ordinal: str) -> DataFrame:
    """(id, matched key, exact) per distinct id that matches.

    An exact key wins; otherwise the first key by ``ordinal`` that the id
    starts with.
    """
    spread = ids.select(F.col(id_col).alias("id")).where("id is not null").distinct().select(
        "id", F.explode(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))))
        .alias("upto")).select("id", F.substring("id", F.lit(1), F.col("upto")).alias("prefix"))
    hits = spread.join(keys.select(F.col(key_col).alias("prefix"),
                                   F.col(ordinal).alias("ordinal")), "prefix")
    inexact = F.when(F.col("prefix") == F.col("id"), 0).otherwise(1)
    return hits.groupBy("id").agg(
        F.min_by("prefix", F.struct(inexact, "ordinal")).alias("matched"),
        (F.min(inexact) == 0).alias("exact"))


def first_in_list(lists: DataFrame, list_col: str, matches: DataFrame,
                  value_col: str) -> DataFrame:
    """Per distinct list of ids, the match of its first id that has one."""
    spread = lists.select(F.col(list_col).alias("ids")).where("ids is not null").distinct().select(
        "ids", F.posexplode("ids").alias("rank", "id"))
    return (spread.join(matches, "id").groupBy("ids")
            .agg(F.min_by(value_col, "rank").alias(value_col)))
