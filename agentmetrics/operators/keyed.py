"""Keyed picks: one row or value per key without a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str],
                  keep: list[str] | None = None) -> DataFrame:
    """The row that sorts first within each key.

    An aggregate, so a hot key is reduced on the map side; a ``row_number``
    window would first move all of it into one task.
    """
    keep = keep if keep is not None else [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*keep), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, "__row.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str],
                 keep: list[str] | None = None) -> DataFrame:
    """The row that sorts last within each key."""
    keep = keep if keep is not None else [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*keep), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, "__row.*")


def earliest(value: Column, position: Column) -> Column:
    """First non-null value in position order."""
    return F.min_by(value, F.when(value.isNotNull(), position))


def final(value: Column, position: Column) -> Column:
    """Last non-null value in position order."""
    return F.max_by(value, F.when(value.isNotNull(), position))


def by_shuffle(df: DataFrame) -> DataFrame:
    """Marks a side with a row a session, or a key as fine: a join with it shuffles, also where its files look small.

    Spark plans by the compressed size of files, shared out over their columns by width. The rows that a
    broadcast holds in the driver were over twenty times that.
    """
    return df.hint("merge")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))
