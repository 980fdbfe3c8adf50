"""Points inside spans of their key, without comparing all points with all spans.

Time is cut into cells of a power of two of microseconds. A span lies in at most two
cells of the least width over its own length, so it is listed under those, at that one
level. A point looks into its cell of every level that some span uses (64 at most). The
join is then an equality on (key, level, cell), which splits a busy key by time; a pair
meets exactly once, and at least a quarter of the time a cell listing covers is inside its span.

A key with few spans needs no cells: up to ``SPANS_AT_ONCE`` of them, as many as the levels a point
might look into, are met by its points directly, so that neither side is listed more than once.
A key with more spans, or with more than ``limit`` points, goes by cells.

A cell with more than ``limit`` points is dealt into parts by a hash of the point, and its
spans are copied to each part, so a burst of points at one time is not one task either.

Defined cases: points without a time, spans without a start or end, spans that end before
they start, and null keys meet nothing; both ends of a span belong to it; repeated rows
meet as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

POINTS_PER_CELL = 1_000_000
SPANS_AT_ONCE = 64
CELL = ["__level", "__cell"]


def cell_of(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def stabs(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str,
          take: list[str], limit: int = POINTS_PER_CELL, at_once: int = SPANS_AT_ONCE) -> DataFrame:
    """Every point with each span of its key that holds it: the point's columns and ``take`` of the span."""
    opens, closes = F.unix_micros(start), F.unix_micros(end)
    named = {c: f"__span_{c}" for c in take}
    listed = spans.where(closes >= opens).select(
        *keys, opens.alias("__opens"), closes.alias("__closes"), *[F.col(c).alias(n) for c, n in named.items()])
    asked = points.where(F.col(at).isNotNull()).withColumn("__at", F.unix_micros(at))

    def beyond(rows: DataFrame, most: int) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys)

    # few keys by nature, as each has many rows
    busy = durable(beyond(listed, at_once).unionByName(beyond(asked, limit)).distinct())
    if busy.isEmpty():
        met = inside(asked.join(listed, keys))
    else:
        few = inside(asked.join(busy, keys, "left_anti").join(listed.join(busy, keys, "left_anti"), keys))
        many = by_cells(asked.join(busy, keys, "left_semi"), listed.join(busy, keys, "left_semi"), keys,
                        points.columns, limit)
        columns = [*points.columns, *named.values()]
        met = few.select(*columns).unionByName(many.select(*columns))
    return met.select(*[F.col(c) for c in points.columns], *[F.col(n).alias(c) for c, n in named.items()])


def inside(met: DataFrame) -> DataFrame:
    return met.where(F.col("__at").between(F.col("__opens"), F.col("__closes")))


def by_cells(points: DataFrame, spans: DataFrame, keys: list[str], of_point: list[str], limit: int) -> DataFrame:
    """Points and spans of busy keys, met by level and cell."""
    listed = spans.withColumn("__level", F.length(F.bin(F.col("__closes") - F.col("__opens"))))
    level = F.col("__level")
    listed = durable(listed.withColumn("__cell", F.explode(F.array_distinct(F.array(
        cell_of(F.col("__opens"), level), cell_of(F.col("__closes"), level))))))
    levels = [r[0] for r in listed.select("__level").distinct().collect()]  # at most 64
    asks = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), cell_of(F.col("__at"), F.lit(n)).alias("cell"))
                               for n in sorted(levels)] or [F.lit(None).cast("struct<level:int,cell:bigint>")]))
    placed = points.withColumn("__ask", asks).withColumn("__level", F.col("__ask.level")) \
        .withColumn("__cell", F.col("__ask.cell")).drop("__ask")

    cells = [*keys, *CELL]
    parts = F.ceil(F.col("__points") / limit).cast("int")
    crowded = durable(placed.groupBy(*cells).agg(F.count("*").alias("__points")).where(F.col("__points") > limit)
                      .select(*cells, parts.alias("__parts")))
    dealt = placed.join(crowded, cells, "left").withColumn(
        "__part", F.pmod(F.xxhash64(*of_point), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = listed.join(crowded, cells, "left").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return inside(dealt.join(copied, [*cells, "__part"]))
