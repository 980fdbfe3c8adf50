"""Ordered scans that survive a hot key.

A running value over ``PARTITION BY key ORDER BY pos`` puts every row of one
key into one task. That is the right plan while keys are small. When one key
holds more rows than a task should, the rows are cut into ordered blocks, the
scan runs inside each block, and what earlier blocks contribute is carried in
from a table with one row per (key, block).

Whether blocks are needed is decided by one counting job (map-side combined,
key columns only), so ordinary data keeps the plain single-window plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

ROWS_PER_BLOCK = 4_000_000
#: Least rows of a range partition; smaller blocks are cut inside it.
ROWS_PER_RANGE = 500_000
BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum`` or ``last`` (last non-null)."""

    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value: Column) -> Running:
    return Running("sum", value)


def latest(value: Column) -> Running:
    """Last non-null value up to and including the row."""
    return Running("last", value)


def latest_before(value: Column) -> Running:
    """Last non-null value strictly before the row."""
    return Running("last", value, inclusive=False)


def rows_per_key(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows in the biggest key, rows in all)."""
    row = (df.groupBy(*keys).count()
           .agg(F.max("count").alias("top"), F.sum("count").alias("total")).first())
    return (row["top"] or 0, row["total"] or 0)


def with_blocks(df: DataFrame, keys: list[str], order: list[str],
                limit: int = ROWS_PER_BLOCK, ordinal: str | None = None,
                top: int | None = None) -> tuple[DataFrame, bool]:
    """Add an ordered block number when the biggest key exceeds ``limit`` rows.

    ``top``, a known bound on the rows of any key, saves the counting job while
    it is within the limit.

    With an ``ordinal`` column (a row position, unique within the key) blocks
    are a plain division. Without one, rows are range-partitioned on
    (keys, order), which splits a hot key at sampled cut points; the result is
    written out because cut points may differ between two evaluations. Blocks smaller
    than ``ROWS_PER_RANGE`` are cut by the row's place in its sorted partition, as the samples
    and task results that reach the driver grow with the number of partitions.
    """
    if top is not None and top <= limit:
        return df, False
    top, total = rows_per_key(df, keys)
    if top <= limit:
        return df, False
    if ordinal is not None:
        return df.withColumn(BLOCK, F.floor(F.col(ordinal) / F.lit(limit)).cast("long")), True
    parts = max(2, -(-total // max(limit, ROWS_PER_RANGE)))
    by = [F.col(c) for c in [*keys, *order]]
    cut = df.repartitionByRange(parts, *by)
    if limit >= ROWS_PER_RANGE:
        return durable(cut.withColumn(BLOCK, F.spark_partition_id().cast("long"))), True
    # the id holds the partition above its 33 lowest bits and the place in it below, so blocks ascend
    return durable(cut.sortWithinPartitions(*by).withColumn(BLOCK, F.expr(f"monotonically_increasing_id() div {limit}"))), True


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running],
            limit: int = ROWS_PER_BLOCK, ordinal: str | None = None,
            top: int | None = None) -> DataFrame:
    """Add each running value in ``values`` as a column.

    ``order`` must give a total order within a key; rows with a null key form
    one key of their own.
    """
    inputs = {name: f"__in_{name}" for name in values}
    df = df.select("*", *[v.value.alias(inputs[n]) for n, v in values.items()])
    df, blocked = with_blocks(df, keys, order, limit, ordinal, top)
    scope = [*keys, BLOCK] if blocked else keys
    ordered = Window.partitionBy(*scope).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    local = []
    for name, item in values.items():
        frame = upto if item.inclusive else before
        source = F.col(inputs[name])
        if item.kind == "sum":
            local.append(F.sum(source).over(frame).alias(name))
        else:
            local.append(F.last(source, ignorenulls=True).over(frame).alias(name))
    scanned = df.select("*", *local)
    if not blocked:
        return scanned.drop(*inputs.values())

    position = F.struct(*order)

    def block_total(name: str, item: Running) -> Column:
        source = F.col(inputs[name])
        if item.kind == "sum":
            return F.sum(source)
        return F.max_by(source, F.when(source.isNotNull(), position))

    totals = [block_total(n, v).alias(f"__tot_{n}") for n, v in values.items()]
    earlier = (Window.partitionBy(*keys).orderBy(BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))

    def carried_in(name: str, item: Running) -> Column:
        total = F.col(f"__tot_{name}")
        if item.kind == "sum":
            return F.sum(total).over(earlier)
        return F.last(total, ignorenulls=True).over(earlier)

    carries = [carried_in(n, v).alias(f"__carry_{n}") for n, v in values.items()]
    carried = df.groupBy(*scope).agg(*totals).select(*scope, *carries)
    same = F.lit(True)
    for c in scope:  # a null key is a key, as it is to a window
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
    joined = scanned.alias("s").join(carried.alias("c"), same, "left").select(
        "s.*", *[f"c.__carry_{n}" for n in values])
    for name, item in values.items():
        carry = F.col(f"__carry_{name}")
        if item.kind == "sum":
            value = F.when(carry.isNull(), F.col(name)).otherwise(
                carry + F.coalesce(F.col(name), F.lit(0)))
        else:
            value = F.coalesce(F.col(name), carry)
        joined = joined.withColumn(name, value)
    return joined.drop(BLOCK, *inputs.values(), *[f"__carry_{n}" for n in values])


def asof(probes: DataFrame, facts: DataFrame, keys: list[str], probe_at: str, fact_at: str,
         take: dict[str, str], tie: str | None = None,
         limit: int = ROWS_PER_BLOCK) -> DataFrame:
    """For each probe, the latest fact of its key at or before its time.

    ``take`` maps output names to fact columns. Facts sort before probes at an
    equal time, so a fact at exactly the probe time counts; among facts at one
    time the greatest ``tie`` wins. A probe without a fact keeps nulls. This is
    one union and one scan: no pair of probe and fact is ever formed.
    """
    key_cols = [F.col(k) for k in keys]
    tie_type = facts.schema[tie].dataType if tie else None
    fact_rows = facts.where(F.col(fact_at).isNotNull()).select(
        *key_cols, F.col(fact_at).alias("__at"), F.lit(0).alias("__kind"),
        (F.col(tie) if tie else F.lit(0)).alias("__tie"),
        F.struct(*[F.col(c).alias(n) for n, c in take.items()]).alias("__fact"),
    )
    probe_rows = probes.select(
        *key_cols, F.col(probe_at).alias("__at"), F.lit(1).alias("__kind"),
        (F.lit(None).cast(tie_type) if tie else F.lit(0)).alias("__tie"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("__probe"),
    )
    timeline = fact_rows.unionByName(probe_rows, allowMissingColumns=True)
    scanned = running(timeline, keys, ["__at", "__kind", "__tie"],
                      {"__seen": latest(F.col("__fact"))}, limit=limit)
    return scanned.where(F.col("__kind") == 1).select(
        "__probe.*", *[F.col(f"__seen.{n}").alias(n) for n in take])
