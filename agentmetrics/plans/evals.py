"""Replay results: solve rates, cost per tier, overspend and tests between tiers."""

from __future__ import annotations

from math import asin, ceil, log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from ..operators.keyed import count_if, last_per_key
from ..session import durable
from . import pricing


def solved(completed: Column, capped: Column, build: Column, passed: Column,
           total: Column) -> Column:
    """A run counts only if it finished under its cap, built, and passed every
    one of at least one test."""
    return F.coalesce(completed & ~capped & (build == "pass") & (total > 0) & (passed == total),
                      F.lit(False))


def turn_capped(subtype: Column, turns: Column, cap: int = 60) -> Column:
    return F.coalesce(subtype == "error_max_turns", F.lit(False)) | (
        F.coalesce(turns, F.lit(0)) > cap)


def tier_grid(runs: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Per tier: runs, solved, cost, mean turns, wall time and cost per solve.

    ``adjustments`` (model_id, factor) restates the cost of a tier's model where
    list and billed rates differ. A missing cost counts as nothing; mean turns
    are over the runs that know them.
    """
    grid = runs.groupBy("tier").agg(
        F.min_by("model_id", "ordinal").alias("model_id"), F.count("*").alias("n"),
        count_if(F.col("solved")).alias("solved"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.avg("turns").alias("mean_turns"),
        F.sum(F.coalesce("wall_seconds", F.lit(0.0))).alias("wall_seconds"))
    if adjustments is not None:
        grid = grid.join(adjustments, "model_id", "left")
    else:
        grid = grid.withColumn("factor", F.lit(None).cast("double"))
    billed = F.col("cost") * F.coalesce("factor", F.lit(1.0))
    return grid.select(
        "tier", "model_id", "n", "solved", "cost", "mean_turns", "wall_seconds",
        billed.alias("cost_billed"), F.col("factor").isNotNull().alias("restated"),
        C.ratio(billed, F.col("solved")).alias("per_solve"))


def with_wilson(df: DataFrame, successes: str, n: str) -> DataFrame:
    return df.withColumn("ci_lower", C.wilson(F.col(successes), F.col(n), upper=False)).withColumn(
        "ci_upper", C.wilson(F.col(successes), F.col(n), upper=True))


def curve_points(policies: DataFrame, metric_suffix: str = "full_run_n1") -> DataFrame:
    """Quality-curve points of the wanted metric; the last point of a tier wins."""
    points = policies.select("policy_id", F.posexplode("quality_curve").alias("at", "p")).where(
        F.col("p.metric").endswith(metric_suffix)).select("policy_id", "at", "p.*")
    return last_per_key(points, ["policy_id", "model_tier"], ["at"])


def in_scope(sessions: DataFrame, classes: DataFrame, task_type: str) -> DataFrame:
    """Sessions labelled with the policy's task type at session grain."""
    wanted = classes.where((F.col("unit") == "session") & (F.col("task_type") == task_type))
    return sessions.join(wanted.select("session_id"), "session_id", "left_semi")


def lead_tier(sessions: DataFrame, tiers: DataFrame, list_col: str = "model_list") -> DataFrame:
    """Attach the tier of the first model in the list that has one."""
    from ..operators.prefix import first_in_list
    lists = sessions.select(list_col).distinct()
    known = pricing.tier_of(lists.select(F.explode(list_col).alias("m")), "m", tiers)
    by_list = first_in_list(lists, list_col, known, "tier").withColumnRenamed("ids", list_col)
    return sessions.join(durable(by_list), list_col, "left")


def overspend(tiered_sessions: DataFrame, sheet: DataFrame, mid_model: str) -> DataFrame:
    """Frontier sessions at their own and at the mid model's price, and how many
    small-tier sessions sit below the floor. Sessions without tokens or without
    either price are left out."""
    rated = pricing.with_rates(tiered_sessions, sheet, suffix="_own")
    rated = rated.withColumn("own", pricing.session_price("_own"))
    mid = rated.withColumn("mid_list", F.array(F.lit(mid_model)))
    one = sheet.select(F.array(F.lit(mid_model)).alias("mid_list"))
    mid = pricing.with_rates(mid, sheet, "mid_list", "_mid", one).withColumn(
        "mid", pricing.session_price("_mid"))
    tokens = F.coalesce(*[F.col(b) for b in fixed.TOKEN_BUCKETS]).isNotNull()
    over = (F.col("tier") == "frontier") & F.col("own").isNotNull() & F.col("mid").isNotNull()
    return mid.where(tokens).agg(
        count_if(over).alias("sessions"),
        F.coalesce(F.sum(F.when(over, F.col("own"))), F.lit(0.0)).alias("actual"),
        F.coalesce(F.sum(F.when(over, F.col("mid"))), F.lit(0.0)).alias("at_mid"),
        count_if(over & (F.col("cohort") == "eval_harness")).alias("eval_sessions"),
        count_if(F.col("tier") == "small").alias("below_floor")).withColumn(
        "delta", F.col("actual") - F.col("at_mid"))


def accessible_tiers(model_rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tiers proven by traffic, with the models that prove them."""
    return (pricing.tier_of(model_rows, "model_id", tiers).groupBy("tier")
            .agg(F.array_sort(F.collect_set("id")).alias("models")))


def missing_cells(tasks: DataFrame, runs: DataFrame, models: list[str]) -> DataFrame:
    """Task and model pairs of the grid that have no run yet."""
    grid = tasks.select("task_id", F.explode(F.array(*[F.lit(m) for m in models]))
                        .alias("model_id"))
    return grid.join(runs.select("task_id", "model_id").distinct(), ["task_id", "model_id"],
                     "left_anti")


# -- repeated runs -----------------------------------------------------------------------

def cells(runs: DataFrame) -> DataFrame:
    """Runs and solved runs per task and tier."""
    return runs.groupBy("task_id", "tier").agg(
        F.count("*").alias("n"), count_if(F.col("solved")).alias("solved"))


def flaky(cell_rows: DataFrame) -> DataFrame:
    return cell_rows.where((F.col("solved") > 0) & (F.col("solved") < F.col("n")))


def flipped(single: DataFrame, repeated: DataFrame) -> DataFrame:
    """Cells whose single run says the opposite of every repeated run."""
    both = single.select("task_id", "tier", F.col("solved").alias("once")).join(
        repeated.select("task_id", "tier", "n", "solved"), ["task_id", "tier"])
    return both.where(((F.col("once") == 0) & (F.col("solved") == F.col("n")))
                      | ((F.col("once") > 0) & (F.col("solved") == 0)))


def solved_only_by(cell_rows: DataFrame, tier: str, other: str) -> DataFrame:
    """Tasks one tier solved and the other did not; none when failures nest."""
    def won(name: str) -> DataFrame:
        return cell_rows.where((F.col("tier") == name) & (F.col("solved") > 0)).select("task_id")

    return won(tier).join(won(other), "task_id", "left_anti")


def paired(cell_rows: DataFrame, a: str, b: str) -> DataFrame:
    """Both tiers' counts per task that has both, from one aggregate."""
    def of(tier: str, name: str, alias: str) -> Column:
        return F.max(F.when(F.col("tier") == tier, F.col(name))).alias(alias)

    return cell_rows.where(F.col("tier").isin(a, b)).groupBy("task_id").agg(
        of(a, "n", "n_a"), of(a, "solved", "k_a"), of(b, "n", "n_b"), of(b, "solved", "k_b")
    ).where(F.col("n_a").isNotNull() & F.col("n_b").isNotNull())


def sign_counts(pairs: DataFrame) -> DataFrame:
    """Tasks favouring either tier, and ties, by solve rate."""
    lead = F.col("k_a") * F.col("n_b") - F.col("k_b") * F.col("n_a")
    return pairs.agg(count_if(lead > 0).alias("favour_a"), count_if(lead < 0).alias("favour_b"),
                     count_if(lead == 0).alias("tied"))


def _choose(n: Column, x: Column) -> Column:
    """Ways to choose x of n."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(1.0),
                       lambda acc, i: F.when(i > x, acc).otherwise(acc * (n - x + i) / i))


def highest_frequency(size: int, spread: float) -> int:
    """The last frequency that can count in the inverse transform of a sum with variance ``spread``.

    A hypergeometric count is a sum of independent Bernoulli variables, so at w the characteristic function
    is at most exp(-2 spread sin(w/2)^2). Beyond this frequency that is under exp(-60) / size^2, and
    all such terms together stay below what a double can hold beside one.
    """
    share = (60 + 2 * log(size)) / (2 * spread) if spread > 0 else 1.0
    return min(size // 2, ceil(asin(sqrt(share)) * size / pi)) if share < 1 else size // 2


def permutation_test(pairs: DataFrame) -> DataFrame:
    """Exact two-sided p of the difference in solved runs, labels permuted
    within each task.

    Within a task the permuted count is hypergeometric, and tasks are
    independent, so the distribution of the sum is a product of characteristic
    functions: a sum of logarithms over tasks, at each frequency. Tasks with
    equal counts share one term. The inverse transform is a sum over frequencies;
    those above the middle mirror the ones below, and those past ``highest_frequency`` add nothing.
    """
    k = (F.col("k_a") + F.col("k_b")).alias("k")
    signatures = durable(pairs.groupBy("n_a", "n_b", k).agg(
        F.count("*").alias("tasks"), F.sum(F.col("k_a") - F.col("k_b")).alias("lead")))
    n = F.col("n_a") + F.col("n_b")
    variance = F.coalesce(F.try_divide(F.col("n_a").cast("double") * F.col("n_b") * F.col("k") * (n - F.col("k")),
                                       n.cast("double") * n * (n - 1)), F.lit(0.0))
    row = signatures.agg(F.coalesce(F.sum(F.col("k") * F.col("tasks")), F.lit(0)).alias("total"),
                         F.abs(F.coalesce(F.sum("lead"), F.lit(0))).alias("lead"),
                         F.coalesce(F.sum(F.col("tasks") * variance), F.lit(0.0)).alias("spread")).first()
    total, lead = int(row["total"]), int(row["lead"])
    size, low, high = total + 1, (total - lead) // 2, -(-(total + lead) // 2)

    def way(x: Column) -> Column:
        return F.struct(x.alias("x"), (_choose(F.col("n_a"), x) * _choose(F.col("n_b"), F.col("k") - x)
                                       / _choose(F.col("n_a") + F.col("n_b"), F.col("k"))).alias("p"))

    span = F.sequence(F.greatest(F.lit(0), F.col("k") - F.col("n_b")), F.least("n_a", "k"))
    w = F.col("i") * F.lit(2 * pi / size)

    def part(wave) -> Column:
        return F.aggregate("ways", F.lit(0.0), lambda acc, e: acc + e["p"] * wave(w * e["x"]))

    terms = signatures.select("tasks", F.transform(span, way).alias("ways")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(highest_frequency(size, row["spread"]))))).select(
        "i", "tasks", part(F.cos).alias("re"), part(F.sin).alias("im"))
    modulus = F.log(F.greatest(F.hypot("re", "im"), F.lit(1e-300)))
    factor = terms.groupBy("i").agg(F.sum(F.col("tasks") * modulus).alias("log_modulus"),
                                    F.sum(F.col("tasks") * F.atan2("im", "re")).alias("angle"))
    # sum of exp(-iwx) over the inner outcomes low < x < high
    count = high - low - 1
    kernel = F.when(F.col("i") == 0, F.lit(float(count))).otherwise(
        F.try_divide(F.sin(w * (count / 2)), F.sin(w / 2)))
    mirrored = F.when((F.col("i") == 0) | (F.col("i") * 2 == size), 1.0).otherwise(2.0)
    inside = factor.agg(F.coalesce(F.sum(mirrored * F.exp("log_modulus") * kernel * F.cos(
        F.col("angle") - w * ((low + high) / 2))), F.lit(0.0)).alias("inside"))
    return inside.select(
        F.lit(lead).cast("long").alias("difference"), F.lit(total).cast("long").alias("solved_runs"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("inside") / size)).alias("p_value"))
