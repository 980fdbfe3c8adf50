"""URL filters from path-template trees; DataFrame functions only.

Listed rules judge the urls they fit; those urls are the labelled ones. All others
are judged by the template their url falls under. Urls are first counted by host
and path. Per host a tree of path segments grows level by level: a segment that
holds a digit, or has less than a 1 / BRANCHES share of its parent, becomes a
wildcard, so a node has at most BRANCHES named children; segments below DEPTH are
one open end. Siblings are put in order of their share of allowed urls, and
neighbours whose shares do not differ by a two-proportion test are merged: they
pool their counts. A branch's purity is its share of allowed urls, smoothed towards
its parent's with SMOOTHING pseudo-counts; a host's parents are its last two names,
its last name, and all urls. A template under MIN_PURITY is blocked.

Only the url is read. Keys with many rows are joined by ``common.join_groups``.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no rule, and is judged by the template of those; repeated rows are judged alike and
count as often as they occur; without any labelled url purity is 1/2, which allows;
a null page id stays null; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .common import join_groups

DEPTH = 4
BRANCHES = 32
SMOOTHING = 2.0
MIN_PURITY = 0.5
#: A difference of shares over this many standard errors keeps siblings apart.
APART = 1.96
#: Rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LETTERS),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits _host and _path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("_host") == host) | F.col("_host").endswith("." + host)) & F.col("_path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def key(*columns: str) -> Column:
    """Columns as one text; a null differs from every text."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in columns])


def grouped_join(rows: DataFrame, groups: DataFrame, columns: list[str], total: int, size: str = "_size") -> DataFrame:
    out = join_groups(rows.withColumn("_key", key(*columns)), groups.withColumn("_key", key(*columns)).drop(*columns),
                      "_key", size, total)
    return out.drop("_key", size)


def templates(shapes: DataFrame, total: int) -> DataFrame:
    """Adds the prefixes _p0 (empty) to _pDEPTH of each distinct host and path."""
    state = shapes.withColumn("_segments", F.filter(F.split("_path", "/"), lambda s: s != "")) \
        .withColumn("_p0", F.lit(""))
    for d in range(1, DEPTH + 1):
        above = f"_p{d - 1}"
        name = F.get("_segments", F.lit(d - 1))
        state = state.withColumn("_name", F.when(name.rlike("[0-9]"), F.lit("*")).otherwise(name))
        counts = durable(state.groupBy("_host", above, "_name").agg(
            F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_size")))
        totals = counts.groupBy("_host", above).agg(F.sum("_n").alias("_above"), F.count(F.lit(1)).alias("_names"))
        named = grouped_join(counts, totals, ["_host", above], counts.count(), "_names")
        segment = F.when(F.col("_n") * BRANCHES >= F.col("_above"), F.col("_name")).otherwise(F.lit("*"))
        prefix = F.when(F.col("_name").isNull(), F.col(above)).otherwise(F.concat(F.col(above), F.lit("/"), segment))
        named = named.select("_host", above, "_name", "_size", prefix.alias(f"_p{d}"))
        state = durable(grouped_join(state, named, ["_host", above, "_name"], total).drop("_name"))
    return state.withColumn(f"_p{DEPTH}", F.when(
        F.size("_segments") > DEPTH, F.concat(F.col(f"_p{DEPTH}"), F.lit("/**"))).otherwise(F.col(f"_p{DEPTH}"))) \
        .drop("_segments")


def smoothed(good: str, bad: str, above: Column) -> Column:
    return (F.col(good) + F.lit(SMOOTHING) * above) / (F.col(good) + F.col(bad) + F.lit(SMOOTHING))


def host_purity(shapes: DataFrame, overall: float) -> DataFrame:
    """(_host, _p0, _purity): down from all urls by last name, last two names, host."""
    labels = F.split("_host", r"\.")
    hosts = shapes.groupBy("_host").agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad")) \
        .withColumn("_last", F.element_at(labels, -1)).withColumn("_two", F.concat_ws(".", F.slice(F.reverse(labels), 1, 2)))
    hosts = durable(hosts)
    last = hosts.groupBy("_last").agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad")) \
        .select("_last", smoothed("_good", "_bad", F.lit(overall)).alias("_last_purity"))
    two = durable(hosts.groupBy("_two", "_last").agg(
        F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"), F.count(F.lit(1)).alias("_size")))
    names = two.groupBy("_last").agg(F.count(F.lit(1)).alias("_size")).join(last, "_last")
    two = grouped_join(two.withColumnRenamed("_size", "_hosts"), names, ["_last"], two.count()) \
        .select("_two", F.col("_hosts").alias("_size"), smoothed("_good", "_bad", F.col("_last_purity")).alias("_two_purity"))
    return grouped_join(hosts, two, ["_two"], hosts.count()).select(
        "_host", F.lit("").alias("_p0"), smoothed("_good", "_bad", F.col("_two_purity")).alias("_purity"))


def merged(nodes: DataFrame, above: str, own: str) -> DataFrame:
    """Pools the counts of siblings in order whose shares do not differ.

    A parent has at most BRANCHES + 2 branches: its named ones, the wildcard and its end.
    """
    siblings = Window.partitionBy("_host", above)
    order = siblings.orderBy(F.col("_share").asc_nulls_last(), own)
    n = F.col("_good") + F.col("_bad")
    rows = nodes.withColumn("_share", F.when(n > 0, F.col("_good") / n))
    rows = rows.withColumn("_share0", F.lag("_share").over(order)).withColumn("_good0", F.lag("_good").over(order)) \
        .withColumn("_n0", F.lag(n).over(order))
    pooled = F.try_divide(F.col("_good") + F.col("_good0"), n + F.col("_n0"))
    error = F.sqrt(pooled * (1 - pooled) * F.try_divide(n + F.col("_n0"), n * F.col("_n0")))
    apart = F.coalesce(F.col("_share") - F.col("_share0") > F.lit(APART) * error, F.lit(True))
    rows = rows.withColumn("_branch", F.sum(F.when(apart, 1).otherwise(0)).over(order))
    branch = Window.partitionBy("_host", above, "_branch")
    return rows.withColumn("_good", F.sum("_good").over(branch)).withColumn("_bad", F.sum("_bad").over(branch)) \
        .drop("_share", "_share0", "_good0", "_n0", "_branch")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url",
           page_id: str = "page_id", min_purity: float = MIN_PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and the template's purity."""
    host, path = host_and_path(url)
    rule, decision = rule_of(rules)
    urls = pages.select(F.col(page_id).alias("_id"), host.alias("_host"), path.alias("_path")) \
        .withColumn("_rule", rule).withColumn("_decision", decision)
    shapes = durable(urls.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_decision") == "allow").alias("_good"),
        F.count_if(F.col("_decision") == "block").alias("_bad")))
    total = shapes.count()
    state = durable(templates(shapes, total))
    good, bad = shapes.agg(F.coalesce(F.sum("_good"), F.lit(0)), F.coalesce(F.sum("_bad"), F.lit(0))).first()
    purity = host_purity(shapes, (good + 1) / (good + bad + 2))
    for d in range(1, DEPTH + 1):
        above, own = f"_p{d - 1}", f"_p{d}"
        nodes = state.groupBy("_host", above, own).agg(F.sum("_good").alias("_good"), F.sum("_bad").alias("_bad"))
        purity = durable(merged(nodes, above, own).join(purity, ["_host", above]).select(
            "_host", own, smoothed("_good", "_bad", F.col("_purity")).alias("_purity")))
    last = f"_p{DEPTH}"
    sizes = state.groupBy("_host", last).agg(F.count(F.lit(1)).alias("_size"))
    known = grouped_join(state.select("_host", "_path", "_n", last), sizes.join(purity, ["_host", last]),
                         ["_host", last], total)
    known = durable(known.select("_host", "_path", F.col("_n").alias("_size"), F.col(last).alias("_template"), "_purity"))
    found = grouped_join(urls, known, ["_host", "_path"], pages.count())
    verdict = F.coalesce("_decision", F.when(F.col("_purity") < min_purity, "block").otherwise("allow"))
    return found.select(F.col("_id").alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"),
                        F.col("_rule").alias("rule"), verdict.alias("verdict"), F.col("_template").alias("template"),
                        F.col("_purity").alias("purity"))
