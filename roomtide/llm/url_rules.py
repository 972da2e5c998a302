"""Allow and block rules for URLs as a sort-merge range join.

A rule names a host, with its subdomains, and the start of a path. Written with the labels of the
host reversed, a rule is a prefix, and a prefix is an interval of sorted keys. Intervals of one host
lie inside each other or apart, so a sweep over the sorted keys needs only the stack of the rules
that are open: each start and end of an interval carries the stack that holds from there on, and
every URL takes the stack of the last boundary before it. A URL takes part once for each suffix of
its host that may be a rule's host.

Keys are dealt in ranges and swept range by range; a range learns the stack that is open at its
start from one row for each range. Equal host and path are swept once, however many URLs have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomtide.sources.scratch import stored

UNMATCHED = "allow"
#: The rules (host, path, verdict) that the query applies.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, _AFTER_SCHEME, 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 2), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.concat_ws(".", F.reverse(labels))


def _key(reversed_host: Column) -> Column:
    """No host has a slash, so the first one ends it."""
    return F.concat(reversed_host, F.lit("/"), F.col("path"))


def _boundaries(rules: DataFrame) -> DataFrame:
    """Where a stack of open rules begins to hold: `at`, `stack` (outermost rule first)."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    one_each = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(host.alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    named = one_each.select(
        _key(_reversed(F.split("host", r"\."))).alias("key"),
        F.length("path").alias("path_length"),
        F.struct(
            F.concat("host", "path").alias("rule"),
            "verdict",
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
        ).alias("rule"),
    )
    named = stored(named, "url-rules")
    # A rule lies in those whose key is a shorter prefix of its own: the path, cut at each length.
    cuts = F.sequence(F.lit(0), F.col("path_length"))
    whole = F.length("key")
    prefixes = named.select(
        F.col("key").alias("inner"),
        F.explode(F.transform(cuts, lambda n: F.substring("key", F.lit(1), whole - n))).alias("key"),
    )
    stacks = (
        prefixes.join(named.select("key", F.col("rule").alias("open")), "key")
        .groupBy("inner")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("key").alias("n"), "open"))).alias("all"))
        .select(F.col("inner").alias("key"), F.col("all.open").alias("stack"))
    )
    starts = stacks.select(F.col("key").cast("binary").alias("at"), "stack")
    # No text has the byte 0xFF: behind the prefix it sorts after all that starts with it.
    ends = stacks.select(
        F.concat(F.col("key").cast("binary"), F.lit(b"\xff")).alias("at"),
        F.slice("stack", 1, F.size("stack") - 1).alias("stack"),
    )
    return starts.unionByName(ends)


def _swept(events: DataFrame) -> DataFrame:
    """The URL keys among `events` with the innermost rule open at each, null if there is none."""
    order = ["at", "is_url"]
    ranges = stored(
        events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "url-ranges"
    )
    within = Window.partitionBy("part").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranges.withColumn("open", F.last("stack", ignorenulls=True).over(so_far)).where("is_url")
    # One row for each range: the last stack of the ranges before it.
    boundary = F.when(~F.col("is_url"), F.col("at"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left_open = (
        ranges.groupBy("part")
        .agg(F.max_by("stack", boundary).alias("last"))
        .select("part", F.last("last", ignorenulls=True).over(earlier).alias("left_open"))
    )
    stack = F.coalesce("open", "left_open")
    return swept.join(left_open, "part").select(
        "host", "path", F.try_element_at(stack, F.lit(-1)).alias("rule")
    )


def apply_rules(pages: DataFrame, rules: DataFrame, unmatched: str = UNMATCHED) -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict` for every row of `pages` (`page_id`, `url`).

    The longest rule (host and path together; of equal ones that with the longer host) decides;
    where none fits, `rule` is null and the verdict is `unmatched`. A null url or one without `://`
    has an empty host and path. Of rules with the same host and path the larger verdict counts, so
    block before allow; rules with nulls are left out. Repeated rows and null ids are judged like
    any other; other columns are ignored."""
    located = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rules = rules.where("host IS NOT NULL")
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda n: _reversed(F.slice(labels, F.size(labels) - n + 1, n)),
    )
    keys = located.select("host", "path").distinct().select(
        "host", "path", F.explode(F.when(F.lit(most) > 0, suffixes)).alias("suffix")
    )
    boundaries = _boundaries(rules)
    events = keys.select(
        _key(F.col("suffix")).cast("binary").alias("at"),
        F.lit(True).alias("is_url"),
        "host",
        "path",
    ).unionByName(boundaries.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    best = (
        _swept(events)
        .where("rule IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max_by("rule", F.struct("rule.size", "rule.host_size")).alias("best"))
    )
    return located.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(unmatched)).alias("verdict"),
    )
