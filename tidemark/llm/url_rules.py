"""URL rules by a sort-merge range join: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, materialize, small

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
# Behind every path that goes on: no path has this code point, which is none of a character.
HIGHEST = "\U0010ffff"
# Pages of one sweep.
SHARE = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The labels of a host from last to first, each with a dot, then the path: what a rule covers under its host are the keys that begin with its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."), path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def rule_bounds(rules: DataFrame) -> DataFrame:
    """(site, key, kind, rule): where the interval of each rule opens (kind 1) and closes (kind 0) among the keys of its host.

    The keys that begin with k are those from k up to k and the highest character, so that two intervals are nested or apart. Rules without a host, path or verdict are none; of rules with the same host and path the verdict
    that sorts last holds.
    """
    own = rules.select(F.translate("host", UPPER, LOWER).alias("site"), F.col("path"), "verdict").where("site is not null and path is not null and verdict is not null")
    own = own.groupBy("site", "path").agg(F.max("verdict").alias("verdict")).withColumn("rule", F.struct(F.concat("site", "path").alias("rule"), "verdict"))
    key = canonical(F.col("site"), F.col("path"))
    ends = F.array(F.struct(key.alias("key"), F.lit(1).alias("kind")), F.struct(F.concat(key, F.lit(HIGHEST)).alias("key"), F.lit(0).alias("kind")))
    return own.select("site", F.explode(ends).alias("b"), "rule").select("site", "b.*", "rule")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", share: int = SHARE, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict.

    A page has one canonical key under its host and one under every host above it; those under hosts without rules fall away. Of each host,
    pages and the bounds of its rules' intervals are sorted by key, and one sweep keeps the stack of open rules: its depth is the sum of bounds passed,
    and its top at a depth is the last rule that opened there. The top under the longest host wins. A host that more than `share` pages are looked
    for under is dealt into sweeps of about as many, or as many as the host has bounds, of which each sweep has all. `default` is the verdict where no rule fits; rule is
    null there. Null urls and such without :// have an empty host and path. Repeated rows and null ids each keep a row of their own; urls
    of any length are taken whole; an empty table gives no rows; other columns aren't read.
    """
    host, path = host_and_path(F.col(url))
    rows = materialize(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    bounds = materialize(rule_bounds(rules), "bounds")
    sites = bounds.select("site").distinct()

    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    probes = rows.select("row", "path", F.explode(above).alias("site")).join(small(sites, max_broadcast_rows), "site", "left_semi")
    probes = materialize(probes, "probes")
    most = F.greatest(F.lit(share), F.col("n_bounds"))
    hot = probes.groupBy("site").count().where(F.col("count") > share).join(bounds.groupBy("site").agg(F.count("*").alias("n_bounds")), "site")
    hot = materialize(hot.select("site", F.ceil(F.col("count") / most).cast("int").alias("parts")).where("parts > 1"), "hot-sites")
    dealt = lambda df, part: df.join(small(hot, max_broadcast_rows), "site", "left").withColumn("part", part(F.coalesce("parts", F.lit(1)))).drop("parts")

    swept = dealt(probes, lambda n: F.pmod(F.xxhash64("row"), n).cast("int")).select("site", "part", canonical(F.col("site"), F.col("path")).alias("key"), F.lit(2).alias("kind"), "row", F.lit(None).cast(bounds.schema["rule"].dataType).alias("rule")).unionByName(
        dealt(bounds, lambda n: F.explode(F.sequence(F.lit(0), n - 1))).select("site", "part", "key", "kind", F.lit(None).cast("long").alias("row"), "rule")
    )
    # At one key intervals close, the outer ones open before the inner (their paths are equal only if they are one), pages come last.
    sweep = Window.partitionBy("site", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(sweep)
    opened = Window.partitionBy("site", "part", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 1, F.col("rule")), ignorenulls=True).over(opened)
    hits = swept.withColumn("depth", depth).withColumn("top", top).where("kind = 2 and depth > 0")
    best = hits.groupBy("row").agg(F.max_by("top", F.length("site")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
