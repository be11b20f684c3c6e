"""Scalars: times, frames, rates, intervals, geometry. Rounding is half to even, as everywhere in this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
# Frame rates that a measured rate is taken for, as (numerator, denominator).
RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1), (120, 1))


def clock(seconds: Column) -> Column:
    """H:MM:SS"""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def subtitle_time(seconds: Column) -> Column:
    """H:MM:SS.CC"""
    c = F.bround(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def subtitle_color(rgb: Column) -> Column:
    """#RRGGBB as &H00BBGGRR"""
    return F.concat(F.lit("&H00"), F.upper(F.concat(F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2))))


def frame_floor(t: Column, num: Column | int, den: Column | int) -> Column:
    return F.floor(t * num / den + EPS)


def frame_ceil(t: Column, num: Column | int, den: Column | int) -> Column:
    return F.ceil(t * num / den - EPS)


def standard_rate(rate: Column, within: float = 0.005) -> Column:
    """The nearest of RATES within half a percent as num/den text, else null."""
    gaps = F.array(*(F.struct(F.abs(rate - n / d).alias("gap"), F.lit(f"{n}/{d}").alias("name"), F.lit(n / d).alias("rate")) for n, d in RATES))
    best = F.array_min(gaps)
    return F.when(best["gap"] <= within * best["rate"], best["name"])


def sparkline(df: DataFrame, keys: list[str], i: str, value: str, buckets: int) -> DataFrame:
    """Largest value by bucket; bucket b of n samples covers [b * n // buckets, (b + 1) * n // buckets)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    b = F.floor(((F.col(i) + 1) * buckets - 1) / F.col("_n"))
    return df.withColumn("_n", n).groupBy(*keys, b.alias("bucket")).agg(F.max(value).alias(value))


def cut_time(times: DataFrame, cuts: DataFrame, key: str, t: str) -> DataFrame:
    """Where time t lies after the cuts [c_start, c_end) before it are taken out; inside a cut, where the cut was."""
    c = cuts.select(key, F.col("c_start").alias("_t"), F.lit(0).alias("_k"), (F.col("c_end") - F.col("c_start")).alias("_len"), F.col("c_end").alias("_end"))
    all_ = times.withColumn("_t", F.col(t)).withColumn("_k", F.lit(1)).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = all_.withColumn("_gone", F.coalesce(F.sum("_len").over(w), F.lit(0.0))).withColumn("_open", F.last("_end", ignorenulls=True).over(w)).where("_k = 1")
    return out.withColumn("mapped", F.col(t) - F.col("_gone") + F.greatest(F.coalesce(F.col("_open") - F.col(t), F.lit(0.0)), F.lit(0.0))).drop("_t", "_k", "_len", "_end", "_gone", "_open")


def gain(loudness: Column, target: float, limit: float = 20.0) -> Column:
    """What to do to reach the target: silent, refuse over the limit, or the gain in decibels as text."""
    g = F.lit(target) - loudness
    return F.when(loudness.isNull() | (loudness == float("-inf")), "silent").when(g > limit, "refuse").otherwise(F.format_string("%.2f", g))


def byte_range(header: Column, size: Column) -> Column:
    """First and last byte of bytes=a-b, a- or -n; null if it can't be satisfied."""
    a = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1)
    b = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    x, y = a.try_cast("long"), b.try_cast("long")
    start = F.when(a != "", x).when(b != "", F.greatest(size - y, F.lit(0)))
    end = F.when((a != "") & (b != ""), F.least(y, size - 1)).otherwise(size - 1)
    return F.when(F.regexp_like(header, F.lit(r"^bytes=\d*-\d*$")) & (start < size) & (start <= end) & ~((a == "") & (y <= 0)), F.struct(start.alias("first"), end.alias("last")))
