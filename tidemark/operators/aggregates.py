"""Summaries over known values, rank statistics, and the counts that reviews are judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import dealt
from .windows import average_rank


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, observed, and over the known values: min, p05, median, p95 (interpolated), max, mean; null where none is known."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("observed"), F.min(value).alias("min"), p.alias("_p"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return out.select(*keys, "n", "observed", "min", F.col("_p")[0].alias("p05"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("p95"), "max", "mean")


def downsample(df: DataFrame, keys: list[str], i: str, value: str, step: int) -> DataFrame:
    """Means of `step` samples each; a last part that isn't full is left out."""
    n = F.count("*").over(Window.partitionBy(*keys))
    full = df.withColumn("_n", n).where(F.col(i) < F.floor(F.col("_n") / step) * step)
    return full.groupBy(*keys, F.floor(F.col(i) / step).alias(i)).agg(F.avg(value).alias(value))


def separation(df: DataFrame, keys: list[str], value: str, positive: str, least: int = 10) -> DataFrame:
    """AUC (ties averaged) of value for the flag; null where either class has fewer than `least` rows."""
    ranked = df.where(F.col(value).isNotNull() & F.col(positive).isNotNull()).withColumn("_r", average_rank(value, keys))
    out = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(positive), F.col("_r"))).alias("_s"), F.count_if(positive).alias("n_pos"), F.count_if(~F.col(positive)).alias("n_neg"))
    auc = (F.col("_s") - F.col("n_pos") * (F.col("n_pos") - 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") >= least) & (F.col("n_neg") >= least), F.bround(auc, 4))).drop("_s")


def rank_agreement(df: DataFrame, keys: list[str], a: str, b: str, top: int, tie: str) -> DataFrame:
    """Spearman's correlation by average ranks (null for fewer than two rows or no variance) and the share of the top rows in common."""
    df = dealt(df, keys, df.count())
    r = df.withColumn("_a", average_rank(a, keys)).withColumn("_b", average_rank(b, keys))
    place = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(c), tie)) <= top
    r = r.withColumn("_ta", place(a)).withColumn("_tb", place(b))
    flat = (F.count("*") < 2) | (F.stddev_pop("_a") == 0) | (F.stddev_pop("_b") == 0)
    return r.groupBy(*keys).agg(F.when(~flat, F.bround(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")), 4)).alias("spearman"), F.count_if(F.col("_ta") & F.col("_tb")).alias("shared"), F.count("*").alias("n"))


def mean_power(db: Column) -> Column:
    """Mean of decibels as power."""
    return F.avg(F.pow(F.lit(10.0), db / 10))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def upper_median(values: Column) -> Column:
    """The middle of a sorted array; of two, the upper."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
