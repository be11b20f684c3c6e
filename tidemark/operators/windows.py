"""Rolling statistics, runs and ranks over ordered rows. A null sample is unknown, never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


# Rows of a frame that is summed anew for each row.
FRAME = 32


def ordered(keys: list[str], order: list[str] | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def rolling_moments(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """Adds n, mean and std (population) of the rows from -half to +half, edges cut off, nulls passed over.

    Frames of up to FRAME rows are summed each by itself, from their first row to the last: what is compared with a mean must not depend on what lies
    outside the frame, since values often lie just on the threshold. Longer frames come from running sums, so that the work doesn't grow
    with them; values are first centred on their partition's mean to keep digits.
    """
    if 2 * half + 1 <= FRAME:
        near = ordered(keys, order).rowsBetween(-half, half)
        return df.withColumns({"n": F.nullif(F.count(value).over(near), F.lit(0)), "mean": F.avg(value).over(near), "std": F.stddev_pop(value).over(near)})
    w, all_, to_here = ordered(keys, order), Window.partitionBy(*keys), ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_m", F.avg(value).over(all_)).withColumn("_x", F.col(value) - F.col("_m"))
    parts = {"_n": F.when(F.col("_x").isNotNull(), 1).otherwise(0), "_s": F.coalesce("_x", F.lit(0.0)), "_q": F.coalesce(F.col("_x") * F.col("_x"), F.lit(0.0))}
    for name, x in parts.items():
        out = out.withColumn(name, F.sum(x).over(to_here)).withColumn(name + "t", F.sum(x).over(all_))
    for name in parts:
        out = out.withColumn(name + "w", F.coalesce(F.lead(name, half).over(w), F.col(name + "t")) - F.coalesce(F.lag(name, half + 1).over(w), F.lit(0)))
    n, mean = F.nullif(F.col("_nw"), F.lit(0)), F.col("_sw") / F.nullif(F.col("_nw"), F.lit(0))
    var = F.col("_qw") / n - mean * mean
    # What is left of equal values by cancellation counts as 0: under 1e-10 of the partition's variance.
    var = F.when(F.col("_nw") > 0, F.when(var > 1e-10 * F.col("_qt") / F.col("_nt"), var).otherwise(0.0))
    out = out.withColumn("n", F.col("_nw")).withColumn("mean", mean + F.col("_m")).withColumn("std", F.sqrt(var))
    return out.drop("_m", "_x", *(name + end for name in parts for end in ("", "t", "w")))


def rolling_zscore(df: DataFrame, keys: list[str], order: str, value: str, window: int, floor: float) -> DataFrame:
    """Adds mean, std and z = (value - mean) / max(std, floor) over a centred window; an unknown value has no z."""
    out = rolling_moments(df, keys, order, value, window // 2)
    return out.withColumn("z", (F.col(value) - F.col("mean")) / F.greatest(F.coalesce("std", F.lit(0.0)), F.lit(floor))).drop("n")


def rolling_std(df: DataFrame, keys: list[str], order: str, value: str, window: int, min_obs: int) -> DataFrame:
    """Adds std, null where the window has fewer than min_obs known values."""
    out = rolling_moments(df, keys, order, value, window // 2)
    return out.withColumn("std", F.when(F.col("n") >= min_obs, F.col("std"))).drop("n", "mean")


def rolling_max(value: Column, keys: list[str], order: str, window: int) -> Column:
    """Over the row and the window - 1 before it."""
    return F.max(value).over(ordered(keys, order).rowsBetween(-(window - 1), 0))


def hold(active: Column, keys: list[str], order: str, samples: int) -> Column:
    """True for `samples` rows after a true one as well."""
    return F.coalesce(F.max(F.coalesce(active, F.lit(False)).cast("int")).over(ordered(keys, order).rowsBetween(-samples, 0)) == 1, F.lit(False))


def island(df: DataFrame, keys: list[str], order: str, flag: str, name: str = "run") -> DataFrame:
    """Adds a number that is the same for neighbouring rows with the same flag (null counts as false)."""
    w = ordered(keys, order)
    now = F.coalesce(F.col(flag), F.lit(False))
    turn = F.when(now.eqNullSafe(F.lag(now).over(w)), 0).otherwise(1)
    return df.withColumn(name, F.sum(turn).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def run_length(df: DataFrame, keys: list[str], order: str, flag: str, name: str) -> DataFrame:
    """Adds how many trues in a row end here."""
    out = island(df, keys, order, flag, "_run")
    return out.withColumn(name, F.when(F.coalesce(F.col(flag), F.lit(False)), F.row_number().over(ordered([*keys, "_run"], order))).otherwise(0)).drop("_run")


def drop_short_runs(df: DataFrame, keys: list[str], order: str, flag: str, samples: int) -> DataFrame:
    """Trues in runs of fewer than `samples` become false."""
    if samples <= 1:
        return df
    out = island(df, keys, order, flag, "_run")
    size = F.count("*").over(Window.partitionBy(*keys, "_run"))
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) & (size >= samples)).drop("_run")


def ramp_up(df: DataFrame, keys: list[str], order: str, flag: str, steps: int, name: str) -> DataFrame:
    """Rises by 1 / steps with each true in a row up to 1; 0 at a false."""
    return run_length(df, keys, order, flag, name).withColumn(name, F.least(F.col(name) / float(max(1, steps)), F.lit(1.0)))


def sustained(df: DataFrame, keys: list[str], order: str, flag: str, sustain: int, ramp: int, name: str) -> DataFrame:
    """ramp_up of what has held for `sustain` rows; it starts anew at each break."""
    out = run_length(df, keys, order, flag, "_held").withColumn("_held", F.col("_held") >= sustain)
    return ramp_up(out, keys, order, "_held", ramp, name).drop("_held")


def rising_edge(active: Column, keys: list[str], order: str) -> Column:
    now = F.coalesce(active, F.lit(False))
    return now & ~F.lag(now, 1, False).over(ordered(keys, order))


def runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Half-open [start, end) of each run of trues."""
    out = island(df, keys, order, flag, "_run").where(F.col(flag))
    return out.groupBy(*keys, "_run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_run")


def boxcar_sum(value: Column, keys: list[str], order: str, width: int) -> Column:
    """Sum over a window of `width` that is centred as convolution centres it."""
    return F.sum(value).over(ordered(keys, order).rowsBetween(-(width - 1 - (width - 1) // 2), (width - 1) // 2))


def gaussian(value: Column, keys: list[str], order: str, sigma: float, truncate: float = 4.0) -> Column:
    """Weighted sum with a normal kernel cut at truncate * sigma; beyond the ends the end values go on."""
    radius = int(truncate * sigma + 0.5)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total, w, all_ = sum(weight), ordered(keys, order), ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(all_), F.last(value).over(all_)
    terms = [F.lit(weight[radius + k] / total) * (F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last) if k else value) for k in range(-radius, radius + 1)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def average_rank(value: str, keys: list[str]) -> Column:
    """From 0; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def overlap_clusters(df: DataFrame, keys: list[str], start: str, end: str, tie: str, name: str = "cluster") -> DataFrame:
    """Numbers from 0 of groups of intervals that overlap or touch, by start."""
    w = Window.partitionBy(*keys).orderBy(start, end, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def spans_from_switches(df: DataFrame, key: str, t: str, state: str, duration: str, tie: str) -> DataFrame:
    """Spans [start, end) in which each state holds within [0, duration], and the state of the span before.

    The last switch before 0 is in force at 0, the last of all runs to the end, empty spans fall away.
    """
    w = Window.partitionBy(key).orderBy(t, tie)
    out = df.withColumn("end", F.least(F.coalesce(F.lead(t).over(w), F.col(duration)), F.col(duration))).withColumn("start", F.greatest(F.col(t), F.lit(0.0)))
    out = out.where("end > start")
    return out.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy("start", tie)))


def repeats(df: DataFrame, keys: list[str], t_ms: str, seq: str, within_ms: int, name: str = "times") -> DataFrame:
    """Adds how many rows of the key up to this one lie within the last within_ms, both ends included.

    Rows at the same time count only if they come first by seq.
    """
    w = Window.partitionBy(*keys).orderBy(t_ms).rangeBetween(-within_ms, 0)
    later = F.count("*").over(Window.partitionBy(*keys, t_ms)) - F.row_number().over(Window.partitionBy(*keys, t_ms).orderBy(seq))
    return df.withColumn(name, F.count("*").over(w) - later)
