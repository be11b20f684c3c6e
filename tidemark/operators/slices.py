"""Long series in slices: a recording's samples are dealt by (keys, slice), so that no task has a whole recording.

A series is a dense grid: its order column counts 0, 1, 2 and so on within its keys. What looks a bounded number of samples around gets those as a halo
from the neighbouring slices (`sliced`). What runs on without bound, as runs and fills do, is scanned in two steps: within slices, and over one row for
each slice (`running`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import ordered

SIZE = 1 << 16


def halo(df: DataFrame, order: str, before: int, after: int, size: int = SIZE) -> DataFrame:
    """Adds _slice and _own: a row goes to its own slice, and as a halo to those that begin up to `before` after it or ended up to `after` before it. Halos may span several slices."""
    at = F.floor(F.col(order) / size)
    first, last = F.floor((F.col(order) - after) / size), F.floor((F.col(order) + before) / size)
    return df.withColumn("_slice", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_slice") == at)


def sliced(df: DataFrame, keys: list[str], order: str, before: int, after: int, op: Callable[[DataFrame, list[str]], DataFrame], size: int = SIZE) -> DataFrame:
    """op(rows, keys) over each slice with its halo, of which the slice's own rows are kept. Only where a series really begins or ends does an op see an end."""
    return op(halo(df, order, before, after, size), [*keys, "_slice"]).where("_own").drop("_slice", "_own")


def running(df: DataFrame, keys: list[str], order: str, value: Column, how: str, name: str, back: bool = False, size: int = SIZE) -> DataFrame:
    """Adds the running max, min, sum or last known value up to each row, or from it to the end with `back`."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    to = (F.desc(order),) if back else (F.asc(order),)
    rows = df.withColumn("_slice", F.floor(F.col(order) / size)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*to).rowsBetween(Window.unboundedPreceding, 0)
    if how == "last":
        ends = rows.where("_v is not null").groupBy(*keys, "_slice").agg((F.min_by if back else F.max_by)("_v", order).alias("_end"))
    else:
        ends = rows.groupBy(*keys, "_slice").agg(fold("_v").alias("_end"))
    # Slices without a known value have no row here; what they are handed is looked up from the last that has.
    slices = rows.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    over = Window.partitionBy(*keys).orderBy(F.desc("_slice") if back else F.asc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", fold("_end").over(over).alias("_carry"))
    out = rows.withColumn("_here", fold("_v").over(inside)).join(carried, [*keys, "_slice"])
    both = {"max": lambda: F.greatest("_here", "_carry"), "min": lambda: F.least("_here", "_carry"), "sum": lambda: F.when(F.col("_here").isNotNull() | F.col("_carry").isNotNull(), F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0))), "last": lambda: F.coalesce("_here", "_carry")}[how]()
    return out.withColumn(name, both).drop("_slice", "_v", "_here", "_carry")


def run_length(df: DataFrame, keys: list[str], order: str, flag: str, name: str, size: int = SIZE) -> DataFrame:
    """Adds how many trues in a row end here, from the last false before it."""
    now = F.coalesce(F.col(flag), F.lit(False))
    out = running(df, keys, order, F.when(~now, F.col(order)), "max", "_false", size=size)
    return out.withColumn(name, F.col(order) - F.coalesce("_false", F.lit(-1))).drop("_false")


def drop_short_runs(df: DataFrame, keys: list[str], order: str, flag: str, samples: int, size: int = SIZE) -> DataFrame:
    """Trues in runs of fewer than `samples` become false. How far a run goes is looked for no further than `samples` on both sides."""
    if samples <= 1:
        return df

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        w = ordered(by, order)
        now = F.coalesce(F.col(flag), F.lit(False))
        last = F.max(F.when(~now, F.col(order))).over(w.rowsBetween(-samples, 0))
        next_ = F.min(F.when(~now, F.col(order))).over(w.rowsBetween(0, samples))
        start = F.min(order).over(w.rowsBetween(-samples, 0))
        stop = F.max(order).over(w.rowsBetween(0, samples))
        long = F.coalesce(next_, stop + 1) - F.coalesce(last, start - 1) - 1 >= samples
        return rows.withColumn("_kept", now & long).drop(flag).withColumnRenamed("_kept", flag)

    return sliced(df, keys, order, samples, samples, within, size).select(df.columns)


def sustained(df: DataFrame, keys: list[str], order: str, flag: str, sustain: int, ramp: int, name: str, size: int = SIZE) -> DataFrame:
    """Rises by 1 / ramp with each sample from the sustain-th of a run on, up to 1; 0 elsewhere."""
    out = run_length(df, keys, order, flag, "_n", size)
    return out.withColumn(name, F.least(F.greatest(F.col("_n") - (max(1, sustain) - 1), F.lit(0)) / float(max(1, ramp)), F.lit(1.0))).drop("_n")


def runs(df: DataFrame, keys: list[str], order: str, flag: str, size: int = SIZE) -> DataFrame:
    """Half-open [start, end) of each run of trues: its last row knows how long it is."""
    out = run_length(df, keys, order, flag, "_n", size)
    last = lambda rows, by: rows.withColumn("_next", F.coalesce(F.lead(flag).over(ordered(by, order)), F.lit(False)))
    ends = sliced(out, keys, order, 0, 1, last, size).where(F.col(flag) & ~F.col("_next"))
    return ends.select(*keys, (F.col(order) - F.col("_n") + 1).alias("start"), (F.col(order) + 1).alias("end"))
