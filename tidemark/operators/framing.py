"""Whether a recording's frames come at a constant rate, from their times alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import standard_rate

# Fewer frames than this tell nothing.
ENOUGH, BUCKET_S = 8, 600.0


def constant_rate(frames: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, rate, variable, reason, ticks) for each declared recording: frames has key and pts in seconds, declared has key, nominal and average rate (either may be null) and tick, the least step of its clock (null: a millisecond).

    Frame i of a constant rate lies i / rate behind the first, to within rounding, however long it goes on; what drops or repeats frames drifts away. So each frame's
    place in order is held against its time: where the worst is over one and a half ticks, and over a fiftieth of a frame, the rate varies, and the average one, brought to a standard one,
    stands for it. ticks is the worst in ticks, null where fewer than ENOUGH frames are known: there only rates that are declared apart tell of a varying one. Without any rate the reason says so.
    Places come from counts of time buckets and the order within each, so that no task sorts a whole recording. Frames without a time don't count.
    """
    known = frames.where("pts is not null").select(key, "pts", F.floor(F.col("pts") / BUCKET_S).alias("_b"))
    counts = known.groupBy(key, "_b").agg(F.count("*").alias("_n"), F.min("pts").alias("_least"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_first", F.min("_least").over(Window.partitionBy(key)))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy("pts")) - 1 + F.col("_base")
    at = known.join(base.select(key, "_b", "_base", "_first"), [key, "_b"]).withColumn("_i", place)
    rate = F.coalesce("nominal", "average")
    own = declared.select(key, rate.alias("_rate"), "nominal", "average", F.coalesce("tick", F.lit(0.001)).alias("_tick"))
    worst = at.join(own.select(key, "_rate"), key).groupBy(key).agg(F.count("*").alias("_n"), F.max(F.abs(F.col("pts") - (F.col("_first") + F.col("_i") / F.col("_rate")))).alias("_worst"))
    out = own.join(worst, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    few = F.col("_n") < ENOUGH
    apart = F.coalesce(F.col("nominal") != F.col("average"), F.lit(False))
    drifts = ~few & (F.col("_worst") > F.greatest(F.col("_tick") * 1.5, F.lit(0.02) / F.col("_rate")))
    variable = F.when(F.col("_rate").isNull(), F.lit(None)).when(few, apart).otherwise(drifts)
    reason = F.when(F.col("_rate").isNull(), "no rate").when(few & apart, "declared rates differ").when(few, "too few frames").when(drifts, "drifts").otherwise("constant")
    average = F.coalesce("average", "_rate")
    part = lambda k: F.split_part(standard_rate(average), F.lit("/"), F.lit(k)).cast("double")
    return out.select(key, F.when(variable, F.coalesce(part(1) / part(2), average)).otherwise(F.col("_rate")).alias("rate"), variable.alias("variable"), reason.alias("reason"), F.when(~few, F.col("_worst") / F.col("_tick")).alias("ticks"))
