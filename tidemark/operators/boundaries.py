"""Topic boundaries: where the two sides of a gap talk about things that are unlike."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .peaks import Peaks, extremes
from .selection import embedding_shift
from .windows import ordered


def embedding_boundaries(segments: DataFrame, key: str, order: str, vec: str, start: str, end: str, side: int, prominence: float = 1.0) -> DataFrame:
    """(key, t, strength): peaks of the depth between the `side` segments before and after a gap, in the middle of the gap.

    A peak counts if its prominence is at least `prominence` standard deviations of its recording's depths, and strength says how many it is. Recordings with fewer than three
    gaps to compare, or whose depths are all alike, have none. A task has one recording's turning depths, not its vectors.
    """
    after = segments.withColumn("_t", (F.col(end) + F.lead(start).over(ordered([key], order))) / 2)
    depth = embedding_shift(after, key, order, vec, side).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    depth = depth.select(key, F.col("i").cast("long").alias("i"), "_t", "depth")
    spread = depth.groupBy(key).agg(F.stddev_pop("depth").alias("_sd"), F.count("*").alias("_n")).where("_sd > 0 and _n >= 3").select(key, "_sd")
    turns = extremes(depth, [key], "depth").join(spread, key)
    kinds = dict(turns.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, sd = rows.sort_values("a"), rows["_sd"].iloc[0]
        found = Peaks(*(rows[c].to_numpy() for c in "abv")).at(prominence * sd)
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(found), "i": [p.i for p in found], "strength": [(p.value - p.base) / sd for p in found]})

    found = turns.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, i long, strength double")
    return found.join(depth.select(key, "i", F.col("_t").alias("t")), [key, "i"]).select(key, "t", "strength")
