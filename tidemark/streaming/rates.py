"""Live input rates: counts and travelled distance of each window over the time that it really took.

Events are (key, ms, kind, x, y), kind being key, click, move or tick. A window ends at the first tick at least `period_ms` after the tick that the last one ended at; the first tick of a key
begins its first window, to which also counts what came before. A move adds the distance from the move before it, whatever windows they are in. At one time ticks come last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.selection import greedy

RATES = "key string, start_ms long, end_ms long, keys_per_s double, clicks_per_s double, px_per_s double, late long"
STATE = "keys long, clicks long, distance double, x double, y double, start_ms long, seen_ms long, late long"


def rates(events: DataFrame, period_ms: int, tie: Column | None = None) -> DataFrame:
    """The batch form; rows of one key and time go by `tie` (by kind, x and y if none is given)."""
    order = ["ms", F.col("kind") == "tick", *([tie] if tie is not None else [F.col("kind"), F.col("x"), F.col("y")])]
    by = Window.partitionBy("key")
    ticks = events.where("kind = 'tick'").select("key", "ms").distinct()
    before = F.lag("ms").over(by.orderBy("ms"))
    ends = greedy(ticks, "key", "ms", lambda t, last: t - last >= period_ms, F.col("ms") - before >= period_ms)
    ends = ends.withColumn("start_ms", F.lag("ms").over(by.orderBy("ms"))).where("start_ms is not null")
    moves = events.where("kind = 'move'").withColumn("px", F.lag("x").over(by.orderBy(*order))).withColumn("py", F.lag("y").over(by.orderBy(*order)))
    far = moves.select("key", "ms", F.lit("move").alias("kind"), F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)).alias("d"))
    counted = events.where("kind in ('key', 'click')").select("key", "ms", "kind", F.lit(0.0).alias("d")).unionByName(far)
    # An event belongs to the first window that ends at or after it: one sort, and the next end looked up from behind.
    both = counted.select("key", "ms", "kind", "d", F.lit(None).cast("long").alias("end_ms")).unionByName(ends.select("key", "ms", F.lit("end").alias("kind"), F.lit(0.0).alias("d"), F.col("ms").alias("end_ms")))
    after = by.orderBy(F.desc("ms"), F.col("kind") != "end").rowsBetween(Window.unboundedPreceding, 0)
    of = both.withColumn("end_ms", F.last("end_ms", ignorenulls=True).over(after)).where("kind != 'end' and end_ms is not null")
    sums = of.groupBy("key", F.col("end_ms").alias("ms")).agg(F.count_if(F.col("kind") == "key").alias("k"), F.count_if(F.col("kind") == "click").alias("c"), F.sum("d").alias("d"))
    span = (F.col("ms") - F.col("start_ms")) / 1000.0
    out = ends.join(sums, ["key", "ms"], "left")
    return out.select("key", "start_ms", F.col("ms").alias("end_ms"), *((F.coalesce(c, F.lit(0)) / span).alias(name) for c, name in (("k", "keys_per_s"), ("c", "clicks_per_s"), ("d", "px_per_s"))))


def live_rates(events: DataFrame, period_ms: int, forget_ms: int) -> DataFrame:
    """The same of a live source (with ts), with a key's counts, last place and window as state, and late: how many of the key's rows since the last window came after a later one had been read.

    Such rows are counted and otherwise left out, as their windows may be gone. A key silent for forget_ms of watermark is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        keys, clicks, distance, x, y, start, seen, late = state.get if state.exists else (0, 0, 0.0, None, None, None, None, 0)
        rows = pd.concat(list(batches))
        rows = rows.assign(last=rows["kind"] == "tick").sort_values(["ms", "last", "kind", "x", "y"])
        out = []
        for ms, kind, a, b in zip(rows["ms"].tolist(), rows["kind"], rows["x"].tolist(), rows["y"].tolist()):
            if seen is not None and ms < seen:
                late += 1
                continue
            seen = ms
            if kind == "key":
                keys += 1
            elif kind == "click":
                clicks += 1
            elif kind == "move":
                distance += math.hypot(a - x, b - y) if x is not None else 0.0
                x, y = a, b
            elif kind == "tick" and start is None:
                start = ms
            elif kind == "tick" and ms - start >= period_ms:
                span = (ms - start) / 1000
                out.append((key[0], start, ms, keys / span, clicks / span, distance / span, late))
                keys, clicks, distance, start, late = 0, 0, 0.0, ms, 0
        state.update((keys, clicks, distance, x, y, start, seen, late))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + forget_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RATES.split(", ")])

    marked = events.withWatermark("ts", f"{forget_ms} milliseconds")
    return marked.groupBy("key").applyInPandasWithState(step, RATES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
