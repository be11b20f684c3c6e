"""Live forms of what capture does: debounced presses, tumbling rates, late rows dropped and counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.selection import greedy
from ..operators.windows import ordered


def debounced_batch(presses: DataFrame, gap_ms: int) -> DataFrame:
    """Presses (key, ms) of a batch at least gap_ms after the last one of their key that was accepted; suppressed ones don't reset the clock."""
    before = F.lag("ms").over(ordered(["key"], "ms"))
    return greedy(presses, "key", "ms", lambda t, last: t - last >= gap_ms, F.col("ms") - before >= gap_ms)


def debounced(presses: DataFrame, gap_ms: int, forget_ms: int) -> DataFrame:
    """The same of a live source (key, ms, ts), with the last accepted press of each key as state; keys silent for forget_ms of watermark are forgotten.

    Rows of a micro-batch are taken in order of ms; one that is older than its key's last accepted press is suppressed.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for ms in sorted(m for r in rows for m in r["ms"].tolist()):
            if last is None or ms - last >= gap_ms:
                last = ms
                out.append((key[0], ms))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + forget_ms)
        yield pd.DataFrame(out, columns=["key", "ms"])

    marked = presses.withWatermark("ts", f"{forget_ms} milliseconds")
    return marked.groupBy("key").applyInPandasWithState(step, "key string, ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, width: str, late: str, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum by key and window; rows later than the watermark are dropped by Spark. Works on batches and recordings."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, key: str = "event_type", ts: str = "ts") -> DataFrame:
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(key, F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def dropped(query: StreamingQuery) -> int:
    """Rows that came later than the watermark and were left out, over the batches whose progress the session still has."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def settled(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an update-mode sink whose rows carry their batch_id."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(*keys, "_last.*")
