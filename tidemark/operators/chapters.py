"""Chapters brought into a range of lengths. One recording at a time, since each step depends on the last."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame

CHAPTER = "recording_id long, chapter int, t_start double, t_end double"


def ranged(opens: list[tuple[float, float]], spare: list[tuple[float, float]], duration: float, least: float, most: float) -> list[float]:
    """Start times of chapters. opens and spare: (t, strength).

    A chapter over `most` is split at its strongest spare boundary (of equals the earliest), whatever the parts, and so are its parts, until none is over
    `most` or none has a boundary inside. Then every opener of a chapter under `least` goes, all at once; the first chapter has none, so a
    short first one stays.
    """
    opened = sorted({0.0, *(t for t, _ in opens if 0 < t < duration)})
    left = sorted((t, s) for t, s in {t: s for t, s in spare if 0 < t < duration}.items() if t not in opened)
    times = [t for t, _ in left]
    starts, todo = [], [(a, b) for a, b in zip(opened, [*opened[1:], duration])]
    while todo:
        a, b = todo.pop()
        inside = range(bisect_right(times, a), bisect_left(times, b)) if b - a > most else ()
        if not inside:
            starts.append(a)
            continue
        at = times[max(inside, key=lambda k: (left[k][1], -k))]
        todo += [(a, at), (at, b)]
    starts.sort()
    ends = [*starts[1:], duration]
    return [a for k, (a, b) in enumerate(zip(starts, ends)) if k == 0 or b - a >= least]


def chapters(bounds: DataFrame, least: float, most: float) -> DataFrame:
    """bounds: recording_id, duration, t, strength, spare (those only used to split). A recording without boundaries has a row with t null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        duration, known = float(rows["duration"].iloc[0]), rows[rows["t"].notna()]
        pick = lambda flag: list(known[known["spare"] == flag][["t", "strength"]].itertuples(index=False, name=None))
        starts = ranged(pick(False), pick(True), duration, least, most)
        return pd.DataFrame([(rows["recording_id"].iloc[0], k, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], duration]))], columns=["recording_id", "chapter", "t_start", "t_end"])

    return bounds.groupBy("recording_id").applyInPandas(run, CHAPTER)
