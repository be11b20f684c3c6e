"""Derived signals, event kernels, penalties and weighted composites on a common grid.

Inputs are wide frames, one row a grid point i of a recording with a column for each signal. A signal whose inputs
aren't there is absent; it is never filled with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins as J
from . import windows as W

KEY = ["recording_id"]


def wide(series: DataFrame, kinds: list[str]) -> DataFrame:
    """Columns of the given kinds by recording and grid point, in one pass."""
    return series.where(F.col("kind").isin(kinds)).groupBy("recording_id", "i", "t").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in kinds))


def speech_gate(df: DataFrame, level: str, name: str, window: int, margin: float = 6.0, hang: int = 4, least: int = 3) -> DataFrame:
    """Louder than the rolling mean by `margin`, held on for `hang` samples, runs under `least` samples dropped."""
    out = W.rolling_moments(df, KEY, "i", level, window // 2).withColumn("_loud", F.coalesce(F.col(level) > F.col("mean") + margin, F.lit(False))).drop("n", "mean", "std")
    out = out.withColumn(name, W.hold(F.col("_loud"), KEY, "i", hang)).drop("_loud")
    return W.drop_short_runs(out, KEY, "i", name, least)


def semitones(hz: Column) -> Column:
    return F.when(hz > 0, 12 * F.log2(hz / 100))


def pitch_variation(df: DataFrame, hz: str, name: str, window: int, least: int = 8) -> DataFrame:
    out = df.withColumn("_st", semitones(F.col(hz)))
    return W.rolling_std(out, KEY, "i", "_st", window, least).withColumnRenamed("std", name).drop("_st")


def sudden_silence(df: DataFrame, level: str, name: str, window: int, floor: float, back: int, ramp: int) -> DataFrame:
    """Rises where the z-score has been 1 or more within `back` samples, has fallen by 1.5 or more, and is 0.5 or less."""
    out = W.rolling_zscore(df, KEY, "i", level, window, floor).drop("mean", "std").withColumn("z", F.round("z", 9))
    peak = W.rolling_max(F.col("z"), KEY, "i", back)
    out = out.withColumn("_quiet", F.coalesce((peak >= 1) & (peak - F.col("z") >= 1.5) & (F.col("z") <= 0.5), F.lit(False)))
    return W.ramp_up(out, KEY, "i", "_quiet", ramp, name).drop("z", "_quiet")


def stillness(df: DataFrame, rate: str, name: str, calm: float, busy: float, back: int, ramp: int) -> DataFrame:
    """Rises where the rate is known and calm after it was busy within `back` samples."""
    still = F.coalesce((F.col(rate) <= calm) & (W.rolling_max(F.col(rate), KEY, "i", back) >= busy), F.lit(False))
    return W.ramp_up(df.withColumn("_still", still), KEY, "i", "_still", ramp, name).drop("_still")


def reaction_onsets(df: DataFrame, overlap: str, silence: str, z: str, back: int) -> DataFrame:
    """Grid points where overlapping speech sets in while z is 1 or more, after a silence of 0.5 or more within `back` samples."""
    out = df.withColumn("_edge", W.rising_edge(F.col(overlap), KEY, "i")).withColumn("_was", W.rolling_max(F.col(silence), KEY, "i", back))
    return out.where("_edge").where((F.col("_was") >= 0.5) & (F.round(z, 9) >= 1)).select("recording_id", "i")


def long_runs(df: DataFrame, flag: str, least: int) -> DataFrame:
    """One event at the start of each run of `least` samples or more."""
    return W.runs(df, KEY, "i", flag).where(F.col("end") - F.col("start") >= least).select("recording_id", F.col("start").alias("i"), (F.col("end") - F.col("start")).alias("size"))


def plateau(gap: Column, before: float, after: float, shoulder: float) -> Column:
    """1 from `before` ahead of an event to `after` behind it, with raised-cosine shoulders; gap is grid time less event time."""
    out = F.greatest(-before - gap, gap - after, F.lit(0.0)) / shoulder
    x = F.least(F.greatest(1 - out, F.lit(0.0)), F.lit(1.0))
    return 0.5 * (1 - F.cos(math.pi * x))


def dispatched(kind: Column, gap: Column, marked: tuple[str, ...], before: float, after: float, shoulder: float, sigma: float) -> Column:
    """The plateau for kinds that begin with one of `marked`, the bell for all others."""
    starts = F.lit(False)
    for prefix in marked:
        starts = starts | F.startswith(kind, F.lit(prefix))
    return F.when(starts, plateau(gap, before, after, shoulder)).otherwise(F.exp(-0.5 * (gap / sigma) * (gap / sigma)))


def plateau_kernel(grid: DataFrame, events: DataFrame, before: float, after: float, shoulder: float, name: str) -> DataFrame:
    """Largest plateau over the events of each grid point; 0 without any."""
    spans = events.select("recording_id", F.col("t").alias("_e"), (F.col("t") - before - shoulder).alias("_from"), (F.col("t") + after + shoulder).alias("_to"))
    near = J.points_in(grid.select("recording_id", "i", "t"), spans, "recording_id", "t", "_from", "_to", before + after + 2 * shoulder)
    level = near.groupBy("recording_id", "i").agg(F.max(plateau(F.col("t") - F.col("_e"), before, after, shoulder)).alias(name))
    return grid.join(level, ["recording_id", "i"], "left").na.fill(0.0, [name])


def gaussian_kernel(grid: DataFrame, events: DataFrame, sigma: float, name: str, reach: float = 9.0) -> DataFrame:
    """Sum of unit bells over the events of each grid point, cut at reach * sigma (under 1e-17 each)."""
    spans = events.select("recording_id", F.col("t").alias("_e"), (F.col("t") - reach * sigma).alias("_from"), (F.col("t") + reach * sigma).alias("_to"))
    near = J.points_in(grid.select("recording_id", "i", "t"), spans, "recording_id", "t", "_from", "_to", 2 * reach * sigma)
    gap = (F.col("t") - F.col("_e")) / sigma
    level = near.groupBy("recording_id", "i").agg(F.sum(F.exp(-0.5 * gap * gap)).alias(name))
    return grid.join(level, ["recording_id", "i"], "left").na.fill(0.0, [name])


def menu_penalty(df: DataFrame, menu: str, speech: str, levels: dict[str, str], sustain: int, ramp: int, name: str = "menu") -> DataFrame:
    """In a menu, nobody speaking, every voice at or under its baseline (equal counts), for `sustain` samples. levels: level column to its baseline column."""
    flag = F.col(menu) & ~F.coalesce(F.col(speech), F.lit(False))
    for level, base in levels.items():
        flag = flag & F.coalesce(F.col(level) <= F.col(base) + 1e-9, F.lit(True))
    return W.sustained(df.withColumn("_m", F.coalesce(flag, F.lit(False))), KEY, "i", "_m", sustain, ramp, name).drop("_m")


def afk_penalty(df: DataFrame, rate: str, speed: str, speech: str, sustain: int, ramp: int, name: str = "afk") -> DataFrame:
    """Inputs known and at rest, nobody speaking, for `sustain` samples."""
    flag = (F.col(rate) <= 0) & (F.col(speed) <= 0) & ~F.coalesce(F.col(speech), F.lit(False))
    return W.sustained(df.withColumn("_a", F.coalesce(flag, F.lit(False))), KEY, "i", "_a", sustain, ramp, name).drop("_a")


def penalized(score: Column, penalties: list[Column], weight: float = 2.0) -> Column:
    for p in penalties:
        score = score - weight * p
    return score


def composite(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight * z by profile, recording and grid point; signals of weight 0 take no part and unknown values add nothing.

    signals: recording_id, i, signal, z. weights: profile, signal, weight (few rows; broadcast by the optimizer if small).
    """
    live = weights.where("weight != 0")
    return signals.join(live, "signal").groupBy("profile", "recording_id", "i").agg(F.sum(F.col("weight") * F.coalesce("z", F.lit(0.0))).alias("composite"))


def missing(weights: DataFrame, signals: DataFrame) -> DataFrame:
    """Weighted signals that nothing produces."""
    return weights.where("weight != 0").join(signals.select("signal").distinct(), "signal", "left_anti")


@dataclass(frozen=True)
class Derivation:
    name: str
    requires: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame]


def derive(df: DataFrame, derivations: list[Derivation]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Adds each derived column whose inputs are there (earlier ones count), and tells what the others lack. A column that is there already stays."""
    absent: dict[str, list[str]] = {}
    for d in derivations:
        if lack := [c for c in d.requires if c not in df.columns]:
            absent[d.name] = lack
        elif d.name not in df.columns:
            df = d.make(df)
    return df, absent
