"""Recursive filters over long series: a slice of a linear recurrence is an affine map of its state, and such maps compose.

Each slice is run from rest by a task of its own and gives what it adds to the state; the states at which the slices begin follow from one row a slice; then
each slice is run again from its state. Forth and back, so without delay, with the ends continued by odd reflection.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written
from .groups import each_group
from .slices import SIZE, sliced
from .windows import boxcar_sum

_STEP = 64


def band_sections(order: int, low: float, high: float, rate: float) -> list[tuple[float, ...]]:
    """A digital Butterworth band-pass as second-order sections (b0, b1, b2, a1, a2), by the bilinear transform of the analog one with its edges prewarped."""
    if not 0 < low < high < rate / 2:
        raise ValueError("the band must lie between 0 and half the rate")
    a, b = (2 * math.tan(math.pi * f / rate) for f in (low, high))
    poles = []
    for k in range(order):
        p = cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) * (b - a) / 2
        root = cmath.sqrt(p * p - a * b)
        poles += [p + root, p - root]
    moved = [(2 + p) / (2 - p) for p in poles]
    upper = sorted((z for z in moved if z.imag > 1e-14), key=lambda z: (abs(z), z.real))
    real = sorted(z.real for z in moved if abs(z.imag) <= 1e-14)
    pairs = [(-2 * z.real, abs(z) ** 2) for z in upper] + [(-(p + q), p * q) for p, q in zip(real[::2], real[1::2])]
    whole = ((b - a) ** order * 2.0**order / np.prod([2 - p for p in poles])).real
    share = math.copysign(abs(whole) ** (1 / order), whole)
    return [(share, 0.0, -share, a1, a2) for a1, a2 in pairs]


class Recurrence:
    """s' = A s + B x, y = C s + D x of a cascade of sections, run in blocks of _STEP samples."""

    def __init__(self, sections: list[tuple[float, ...]]):
        n = 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            i = 2 * k
            # The section's input is what the ones before give: c s + d x. Its output is s[i] + b0 times that.
            into, direct = c.copy(), d
            out = b0 * into
            out[i] += 1
            for row, (num, den) in enumerate(((b1, a1), (b2, a2))):
                a[i + row] = num * into - den * out
                b[i + row] = (num - den * b0) * direct
            a[i, i + 1] += 1
            c, d = out, b0 * direct
        self.a, self.b, self.c, self.d = a, b, c, d
        powers = [np.eye(n)]
        for _ in range(_STEP):
            powers.append(a @ powers[-1])
        self.power = powers[_STEP]
        self.seen = np.array([c @ powers[t] for t in range(_STEP)])
        pulse = np.array([d, *(c @ powers[t] @ b for t in range(_STEP - 1))])
        self.reply = np.array([[pulse[t - u] if t >= u else 0.0 for u in range(_STEP)] for t in range(_STEP)])
        self.gather = np.stack([powers[_STEP - 1 - u] @ b for u in range(_STEP)], 1)

    def at_rest(self, x: float) -> np.ndarray:
        """The state after x for ever."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.b * x)

    def run(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and the state after it."""
        whole = len(x) // _STEP * _STEP
        blocks = x[:whole].reshape(-1, _STEP)
        added = blocks @ self.gather.T
        states = np.empty((len(blocks) + 1, len(s)))
        states[0] = s
        for k in range(len(blocks)):
            states[k + 1] = self.power @ states[k] + added[k]
        y, s, tail = [(blocks @ self.reply.T + states[:-1] @ self.seen.T).ravel()], states[-1], np.empty(len(x) - whole)
        for t, v in enumerate(x[whole:]):
            tail[t] = self.c @ s + self.d * v
            s = self.a @ s + self.b * v
        return np.concatenate([*y, tail]), s


def _pass(df: DataFrame, keys: list[str], order: str, sections: list[tuple[float, ...]], size: int, sign: int) -> DataFrame:
    """(keys, order, x) run through the sections in order (sign 1) or against it (-1), from rest at its first sample's value."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = df.withColumn("_slice", F.floor(F.col(order) / size))
    n = 2 * len(sections)

    def added(key: tuple, c: dict) -> list[tuple]:
        x = c["x"][::sign]
        return [(*key, len(x), float(x[0]), r.run(x, np.zeros(n))[1].tolist())]

    def begins(key: tuple, c: dict) -> list[tuple]:
        s, out = r.at_rest(c["first"][::sign][0]), []
        for at, length, gives in zip(c["_slice"][::sign].tolist(), c["n"][::sign].tolist(), c["gives"][::sign]):
            out.append((*key, at, s.tolist()))
            s = np.linalg.matrix_power(r.a, length) @ s + np.asarray(gives) if len(c["n"]) > 1 else s
        return out

    def filtered(key: tuple, c: dict) -> list[tuple]:
        y = r.run(c["x"][1:][::sign], np.asarray(c["state"][0]))[0]
        return [(*key[:-1], i, v) for i, v in zip(c[order][1:][::sign].tolist(), y.tolist())]

    r = Recurrence(sections)
    parts = each_group(rows.select(*keys, "_slice", order, "x"), [*keys, "_slice"], [order], added, f"{head}, _slice long, n long, first double, gives array<double>")
    states = each_group(parts, keys, ["_slice"], begins, f"{head}, _slice long, state array<double>")
    # A slice's state comes as a row ahead of its own.
    known = rows.select(*keys, "_slice", F.lit(1).alias("_k"), F.col(order).cast("long").alias(order), "x", F.lit(None).cast("array<double>").alias("state"))
    led = known.unionByName(states.select(*keys, "_slice", F.lit(0).alias("_k"), F.lit(0).cast("long").alias(order), F.lit(0.0).alias("x"), "state"))
    return each_group(led, [*keys, "_slice"], ["_k", order], filtered, f"{head}, `{order}` long, x double")


def forth_and_back(df: DataFrame, keys: list[str], order: str, value: str, sections: list[tuple[float, ...]], pad: int | None = None, size: int = SIZE) -> DataFrame:
    """(keys, order, x): value run through the sections forth and back. The ends are continued by `pad` samples of odd reflection (three times the filter's taps); series that aren't longer than that have no rows.

    The order counts from 0 without gaps; no value is null.
    """
    pad = 3 * (2 * len(sections) + 1) if pad is None else pad
    ends = df.groupBy(*keys).agg(F.max(order).alias("_last"), F.max_by(value, order).alias("_x1"), F.min_by(value, order).alias("_x0")).where(F.col("_last") >= pad)
    x = df.join(ends, keys).withColumn("x", F.col(value).cast("double"))
    front = x.where((F.col(order) >= 1) & (F.col(order) <= pad)).select(*keys, (-F.col(order)).alias(order), (2 * F.col("_x0") - F.col("x")).alias("x"))
    rear = x.where((F.col(order) < F.col("_last")) & (F.col(order) >= F.col("_last") - pad)).select(*keys, (2 * F.col("_last") - F.col(order)).alias(order), (2 * F.col("_x1") - F.col("x")).alias("x"))
    padded = front.unionByName(x.select(*keys, F.col(order).cast("long").alias(order), "x")).unionByName(rear)
    forth = written(_pass(padded, keys, order, sections, size, 1), "forth")
    back = written(_pass(forth, keys, order, sections, size, -1), "back")
    dropped(forth)
    return back.join(ends.select(*keys, "_last"), keys).where((F.col(order) >= 0) & (F.col(order) <= F.col("_last"))).drop("_last")


def band_share(df: DataFrame, key: str, order: str, value: str, rate: float, low: float, high: float, poles: int, window: int, size: int = SIZE) -> DataFrame:
    """(key, order, share, depth) of a series at `rate`: how much of its swing about the local mean is between low and high, 0 to 1, and that part's size over the local mean.

    The local mean and both sizes are boxcars of `window` samples, cut off at the ends. Null where the series is shorter than the window or than twelve poles.
    The order counts from 0 without gaps; no value is null.
    """
    sections, keys = band_sections(poles, low, high, rate), [key]
    mean = lambda c, by: boxcar_sum(c, by, order, window) / float(window)
    around = lambda op: lambda rows: sliced(rows, keys, order, window, window, op, size)
    rows = df.select(key, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias("v"))
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    known = rows.join(n.where(F.col("_n") >= max(window, 12 * poles + 1)).select(key), key, "left_semi")
    swing = written(around(lambda r, by: r.withColumn("local", mean(F.col("v"), by)))(known).withColumn("swing", F.col("v") - F.col("local")), "swing")
    band = forth_and_back(swing, keys, order, "swing", sections, size=size).withColumnRenamed("x", "band")
    both = swing.join(band, [key, order])
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    sized = around(lambda r, by: r.withColumn("b", root(mean(F.col("band") ** 2, by))).withColumn("t", root(mean(F.col("swing") ** 2, by))))(both)
    told = sized.select(key, order, share(F.col("b"), F.col("t")).alias("share"), F.when(F.col("local") > 1e-12, F.col("b") / F.col("local")).otherwise(0.0).alias("depth"))
    return rows.select(key, order).join(told, [key, order], "left")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 1e-12, F.least(part / whole, F.lit(1.0))).otherwise(0.0)
