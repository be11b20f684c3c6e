"""Slices with halos against whole series, recursive filters against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive as R
from tidemark.operators import slices as L
from tidemark.operators import windows as W

K = ["k"]


@pytest.fixture(scope="module")
def grid(spark):
    rnd = random.Random(8)
    rows = [(k, i, None if rnd.random() < 0.2 or 40 < i < 55 else rnd.uniform(0, 9), (rnd.random() < 0.7) if not 20 <= i < 46 else k == 1) for k, n in ((1, 100), (2, 9), (3, 1), (4, 61)) for i in range(n)]
    rows = [(k, i, v, None if k == 4 and i % 17 == 3 else f) for k, i, v, f in rows]
    return spark.createDataFrame(rows, "k long, i long, v double, f boolean").repartition(4).cache()


def same(a, b):
    plain = lambda x: repr(round(x, 8) + 0.0 if isinstance(x, float) else x)
    both = [sorted(tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect()) for df in (a, b)]
    assert both[0] == both[1]


OPS = {
    "zscore": (5, 5, lambda r, by: W.rolling_zscore(r, by, "i", "v", 10, 0.5)),
    "std": (4, 4, lambda r, by: W.rolling_std(r, by, "i", "v", 8, 3)),
    "max": (30, 0, lambda r, by: r.withColumn("o", W.rolling_max(F.col("v"), by, "i", 31))),
    "hold": (3, 0, lambda r, by: r.withColumn("o", W.hold(F.col("f"), by, "i", 3))),
    "edge": (1, 0, lambda r, by: r.withColumn("o", W.rising_edge(F.col("f"), by, "i"))),
    "boxcar": (6, 6, lambda r, by: r.withColumn("o", W.boxcar_sum(F.coalesce("v", F.lit(0.0)), by, "i", 6))),
    "gaussian": (8, 8, lambda r, by: r.withColumn("o", W.gaussian(F.coalesce("v", F.lit(0.0)), by, "i", 2.0))),
}


@pytest.mark.parametrize("name", OPS)
def test_slices_give_what_whole_series_give(grid, name):
    before, after, op = OPS[name]
    same(L.sliced(grid, K, "i", before, after, op, size=7), op(grid, K))


def test_runs_go_on_across_slices(grid):
    flags = grid.drop("v")
    same(L.run_length(flags, K, "i", "f", "n", 7), W.run_length(flags, K, "i", "f", "n"))
    same(L.sustained(flags, K, "i", "f", 3, 4, "o", 7), W.sustained(flags, K, "i", "f", 3, 4, "o"))
    same(L.runs(flags, K, "i", "f", 7), W.runs(flags, K, "i", "f"))
    for samples in (1, 2, 9, 30):
        same(L.drop_short_runs(flags, K, "i", "f", samples, 7), W.drop_short_runs(flags, K, "i", "f", samples).select(flags.columns))


@pytest.mark.parametrize("how", ["max", "min", "sum", "last"])
@pytest.mark.parametrize("back", [False, True])
def test_running_values(grid, how, back):
    got = {(r.k, r.i): r.o for r in L.running(grid, K, "i", F.col("v"), how, "o", back, 7).collect()}
    rows = sorted((r.k, r.i, r.v) for r in grid.select("k", "i", F.coalesce("v", F.lit(-1.0)).alias("v")).collect())
    for k in {k for k, *_ in rows}:
        seen = []
        for _, i, v in sorted((r for r in rows if r[0] == k), reverse=back):
            seen += [v] if v >= 0 else []
            want = {"max": max, "min": min, "sum": sum, "last": lambda s: s[-1]}[how](seen) if seen else None
            assert got[k, i] == pytest.approx(want) if want is not None else got[k, i] is None


def loop(sections, x, x0):
    """One section after the other, sample by sample, each beginning as if x0 had gone on for ever before."""
    for b0, b1, b2, a1, a2 in sections:
        level = (b0 + b1 + b2) / (1 + a1 + a2) * x0
        z1, z2, out = level - b0 * x0, b2 * x0 - a2 * level, []
        for v in x:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        x, x0 = out, level
    return np.array(x)


def plain_filter(x, sections):
    pad = 3 * (2 * len(sections) + 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = loop(sections, y, y[0])[::-1]
    return loop(sections, y, y[0])[::-1][pad:-pad]


@pytest.mark.parametrize("order,low,high,rate", [(2, 0.2, 0.5, 2.0), (3, 4.0, 7.0, 50.0), (6, 4.0, 7.0, 50.0)])
def test_filter_is_that_of_a_plain_loop_ends_included(spark, order, low, high, rate):
    sections = R.band_sections(order, low, high, rate)
    at = lambda f: abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections for z in [np.exp(-2j * np.pi * f / rate)]]))
    assert at(low) == pytest.approx(0.5**0.5) and at(high) == pytest.approx(0.5**0.5) and at(0) < 1e-9 and max(at(f) for f in np.linspace(low, high, 50)) <= 1 + 1e-9
    rnd = np.random.default_rng(1)
    series = {1: np.cumsum(rnd.normal(size=700)), 2: rnd.normal(size=3 * (2 * order + 1) + 1) + 5, 3: rnd.normal(size=10)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k long, i long, v double").repartition(3)
    got = R.forth_and_back(df, K, "i", "v", sections, size=150).toPandas().sort_values(["k", "i"])
    for k in (1, 2):
        one = got[got.k == k]
        assert list(one.i) == list(range(len(series[k]))) and np.abs(one.x.to_numpy() - plain_filter(series[k], sections)).max() < 1e-9
    assert set(got.k) == {1, 2}  # what isn't longer than the padding has none


def test_band_share_is_that_of_a_whole_recording(spark):
    rnd, w = np.random.default_rng(4), 25
    x = np.abs(1 + 0.5 * np.sin(2 * np.pi * 5.5 * np.arange(900) / 50) * (np.arange(900) > 300) + rnd.normal(size=900) / 10)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, 1.0) for i in range(20)], "k long, i long, v double")
    got = R.band_share(df, "k", "i", "v", 50.0, 4.0, 7.0, 3, w, size=111).toPandas().sort_values(["k", "i"])
    mean = lambda v: np.convolve(v, np.ones(w) / w, "same")
    local = mean(x)
    band, whole = np.sqrt(mean(plain_filter(x - local, R.band_sections(3, 4.0, 7.0, 50.0)) ** 2)), np.sqrt(mean((x - local) ** 2))
    one = got[got.k == 1]
    assert np.abs(one.share.to_numpy() - np.clip(band / whole, 0, 1)).max() < 1e-9 and np.abs(one.depth.to_numpy() - band / local).max() < 1e-9
    assert len(got[got.k == 2]) == 20 and got[got.k == 2].share.isna().all()
