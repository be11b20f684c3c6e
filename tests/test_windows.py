import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import recursive
from tidemark.operators import selection as S
from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.streaming import capture


def test_unknown_stays_unknown(spark):
    rows = [(1, i, None if i in (0, 3, 4, 9) else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "recording_id long, i long, v double")
    out = {r.i: r for r in W.rolling_zscore(df, ["recording_id"], "i", "v", 2, 0.5).collect()}
    assert out[0].z is None and out[0].mean == 1.0
    assert out[3].z is None and out[3].mean == 2.0
    assert out[1].mean == pytest.approx(1.5)
    empty = W.rolling_zscore(df.withColumn("v", F.lit(None).cast("double")), ["recording_id"], "i", "v", 2, 0.5).collect()
    assert all(r.z is None and r.mean is None for r in empty)


def test_absent_signal_is_not_zero(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "recording_id long, i long, a double")
    out, absent = G.derive(df, [G.Derivation("b", ("missing",), lambda d: d.withColumn("b", F.lit(0.0))), G.Derivation("c", ("a",), lambda d: d.withColumn("c", F.col("a") + 1)), G.Derivation("e", ("c",), lambda d: d.withColumn("e", F.col("c")))])
    assert "b" not in out.columns and absent == {"b": ["missing"]} and "e" in out.columns


def test_touching_windows_cluster(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 5.0, 8.0), (1, 3, 8.1, 9.0), (1, 4, 1.0, 20.0)], "recording_id long, id long, t_start double, t_end double")
    got = {r.id: r.cluster for r in W.overlap_clusters(df, ["recording_id"], "t_start", "t_end", "id").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}


def test_clusters_are_anchored_not_chained(spark):
    df = spark.createDataFrame([(1, t) for t in (0.0, 100.0, 130.0, 260.0)], "recording_id long, t double")
    assert sorted(r.t for r in S.anchored_clusters(df, 120.0).collect()) == [0.0, 130.0, 260.0]


def test_tiling_covers(spark):
    b = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 0.0), (1, 12.0)], "recording_id long, t double")
    d = spark.createDataFrame([(1, 10.0), (2, 4.0)], "recording_id long, duration double")
    got = sorted((r.recording_id, r.t_start, r.t_end) for r in S.tiling(b, d).collect())
    assert got == [(1, 0.0, 5.0), (1, 5.0, 10.0), (2, 0.0, 4.0)]


def debounce(times, gap):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= gap:
            out.append(t)
            last = t
    return out


def test_debounce_batch(spark):
    rnd = random.Random(5)
    times = [rnd.randrange(3000) for _ in range(200)]
    df = spark.createDataFrame([("k", t) for t in times], "key string, ms long")
    assert sorted(r.ms for r in capture.debounced_batch(df, 100).collect()) == debounce(times, 100)


def test_debounce_live(spark, tmp_path):
    rnd = random.Random(6)
    times = sorted(rnd.randrange(3000) for _ in range(120))
    for n, part in enumerate((times[:60], times[60:])):
        df = spark.createDataFrame([("k", t) for t in part], "key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append" if n else "overwrite").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("key string, ms long, ts timestamp").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = capture.debounced(live, 100, 10_000_000).writeStream.format("memory").queryName("pressed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ms for r in spark.table("pressed").collect()) == debounce(times, 100)


def test_band_share_tells_rates_apart(spark):
    import numpy as np

    t = np.arange(2000) / 50
    made = {1: 1 + 0.5 * np.sin(2 * np.pi * 5.5 * t), 2: 1 + 0.5 * np.sin(2 * np.pi * 1.0 * t), 3: np.ones(2000), 4: np.ones(20)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)], "k long, i long, x double")
    got = recursive.band_share(df, "k", "i", "x", 50.0, 4.0, 7.0, 6, 25).toPandas().sort_values(["k", "i"])
    mid = {k: g.iloc[len(g) // 4 : 3 * len(g) // 4] for k, g in got.groupby("k")}
    assert mid[1]["share"].min() > 0.9 and mid[1]["depth"].between(0.29, 0.36).all()
    assert mid[2]["share"].max() < 0.05 and mid[3]["share"].max() == 0 and mid[4]["share"].isna().all()


def test_short_frames_depend_on_nothing_outside(spark):
    """Samples just on a threshold: the mean is that of the frame's values added from first to last, whatever stands elsewhere."""
    rnd = random.Random(8)
    v = [0.1 * k if k % 60 > 40 else rnd.choice((None, float(rnd.randrange(30)), rnd.randrange(3000) / 100)) for k in range(600)]
    got = W.rolling_moments(spark.createDataFrame(list(enumerate(v)), "i long, v double").withColumn("k", F.lit(1)), ["k"], "i", "v", 5).collect()
    for r in got:
        near = [x for x in v[max(0, r.i - 5) : r.i + 6] if x is not None]
        assert r.n == (len(near) or None) and r["mean"] == (sum_in_order(near) / len(near) if near else None)


def sum_in_order(values):
    total = 0.0
    for x in values:
        total += x
    return total
