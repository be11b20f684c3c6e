"""Input rates: the batch form and the live one against a plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import rates as R

EVENT = "key string, ms long, kind string, x double, y double"


def plain(events, period):
    out, at = [], {}
    for key, ms, kind, x, y in sorted(events, key=lambda e: (e[0], e[1], e[2] == "tick", e[2], e[3], e[4])):
        s = at.setdefault(key, {"key": 0, "click": 0, "d": 0.0, "xy": None, "start": None})
        if kind in ("key", "click"):
            s[kind] += 1
        elif kind == "move":
            s["d"] += math.dist(s["xy"], (x, y)) if s["xy"] else 0.0
            s["xy"] = x, y
        elif s["start"] is None:
            s["start"] = ms
        elif ms - s["start"] >= period:
            span = (ms - s["start"]) / 1000
            out.append((key, s["start"], ms, s["key"] / span, s["click"] / span, s["d"] / span))
            s.update({"key": 0, "click": 0, "d": 0.0, "start": ms})
    return sorted(out)


def made(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), rnd.randrange(1, 20_000), rnd.choice(["key", "click", "move", "move", "tick"]), float(rnd.randrange(90)), float(rnd.randrange(90))) for _ in range(n)] + [("c", 5, "key", 0.0, 0.0), ("c", 9, "tick", 0.0, 0.0)]


def near(rows):
    return [(k, a, b, *(round(v, 9) for v in vs)) for k, a, b, *vs in sorted(rows)]


@pytest.mark.parametrize("period", [100, 1500])
def test_batch(spark, period):
    events = made(period)
    got = R.rates(spark.createDataFrame(events, EVENT).repartition(3), period).collect()
    assert near(tuple(r) for r in got) == near(plain(events, period)) and len(got) > 5


def live(spark, tmp_path, parts, period):
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, EVENT).withColumn("ts", F.timestamp_millis("ms"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    out = []
    for n in range(len(parts)):  # one file after the other, by the same query
        source = spark.readStream.schema(EVENT + ", ts timestamp").parquet(str(tmp_path / ("in/[0-%d]" % n)))
        q = R.live_rates(source, period, 10_000_000).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_live_in_several_batches_is_the_batch_form(spark, tmp_path):
    events = sorted(made(3), key=lambda e: e[1])
    cuts = [0, 130, 131, 290, len(events)]
    # Rows of one time stay together.
    cuts = [0] + [next(k for k in range(c, len(events) + 1) if k == len(events) or events[k][1] != events[k - 1][1]) for c in cuts[1:]]
    got = live(spark, tmp_path, [events[a:b] for a, b in zip(cuts, cuts[1:]) if a < b], 1000)
    assert near(tuple(r)[:6] for r in got) == near(plain(events, 1000)) and sum(r.late for r in got) == 0


def test_rows_out_of_order_are_counted(spark, tmp_path):
    first = [("a", 5000, "tick", 0.0, 0.0), ("a", 5500, "key", 0.0, 0.0), ("a", 6000, "tick", 0.0, 0.0)]
    second = [("a", 5400, "key", 0.0, 0.0), ("a", 5900, "click", 0.0, 0.0), ("a", 6500, "key", 0.0, 0.0), ("a", 7100, "tick", 0.0, 0.0)]
    got = sorted(tuple(r) for r in live(spark, tmp_path, [first, second], 1000))
    assert got == [("a", 5000, 6000, 1.0, 0.0, 0.0, 0), ("a", 6000, 7100, 1 / 1.1, 0.0, 0.0, 2)]
