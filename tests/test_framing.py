import random

import pytest

from tidemark.operators.framing import constant_rate


def plain(pts, nominal, average, tick):
    rate, tick = nominal or average, tick or 0.001
    if len(pts) < 8:
        return bool(nominal and average and nominal != average), None
    pts = sorted(pts)
    worst = max(abs(t - (pts[0] + i / rate)) for i, t in enumerate(pts))
    return worst > max(1.5 * tick, 0.02 / rate), worst / tick


def test_rates(spark):
    rnd = random.Random(3)
    cut = lambda rate, n, tick=0.001: [round(round((7.3 + i / rate) / tick) * tick, 6) for i in range(n)]
    cases = {
        1: (cut(30, 40_000), 30.0, 30.0, 0.001), 2: (cut(30000 / 1001, 40_000), 30000 / 1001, 29.97, 0.001), 3: (cut(30, 40_000), 29.97, 30.0, 0.001), 4: (cut(60, 900, 1 / 90000), 60.0, None, 1 / 90000),
        5: ([t for t in cut(30, 20_000) if rnd.random() > 0.001], 30.0, 29.95, None), 6: (cut(30, 5), 30.0, 25.0, None), 7: (cut(30, 7), 30.0, None, None), 8: ([], 30.0, 30.0, None), 9: (cut(25, 50), None, None, None),
    }
    rows = [(k, t) for k, (pts, *_) in cases.items() for t in pts]
    rnd.shuffle(rows)
    frames = spark.createDataFrame([*rows, (1, None), (77, 1.0)], "k long, pts double")
    declared = spark.createDataFrame([(k, *c[1:]) for k, c in cases.items()], "k long, nominal double, average double, tick double")
    got = {r.k: r for r in constant_rate(frames, declared, "k").collect()}
    assert set(got) == set(cases)
    for k, (pts, nominal, average, tick) in cases.items():
        if k < 9:
            variable, ticks = plain(pts, nominal, average, tick)
            assert got[k].variable == variable and (got[k].ticks == pytest.approx(ticks, abs=1e-6) if ticks is not None else got[k].ticks is None)
    assert [got[k].reason for k in range(1, 10)] == ["constant", "constant", "drifts", "constant", "drifts", "declared rates differ", "too few frames", "too few frames", "no rate"]
    assert got[3].rate == 30.0 and got[5].rate == pytest.approx(30000 / 1001) and got[6].rate == 25.0 and got[9].rate is None
