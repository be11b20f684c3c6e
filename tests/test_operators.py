"""Operators without SQL, or beyond what the tables hold, against plain Python."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import text as X
from tidemark.operators import chapters as Ch
from tidemark.operators import selection as S


def plain_chapters(opens, spare, duration, least, most):
    accepted = sorted({t for t, _ in opens if 0 < t < duration})
    left = {t: s for t, s in spare if 0 < t < duration and t not in accepted}
    while True:
        starts = [0.0, *accepted]
        over = next(((a, b) for a, b in zip(starts, [*accepted, duration]) if b - a > most and any(a < t < b for t in left)), None)
        if over is None:
            break
        t = max((t for t in left if over[0] < t < over[1]), key=lambda t: (left[t], -t))
        accepted = sorted([*accepted, t])
        del left[t]
    starts = [0.0, *accepted]
    return [a for k, (a, b) in enumerate(zip(starts, [*accepted, duration])) if k == 0 or b - a >= least]


marks = st.lists(st.tuples(st.integers(1, 99), st.integers(0, 5)), max_size=15, unique_by=lambda m: m[0])


@given(marks, marks, st.integers(1, 12), st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_chapters(opens, spare, least, most):
    assert Ch.ranged(opens, spare, 100.0, least, most) == plain_chapters(opens, spare, 100.0, least, most)


def test_chapters_of_a_long_recording_are_all_split():
    assert len(Ch.ranged([], [(10.0 * k, 1.0 + k % 7) for k in range(1, 200)], 2000.0, 5.0, 10.0)) == 200


def test_folds_in_order_against_a_loop(spark):
    rnd = random.Random(1)
    data = [(k, float(rnd.randrange(400))) for k in (1, 1, 1, 2, 3) for _ in range(60)] + [(4, 1.0), (4, 1.0)]
    df = spark.createDataFrame(data, "recording_id long, t double")
    want = []
    for k in (1, 2, 3, 4):
        last = None
        for t in sorted(t for j, t in data if j == k):
            if last is None or t - last > 7:
                last = t
                want.append((k, t))
    assert sorted(map(tuple, S.anchored_clusters(df, 7.0).collect())) == sorted(want)


def test_tail_json(spark):
    deep = {"a": {"b": {"c": {"d": [{"e": "} {"}, 1]}}}}
    said = ["x {y} " + json.dumps(deep) + " so", "{", "", None, '{"a": 1} {"b": 2', "{" * 2000]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(X.tail_json(__import__("pyspark").sql.functions.col("s"))).collect()]
    assert json.loads(got[0]) == deep and got[1:] == [None, None, None, '{"a": 1}', None]


def test_relinked_keeps_long_tails(spark):
    from pyspark.sql import functions as F

    path = "/old/" + "x" * 1_200_000
    got = spark.createDataFrame([(path,), ("/older",)], "p string").select(X.relinked(F.col("p"), "/old/", "/new/")).collect()
    assert [r[0] for r in got] == ["/new/" + "x" * 1_200_000, "/older"]


def test_quotes_in_capitals_are_found(spark):
    from pyspark.sql import functions as F

    said = ["Straße und ŉ, ﬁn, ᾳ", "ΟΔΟΣ", "ΟΔΟΣΣ İx", "plain\U0001f600x", "", None]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(X.raised(F.col("s")).alias("up"), X.folded(F.col("s")) == X.folded(X.raised(F.col("s"))), X.folded(F.substring("s", 1, 4))).collect()
    assert [r[0] for r in got] == ["STRAẞE UND ŉ, ﬁN, ᾼ", "ΟΔΟΣ", "ΟΔΟΣΣ İX", "PLAIN\U0001f600X", "", None]
    assert all(r[1] for r in got if r[0] is not None) and got[1][2] == "οδοσ"
