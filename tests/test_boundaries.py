import numpy as np
import pytest

from tidemark.operators import peaks as X
from tidemark.operators.boundaries import embedding_boundaries


def test_boundaries_are_those_of_a_plain_walk(spark):
    rnd, data = np.random.default_rng(3), {}
    for k, n in ((1, 60), (2, 9), (3, 5), (4, 30)):
        topics = rnd.normal(size=(5, 8))
        data[k] = [topics[(i // 12) % 5] + rnd.normal(size=8) * 0.4 if k < 4 else topics[0] for i in range(n)]
    rows = [(k, i, v.tolist(), i * 10.0, i * 10.0 + 7) for k, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k long, seq long, v array<double>, t_start double, t_end double").repartition(3)
    got = sorted((r.k, r.t, r.strength) for r in embedding_boundaries(df, "k", "seq", "v", "t_start", "t_end", 3).collect())
    want = []
    for k, vs in data.items():
        unit = lambda m: m / np.linalg.norm(m)
        depth = np.array([1 - unit(np.mean(vs[i - 3 : i], 0)) @ unit(np.mean(vs[i : i + 3], 0)) for i in range(3, len(vs) - 2)])
        if len(depth) >= 3 and k != 4:
            want += [(k, ((p.i + 2) * 10 + 7 + (p.i + 3) * 10) / 2, (p.value - p.base) / depth.std()) for p in X.find(depth, depth.std())]
    assert len(got) == len(want) > 3 and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2]) for a, b in zip(got, sorted(want)))
