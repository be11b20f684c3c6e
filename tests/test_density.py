"""Density clusters against a plain version over all pairs."""

import math

import numpy as np
import pytest

from tidemark.operators import density

SCHEMA = "id long, v array<double>, g long, node long"


def plain(points, least, samples):
    """Kruskal over all pairs, then the condensed tree from the top, then excess of mass. points: {id: vector}, all different."""
    ids = sorted(points)
    d = {(a, b): math.sqrt(((points[a] - points[b]) ** 2).sum()) for a in ids for b in ids}
    core = {a: sorted(d[a, b] for b in ids)[min(samples, len(ids) - 1)] for a in ids}
    edges = sorted((max(core[a], core[b], d[a, b]), a, b) for a in ids for b in ids if a < b)
    tree, root = [], {a: a for a in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for w, a, b in edges:
        if find(a) != find(b):
            root[find(a)] = find(b)
            tree.append((w, a, b))

    def split(members, edges, born):
        """Condensed cluster over members: its stability, its own set, its children."""
        mass, rest, left = 0.0, list(edges), set(members)
        while True:
            if not rest:
                return {"s": mass, "members": members, "children": []}
            w, a, b = rest.pop()
            near = {x: [] for x in left}
            for _, p, q in rest:
                near[p].append(q)
                near[q].append(p)
            side, todo = {a}, [a]
            while todo:
                for y in near[todo.pop()]:
                    if y not in side:
                        side.add(y)
                        todo.append(y)
            other = left - side
            big = [s for s in (side, other) if len(s) >= least]
            if len(big) == 2:
                mass += len(left) * (1 / w - born)
                kids = [split(s, [e for e in rest if e[1] in s], 1 / w) for s in big]
                return {"s": mass, "members": members, "children": kids}
            gone = left - big[0] if big else left
            mass += len(gone) * (1 / w - born)
            if not big:
                return {"s": mass, "members": members, "children": []}
            left, rest = big[0], [e for e in rest if e[1] in big[0]]

    def best(c):
        below = [best(k) for k in c["children"]]
        total = sum(v for v, _ in below)
        return (c["s"], [c["members"]]) if c["s"] >= total else (total, [m for _, ms in below for m in ms])

    if len(ids) < least:
        return tree, {}
    top = split(set(ids), tree, 0.0)
    found = [m for k in top["children"] for m in best(k)[1]]
    return tree, {i: min(m) for m in found for i in m}


def clouds(seed, sizes, dim, noise):
    rnd = np.random.default_rng(seed)
    parts = [rnd.normal(size=(n, dim)) * rnd.uniform(0.2, 1.5) + rnd.normal(size=dim) * 6 for n in sizes]
    return {i: v for i, v in enumerate(np.concatenate([*parts, rnd.uniform(-12, 12, size=(noise, dim))]))}


@pytest.mark.parametrize("seed,sizes,dim,noise,level", [(1, (40, 25, 12, 7), 3, 20, 1_000_000), (2, (60, 5, 5, 30), 2, 10, 25)])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, seed, sizes, dim, noise, level):
    monkeypatch.setattr(density, "LEVEL", level)
    monkeypatch.setattr(density, "MEMBERS", 9)
    points = clouds(seed, sizes, dim, noise)
    tree, want = plain(points, 5, 5)
    kept = []
    whole = density.condensed
    monkeypatch.setattr(density, "condensed", lambda nodes, core, t, least: kept.append(t.collect()) or whole(nodes, core, t, least))
    df = spark.createDataFrame([(i, v.tolist(), i % 3, 0) for i, v in points.items()], SCHEMA)
    got = {r.id: r for r in density.density_clusters(df, "id", "v", "g").collect()}
    assert sorted((r.a, r.b) for r in kept[0]) == sorted((a, b) for _, a, b in tree)
    assert np.allclose(sorted(r.w for r in kept[0]), sorted(w for w, *_ in tree), rtol=1e-12)
    assert {i: r.cluster for i, r in got.items() if r.cluster is not None} == want and len(set(want.values())) > 1
    for i, r in got.items():
        if r.cluster is not None:
            mates = [j for j in want if want[j] == r.cluster]
            assert (r.n_members, r.n_groups) == (len(mates), len({j % 3 for j in mates}))


def test_copies_few_rows_and_odd_ones(spark):
    nan = float("nan")
    rows = [(i, [0.0, 0.0], i, 0) for i in range(6)] + [(10 + i, [5.0 + i / 100, 5.0], 1, 0) for i in range(7)] + [(20 + i, [9.0 * i, 40.0 * (-1) ** i], 1, 0) for i in range(4)]
    rows += [(30, None, 1, 0), (31, [1.0, None], 1, 0), (32, [nan, 1.0], 1, 0), (None, [0.0, 0.0], 1, 0)]
    got = {r.id: (r.cluster, r.n_members, r.n_groups) for r in density.density_clusters(spark.createDataFrame(rows, SCHEMA), "id", "v", "g").collect()}
    assert got == {**{i: (0, 6, 6) for i in range(6)}, **{10 + i: (10, 7, 1) for i in range(7)}, **{20 + i: (None, None, None) for i in range(4)}}
    few = density.density_clusters(spark.createDataFrame(rows[6:8], SCHEMA), "id", "v", "g").collect()
    assert [(r.id, r.cluster) for r in sorted(few)] == [(10, None), (11, None)]
    one = density.density_clusters(spark.createDataFrame(rows[:6], SCHEMA), "id", "v", "g").collect()
    assert {r.cluster for r in one} == {None}  # a whole table is never one cluster
    assert density.density_clusters(spark.createDataFrame(rows[17:], SCHEMA), "id", "v", "g").count() == 0


def test_who_searches_in_flat_dimensions(spark, monkeypatch):
    """Where no block can be skipped, each vector looks past all others once; the spanning tree's rounds take their edges from its list of neighbours."""
    asked, search = [], density.Blocks.search

    def counted(self, seekers, members, *args, **named):
        asked.append(sum(len(r.node) // 8 if isinstance(r.node, bytearray) else 1 for r in seekers.select("node").collect()))
        return search(self, seekers, members, *args, **named)

    monkeypatch.setattr(density.Blocks, "search", counted)
    points = {i: v for i, v in enumerate(np.random.default_rng(3).normal(size=(400, 24)))}
    points |= {400 + i: points[i] + 0.01 * points[i + 1] for i in range(0, 60, 2)}
    tree, want = plain(points, 5, 5)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in points.items()], SCHEMA)
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", "v", "g").collect()}
    assert {i: c for i, c in got.items() if c is not None} == want
    assert sum(asked) < 1.5 * len(points)


def test_kernels_are_exact_far_from_the_origin_and_with_short_lists(spark, monkeypatch):
    """Single precision only leaves out what is surely too far; short lists and small chunks make the rounds search."""
    for name, value in {"LISTED": 6, "CHUNK": (40, 40), "ROWS": 16, "PAIRS": 50, "WAITING": 1, "MEMBERS": 30}.items():
        monkeypatch.setattr(density, name, value)
    points = {i: 1e6 + v * 1e-2 for i, v in clouds(5, (70, 30, 9), 4, 15).items()}
    tree, want = plain(points, 5, 5)
    kept, whole = [], density.condensed
    monkeypatch.setattr(density, "condensed", lambda nodes, core, t, least: kept.append(t.collect()) or whole(nodes, core, t, least))
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in points.items()], SCHEMA)
    got = {r.id: r.cluster for r in density.density_clusters(df, "id", "v", "g").collect()}
    assert sorted((r.a, r.b) for r in kept[0]) == sorted((a, b) for _, a, b in tree)
    assert {i: c for i, c in got.items() if c is not None} == want and len(set(want.values())) > 1
