import random

from tidemark.operators import graphs as G

NODE, EDGE = "graph long, node string, rank long", "graph long, node string, needs string"


def plain_order(nodes, edges):
    """One after the other: the least of those whose needs are all placed."""
    done = []
    while len(done) < len(nodes):
        ready = [n for n in nodes if n not in done and all(d in done for m, d in edges if m == n and d in nodes)]
        if not ready:
            return None
        done.append(min(ready, key=lambda n: (nodes[n], n)))
    return done


def test_orders_closures_and_cycles(spark):
    rnd, graphs = random.Random(2), {}
    for g in range(25):
        nodes = {f"n{k}": rnd.randrange(6) for k in range(rnd.randrange(1, 9))}
        edges = {(a, b) for a in nodes for b in nodes if rnd.random() < 0.25 and (a > b or g % 5 == 4)} | {(min(nodes), "elsewhere")}
        graphs[g] = nodes, edges
    n = spark.createDataFrame([(g, a, r) for g, (nodes, _) in graphs.items() for a, r in nodes.items()], NODE)
    e = spark.createDataFrame([(g, a, b) for g, (_, edges) in graphs.items() for a, b in edges] * 2, EDGE)
    got, left = {}, {(r.graph, r.node) for r in G.cyclic(n, e).collect()}
    for r in G.topological_order(n, e).collect():
        got.setdefault(r.graph, []).append(r)
    for g, (nodes, edges) in graphs.items():
        want = plain_order(nodes, edges)
        if want is None:
            stuck = sorted(a for h, a in left if h == g)
            assert stuck and all(r.place is None and r.cycle == stuck for r in got[g])
        else:
            assert [r.node for r in sorted(got[g], key=lambda r: r.place)] == want and all(r.cycle is None for r in got[g])
            assert not any(h == g for h, _ in left)
    assert any(plain_order(*x) is None for x in graphs.values())
    reach = {(r.graph, r.node, r.needs) for r in G.closure(e).collect()}
    for g, (nodes, edges) in graphs.items():
        for a in nodes:
            seen, todo = set(), [b for m, b in edges if m == a]
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += [c for m, c in edges if m == b]
            assert {b for h, m, b in reach if (h, m) == (g, a)} == seen
    assert G.closure(e.limit(0)).count() == 0 and G.cyclic(n.limit(0), e).count() == 0
