"""Graphs of what needs what: order, closure, cycles. A graph is named by a key; edges are (graph, node, needs)."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written
from .groups import each_group


def closure(edges: DataFrame) -> DataFrame:
    """(graph, node, needs) directly or through others. Only pairs that the last round found are joined on; it ends when a round finds none, on cycles too, where a node needs itself."""
    known = written(edges.select("graph", "node", "needs").distinct(), "closure")
    step, news = edges.select("graph", F.col("node").alias("needs"), F.col("needs").alias("further")).distinct(), known
    while True:
        found = news.join(step, ["graph", "needs"]).select("graph", "node", F.col("further").alias("needs")).distinct()
        found = written(found.join(known, ["graph", "node", "needs"], "left_anti"), "closure-step")
        if not found.limit(1).count():
            dropped(found)
            return known
        grown = written(known.unionByName(found), "closure")
        dropped(known)
        known, news = grown, found


def cyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node): what is left when nodes that need nothing are peeled off again and again: the cycles and what needs them. Needs that are no nodes of their graph don't count."""
    left = written(nodes.select("graph", "node").distinct(), "left")
    own = edges.select("graph", "node", "needs").distinct()
    while True:
        held = own.join(left.select("graph", F.col("node").alias("needs")), ["graph", "needs"], "left_semi").select("graph", "node").distinct()
        rest = written(left.join(held, ["graph", "node"], "left_semi"), "left")
        done = rest.count() == left.count()
        dropped(left)
        left = rest
        if done:
            return left


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, place from 0, or null): nodes (graph, node, rank) after all that they need, of those that are ready the one with the least rank first.

    A graph with a cycle has no order: `cycle` then names its nodes that can't be placed, and all places are null. Needs that are no nodes of their graph don't count. Which node is
    next depends on all that came before, so a graph is one group; graphs are many, and each is as large as a plan is.
    """

    def run(key: tuple, rows: dict) -> list[tuple]:
        of = list(zip(rows["node"].tolist(), rows["rank"].tolist(), rows["needs"].tolist(), rows["_edge"].tolist()))
        rank = {n: r for n, r, _, edge in of if not edge}
        waits, after = dict.fromkeys(rank, 0), {n: [] for n in rank}
        for n, d in {(n, d) for n, _, d, edge in of if edge and n in rank and d in rank}:
            waits[n] += 1
            after[d].append(n)
        ready = [(rank[n], n) for n, w in waits.items() if not w]
        heapify(ready)
        place: dict = {}
        while ready:
            n = heappop(ready)[1]
            place[n] = len(place)
            for m in after[n]:
                waits[m] -= 1
                if not waits[m]:
                    heappush(ready, (rank[m], m))
        stuck = sorted(set(rank) - set(place)) or None
        return [(key[0], n, None if stuck else place[n], stuck) for n in rank]

    kinds = dict(nodes.dtypes)
    schema = f"graph {kinds['graph']}, node {kinds['node']}, place long, cycle array<{kinds['node']}>"
    # Nodes and edges in one table, sorted by graph: graphs are many and most are small.
    rows = nodes.select("graph", "node", "rank", F.col("node").alias("needs"), F.lit(False).alias("_edge"))
    edges = edges.select("graph", "node", F.lit(0).cast(kinds["rank"]).alias("rank"), "needs", F.lit(True).alias("_edge"))
    return each_group(rows.unionByName(edges), ["graph"], ["_edge"], run, schema)
