"""Clusters by density: mutual reachability, spanning tree, condensed tree, excess of mass.

Vectors are dealt into blocks around pivots, and packed into tiles, one row each. Who looks for neighbours within a reach is dealt into chunks of near
blocks; past a chunk run the tiles that can hold any by the triangle inequality, the nearest first, and what can be near by a product
of matrices in single precision, whose rounding is allowed for, is then measured exactly. So results are those of all pairs without listing them, and
a task holds one chunk and one tile. The spanning tree grows in Boruvka rounds: each component but the largest takes its least edge outwards,
first from lists of the nearest neighbours, and only who has a list too short to decide it searches. The tree's edges are then read from the
shortest to the longest, in levels of about LEVEL edges, each connected part of a level by a task of its own, which keeps for each component
its size, its cluster and its clusters' stability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

MAX_PIVOTS, MEMBERS, LEVEL = 1024, 4096, 1_000_000
# Seekers of a chunk: a 48th of all within these bounds. Rows of a product, pairs measured at once, the least length of a list of neighbours, and candidates for it that wait on average.
CHUNK, ROWS, PAIRS, LISTED, WAITING = (2048, 16384), 1024, 65536, 32, 16
# The level of a vector that is there often enough by itself; a distance can't be smaller in what 1 / distance gives.
LEAST = 1e-9
_INF, _LAST = float("inf"), np.iinfo(np.int64).max
_TILE = ["node", "v", "core", "comp", "reach"]


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _measured(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean between rows at equal places, by differences, so that equal pairs give equal values wherever they meet."""
    return np.sqrt(((y - x) ** 2).sum(1))


def _under(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all to all in double precision, less what rounding may have added."""
    a, b = (x * x).sum(1)[:, None], (y * y).sum(1)
    with np.errstate(all="ignore"):
        low = a + b - 2 * (x @ y.T) - (x.shape[1] + 16) * 2.0**-51 * (a + b)
    return np.sqrt(np.where(low > 0, low, 0))


def _set(flags: np.ndarray) -> np.ndarray:
    """Places of the few flags that are set, looked for by eights."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64))
    at, bit = np.nonzero(flags[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at] * 8 + bit, whole + np.flatnonzero(flags[whole:])])


def _ordered(pivots: np.ndarray) -> list[int]:
    """Places of the pivots such that near ones mostly follow each other: halved again and again where they spread most."""
    out, todo = [], [np.arange(len(pivots))]
    while todo:
        at = todo.pop()
        if len(at) < 3:
            out += at.tolist()
            continue
        widest = np.ptp(pivots[at], axis=0).argmax()
        at = at[np.argsort(pivots[at, widest], kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return out


class _Frame:
    """Vectors in single precision, moved to a middle and scaled so that pivots lie about 1 from it."""

    def __init__(self, pivots: np.ndarray):
        self.middle = pivots.mean(0)
        spread = float(np.abs(pivots - self.middle).max(initial=0))
        self.scale = 1 / spread if 1e-300 < spread < 1e300 else 1.0
        self.slack = (pivots.shape[1] + 32) * 2.0**-23

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors, and their squared lengths."""
        with np.errstate(all="ignore"):
            x = ((v - self.middle) * self.scale).astype(np.float32)
            return x, (x.astype(np.float64) ** 2).sum(1)

    def near(self, x: np.ndarray, xx: np.ndarray, y: np.ndarray, yy: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of all pairs within the row's reach, and some just outside. What overflows counts as near."""
        with np.errstate(all="ignore"):
            most = ((reach * self.scale) ** 2 * (1 + 2.0**-18) + 1e-30 - (1 - self.slack) * xx) / 2
            z = x @ y.T
            z -= ((1 - self.slack) / 2 * yy).astype(np.float32)
            far = z < (-most).astype(np.float32)[:, None]
        return np.divmod(_set(np.logical_not(far, out=far).ravel()), len(y))

    def within(self, x: np.ndarray, xx: np.ndarray, y: np.ndarray, yy: np.ndarray) -> np.ndarray:
        """Distances of all to all, with what rounding may have taken off."""
        with np.errstate(all="ignore"):
            high = (1 + self.slack) * (xx[:, None] + yy) - 2 * (x @ y.T)
            d = np.sqrt(np.maximum(high, 0) + 1e-30) / self.scale * (1 + 2.0**-40)
        return np.where(np.isnan(d), _INF, d)


class _Seekers:
    """A chunk of seekers, past which tiles run. `bound` is how far each still has to look."""

    def __init__(self, frame: _Frame, tiles: list[tuple]):
        self.frame = frame
        self.node, self.v, self.core, self.comp, self.bound = (np.concatenate(c) for c in zip(*tiles))
        self.x, self.xx = frame.of(self.v)

    def asked(self, pivot: np.ndarray, radius: float, inside: int) -> np.ndarray:
        """Who may find something around the pivot; a little is added for rounding."""
        low = _under(self.v, pivot[None])[:, 0]
        return np.flatnonzero((low - radius <= self.bound + 1e-9 * (1 + low)) & (self.comp != inside))

    def pass_by(self, asked: np.ndarray, tile: tuple) -> None:
        y, yy = self.frame.of(tile[1])
        for k in range(0, len(asked), ROWS):
            rows = asked[k : k + ROWS]
            self.begin(rows, tile, y, yy)
            at, j = self.frame.near(self.x[rows], self.xx[rows], y, yy, self.bound[rows])
            i = rows[at]
            keep = self.wanted(i, j, tile)
            i, j = i[keep], j[keep]
            for c in range(0, len(i), PAIRS):
                p, q = i[c : c + PAIRS], j[c : c + PAIRS]
                self.add(p, q, _measured(self.v[p], tile[1][q]), tile)


class _Nearest(_Seekers):
    """The k nearest of each, ties by the lower id."""

    schema = "node long, core double, far double, other array<long>, d array<double>"

    def __init__(self, frame: _Frame, tiles: list[tuple], k: int, samples: int):
        super().__init__(frame, tiles)
        self.k, self.samples, shape = k, samples, (len(self.node), k)
        self.d, self.other, self.m = np.full(shape, _INF), np.full(shape, _LAST), np.zeros(shape)
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def begin(self, rows: np.ndarray, tile: tuple, y: np.ndarray, yy: np.ndarray) -> None:
        pass

    def wanted(self, i: np.ndarray, j: np.ndarray, tile: tuple) -> np.ndarray:
        return np.ones(len(i), bool)

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, tile: tuple) -> None:
        near = d <= self.bound[i]
        i, j = i[near], j[near]
        self.waiting.append((i, d[near], tile[0][j], tile[4][j]))
        self.n_waiting += len(i)
        if self.n_waiting > WAITING * len(self.node):
            self.settle()

    def settle(self) -> None:
        i, d, other, m = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.n_waiting = [], 0
        rows, k = np.unique(i), self.k
        i = np.concatenate([np.repeat(rows, k), i])
        d, other, m = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.d, d), (self.other, other), (self.m, m)))
        order = np.lexsort((other, d, i))
        first = np.searchsorted(i[order], rows)
        order = order[first[:, None] + np.arange(k)]
        self.d[rows], self.other[rows], self.m[rows] = d[order], other[order], m[order]
        self.bound[rows] = np.minimum(self.bound[rows], self.d[rows, -1])

    def out(self) -> pa.RecordBatch:
        """core: the distance within which more than `samples` rows lie, else the farthest. far: how far the list goes; all that is missing isn't nearer."""
        if self.waiting:
            self.settle()
        n = (self.other < _LAST).sum(1)
        enough = np.cumsum(self.m, axis=1) > self.samples
        at = np.where(enough.any(1), enough.argmax(1), n - 1)
        core = self.d[np.arange(len(n)), at]
        far = np.where(n == self.k, self.d[:, -1], _INF)
        there, ends = self.other < _LAST, pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[there])) for x in (self.other, self.d)]
        return pa.RecordBatch.from_arrays([pa.array(self.node), pa.array(core), pa.array(far), *lists], ["node", "core", "far", "other", "d"])


class _Outside(_Seekers):
    """Each component's least edge to another, ties by the lower ids."""

    schema = "comp long, w double, a long, b long"

    def __init__(self, frame: _Frame, tiles: list[tuple]):
        super().__init__(frame, tiles)
        self.names, self.of = np.unique(self.comp, return_inverse=True)
        self.w = np.full(len(self.names), _INF)
        np.minimum.at(self.w, self.of, self.bound)
        self.a, self.b = (np.full(len(self.names), _LAST) for _ in range(2))
        self.bound = self.w[self.of]

    def begin(self, rows: np.ndarray, tile: tuple, y: np.ndarray, yy: np.ndarray) -> None:
        rows = rows[self.bound[rows] == _INF]
        if len(rows):
            # Who doesn't know yet how far to look first measures one pair.
            about = np.maximum(self.frame.within(self.x[rows], self.xx[rows], y, yy), tile[2])
            about[self.comp[rows][:, None] == tile[3]] = _INF
            j = about.argmin(1)
            some = tile[3][j] != self.comp[rows]
            self.add(rows[some], j[some], _measured(self.v[rows[some]], tile[1][j[some]]), tile)

    def wanted(self, i: np.ndarray, j: np.ndarray, tile: tuple) -> np.ndarray:
        return (self.comp[i] != tile[3][j]) & (tile[2][j] <= self.bound[i])

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, tile: tuple) -> None:
        w = np.maximum(np.maximum(self.core[i], tile[2][j]), d)
        c = self.of[i]
        good = w <= self.w[c]
        w, c, i, j = w[good], c[good], self.node[i[good]], tile[0][j[good]]
        if not len(c):
            return
        a, b = np.minimum(i, j), np.maximum(i, j)
        w, c, a, b = (np.concatenate(x) for x in ((w, self.w), (c, np.arange(len(self.w))), (a, self.a), (b, self.b)))
        order = np.lexsort((b, a, w, c))
        order = order[np.searchsorted(c[order], np.arange(len(self.w)))]
        self.w, self.a, self.b = w[order], a[order], b[order]
        self.bound = self.w[self.of]

    def out(self) -> pa.RecordBatch:
        found = self.a < _LAST
        return pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (self.names, self.w, self.a, self.b)], ["comp", "w", "a", "b"])


def _read(row: tuple) -> tuple[np.ndarray, ...]:
    """node, v, core, comp, reach of a tile."""
    node, v, *rest = (np.frombuffer(b, t) for b, t in zip(row, (np.int64, np.float64, np.float64, np.int64, np.float64)))
    return node, v.reshape(len(node), -1), *rest


def _packed(rows: DataFrame) -> DataFrame:
    """A tile for each block and part: its rows' columns, each as one run of bytes."""
    fields = ["block", "part", *_TILE]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def tile() -> pa.RecordBatch:
            key, got = held.popitem()
            columns = [[b"".join(c)] for c in zip(*got)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], fields)

        for batch in batches:
            block, part = (batch.column(c).to_numpy() for c in ("block", "part"))
            edges = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]))).tolist() if len(batch) else []
            for lo, hi in zip(edges, [*edges[1:], len(batch)]):
                key, piece = (int(block[lo]), int(part[lo])), batch.slice(lo, hi - lo)
                if held and key not in held:
                    yield tile()
                v = _vectors(piece.column("v"))
                held.setdefault(key, []).append([np.ascontiguousarray(v if c == "v" else piece.column(c).to_numpy()).tobytes() for c in _TILE])
        if held:
            yield tile()

    return rows.select(*fields).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(pack, "block int, part int, node binary, v binary, core binary, comp binary, reach binary")


class Blocks:
    """Nodes (node, m, v) dealt by their nearest pivot into blocks, large ones into parts of about MEMBERS."""

    def __init__(self, nodes: DataFrame, n: int):
        count = min(MAX_PIVOTS, math.ceil(math.sqrt(n)))
        self.pivots = np.array([r.v for r in nodes.orderBy(F.xxhash64("node"), "node").limit(count).collect()])  # at most MAX_PIVOTS vectors
        pivots = self.pivots = self.pivots[_ordered(self.pivots)]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _vectors(batch.column("v")) if len(batch) else pivots[:0]
                at = _under(v, pivots).argmin(1) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(_measured(v, pivots[at]))], ["node", "m", "v", "block", "off"])

        dealt = written(nodes.select("node", "m", "v").mapInArrow(deal, "node long, m long, v array<double>, block int, off double"), "blocks")
        stats = {r.block: r for r in dealt.groupBy("block").agg(F.max("off").alias("off"), F.count("*").alias("n")).collect()}  # one row a pivot
        self.radius = np.array([stats[b].off if b in stats else -_INF for b in range(len(pivots))])
        parts = F.element_at(F.array(*(F.lit(-(-stats[b].n // MEMBERS) if b in stats else 1) for b in range(len(pivots)))), F.col("block") + 1)
        self.nodes = written(dealt.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).drop("off"), "nodes")
        dropped(dealt)

    def search(self, seekers: DataFrame, members: DataFrame, kind: type[_Seekers], *settings: int, uniform: dict[int, int] | None = None) -> DataFrame:
        """What `kind` finds for seekers among members, both tiles: every member within a seeker's reach passes by it.

        Blocks in `uniform` lie within the component named there and are skipped for its seekers.
        """
        pivots, radius, frame = self.pivots, self.radius, _Frame(self.pivots)
        inside = np.array([(uniform or {}).get(b, -2) for b in range(len(pivots))])
        sizes = seekers.select("block", "part", (F.length("node") / 8).cast("long").alias("n")).orderBy("block", "part").collect()  # one row a tile
        total = sum(r.n for r in sizes)
        most, chunks, filled = max(CHUNK[0], min(CHUNK[1], total // 48)), {}, 0
        for r in sizes:
            chunks[r.block, r.part] = filled // most
            filled += r.n
        names = ["chunk", "block", *_TILE]

        def chunk_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = [chunks[key] for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), *batch.columns[2:]], names)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, _, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    _, v, _, comp, reach = _read(row)
                    low = _under(v, pivots)
                    seen = (low - radius <= reach[:, None] + 1e-9 * (1 + low)) & (inside != comp[:, None])
                    gap = np.where(seen, low - radius, _INF).min(0)
                    to = np.flatnonzero(seen.any(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), chunk), pa.int32()), pa.array(to, pa.int32()), pa.array(gap[to])], ["chunk", "block", "gap"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, state = None, [], None
            for batch in batches:
                for k in range(len(batch)):
                    chunk, role, block, *row = (c[k].as_py() for c in batch.columns)
                    if chunk != at:
                        if state is not None:
                            yield state.out()
                        at, held, state = chunk, [], None
                    if role == 0:
                        held.append(_read(row))
                        continue
                    if state is None:
                        state, held = kind(frame, held, *settings), []
                    asked = state.asked(pivots[block], radius[block], inside[block])
                    if len(asked):
                        state.pass_by(asked, _read(row))
            if state is not None:
                yield state.out()

        dealt = seekers.mapInArrow(chunk_of, "chunk int, block int, node binary, v binary, core binary, comp binary, reach binary")
        gaps = dealt.mapInArrow(visits, "chunk int, block int, gap double").groupBy("chunk", "block").agg(F.min("gap").alias("gap"))
        there = members.join(gaps, "block").select("chunk", F.lit(1).alias("role"), "block", *_TILE, "gap")
        both = dealt.select("chunk", F.lit(0).alias("role"), "block", *_TILE, F.lit(0.0).alias("gap")).unionByName(there)
        dealt_out = both.repartitionById(max(chunks.values(), default=0) + 1, F.col("chunk"))
        return dealt_out.sortWithinPartitions("chunk", "role", "gap", "block").drop("gap").mapInArrow(meet, kind.schema)


def neighbours(blocks: Blocks, samples: int) -> DataFrame:
    """(node, core, far, other, d): each node's core distance, its nearest, itself among them, as arrays from the nearest, and how far these go."""
    pivots, frame, k = blocks.pivots, _Frame(blocks.pivots), max(LISTED, samples + 1)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How far the k-th in the own tile is, or the k-th pivot."""
        p, pp = frame.of(pivots)
        for batch in batches:
            reach = []
            for row in zip(*(c.to_pylist() for c in batch.columns[2:])):
                x, xx = frame.of(_read(row)[1])
                r = np.full(len(x), _INF)
                for y, yy in ((x, xx), (p, pp)):
                    for lo in range(0, len(x) if len(y) >= k else 0, ROWS):
                        d = frame.within(x[lo : lo + ROWS], xx[lo : lo + ROWS], y, yy)
                        r[lo : lo + ROWS] = np.minimum(r[lo : lo + ROWS], np.partition(d, k - 1, axis=1)[:, k - 1])
                reach.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(reach, pa.binary())], ["block", "part", *_TILE])

    tiles = written(_packed(blocks.nodes.select("block", "part", "node", "v", F.lit(0.0).alias("core"), F.lit(-1).cast("long").alias("comp"), F.col("m").cast("double").alias("reach"))), "tiles")
    seekers = written(tiles.mapInArrow(own, tiles.schema), "seekers")
    out = written(blocks.search(seekers, tiles, _Nearest, k, samples), "neighbours")
    dropped(tiles, seekers)
    return out


def _least(edges: DataFrame, comp: str) -> DataFrame:
    return edges.groupBy(F.col(comp).alias("comp")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("comp", "e.*")


def spanning_tree(blocks: Blocks, near: DataFrame) -> DataFrame:
    """(a, b, w): the tree of least mutual reachability, ties by the lower ids. near: as neighbours() gives it.

    The largest component takes no edge of its own in a round; others find it, and its many members needn't search.
    """
    nodes = written(blocks.nodes.join(near.select("node", "core", "far"), "node").select("block", "part", "node", "v", "core", "far"), "cored")
    c = near.select(F.col("node").alias("other"), F.col("core").alias("other_core"))
    lists = near.select("node", "core", F.explode(F.arrays_zip("other", "d")).alias("e")).select("node", "core", "e.*").where("node != other").join(c, "other")
    a, b = F.least("node", "other"), F.greatest("node", "other")
    lists = written(lists.select(a.alias("a"), b.alias("b"), F.greatest("core", "other_core", "d").alias("w"), a.alias("comp_a"), b.alias("comp_b")).distinct(), "lists")
    labels, taken = written(nodes.select("node", F.col("node").alias("comp")), "labels"), []
    while True:
        sizes = labels.groupBy("comp").agg(F.count("*").alias("n"))
        n, largest = sizes.agg(F.count("*"), F.max(F.struct("n", "comp")).getField("comp")).first()
        if n <= 1:
            break
        known = lists.select(F.col("comp_a").alias("comp"), "w", "a", "b").unionByName(lists.select(F.col("comp_b").alias("comp"), "w", "a", "b"))
        known = written(_least(known.where(F.col("comp") != largest), "comp"), "known")
        members = nodes.join(labels, "node").withColumn("reach", F.lit(0.0))
        tiles = written(_packed(members), "tiles")
        spread = members.groupBy("block").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).collect()  # one row a pivot
        uniform = {r.block: r.low for r in spread if r.low == r.high}
        seek = members.where(F.col("comp") != largest).drop("reach").join(known.select("comp", F.col("w").alias("reach")), "comp", "left").withColumn("reach", F.coalesce("reach", F.lit(_INF)))
        seek, scouted = seek.where(F.greatest("core", "far") <= F.col("reach")), None
        if known.count() < n - 1:
            # Components whose lists all stay inside first ask for one member, to know how far to look.
            scouts = seek.where(F.col("reach") == _INF).withColumn("first", F.row_number().over(Window.partitionBy("comp").orderBy("core", "node"))).where("first = 1")
            scouts = written(_packed(scouts), "scouts")
            scouted = written(_least(blocks.search(scouts, tiles, _Outside, uniform=uniform), "comp"), "scouted")
            dropped(scouts)
            seek = seek.join(scouted.select("comp", F.col("w").alias("scouted")), "comp", "left").withColumn("reach", F.least("reach", "scouted"))
            seek = seek.where(F.greatest("core", "far") <= F.col("reach"))
        seek = written(_packed(seek), "seek")
        found = known.unionByName(blocks.search(seek, tiles, _Outside, uniform=uniform))
        best = written(_least(found.unionByName(scouted) if scouted is not None else found, "comp"), "best")
        of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))  # noqa: E731, B023
        ends = best.join(of("a"), "a").join(of("b"), "b")
        hop = ends.select("comp", F.when(F.col("comp") == F.col("comp_a"), F.col("comp_b")).otherwise(F.col("comp_a")).alias("up"), "a", "b")
        # Two components that take one edge have each other; the lower of them is the root, and so is the one that takes none.
        back = hop.select(F.col("comp").alias("up"), F.col("up").alias("back"))
        tops = hop.join(back, "up", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("top"))
        tops = pointed(written(tops.unionByName(sizes.where(F.col("comp") == largest).select("comp", F.col("comp").alias("top"))), "tops"))
        taken.append(written(best.select("a", "b", "w").distinct(), "tree"))
        new = written(labels.join(tops, "comp").select("node", F.col("top").alias("comp")), "labels")
        moved = [tops.select(F.col("comp").alias(f"comp_{e}"), F.col("top").alias(f"top_{e}")) for e in "ab"]
        left = lists.join(moved[0], "comp_a").join(moved[1], "comp_b").where("top_a != top_b")
        left = written(left.select("a", "b", "w", F.col("top_a").alias("comp_a"), F.col("top_b").alias("comp_b")), "lists")
        dropped(labels, lists, known, tiles, seek, best, tops, *([scouted] if scouted is not None else []))
        labels, lists = new, left
    dropped(nodes, lists, labels)
    return reduce(DataFrame.unionByName, taken) if taken else near.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("core").alias("w")).limit(0)


def pointed(tops: DataFrame) -> DataFrame:
    """(comp, top) with each top replaced by the root above it; pointers double in length with each round."""
    while True:
        up = tops.select(F.col("comp").alias("top"), F.col("top").alias("above"))
        new = written(tops.join(up, "top").select("comp", F.col("above").alias("top"), (F.col("above") != F.col("top")).alias("moved")), "tops")
        moved = new.where("moved").limit(1).count()
        dropped(tops)
        tops = new.drop("moved")
        if not moved:
            return tops


_STATE = "comp long, size long, cluster long, mass double, children double"


class _Tree:
    """Components of one part of a level: merged in order of their edges."""

    def __init__(self, states: pd.DataFrame, least: int):
        self.least = least
        self.root = {c: c for c in states["comp"]}
        self.state = {r.comp: [r.size, None if pd.isna(r.cluster) else int(r.cluster), r.mass, r.children] for r in states.itertuples()}
        self.inside = {c: [c] for c in self.root}
        self.joined: list[tuple[int, int]] = []
        self.closed: list[tuple[int, int, float, bool]] = []

    def find(self, c: int) -> int:
        while self.root[c] != c:
            self.root[c] = c = self.root[self.root[c]]
        return c

    def _close(self, state: list, parent: int, w: float) -> float:
        """A cluster ends: its stability against the best of its children."""
        size, cluster, mass, children = state
        stability = mass - size / w
        self.closed.append((cluster, parent, stability, stability >= children))
        return max(stability, children)

    def merge(self, a: int, b: int, w: float, edge: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        x, y, w = self.state.pop(a), self.state.pop(b), max(w, LEAST)
        size = x[0] + y[0]
        both, one = x[1] is not None and y[1] is not None, x if x[1] is not None else y
        if both:
            new = [size, edge, size / w, self._close(x, edge, w) + self._close(y, edge, w)]
        elif one[1] is not None:
            other, inside = (y, b) if one is x else (x, a)
            self.joined += [(c, one[1]) for c in self.inside[inside]]
            new = [size, one[1], one[2] + other[0] / w, one[3]]
        elif size >= self.least:
            self.joined += [(c, edge) for c in self.inside[a] + self.inside[b]]
            new = [size, edge, size / w, 0.0]
        else:
            new = [size, None, 0.0, 0.0]
        # Only components without a cluster still have to tell their members of one.
        self.inside[a] = self.inside[a] + self.inside[b] if new[1] is None else []
        self.inside[b], self.root[b], self.state[a] = [], a, new


def _levels(edges: DataFrame) -> list[DataFrame]:
    n = edges.count()
    parts = max(1, -(-n // LEVEL))
    if parts == 1:
        return [edges] if n else []
    cuts = edges.select(F.percentile_approx("w", [k / parts for k in range(1, parts)], 100_000)).collect()[0][0]
    bounds = [-_INF, *sorted(set(cuts)), _INF]
    return [edges.where((F.col("w") > lo) & (F.col("w") <= hi)) for lo, hi in zip(bounds, bounds[1:])]


def _parts(now: DataFrame) -> DataFrame:
    """(comp, top): components of a level by the connected part that they are in, named by its lowest component."""
    near = written(now.select("comp_a", "comp_b").unionByName(now.select(F.col("comp_b").alias("comp_a"), F.col("comp_a").alias("comp_b"))), "near")
    groups = written(near.groupBy(F.col("comp_a").alias("comp")).agg(F.min("comp_b").alias("low")).select("comp", F.least("comp", "low").alias("top")), "groups")
    while True:
        low = near.join(groups.toDF("comp_b", "low"), "comp_b").groupBy(F.col("comp_a").alias("comp")).agg(F.min("low").alias("low"))
        step = written(groups.join(low, "comp").select("comp", F.least("top", "low").alias("top"), F.col("top").alias("was")), "step")
        new = written(step.join(step.select(F.col("comp").alias("top"), F.col("top").alias("above")), "top").select("comp", F.col("above").alias("top"), (F.col("above") != F.col("was")).alias("moved")), "groups")
        moved = new.where("moved").limit(1).count()
        dropped(groups, step)
        groups = new.drop("moved")
        if not moved:
            dropped(near)
            return groups


def condensed(nodes: DataFrame, core: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster): the first cluster of at least `least` rows that a node belongs to, and (cluster, parent, own): each cluster's parent and whether its stability is at least that of the best below it.

    A cluster is named by the edge that made it, or -1 - node if its vector alone is there often enough.
    """
    edges = written(tree.withColumn("edge", F.monotonically_increasing_id()), "edges")
    alone = F.col("m") >= least
    mass = F.when(alone, F.col("m") / F.greatest("core", F.lit(LEAST))).otherwise(0.0)
    own = F.when(alone, -1 - F.col("node"))
    states = written(nodes.join(core, "node").select(F.col("node").alias("comp"), F.col("m").alias("size"), own.alias("cluster"), mass.alias("mass"), F.lit(0.0).alias("children")), "states")
    labels = written(nodes.select("node", F.col("node").alias("comp"), own.alias("cluster")), "labels")
    closed = []

    def level(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        t = _Tree(parts, least)
        for r in rows.sort_values(["w", "a", "b"], kind="stable").itertuples():
            t.merge(r.comp_a, r.comp_b, r.w, r.edge)
        out = [("state", c, None, *s, None) for c, s in t.state.items()]
        out += [("label", c, t.find(c), None, None, None, None, None) for c in t.root]
        out += [("join", c, None, None, k, None, None, None) for c, k in t.joined]
        out += [("close", None, p, None, c, s, None, o) for c, p, s, o in t.closed]
        return pd.DataFrame(out, columns=["kind", "comp", "top", "size", "cluster", "mass", "children", "own"]).astype({c: "Int64" for c in ("comp", "top", "size", "cluster")})

    levels = _levels(edges)
    for part in levels:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))  # noqa: E731, B023
        now = written(part.join(of("a"), "a").join(of("b"), "b"), "level")
        groups = _parts(now) if len(levels) > 1 else states.select("comp", F.lit(0).cast("long").alias("top"))  # the whole tree is one part
        grouped = now.join(groups.select(F.col("comp").alias("comp_a"), "top"), "comp_a").groupBy("top")
        got = written(grouped.cogroup(states.join(groups.toDF("comp", "part"), "comp").groupBy("part")).applyInPandas(level, "kind string, comp long, top long, size long, cluster long, mass double, children double, own boolean"), "merged")
        kind = lambda k: got.where(F.col("kind") == k)  # noqa: E731, B023
        fresh = written(states.join(groups, "comp", "left_anti").unionByName(kind("state").select("comp", "size", "cluster", "mass", "children")), "states")
        tops, joins = kind("label").select("comp", "top"), kind("join").select("comp", F.col("cluster").alias("joined"))
        moved = labels.join(tops, "comp", "left").join(joins, "comp", "left")
        named = written(moved.select("node", F.coalesce("top", "comp").alias("comp"), F.coalesce("cluster", "joined").alias("cluster")), "labels")
        closed.append(kind("close").select("cluster", F.col("top").alias("parent"), "own"))
        dropped(now, states, labels)
        states, labels = fresh, named
    # What is left at the top is the root, or a vector that is alone: nothing is above it and it isn't chosen.
    roots = states.where("cluster is not null").select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(False).alias("own"))
    return labels.select("node", "cluster"), written(reduce(DataFrame.unionByName, [roots, *closed]), "clusters")


def chosen(clusters: DataFrame) -> DataFrame:
    """(cluster, label): the highest cluster at or above each that holds its own against those below it; null if none does."""
    at = written(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("own"), F.col("cluster")).alias("label")), "chain")
    while at.where("up is not null").limit(1).count():
        above = at.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("label").alias("higher"))
        new = written(at.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "label").alias("label")), "chain")
        dropped(at)
        at = new
    return at.select("cluster", "label")


def density_clusters(df: DataFrame, id: str, vector: str, group: str, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """One row for each row with an id and a vector: id, cluster (the least id in it, null for noise), n_members, n_groups (distinct values of `group` in the cluster).

    Hierarchical clusters by mutual reachability with the most excess of mass, the whole never being one cluster. A core distance reaches to the min_samples-th other row
    (min_cluster_size if none is given), or to the farthest if there are fewer. Equal vectors are one node with as many rows, so that copies cost nothing; min_cluster_size of them
    are a cluster by themselves. ids are unique; rows whose vector is null, or holds null or NaN, take no part; all vectors have one length. An empty table gives no rows.
    """
    samples = min_samples or min_cluster_size
    ok = F.col(id).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    rows = df.where(ok).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(group).alias("g"))
    nodes = written(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("m")), "distinct")
    n = nodes.count()
    if not n:
        return rows.select(F.col("id"), F.col("id").alias("cluster"), F.col("id").alias("n_members"), F.col("id").alias("n_groups"))
    blocks = Blocks(nodes, n)
    near = neighbours(blocks, samples)
    core = near.select("node", "core")
    tree = spanning_tree(blocks, near)
    first, clusters = condensed(nodes, core, tree, min_cluster_size)
    label = first.join(chosen(clusters), "cluster", "left").select("node", "label")
    told = written(rows.join(nodes.select("v", "node"), "v").join(label, "node").select("id", "g", "label"), "told")
    sizes = told.where("label is not null").groupBy("label").agg(F.min("id").alias("cluster"), F.count("*").alias("n_members"), F.count_distinct("g").alias("n_groups"))
    return told.join(sizes, "label", "left").select("id", "cluster", "n_members", "n_groups")
