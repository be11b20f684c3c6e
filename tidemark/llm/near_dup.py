"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

A document's set holds 64-bit hashes of its distinct five-word shingles. The sketch has COORDS
coordinates (bins). In round i each shingle is hashed by the i-th hash function to a bin and a value; a
bin keeps the least (round, value). After a few rounds of random placement nearly all bins are filled,
and should any be left after COORDS rounds, one further round for each of them places every shingle
into it, so that all are filled for certain. Two sets agree in a coordinate with a probability equal to
their similarity, with concentration like that of independent MinHashes, in time COORDS log COORDS + n.

BANDS bands of ROWS coordinates: sets of similarity 0.85 share no band with probability
(1 - 0.85^6)^21 = 5e-5, of 0.9 with 1.5e-7. All pairs that share one are candidates, except those already
linked through others; candidates are confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, discard, materialize, once, small, small_batches, text_key, without
from .words import mixed, run_hashes, word_hashes

BANDS, ROWS = 21, 6
COORDS = BANDS * ROWS
CHUNK = 32
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted set. A-Z are lower-cased; words are what white space of ASCII parts; fewer than k words make one shingle."""
    words = text.encode().lower().split() if text else []
    hashes = word_hashes(words)
    return np.unique(run_hashes(hashes, min(k, len(words)))) if words else np.zeros(0, _U)


def sketch(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    n, full = len(items), np.iinfo(np.uint64).max
    out = np.full(coords, full, _U)
    rounds, i = max(1, min(coords, round(8 * coords / n))), 0
    while i < coords and (out == full).any():
        r = np.arange(i, min(i + rounds, coords), dtype=_U)[:, None]
        x = mixed(items[None, :] + (r + _U(1)) * _U(_STEP))
        np.minimum.at(out, (((x >> _U(32)) * _U(coords)) >> _U(32)).ravel().astype(np.int64), ((x & _U(0xFFFFFFFFFFFF)) | r << _U(48)).ravel())
        i += rounds
    for b in np.flatnonzero(out == full).tolist():
        x = mixed(items + _U((coords + b + 1) * _STEP % (1 << 64)))
        out[b] = (x & _U(0xFFFFFFFFFFFF)).min() | _U(coords + b) << _U(48)
    return out


def prints(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; with its size they tell sets apart."""
    if not len(items):
        return 0, 0
    a, b = mixed(items ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U), mixed(items ^ _U(0x14057B7EF767814F)).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def band_keys(items: np.ndarray, bands: int, rows: int) -> list[int]:
    s = sketch(items, bands * rows).reshape(bands, rows)
    weight = mixed(np.arange(1, rows + 1, dtype=_U)) | _U(1)
    return mixed((mixed(s) * weight).sum(1, dtype=_U) + np.arange(bands, dtype=_U)).view(np.int64).tolist()


SIGNATURE = "doc_id long, text_key long, n_shingles long, a long, b long, bands array<long>"


def signatures(docs: DataFrame, k: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                sets = [shingles(t, k) for t in batch.column(1)[at : at + 512].to_pylist()]
                ab = [prints(s) for s in sets]
                keys = [band_keys(s, bands, rows) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 512].cast(pa.int64()), batch.column(2)[at : at + 512], pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in ab], pa.int64()), pa.array([x[1] for x in ab], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "a", "b", "bands"])

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(text)).mapInArrow(run, SIGNATURE)


TRIED = "x long, y long, y_a long, y_n long, linked boolean, beyond array<long>, lacks array<long>"


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int, doc_id: str, text: str, max_broadcast_rows: int) -> DataFrame:
    """Tries pairs (x, x_id, x_a, y, y_id, y_a) of classes on their full sets; _id and _a find a document with the set.

    linked: 100 * intersection >= percent * union. `beyond` has the shingles of y that x hasn't, `lacks` those of x that
    y hasn't.

    Pairs are grouped by x in chunks of about CHUNK; a chunk's task gets the text of x once and then
    those of its ys, so however often x occurs no task gathers all of its partners. A node whose text several rows have
    (repeated rows, or an id under which it stands twice) comes in as often, one after the other, and is tried once.
    """
    counts = materialize(pairs.groupBy("x").count().where(F.col("count") > CHUNK).withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).select("x", "chunks"), "hot")
    dealt = materialize(pairs.join(small(counts, max_broadcast_rows), "x", "left").withColumn("chunk", F.pmod(F.xxhash64("y"), F.coalesce("chunks", F.lit(1))).cast("int")).drop("chunks"), "pairs")
    wanted = dealt.select("x", "chunk", F.lit(0).alias("role"), F.col("x").alias("node"), F.col("x_id").alias("id"), F.col("x_a").alias("set_a")).distinct().unionByName(dealt.select("x", "chunk", F.lit(1).alias("role"), F.col("y").alias("node"), F.col("y_id").alias("id"), F.col("y_a").alias("set_a")))
    wanted = materialize(wanted, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, done = None, None, None
        for batch in batches:
            found = []
            for x, chunk, role, y, set_a, t in zip(*(c.to_pylist() for c in batch.columns)):
                if done == (x, chunk, role, y):
                    continue
                items = shingles(t, k)
                if prints(items)[0] != set_a:
                    continue  # another text under the same id
                done = (x, chunk, role, y)
                if role == 0:
                    at, first = (x, chunk), items
                elif at == (x, chunk):
                    beyond, n = np.setdiff1d(items, first, assume_unique=True), len(items)
                    both = n - len(beyond)
                    linked = 100 * both >= percent * (len(first) + len(beyond))
                    lacks = np.setdiff1d(first, items, assume_unique=True)
                    found.append((x, y, set_a, n, linked, beyond.view(np.int64).tolist(), lacks.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 7, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())])], ["x", "y", "y_a", "y_n", "linked", "beyond", "lacks"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(small(wanted, max_broadcast_rows), "id").select("x", "chunk", "role", "node", "set_a", "text")
    out = materialize(rows.repartition("x", "chunk").sortWithinPartitions("x", "chunk", "role", "node").mapInArrow(run, TRIED), "tried")
    for df in (counts, dealt, wanted):
        discard(df)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over links (x, y). Labels spread to neighbours and jump to their labels' labels until none changes."""
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy("x").agg(F.min("component").alias("m"))
        nxt = labels.join(near.withColumnRenamed("x", "id"), "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        nxt = materialize(nxt, "spread")
        up = nxt.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = materialize(nxt.join(up, "component").select("id", F.col("top").alias("component"), (F.col("top") != F.col("was")).alias("moved")), "labels")
        changed = new.where("moved").limit(1).count()
        discard(nxt)
        discard(labels)
        labels = new.drop("moved")
        if not changed:
            return labels


def beyond_leaders(tried: DataFrame, placed: DataFrame, comp: DataFrame, links: DataFrame, percent: int, max_broadcast_rows: int) -> DataFrame:
    """Components with the links between members of one bucket that its leader doesn't show.

    D(y), the shingles that just one of y and the leader L has, tells two members apart as their sets do: with t = percent / 100 and
    s = (1 - t) / (1 + t), y and c are linked if |D(y) ^ D(c)| <= s * (|y| + |c|). At least one of two members of different components
    isn't linked with L; call it y, so |D(y)| > s * (|y| + |L|). A linked c then shares some of D(y), and each of these holds:

        |D(y) - D(c)| <= (|D(y)| + s * (|y| + |L|)) / 2,    |D(c) - D(y)| <= (|D(c)| + s * (|c| - |L|)) / 2
        |y - c| + t * |c - y| <= (1 - t) * |y|,             and the same for c

    What D(y) has and D(c) hasn't is in y - c if it is beyond L and in c - y if y lacks it, so it costs 1 or t of the budget (1 - t) * |y|.
    In any one order of all shingles the first that both share lies where neither bound is used up before it, on either side.
    First come those that only members of one component have: they tell from every member of another component. Then the rarest, so
    that what many members share comes last. Of what y and c each have alone, e, nothing is shared, and of the rest, r, at most as much
    as the one with less of it has, so |D(y) ^ D(c)| >= e(y) + e(c) + |r(y) - r(c)|. That makes two sums, over(y) + under(c) <= 0 and
    under(y) + over(c) <= 0 with over(x) = e(x) + r(x) - s * |x| and under(x) = e(x) - r(x) - s * |x|. They are part of the join by
    (leader, shingle), and a member that is past them with every partner under a shingle doesn't go into it. What meets is tried on
    the whole of both D.
    """
    open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    member = placed.join(open_, "key", "left_semi").where(F.col("node") != F.col("x")).select("x", "x_n", "node", "n", "component").distinct()
    lead = placed.where(F.col("node") == F.col("x")).select("x", F.col("component").alias("x_component")).distinct()
    none = F.array().cast("array<long>")
    told = tried.select("x", F.col("y").alias("node"), F.coalesce("beyond", none).alias("beyond"), F.concat(F.coalesce("beyond", none), F.coalesce("lacks", none)).alias("d"), "linked")
    told = told.withColumn("n_beyond", F.size("beyond")).drop("beyond")
    member = materialize(member.join(lead, "x").join(told, ["x", "node"]).withColumn("m", F.size("d")), "open-members")
    s = F.lit((100 - percent) / (100 + percent))
    # As whole numbers may come out a little low in floating point, a bit is added; longer prefixes are as exact.
    as_c = F.floor((F.col("m") + s * (F.col("n") - F.col("x_n"))) / 2 + 1e-6).cast("int") + 1
    as_y = F.floor((F.col("m") + s * (F.col("n") + F.col("x_n"))) / 2 + 1e-6).cast("int") + 1

    items = member.select("x", "node", "n", "m", "component", "linked", "n_beyond", as_c.alias("as_c"), as_y.alias("as_y"), F.posexplode("d").alias("pos", "item"))
    items = items.withColumn("cost", F.when(F.col("pos") < F.col("n_beyond"), 100).otherwise(percent))
    often = items.groupBy("x", "item").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    often = materialize(often.where("low != high").select("x", "item", "often"), "often")
    # What one component alone has comes first and finds nobody, but takes its places and its cost.
    by = Window.partitionBy("x", "node").orderBy(F.col("often").isNotNull(), "often", "item")
    places = items.join(often, ["x", "item"], "left").withColumn("place", F.row_number().over(by))
    places = places.withColumn("spent", F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cost"))
    alone = F.count_if(F.col("often").isNull()).over(Window.partitionBy("x", "node"))
    share = (100 - percent) * F.col("n")
    places = places.withColumn("over", (100 + percent) * F.col("m") - share).withColumn("under", (100 + percent) * (2 * alone - F.col("m")) - share)
    places = places.where(F.col("often").isNotNull() & (F.col("spent") <= share))
    places = places.withColumn("c", F.col("place") <= F.col("as_c")).withColumn("y", (F.col("place") <= F.col("as_y")) & ~F.col("linked")).where("c or y")
    places = materialize(places.select("x", "item", "node", "component", "over", "under", "c", "y"), "places")
    sums = ("over", "under")
    least = places.groupBy("x", "item").agg(*(F.min(F.when(F.col(side), F.col(k))).alias(f"{side}_{k}") for side in "cy" for k in sums))
    fits = places.join(least, ["x", "item"])
    y = fits.where("y and over + c_under <= 0 and under + c_over <= 0").select("x", "item", F.col("node").alias("y"), *(F.col(k).alias(f"y_{k}") for k in ("component", *sums)))
    c = fits.where("c and over + y_under <= 0 and under + y_over <= 0").select("x", "item", F.col("node").alias("c"), *(F.col(k).alias(f"c_{k}") for k in ("component", *sums)))
    near = y.join(c, ["x", "item"]).where("y != c and y_component != c_component and y_over + c_under <= 0 and y_under + c_over <= 0")
    near = materialize(near.select("x", "y", "c").distinct(), "near")
    d = member.select("x", "node", "n", "m", "d")
    both = near.join(d.toDF("x", "y", "y_n", "y_m", "y_d"), ["x", "y"]).join(d.toDF("x", "c", "c_n", "c_m", "c_d"), ["x", "c"])
    apart = F.col("y_m") + F.col("c_m") - 2 * F.size(F.array_intersect("y_d", "c_d"))
    more = materialize(both.where((100 + percent) * apart <= (100 - percent) * (F.col("y_n") + F.col("c_n"))).select(F.col("y").alias("x"), F.col("c").alias("y")).distinct(), "more-links")
    if more.limit(1).count():
        comp = components(links.unionByName(more)).withColumnRenamed("id", "node")
    for df in (member, often, places, near):
        discard(df)
    return comp


def near_dup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, max_broadcast_rows: int = MAX_BROADCAST_ROWS, keyed: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept, with keyed its text_key.

    1. Documents with the same set form a class, found by its least doc_id; only classes are compared. Each has a number
       (node) of its own, since several sets may have the same least doc_id.
    2. In each bucket (band and key) every member is tried on its full set with its leader, the member whose buckets are
       the largest and so most likely the text that the others come from. Links make components.
    3. Members of buckets that still hold several components are joined by what tells them from their leader, see
       beyond_leaders(); pairs within one component can change nothing and aren't tested.

    Texts that are null or have no word have no shingle, are linked with nothing and stay. A row without
    doc_id takes part only through an equal set: it gets that class's component, or null, and stays if null.
    Every row of a repeated doc_id is judged by its own text. An empty table gives no rows; other columns
    aren't read.
    """
    sig = materialize(signatures(docs, k, bands, rows, doc_id, text), "signatures")
    classes = materialize(sig.where("n_shingles > 0").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = classes.where("id is not null").select(F.explode("bands").alias("key"), "node", "id", "a", F.col("n_shingles").alias("n"))
    sizes = materialize(buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    live = materialize(buckets.join(sizes, "key"), "buckets")
    weights = materialize(live.groupBy("node").agg(F.sum("m").alias("w")), "weights")
    heads = live.join(small(weights, max_broadcast_rows), "node").groupBy("key").agg(F.max_by(F.struct("node", "id", "a", "n"), F.struct("w", -F.col("id"), "a")).alias("l"))
    heads = materialize(heads.select("key", F.col("l.node").alias("x"), F.col("l.id").alias("x_id"), F.col("l.a").alias("x_a"), F.col("l.n").alias("x_n")), "heads")
    live = materialize(live.select("key", "node", "id", "a", "n").join(heads, "key"), "members")
    pairs = materialize(live.where(F.col("node") != F.col("x")).select("x", "x_id", "x_a", F.col("node").alias("y"), F.col("id").alias("y_id"), F.col("a").alias("y_a")).distinct(), "stars")
    tried = confirmed(docs, pairs, k, percent, doc_id, text, max_broadcast_rows)
    links = tried.where("linked").select("x", "y")
    comp = components(links).withColumnRenamed("id", "node")

    placed = materialize(live.select("key", "x", "x_n", "node", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    comp = beyond_leaders(tried, placed, comp, links, percent, max_broadcast_rows)
    for df in (sizes, live, heads, weights, pairs, placed):
        discard(df)

    linked = materialize(classes.drop("bands").join(comp, "node", "left").where("copies > 1 or component is not null"), "linked")
    least = linked.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    labels = materialize(linked.join(least, "component", "left").select("a", "b", "n_shingles", F.coalesce("least", "id").alias("component_id")), "classes-labels")
    own = ["text_key"] if keyed else []
    return sig.select("doc_id", *own, "n_shingles", "a", "b").join(labels, ["a", "b", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"), *own
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id; all columns stay. Of rows that repeat an id with the same text (of at least a word) one stays.

    At similarity 0.8, 25 bands of 5 miss a pair with probability (1 - 0.8^5)^25 = 5e-5.
    """
    told = materialize(near_dup(docs, doc_id, text, percent=percent, bands=bands, rows=rows, keyed=True), "near-told")
    again = told.where("kept and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1")
    return once(without(docs, told.where("not kept"), "near-gone", doc_id, text), again, "near-once", doc_id, text)
