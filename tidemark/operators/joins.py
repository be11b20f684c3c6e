"""Interval and nearest-neighbour joins as equi-joins on buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_in(points: DataFrame, spans: DataFrame, key: str, t: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of a point and a span of the same key with start <= t <= end.

    A span goes to every bucket of `width` that it touches and a point to its own, so the join is by
    (key, bucket); width should be near the usual span.
    """
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [key, "_b"]).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("_b")


def overlapping(a: DataFrame, b: DataFrame, key: str, sa: str, ea: str, sb: str, eb: str, width: float) -> DataFrame:
    """Pairs of spans of the same key that overlap or touch; spans that end before they start overlap nothing. A pair is formed in the first bucket that both touch, once."""
    a, b = a.where(F.col(ea) >= F.col(sa)), b.where(F.col(eb) >= F.col(sb))
    x = a.withColumn("_b", F.explode(F.sequence(F.floor(F.col(sa) / width), F.floor(F.col(ea) / width))))
    y = b.withColumn("_b", F.explode(F.sequence(F.floor(F.col(sb) / width), F.floor(F.col(eb) / width))))
    first = F.col("_b") == F.greatest(F.floor(F.col(sa) / width), F.floor(F.col(sb) / width))
    return x.join(y, [key, "_b"]).where(first & (F.col(sa) <= F.col(eb)) & (F.col(sb) <= F.col(ea))).drop("_b")


def _shares(df: DataFrame, sizes: DataFrame, on: list[str], most: int, crowded: int) -> DataFrame:
    """df with _k, in how many shares of about `most` its key `on` is dealt; `sizes` has _n by key, of which at most `crowded` are over `most`."""
    if not crowded:
        return df.withColumn("_k", F.lit(1).cast("long"))
    over = sizes.where(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).alias("_k"))
    return df.join(F.broadcast(over) if crowded <= 1_000_000 else over, on, "left").withColumn("_k", F.coalesce("_k", F.lit(1).cast("long")))


def overlapping_boxes(boxes: DataFrame, group: str, id: str, x: str, y: str, w: str, h: str, width: int, block: int = 512, parts: int = 96, each: int = 200_000_000) -> DataFrame:
    """(id, other, area): pairs id < other of boxes of one group whose insides overlap.

    Equal boxes are one class, with their ids in blocks. Blocks meet by group and bucket of both axes, in the first bucket that both touch, and only pairs
    that overlap are written out: beyond the result itself, the work grows with the pairs of different boxes. A bucket of more than 8 blocks' ids is dealt
    into shares, and each two shares meet in a cell of their own; cells go to `parts` tasks or more, so that one has about `each` pairs to try. Spark holds
    all rows that come of one row of the left side, so that side has 4 ids a row.
    """
    key, box, wide = [group, "_bx", "_by"], [x, y, w, h], 8 * block
    boxes = boxes.select(group, id, *box).where((F.col(w) >= 0) & (F.col(h) >= 0) & F.col(group).isNotNull())
    touched = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / width), F.floor((F.col(at) + F.col(size)) / width)))
    placed = lambda df: df.withColumn("_bx", touched(x, w)).withColumn("_by", touched(y, h))
    classes = boxes.groupBy(group, *box).agg(F.count("*").alias("_n"))
    buckets = placed(classes).groupBy(*key).agg(F.sum("_n").alias("_n"), F.count_if(F.col("_n") > block).alias("_large"))
    n = F.col("_n").cast("double")
    work, large, crowded = buckets.agg(F.sum(n * n + 1000 * n), F.sum("_large"), F.count_if(F.col("_n") > wide)).first()
    parts = max(parts, int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((work or 0) // each) + 1)
    blocks = _shares(boxes, classes, [group, *box], block, large).groupBy(group, *box, F.pmod(F.xxhash64(id), "_k").alias("_n")).agg(F.sort_array(F.collect_list(id)).alias("ids"))
    blocks = _shares(placed(blocks), buckets, key, wide, crowded).withColumn("_own", F.pmod(F.xxhash64(*box, "_n"), "_k"))
    cell, each_share = [*key, "_i", "_j"], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    side = lambda s, i, j: blocks.select(*key, i.alias("_i"), j.alias("_j"), *[F.col(c).alias(s + c) for c in (*box, "_n", "ids")]).repartition(parts, *cell)
    left, right = side("a_", F.col("_own"), each_share), side("b_", each_share, F.col("_own"))
    left = left.withColumn("a_ids", F.explode(F.expr("transform(sequence(1, size(a_ids), 4), i -> slice(a_ids, i, 4))")))
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    low = lambda at: F.greatest(a(at), b(at))
    over = lambda at, size: F.least(a(at) + a(size), b(at) + b(size)) - low(at)
    cross = (a(x) < b(x) + b(w)) & (b(x) < a(x) + a(w)) & (a(y) < b(y) + b(h)) & (b(y) < a(y) + a(h))
    first = (F.col("_bx") == F.floor(low(x) / width)) & (F.col("_by") == F.floor(low(y) / width))
    which = lambda of: F.struct(*[of(c) for c in (*box, "_n")])
    met = left.join(right.hint("shuffle_hash"), cell).where(cross & first & (which(a) <= which(b)))
    pairs = met.select((which(a) == which(b)).alias("_same"), (over(x, w) * over(y, h)).alias("area"), F.explode("a_ids").alias("_a"), "b_ids").select("_same", "area", "_a", F.explode("b_ids").alias("_b"))
    # Blocks meet once, and a block meets itself with every pair twice.
    return pairs.where(~F.col("_same") | (F.col("_a") < F.col("_b"))).where("_a != _b").select(F.least("_a", "_b").alias("id"), F.greatest("_a", "_b").alias("other"), "area")


def dealt(df: DataFrame, keys: list[str], rows: int, each: int = 250_000) -> DataFrame:
    """df by keys in so many parts that of `rows` rows about `each` come to one: what a task sorts doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // each), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def iou(sa: Column, ea: Column, sb: Column, eb: Column) -> Column:
    """Overlap by hull."""
    return F.greatest(F.least(ea, eb) - F.greatest(sa, sb), F.lit(0.0)) / (F.greatest(ea, eb) - F.least(sa, sb))


def best_overlap(new: DataFrame, old: DataFrame, key: str, width: float, least: float = 0.5) -> DataFrame:
    """Of the old windows of the key, the one with the largest IoU for each new one, from `least` on; ties go to the lower old id."""
    both = overlapping(new, old, key, "t_start", "t_end", "old_start", "old_end", width)
    both = both.withColumn("iou", iou(F.col("t_start"), F.col("t_end"), F.col("old_start"), F.col("old_end")))
    w = Window.partitionBy(key, "id").orderBy(F.desc("iou"), "old_id")
    return both.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("iou") >= least)).drop("_n")


def nearest(points: DataFrame, marks: DataFrame, key: str, t: str, mark: str, tie: str) -> DataFrame:
    """Adds `before` and `after`: the marks of the key next to t on either side, t itself included. One sort, no pairs."""
    m = marks.select(key, F.col(mark).alias("_t"), F.col(mark).alias("_m"), F.lit(0).alias("_k"))
    p = points.withColumn("_t", F.col(t)).withColumn("_k", F.lit(1)).withColumn("_m", F.lit(None).cast("double"))
    all_ = p.unionByName(m, allowMissingColumns=True)
    down = Window.partitionBy(key).orderBy("_t", "_k", tie).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(key).orderBy(F.desc("_t"), "_k", tie).rowsBetween(Window.unboundedPreceding, 0)
    return all_.withColumn("before", F.last("_m", ignorenulls=True).over(down)).withColumn("after", F.last("_m", ignorenulls=True).over(up)).where("_k = 1").drop("_t", "_m", "_k")


def snapped(t: Column, before: Column, after: Column, leash: float, backward: bool) -> Column:
    """The nearer side's mark within the leash, else the other side's, else t."""
    back, ahead = F.when(t - before <= leash, before), F.when(after - t <= leash, after)
    return F.coalesce(*((back, ahead) if backward else (ahead, back)), t)


def snapped_spans(spans: DataFrame, starts: DataFrame, ends: DataFrame, key: str, leash: float, least: float, most: float, duration: str) -> DataFrame:
    """Adds s_start and s_end: spans (key, id, t_start, t_end, duration) opened at a mark of starts (key, m) and closed at one of ends.

    Opening prefers the last mark at or before, closing the first at or after, each within the leash, else the nearest on the other side. A span that would leave
    [0, duration] or [least, most] stays as it was.
    """
    out = nearest(spans, starts, key, "t_start", "m", "id").withColumn("s_start", snapped(F.col("t_start"), F.col("before"), F.col("after"), leash, True)).drop("before", "after")
    out = nearest(out, ends, key, "t_end", "m", "id").withColumn("s_end", snapped(F.col("t_end"), F.col("before"), F.col("after"), leash, False)).drop("before", "after")
    fits = (F.col("s_start") >= 0) & (F.col("s_end") <= F.col(duration)) & (F.col("s_end") - F.col("s_start")).between(least, most)
    return out.withColumns({"s_start": F.when(fits, F.col("s_start")).otherwise(F.col("t_start")), "s_end": F.when(fits, F.col("s_end")).otherwise(F.col("t_end"))})


def clamped(start: Column, end: Column, peak: Column, least: float, most: float, duration: Column) -> tuple[Column, Column]:
    """Windows under `least` grown about their middle, those over `most` cut to `most` about the peak, both slid inside [0, duration] and holding the peak."""
    size, zero = end - start, F.lit(0.0)
    lack = F.greatest(F.lit(least) - size, zero) / 2
    a, b = F.when(size > most, peak - most / 2).otherwise(start - lack), F.when(size > most, peak + most / 2).otherwise(end + lack)
    a, b = F.greatest(a, zero), b + F.greatest(-a, zero)
    a, b = F.greatest(a - F.greatest(b - duration, zero), zero), F.least(b, duration)
    return F.least(a, peak), F.greatest(b, peak)


def resample(samples: DataFrame, grid: DataFrame, key: str, rate: float, last_index: str) -> DataFrame:
    """Linear values of samples (key, i, value; sample i at i / rate) at grid points (key, g, t), ends held.

    Where the nearest sample (halves to even) is missing the result is null; so it is where all are. `last_index` is
    the grid's column with its key's last sample index. Uniform sampling makes this an equi-join.
    """
    known = samples.where("value is not null").select(key, "i", "value")
    x = F.least(F.greatest(F.col("t") * rate, F.lit(0.0)), F.col(last_index).cast("double"))
    g = grid.withColumn("_x", x).withColumn("_near", F.bround("_x").cast("long"))
    near = samples.select(key, F.col("i").alias("_near"), F.col("value").alias("_v"))
    g = g.join(near, [key, "_near"], "left")
    marks = known.select(key, F.col("i").cast("double").alias("_t"), F.col("value").alias("_mv"))
    all_ = g.withColumn("_t", F.col("_x")).withColumn("_k", F.lit(1)).withColumn("_mv", F.lit(None).cast("double")).unionByName(marks.withColumn("_k", F.lit(0)), allowMissingColumns=True)
    point = F.when(F.col("_k") == 0, F.struct(F.col("_t").alias("t"), F.col("_mv").alias("v")))
    down = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(key).orderBy(F.desc("_t"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = all_.withColumn("_p", point).withColumn("_a", F.last("_p", ignorenulls=True).over(down)).withColumn("_c", F.last("_p", ignorenulls=True).over(up)).where("_k = 1")
    a, c, x = F.col("_a"), F.col("_c"), F.col("_x")
    line = F.when(a.isNull(), c["v"]).when(c.isNull() | (c["t"] <= a["t"]), a["v"]).otherwise(a["v"] + (c["v"] - a["v"]) * (x - a["t"]) / F.nullif(c["t"] - a["t"], F.lit(0.0)))
    return out.withColumn("value", F.when(F.col("_v").isNotNull(), line)).drop("_x", "_near", "_v", "_t", "_k", "_mv", "_p", "_a", "_c")
