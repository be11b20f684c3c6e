"""Captions from timed words: groups that end at pauses, sentences and a size, the last one not too short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A sentence's end, whatever quotes and brackets close behind it.
ENDED = r"[.!?…][\s\"'”’)\]]*$"


def caption_groups(words: DataFrame, keys: list[str], order: str, text: str, start: str, end: str, size: int = 4, least: int = 3, pause: float = 1.2) -> DataFrame:
    """Adds place, the caption (from 0) of each word of its key.

    A caption ends before a pause of more than `pause` seconds, after a sentence, and at `size` words. If a key's last caption has fewer than `least` (or size) words, it takes words from the one
    before as long as that keeps `least`; where both together have fewer than twice `least`, they become one.
    """
    least = max(1, min(least, size))
    by = Window.partitionBy(*keys)
    w = by.orderBy(order)
    new = (F.col(start) - F.lag(end).over(w) > pause) | F.regexp_like(F.lag(text).over(w), F.lit(ENDED))
    out = words.withColumn("_run", F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order)) - 1) / size))
    out = out.withColumn("_g", F.dense_rank().over(by.orderBy("_run", "_chunk")) - 1).withColumn("_top", F.max("_g").over(by))
    group = Window.partitionBy(*keys, "_g")
    out = out.withColumn("_n", F.row_number().over(group.orderBy(order))).withColumn("_size", F.count("*").over(group))
    last, before = (F.max(F.when(F.col("_g") == F.col("_top") - k, F.col("_size"))).over(by) for k in (0, 1))
    out = out.withColumn("_last", last).withColumn("_before", before)
    short = (F.col("_top") > 0) & (F.col("_last") < least)
    joined = short & (F.col("_last") + F.col("_before") < 2 * least)
    moved = F.least(least - F.col("_last"), F.col("_before") - least)
    place = (
        F.when(joined & (F.col("_g") == F.col("_top")), F.col("_g") - 1)
        .when(short & ~joined & (F.col("_g") == F.col("_top") - 1) & (F.col("_n") > F.col("_before") - moved), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    return out.withColumn("place", place.cast("long")).drop("_run", "_chunk", "_g", "_top", "_n", "_size", "_last", "_before")


def caption_lines(grouped: DataFrame, keys: list[str], order: str, start: str, end: str, least_s: float) -> DataFrame:
    """Adds from_cs and to_cs, the hundredths of a second in which each word of a caption is the one marked: to where the next begins, or the caption's last word ends. Edges are rounded once for both
    sides and never go back; a word that would be marked for less than least_s isn't (both null)."""
    group = Window.partitionBy(*keys, "place").orderBy(order)
    edge = F.max(F.bround(F.col(start) * 100)).over(group.rowsBetween(Window.unboundedPreceding, 0))
    out = grouped.withColumn("_edge", edge).withColumn("_next", F.coalesce(F.lead("_edge").over(group), F.greatest("_edge", F.bround(F.col(end) * 100))))
    seen = F.col("_next") - F.col("_edge") >= F.bround(F.lit(least_s * 100))
    return out.withColumn("from_cs", F.when(seen, F.col("_edge").cast("long"))).withColumn("to_cs", F.when(seen, F.col("_next").cast("long"))).drop("_edge", "_next")
