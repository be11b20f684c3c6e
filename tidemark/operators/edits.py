"""Plans of edits over the words of a clip: what to mute, and which filler words to cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J
from . import windows as W


def word(text: Column) -> Column:
    """A word as lists have it: lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_]", "")


def mutes(words: DataFrame, plans: DataFrame, terms: tuple[str, ...], pad: float = 0.08) -> DataFrame:
    """Ranges (key, m_start, m_end) of output time to mute: listed words, padded, cut to the plan, overlapping ones merged.

    words: key, id, w_start, w_end, text. plans: key, p_start, p_end, the part of the recording that is put out.
    """
    said = words.where(word(F.col("text")).isin(*terms)).join(plans, "key").where((F.col("w_end") + pad > F.col("p_start")) & (F.col("w_start") - pad < F.col("p_end")))
    cut = said.select("key", "id", (F.greatest(F.col("w_start") - pad, "p_start") - F.col("p_start")).alias("a"), (F.least(F.col("w_end") + pad, "p_end") - F.col("p_start")).alias("b"))
    return W.overlap_clusters(cut, ["key"], "a", "b", "id").groupBy("key", "cluster").agg(F.min("a").alias("m_start"), F.max("b").alias("m_end")).drop("cluster")


def filler_cuts(words: DataFrame, plans: DataFrame, terms: tuple[str, ...], roles: tuple[str, ...], least: float = 0.12, gap: float = 0.35, most_share: float = 0.25, width: float = 5.0) -> DataFrame:
    """Every listed word (key, id) with what becomes of it: role, short, overlap (others talk then), share (the plan would take too much), or cut.

    words: key, id, w_start, w_end, role, text. plans: key, duration. Cuts no more than `gap` apart become one, and if all of a clip's are over
    most_share of its duration none is made, since then the list is wrong.
    """
    listed = words.where(word(F.col("text")).isin(*terms))
    sure = listed.where(F.col("role").isin(*roles) & (F.round(F.col("w_end") - F.col("w_start"), 9) >= least))
    others = words.select("key", F.col("role").alias("o_role"), F.col("w_start").alias("o_start"), F.col("w_end").alias("o_end"))
    hit = J.overlapping(sure, others, "key", "w_start", "w_end", "o_start", "o_end", width).where((F.col("role") != F.col("o_role")) & (F.col("o_start") < F.col("w_end") - 1e-9) & (F.col("w_start") < F.col("o_end") - 1e-9))
    state = F.when(~F.col("role").isin(*roles), "role").when(F.round(F.col("w_end") - F.col("w_start"), 9) < least, "short").when(F.col("talked_over"), "overlap").otherwise("cut")
    out = listed.join(hit.select("key", "id").distinct().withColumn("talked_over", F.lit(True)), ["key", "id"], "left").withColumn("state", state)
    order = Window.partitionBy("key").orderBy("w_start", "w_end", "id")
    kept = out.where("state = 'cut'").withColumn("_before", F.max("w_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # What a word adds: itself beyond those before it, and the pause before it if that goes too.
    added = F.greatest(F.col("w_end") - F.col("_before"), F.lit(0.0)) - F.when(F.col("w_start") - F.col("_before") > gap, F.col("w_start") - F.col("_before")).otherwise(0.0)
    taken = kept.groupBy("key").agg(F.sum(F.when(F.col("_before").isNull(), F.col("w_end") - F.col("w_start")).otherwise(added)).alias("taken")).join(plans, "key")
    over = taken.select("key", (F.round("taken", 9) > F.round(F.col("duration") * most_share, 9)).alias("over"))
    return out.join(over, "key", "left").select("key", "id", F.when((F.col("state") == "cut") & F.coalesce("over", F.lit(False)), "share").otherwise(F.col("state")).alias("state"))
