"""What stores do when rows come again: upserts, refreshes by source, generations, retention, manifests."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import best_overlap


def blob(vector: Column) -> Column:
    """Little-endian 32-bit floats, as vectors are stored."""

    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(pack, "binary")(vector)


def decoded(stored: Column, dim: int) -> Column:
    """The vector of a blob of just `dim` floats; null for any other."""

    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) == 4 * dim else None)

    return F.pandas_udf(unpack, "array<float>")(stored)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def refresh(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of a key that new has at all go; new's come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def next_generation(candidates: DataFrame, ratings: DataFrame, config: str) -> DataFrame:
    """By recording: the generation that a scoring under `config` writes.

    A new one if the current one was made under another config or an operator rated any of it, else the same again.
    """
    now = candidates.where("is_current").groupBy("recording_id").agg(F.max("generation").alias("current"), F.max("config_version").alias("config"))
    rated = candidates.where("is_current").join(ratings.where("source = 'operator'"), "id", "left_semi").select("recording_id").distinct().withColumn("rated", F.lit(True))
    last = candidates.groupBy("recording_id").agg(F.max("generation").alias("last"))
    out = last.join(now, "recording_id", "left").join(rated, "recording_id", "left")
    fresh = F.col("current").isNull() | (F.col("config") != config) | F.coalesce("rated", F.lit(False))
    return out.select("recording_id", F.when(fresh, F.col("last") + 1).otherwise(F.col("current")).alias("generation"), fresh.alias("fresh"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows by table."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("name"), F.lit(1).alias("_")).groupBy("name").agg(F.count("*").alias("n_rows")) for name, df in sorted(tables.items())])


def verified(expected: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """What manifest() says against what is there: name, expected and found rows (null where one side lacks the name), ok."""
    both = expected.select("name", F.col("n_rows").alias("expected")).join(manifest(tables).select("name", F.col("n_rows").alias("found")), "name", "full")
    return both.withColumn("ok", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))


def retained(backups: DataFrame, day: str, daily: int, months: int) -> DataFrame:
    """The newest `daily` (one at least) backups by day, and of older ones the newest of each of the last `months` months. Both are top-k reports; no window sees all backups."""
    newest = backups.select(day).distinct().orderBy(F.desc(day)).limit(max(1, daily))
    by_month = backups.groupBy(F.date_format(day, "yyyy-MM").alias("_month")).agg(F.max(day).alias(day)).orderBy(F.desc("_month")).limit(months).select(day)
    return backups.join(newest.unionByName(by_month).distinct(), day, "left_semi")


def carried(new: DataFrame, old: DataFrame, width: float) -> DataFrame:
    """Ratings of new windows: their own, else, as inherited, that of the old window that overlaps them best (IoU 0.5 or more).

    new: recording_id, id, t_start, t_end, rating, source. old: recording_id, old_id, old_start, old_end, old_rating; only rated ones can pass anything on.
    """
    best = best_overlap(new.select("recording_id", "id", "t_start", "t_end"), old.where("old_rating is not null"), "recording_id", width).select("recording_id", "id", "old_id", "old_rating")
    out = new.join(best, ["recording_id", "id"], "left")
    own = F.col("rating").isNotNull()
    return out.select("recording_id", "id", F.coalesce("rating", "old_rating").alias("rating"), F.when(own, F.col("source")).when(F.col("old_rating").isNotNull(), "inherited").alias("source"), F.when(~own, F.col("old_id")).alias("from_id"))


def layered(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Settings by leaf (keys, layer, value): the last layer that has a value wins, and the layer it came from is told. A null is no value."""
    known = leaves.where("value is not null")
    return known.groupBy(*keys).agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def params_hash(params: Column) -> Column:
    """SHA-256 of flat JSON settings in one canonical form: keys in order, numbers alike however they are written, the rest as it is. Null for what is no JSON object."""
    entries = F.array_sort(F.map_entries(F.from_json(params, "map<string,string>")))
    number = lambda v: F.regexp_replace(F.regexp_replace(v.try_cast("decimal(38,9)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(number(e["value"]), e["value"], F.lit("null")))), ";"), 256)


def merged_passes(passes: list[DataFrame]) -> DataFrame:
    """Segments of all passes (repeats stay), numbered by recording from 0 in order of start, end and track."""
    all_ = reduce(DataFrame.unionByName, passes)
    w = Window.partitionBy("recording_id").orderBy("t_start", "t_end", "track", "text")
    return all_.withColumn("seq", F.row_number().over(w) - 1)
