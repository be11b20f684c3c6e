"""Search, ranking, sections, approved moments, boundaries and tilings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def top_k(vectors: DataFrame, query: list[float], k: int, vec: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """(tie, score) of the k nearest by cosine of unit vectors, ranked by the score rounded to five places, then by id; the score itself isn't rounded.

    Every batch of vectors is one product with the query and passes on its own k best only. Null vectors aren't ranked.
    """
    q = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            score = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64) @ q if len(rows) else np.zeros(0)
            best = np.lexsort((ids.to_numpy(zero_copy_only=False), -np.round(score, 5)))[:k]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best)), pa.array(score[best])], [tie, "score"])

    kind = dict(vectors.dtypes)[tie]
    best = vectors.where(F.col(vec).isNotNull()).select(tie, vec).mapInArrow(run, f"{tie} {kind}, score double")
    return best.orderBy(F.desc(F.bround("score", 5)), tie).limit(k)


def default_model(models: DataFrame, configured: str) -> DataFrame:
    """The configured model if it is there, else the first by name; no row without any."""
    return models.select("model").distinct().agg(F.coalesce(F.max(F.when(F.col("model") == configured, F.col("model"))), F.min("model")).alias("model")).where("model is not null")


def sections(df: DataFrame, top: int) -> DataFrame:
    """Four disjoint sections of each recording: the `top` by combined score, then those a marker anchors, then by which score is larger; with the order within."""
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("score"), "t_peak", "id"))
    part = F.when(F.col("_r") <= top, "combined").when(F.col("anchored"), "markers").when(F.col("e") >= F.col("g"), "entertainment").otherwise("gameplay")
    key = F.when(F.col("section") == "markers", F.col("t_peak")).when(F.col("section") == "entertainment", -F.col("e")).when(F.col("section") == "gameplay", -F.col("g")).otherwise(-F.col("score"))
    out = df.withColumn("_r", rank).withColumn("section", part).withColumn("_k", key)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("recording_id", "section").orderBy("_k", "id"))).drop("_r", "_k")


def approved(rated: DataFrame, least: int) -> DataFrame:
    """One row for each moment (cluster of overlapping rated windows of any generation) whose latest rating is at least `least`.

    Its bounds are those of the rows rated that well, adjusted ones alone if there are any; rescued: none of them is current.
    """
    c = W.overlap_clusters(rated, ["recording_id"], "t_start", "t_end", "id")
    good = F.col("rating") >= least
    fit = lambda f, x: F.coalesce(f(F.when(good & F.col("adjusted"), x)), f(F.when(good, x)))
    out = c.groupBy("recording_id", "cluster").agg(
        F.max_by("rating", F.struct("rated_at", "id")).alias("verdict"), fit(F.min, F.col("t_start")).alias("t_start"), fit(F.max, F.col("t_end")).alias("t_end"), (~F.coalesce(F.bool_or(F.when(good, F.col("is_current"))), F.lit(False))).alias("rescued")
    )
    return out.where(F.col("verdict") >= least)


def first_seen(df: DataFrame, name: str, place: str, limit: int) -> DataFrame:
    """Names once each, whatever their case, in the order of first sight."""
    return df.groupBy(F.lower(name).alias("_k")).agg(F.min_by(name, place).alias(name), F.min(place).alias(place)).drop("_k").orderBy(place).limit(limit)


def tiling(bounds: DataFrame, duration: DataFrame) -> DataFrame:
    """Chapters [t_start, t_end) that cover each recording from 0 to its duration, opened by 0 and every boundary inside."""
    inner = bounds.join(duration, "recording_id").where((F.col("t") > 0) & (F.col("t") < F.col("duration"))).select("recording_id", "t")
    opens = inner.unionByName(duration.select("recording_id", F.lit(0.0).alias("t"))).distinct()
    w = Window.partitionBy("recording_id").orderBy("t")
    out = opens.join(duration, "recording_id").withColumn("t_end", F.coalesce(F.lead("t").over(w), F.col("duration")))
    return out.select("recording_id", (F.row_number().over(w) - 1).alias("chapter"), F.col("t").alias("t_start"), "t_end")


def greedy(df: DataFrame, key: str, t: str, accept: Callable, apart: Column) -> DataFrame:
    """Rows (key, t) that are accepted in order: the first of a key, and each t for which accept(t, the last accepted one).

    `apart` tells from t and the t before it that t is accepted whatever came before; there a key is cut, so that a busy key is many small
    runs. A run is read in order with only its last accepted time held; nothing is gathered.
    """
    w = W.ordered([key], t)
    cut = df.select(key, t).withColumn("_run", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for rows in batches:
            keep = np.zeros(len(rows), bool)
            for k, (name, n, x) in enumerate(zip(rows[key], rows["_run"], rows[t])):
                if at != (name, n) or accept(x, last):
                    at, last, keep[k] = (name, n), x, True
            yield rows.loc[keep, [key, t]]

    schema = ", ".join(f"{c} {kind}" for c, kind in df.select(key, t).dtypes)
    return cut.repartition(key, "_run").sortWithinPartitions(key, "_run", t).mapInPandas(run, schema)


def anchored_clusters(df: DataFrame, within: float) -> DataFrame:
    """Boundaries (recording_id, t) that lie within `within` of the first of their cluster, not of one another, become one at that first time."""
    before = F.lag("t").over(W.ordered(["recording_id"], "t"))
    return greedy(df, "recording_id", "t", lambda t, last: t - last > within, F.col("t") - before > within)


def embedding_shift(vectors: DataFrame, key: str, order: str, vec: str, side: int) -> DataFrame:
    """At each gap with `side` vectors on both sides: 1 less the cosine of the two sides' centroids. Rows of 2 * side neighbours go to numpy in batches."""
    w = W.ordered([key], order)
    near = [F.lead(vec, k).over(w) if k > 0 else F.lag(vec, -k).over(w) if k < 0 else F.col(vec) for k in range(1 - side, side + 1)]

    def depth(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for some in cols:
            if not len(some[0]):
                yield pd.Series([], dtype="float64")
                continue
            a, b = (sum(np.stack(c.to_numpy()).astype(np.float64) for c in part) for part in (some[side:], some[:side]))
            size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            yield pd.Series(np.where(size > 0, 1 - (a * b).sum(1) / np.where(size > 0, size, 1), 1.0))

    names = [f"_v{k}" for k in range(2 * side)]
    x = vectors.select("*", *(c.alias(n) for c, n in zip(near, names))).where(F.col(names[0]).isNotNull() & F.col(names[-1]).isNotNull())
    return x.withColumn("depth", F.pandas_udf(depth, "double")(*names)).drop(*names)


def scored_moments(moments: DataFrame, scores: DataFrame, first: str, second: str, alpha: float = 0.5) -> DataFrame:
    """Moments (recording_id, id, i) with both profiles' values (scores: recording_id, i and two columns) at their peak i, and their score.

    Each profile's values count as shares of its largest over the recording's moments (negative as 0); the score is high only where both are.
    """
    out = moments.join(scores.select("recording_id", "i", first, second), ["recording_id", "i"], "left")
    all_ = Window.partitionBy("recording_id")

    def share(c: str) -> Column:
        x = F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
        return F.when(F.max(x).over(all_) > 1e-12, x / F.max(x).over(all_)).otherwise(0.0)

    out = out.withColumn("_e", share(first)).withColumn("_g", share(second))
    return out.withColumn("score", F.pow("_e", F.lit(alpha)) * F.pow("_g", F.lit(1 - alpha)) * (F.col("_e") + F.col("_g"))).drop("_e", "_g")


def input_reasons(recordings: DataFrame, inputs: dict[str, tuple[DataFrame, DataFrame]], never: tuple[str, ...] = ()) -> DataFrame:
    """(recording_id, input, n, reason) of every recording and input: how many boundaries inside the recording it gave, and why if none.

    inputs: name to (rows that it could use, boundaries that it made), both with recording_id, the second with t. `never`: inputs that nothing produces.
    """
    base = recordings.select("recording_id", "duration")
    out = []
    for name, (data, found) in inputs.items():
        there = data.select("recording_id").distinct().withColumn("there", F.lit(True))
        inside = found.join(base, "recording_id").where((F.col("t") > 0) & (F.col("t") < F.col("duration"))).groupBy("recording_id").agg(F.count("*").alias("n"))
        reason = F.when(F.col("there").isNull(), "no data").when(F.col("n").isNull(), "no boundary met the threshold")
        out.append(base.join(there, "recording_id", "left").join(inside, "recording_id", "left").select("recording_id", F.lit(name).alias("input"), F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason")))
    out += [base.select("recording_id", F.lit(name).alias("input"), F.lit(0).cast("long").alias("n"), F.lit("nothing produces it").alias("reason")) for name in never]
    return reduce(DataFrame.unionByName, out)


def emerging(grams: DataFrame, recordings: DataFrame, early: int, late: int, least: int) -> DataFrame:
    """(gram, n_late, emerging) of grams (recording_id, gram) that the last `late` recordings have: emerging if at least `least` of them have it and none of the first `early`.

    recordings: recording_id, in the order of which first and last are told; only those few are looked at.
    """
    first = recordings.select("recording_id").orderBy("recording_id").limit(early).select("recording_id", F.lit(1).alias("early"), F.lit(0).alias("late"))
    last = recordings.select("recording_id").orderBy(F.desc("recording_id")).limit(late).select("recording_id", F.lit(0).alias("early"), F.lit(1).alias("late"))
    seen = grams.join(first.unionByName(last), "recording_id").distinct().groupBy("gram").agg(F.sum("early").alias("n_early"), F.sum("late").alias("n_late"))
    return seen.where("n_late > 0").select("gram", "n_late", ((F.col("n_early") == 0) & (F.col("n_late") >= least)).alias("emerging"))
