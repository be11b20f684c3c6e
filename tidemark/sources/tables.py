"""Views of the driver's tables in the shapes that the operators take.

recordings    recording_id, duration               one for each user of `events`
points     recording_id, event_id, us, t, kind, value, props   its events; t in seconds from its first
series     recording_id, kind, i, t, value      mean value by kind in buckets of STEP seconds; a bucket without events is null
segments   recording_id, seq, t_start, t_end, speaker, text    turns of `conversations`, ten seconds each
windows    recording_id, id, t_start, t_end, t_peak, score     an hour around each purchase
ratings    id, rating, source                what `labels` says of the document with the window's number
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = 43_200
KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rel = us - F.min(us).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "event_id", rel.alias("us"), (rel / F.lit(1e6)).alias("t"), F.col("event_type").alias("kind"), "value", "props")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("recording_id")).agg(((F.max(us) - F.min(us)) / F.lit(1e6)).alias("duration"), F.count("*").alias("n_events"))


def grid(of: DataFrame, step: float = STEP) -> DataFrame:
    """floor(duration / step) + 1 points of each recording; a duration that isn't positive is an error."""
    ok = F.when(F.col("duration") >= 0, F.col("duration")).otherwise(F.raise_error(F.lit("a recording needs a positive duration")).cast("double"))
    return of.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(ok / step))).alias("i"))


def series(spark: SparkSession, sf_dir: str, step: int = STEP) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    base = grid(recordings(spark, sf_dir), step).join(F.broadcast(kinds), how="cross")
    means = points(spark, sf_dir).groupBy("recording_id", "kind", (F.expr(f"us div {step * 1_000_000}")).alias("i")).agg(F.avg("value").alias("value"))
    return base.join(means, ["recording_id", "kind", "i"], "left").select("recording_id", "kind", "i", (F.col("i") * F.lit(float(step))).alias("t"), "value")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("t_start"), (F.col("turn") * 10.0 + 10.0).alias("t_end"), F.col("role").alias("speaker"), "text")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("kind = 'purchase'")
    return p.select("recording_id", F.col("event_id").alias("id"), F.greatest(F.col("t") - 1800, F.lit(0.0)).alias("t_start"), (F.col("t") + 1800).alias("t_end"), F.col("t").alias("t_peak"), F.col("value").alias("score"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), rating.alias("rating"), F.when(F.col("doc_id") % 5 == 0, "inherited").otherwise("operator").alias("source"))


# The same views for DuckDB.
SQL = f"""
with ev as (select user_id as recording_id, event_id, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as us, event_type as kind, value, props from events),
points as (select recording_id, event_id, us, us / 1e6 as t, kind, value, props from ev),
recordings as (select recording_id, max(us) / 1e6 as duration, count(*) as n_events from ev group by 1),
grid as (select recording_id, unnest(range(0, cast(floor(duration / {STEP}) as bigint) + 1)) as i from recordings),
means as (select recording_id, kind, us // {STEP * 1_000_000} as i, avg(value) as value from ev group by all),
series as (select g.recording_id, k.kind, g.i, g.i * {STEP}.0 as t, m.value from grid g cross join (values {', '.join(f"('{k}')" for k in KINDS)}) k(kind) left join means m on m.recording_id = g.recording_id and m.kind = k.kind and m.i = g.i),
segments as (select conv_id as recording_id, turn as seq, turn * 10.0::double as t_start, turn * 10.0::double + 10.0 as t_end, role as speaker, text from conversations),
windows as (select recording_id, event_id as id, greatest(t - 1800, 0.0) as t_start, t + 1800 as t_end, t as t_peak, value as score from points where kind = 'purchase'),
ratings as (select doc_id as id, case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as rating, case when doc_id % 5 = 0 then 'inherited' else 'operator' end as source from labels)
"""
