"""Queries of live operators: the batch form with SQL, and a live source read to its end over the table's file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.scratch import new_path
from ..streaming import capture, rates
from .registry import query


@query("with recursive " + T.SQL.strip()[5:] + """, p as (select recording_id::varchar || '-' || kind as key, us // 1000 as ms from points), c(key, ms) as (select key, min(ms) from p group by 1 union all select n.key, n.ms from (select c.key, (select min(p.ms) from p where p.key = c.key and p.ms >= c.ms + 86400000) as ms from c) n where n.ms is not null)
select key, ms from c""")
def r1_debounce(spark: SparkSession, d: str) -> DataFrame:
    e = T.points(spark, d).select(F.concat_ws("-", F.col("recording_id").cast("string"), "kind").alias("key"), F.expr("us div 1000").alias("ms"))
    return capture.debounced_batch(e, 86_400_000)


@query("select event_type, h as start, count(*) as n from (select event_type, unnest([date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts)]) as h from events) group by all")
def r4_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = capture.sliding(T.table(spark, d, "events"), "2 hours", "1 hour", "1 day")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select user_id, date_trunc('day', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by all")
def r2_live_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling sum of a live read of the table: every batch writes the windows that it changed to files, and the last state of each counts."""
    schema = T.table(spark, d, "events").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(d if d.endswith("/") else d + "/events.parquet*")
    out = capture.tumbling(live.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "31 days")
    path = new_path(spark, "live")

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    kinds = "user_id long, start timestamp, end timestamp, n long, total double, batch_id long"
    last = capture.settled(spark.read.schema(kinds).parquet(f"{path}/out/*"), ["user_id", "start", "end"])
    return last.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("with recursive " + T.SQL.strip()[5:] + """, p as (select recording_id, us // 1000 as ms, case kind when 'error' then 'key' when 'click' then 'click' when 'view' then 'move' else 'tick' end as kind, value * 10 as x, (event_id % 100)::double as y, event_id from points),
tk as (select distinct recording_id, ms from p where kind = 'tick'), c(recording_id, ms) as (select recording_id, min(ms) from tk group by 1 union all select n.recording_id, n.ms from (select c.recording_id, (select min(tk.ms) from tk where tk.recording_id = c.recording_id and tk.ms >= c.ms + 86400000) as ms from c) n where n.ms is not null),
w as (select recording_id, lag(ms) over (partition by recording_id order by ms) as start_ms, ms as end_ms, row_number() over (partition by recording_id order by ms) = 2 as first from c),
m as (select recording_id, ms, 'move' as kind, coalesce(sqrt(power(x - lag(x) over o, 2) + power(y - lag(y) over o, 2)), 0) as d from p where kind = 'move' window o as (partition by recording_id order by ms, event_id)),
e as (select * from m union all select recording_id, ms, kind, 0 from p where kind in ('key', 'click'))
select w.recording_id::varchar as key, start_ms, end_ms, round(count(*) filter (kind = 'key') / ((end_ms - start_ms) / 1000.0::double), 9) as keys_per_s, round(count(*) filter (kind = 'click') / ((end_ms - start_ms) / 1000.0::double), 9) as clicks_per_s, round(coalesce(sum(d), 0) / ((end_ms - start_ms) / 1000.0::double), 9) as px_per_s
from w left join e on e.recording_id = w.recording_id and e.ms <= end_ms and (first or e.ms > start_ms) where start_ms is not null group by w.recording_id, start_ms, end_ms""")
def r2_live_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each recording by windows of a day or more, as ticks end them, each over the time that it took."""
    kind = F.when(F.col("kind") == "error", "key").when(F.col("kind") == "click", "click").when(F.col("kind") == "view", "move").otherwise("tick")
    p = T.points(spark, d).select(F.col("recording_id").cast("string").alias("key"), F.expr("us div 1000").alias("ms"), kind.alias("kind"), (F.col("value") * 10).alias("x"), (F.col("event_id") % 100).cast("double").alias("y"), "event_id")
    out = rates.rates(p, 86_400_000, F.col("event_id"))
    return out.select("key", "start_ms", "end_ms", *(F.round(c, 9).alias(c) for c in ("keys_per_s", "clicks_per_s", "px_per_s")))
