"""Queries of the window operators (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import slices as L
from ..operators import windows as W
from ..sources import tables as T
from .registry import query

K = ["recording_id", "kind"]


def r6(name: str, as_: str | None = None):
    return F.round(name, 6).alias(as_ or name)


@query(T.SQL + """select recording_id, kind, i, round(avg(value) over w, 6) as mean, round(coalesce(stddev_pop(value) over w, null), 6) as std,
round((value - avg(value) over w) / greatest(coalesce(stddev_pop(value) over w, 0), 0.5), 6) as z
from series window w as (partition by recording_id, kind order by i rows between 5 preceding and 5 following)""")
def w1_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sliced(T.series(spark, sf_dir), K, "i", 5, 5, lambda rows, by: W.rolling_zscore(rows, by, "i", "value", 10, 0.5))
    return out.select(*K, "i", r6("mean"), r6("std"), r6("z"))


@query(T.SQL + """select recording_id, kind, i, case when count(value) over w >= 3 then round(stddev_pop(value) over w, 6) end as std
from series window w as (partition by recording_id, kind order by i rows between 4 preceding and 4 following)""")
def w2_rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sliced(T.series(spark, sf_dir), K, "i", 4, 4, lambda rows, by: W.rolling_std(rows, by, "i", "value", 8, 3))
    return out.select(*K, "i", r6("std"))


@query(T.SQL + "select recording_id, kind, i, max(value) over (partition by recording_id, kind order by i rows between 3 preceding and current row) as peak from series")
def w3_rolling_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sliced(T.series(spark, sf_dir), K, "i", 3, 0, lambda rows, by: rows.withColumn("peak", W.rolling_max(F.col("value"), by, "i", 4)))
    return out.select(*K, "i", "peak")


ACTIVE = T.SQL + ", act as (select recording_id, kind, i, coalesce(value > 40, false) as active from series)"
ISLE = ACTIVE + ", isle as (select *, i - row_number() over (partition by recording_id, kind, active order by i) as g from act), n as (select *, count(*) over (partition by recording_id, kind, active, g) as size, row_number() over (partition by recording_id, kind, active, g order by i) as place from isle)"


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.series(spark, sf_dir).select(*K, "i", F.coalesce(F.col("value") > 40, F.lit(False)).alias("active"))


@query(ACTIVE + "select recording_id, kind, i, coalesce(bool_or(active) over (partition by recording_id, kind order by i rows between 2 preceding and current row), false) as held from act")
def w4_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sliced(active(spark, sf_dir), K, "i", 2, 0, lambda rows, by: rows.withColumn("held", W.hold(F.col("active"), by, "i", 2)))
    return out.select(*K, "i", "held")


@query(ISLE + "select recording_id, kind, i, active and size >= 2 as active from n")
def w5_drop_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_short_runs(active(spark, sf_dir), K, "i", "active", 2)


@query(ISLE + "select recording_id, kind, i, case when active then least(place / 3.0::double, 1.0::double) else 0.0::double end as ramp from n")
def w6_ramp_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ramp_up(active(spark, sf_dir), K, "i", "active", 3, "ramp").drop("active")


@query(ISLE + "select recording_id, kind, i, case when active and place >= 2 then least((place - 1) / 2.0::double, 1.0::double) else 0.0::double end as level from n")
def w7_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sustained(active(spark, sf_dir), K, "i", "active", 2, 2, "level").drop("active")


@query(ACTIVE + "select recording_id, kind, i, active and not lag(active, 1, false) over (partition by recording_id, kind order by i) as onset from act")
def w8_rising_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.sliced(active(spark, sf_dir), K, "i", 1, 0, lambda rows, by: rows.withColumn("onset", W.rising_edge(F.col("active"), by, "i")))
    return out.select(*K, "i", "onset")


@query(ISLE + "select recording_id, kind, min(i) as start, max(i) + 1 as \"end\" from n where active group by recording_id, kind, g")
def w9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.runs(active(spark, sf_dir), K, "i", "active")


@query(T.SQL + """, hits as (select p.recording_id, least(greatest(cast(floor(t / 43200) as bigint), 0), greatest(round_even(duration / 43200, 0)::bigint, 1) - 1) as i, count(*) as n from points p join recordings using (recording_id) where kind = 'click' group by 1, 2),
g as (select recording_id, unnest(range(0, greatest(round_even(duration / 43200, 0)::bigint, 1))) as i from recordings)
select recording_id, i, round(coalesce(sum(coalesce(n, 0)) over (partition by recording_id order by i rows between 3 preceding and 2 following), 0) / 259200.0, 9) as rate from g left join hits using (recording_id, i)""")
def w10_boxcar_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by second over a window of six buckets; the edges are divided by the whole window too."""
    n = F.greatest(F.bround(F.col("duration") / T.STEP).cast("long"), F.lit(1))
    st = T.recordings(spark, sf_dir).select("recording_id", n.alias("n"))
    hits = T.points(spark, sf_dir).where("kind = 'click'").join(st, "recording_id").groupBy("recording_id", F.least(F.greatest(F.floor(F.col("t") / T.STEP), F.lit(0)), F.col("n") - 1).alias("i")).agg(F.count("*").alias("hits"))
    g = st.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).join(hits, ["recording_id", "i"], "left")
    rate = lambda by: W.boxcar_sum(F.coalesce("hits", F.lit(0)), by, "i", 6) / (6.0 * T.STEP)
    out = L.sliced(g, ["recording_id"], "i", 6, 6, lambda rows, by: rows.withColumn("rate", rate(by)))
    return out.select("recording_id", "i", F.round("rate", 9).alias("rate"))


@query(T.SQL + """, x as (select recording_id, kind, i, coalesce(value, 0) as v, max(i) over (partition by recording_id, kind) as last from series),
k as (select d, exp(-0.5 * (d / 2.0) * (d / 2.0)) / (select sum(exp(-0.5 * (e / 2.0) * (e / 2.0))) from range(-8, 9) t(e)) as wt from range(-8, 9) t(d))
select x.recording_id, x.kind, x.i, round(sum(wt * y.v), 6) as smooth from x cross join k join x y on y.recording_id = x.recording_id and y.kind = x.kind and y.i = least(greatest(x.i + d, 0), x.last) group by all""")
def w11_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.series(spark, sf_dir).withColumn("v", F.coalesce("value", F.lit(0.0)))
    out = L.sliced(s, K, "i", 8, 8, lambda rows, by: rows.withColumn("smooth", W.gaussian(F.col("v"), by, "i", 2.0)))
    return out.select(*K, "i", F.round("smooth", 6).alias("smooth"))


@query("select p_partkey, p_brand, rank() over (partition by p_brand order by p_size) - 1 + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as rank from part")
def w12_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").select("p_partkey", "p_brand", W.average_rank("p_size", ["p_brand"]).alias("rank"))


CLUSTER = T.SQL + """, o as (select *, max(t_end) over (partition by recording_id order by t_start, t_end, id rows between unbounded preceding and 1 preceding) as before from windows),
c as (select * exclude (before), sum(case when before is null or t_start > before then 1 else 0 end) over (partition by recording_id order by t_start, t_end, id)::bigint - 1 as cluster from o)"""


@query(CLUSTER + "select recording_id, arg_max(id, (score, id)) as id, max(score) as score, cluster from c group by recording_id, cluster")
def w13_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = W.overlap_clusters(T.windows(spark, sf_dir), ["recording_id"], "t_start", "t_end", "id")
    return c.groupBy("recording_id", "cluster").agg(F.max_by("id", F.struct("score", "id")).alias("id"), F.max("score").alias("score"))


@query(CLUSTER + "select recording_id, id, cluster from c")
def w14_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.overlap_clusters(T.windows(spark, sf_dir), ["recording_id"], "t_start", "t_end", "id").select("recording_id", "id", "cluster")


@query("select * exclude (n) from (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def w15_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(T.SQL + """, sw as (select p.recording_id, event_id, kind, t - 86400.0 as t, duration from points p join recordings using (recording_id)),
s as (select *, greatest(t, 0.0) as start, least(coalesce(lead(t) over (partition by recording_id order by t, event_id), duration), duration) as "end" from sw), k as (select * from s where "end" > start)
select recording_id, event_id, kind, round(start, 6) as start, round("end", 6) as "end", lag(kind) over (partition by recording_id order by start, event_id) as previous from k""")
def w16_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sw = T.points(spark, sf_dir).join(T.recordings(spark, sf_dir), "recording_id").withColumn("t", F.col("t") - 86400.0)
    return W.spans_from_switches(sw, "recording_id", "t", "kind", "duration", "event_id").select("recording_id", "event_id", "kind", r6("start"), r6("end"), "previous")


WORDS = T.SQL + """, wd as (select recording_id, seq, t_start, t_end, unnest(string_split_regex(trim(text), '\\s+')) as w, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) as k from segments where trim(text) <> ''),
al as (select *, case when k % 3 = 1 then t_start + k * 0.1 end as a, case when k % 3 = 1 then t_start + k * 0.1 + 0.05 end as b from wd)"""


@query(WORDS + """, g as (select *, count(a) over (partition by recording_id, seq order by k) as blk from al),
p as (select *, max(b) over (partition by recording_id, seq, blk) as lo, sum(case when a is null then 1 else 0 end) over (partition by recording_id, seq, blk order by k) as place, sum(case when a is null then 1 else 0 end) over (partition by recording_id, seq, blk) as many from g),
q as (select *, (select min(a) from al x where x.recording_id = p.recording_id and x.seq = p.seq and x.k > p.k) as hi from p),
e as (select *, coalesce(lo, t_start) as l, greatest(coalesce(hi, t_end), coalesce(lo, t_start)) as h from q)
select recording_id, seq, k, round(coalesce(a, l + (h - l) * (place - 1) / many), 6) as start, round(coalesce(b, l + (h - l) * place / many), 6) as "end" from e""")
def w17_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without times share the gap between their neighbours' times, or the segment's ends, evenly."""
    s = T.segments(spark, sf_dir).where(F.trim("text") != "")
    s = J.dealt(s, ["recording_id", "seq"], s.agg(F.coalesce(F.sum(F.size(F.split(F.trim("text"), "\\s+"))), F.lit(0))).first()[0])
    w = s.select("recording_id", "seq", "t_start", "t_end", F.posexplode(F.split(F.trim("text"), "\\s+"))).withColumn("k", F.col("pos") + 1)
    w = w.withColumn("a", F.when(F.col("k") % 3 == 1, F.col("t_start") + F.col("k") * F.lit(0.1))).withColumn("b", F.col("a") + F.lit(0.05))
    by = Window.partitionBy("recording_id", "seq").orderBy("k")
    w = w.withColumn("block", F.count("a").over(by))
    block = Window.partitionBy("recording_id", "seq", "block")
    null = F.when(F.col("a").isNull(), 1).otherwise(0)
    w = w.withColumn("lo", F.coalesce(F.max("b").over(block), F.col("t_start"))).withColumn("place", F.sum(null).over(block.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).withColumn("many", F.sum(null).over(block))
    nxt = F.last("a", ignorenulls=True).over(Window.partitionBy("recording_id", "seq").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("hi", F.greatest(F.coalesce(nxt, F.col("t_end")), F.col("lo")))
    part = lambda n: F.col("lo") + (F.col("hi") - F.col("lo")) * n / F.nullif(F.col("many"), F.lit(0))
    return w.select("recording_id", "seq", F.col("k").cast("long").alias("k"), F.round(F.coalesce("a", part(F.col("place") - 1)), 6).alias("start"), F.round(F.coalesce("b", part(F.col("place"))), 6).alias("end"))


@query(T.SQL + """, x as (select recording_id, kind, event_id, us // 1000 as ms from points)
select recording_id, kind, event_id, count(*) over (partition by recording_id, kind order by ms range between 172800000 preceding and current row) - (count(*) over (partition by recording_id, kind, ms) - row_number() over (partition by recording_id, kind, ms order by event_id)) as times from x""")
def w19_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.points(spark, sf_dir).select(*K, "event_id", F.expr("us div 1000").alias("ms"))
    return W.repeats(p, K, "ms", "event_id", 172_800_000).drop("ms")
