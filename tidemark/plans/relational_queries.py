"""Queries of scans and stores (S), predicates (P), joins (J) and aggregates (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..sources import ledger, logs, store
from ..sources import tables as T
from ..sources.scratch import new_path
from .registry import query

Spark = SparkSession


@query("select event_id, user_id, value from events where event_type = 'error' and value > 50")
def s1_scan(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").where("event_type = 'error' and value > 50").select("event_id", "user_id", "value").orderBy("user_id", "event_id")


@query("select vec_id, case when vec_id % 50 = 0 then 253 else len(embedding) * 4 end::bigint as n_bytes, vec_id % 50 <> 0 as ok, case when vec_id % 50 <> 0 then round(list_sum(list_transform(embedding, lambda x: x::double)), 4) end as total from embeddings")
def s2_decode(spark: Spark, d: str) -> DataFrame:
    """Vectors stored as blobs and read again; blobs of another size, as every fiftieth here, are refused."""
    b = T.table(spark, d, "embeddings").select("vec_id", store.blob(F.col("embedding").cast("array<float>")).alias("b")).withColumn("b", F.when(F.col("vec_id") % 50 == 0, F.expr("substring(b, 1, 253)")).otherwise(F.col("b")))
    v = b.withColumn("v", store.decoded(F.col("b"), 64))
    return v.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), F.col("v").isNotNull().alias("ok"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


ANCHORS = """case doc_id % 6 when 0 then '{"schema": 1, "record_start_epoch_ms": ' || (1700000000000 + doc_id)::varchar || '}' when 1 then '{"schema": 2, "record_start_epoch_ms": 1700000000000}' when 2 then '{"record_start_epoch_ms": ' || (1700000000 + doc_id)::varchar || ', "schema": 1}' when 3 then 'no json' when 4 then '{"schema": 1}' end"""


@query(f"with a as (select doc_id, {ANCHORS} as a from documents), j as (select doc_id, case when a is not null and json_valid(a) then try_cast(json_extract_string(a, '$.record_start_epoch_ms') as bigint) end as ms, case when a is not null and json_valid(a) then try_cast(json_extract_string(a, '$.schema') as int) end as v from a) select doc_id, case when ms is null then 'malformed' when coalesce(v, -1) <> 1 then 'unknown schema' when ms < 1577836800000 then 'seconds, not milliseconds' else 'ok' end as state from j")
def s7_anchor(spark: Spark, d: str) -> DataFrame:
    """What is wrong with an anchor, or that it can be used."""
    n, text = F.col("doc_id"), lambda x: x.cast("string")
    a = F.when(n % 6 == 0, F.concat(F.lit('{"schema": 1, "record_start_epoch_ms": '), text(n + 1_700_000_000_000), F.lit("}"))).when(n % 6 == 1, '{"schema": 2, "record_start_epoch_ms": 1700000000000}').when(n % 6 == 2, F.concat(F.lit('{"record_start_epoch_ms": '), text(n + 1_700_000_000), F.lit(', "schema": 1}'))).when(n % 6 == 3, "no json").when(n % 6 == 4, '{"schema": 1}')
    return T.table(spark, d, "documents").select("doc_id", logs.anchor_state(a).alias("state"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' else 'old' end as made, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end as v from customer")
def s3_upsert(spark: Spark, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    old = c.select("c_custkey", F.lit("old").alias("made"), F.col("c_acctbal").alias("v"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("made"), (F.col("c_acctbal") + 1).alias("v"))
    return store.upsert(old, new, ["c_custkey"])


LINES = T.SQL + """, ln as (select recording_id, event_id, duration, 1700000000000 as anchor, case event_id % 7 when 0 then '' when 1 then '{"epoch_ms": "x", "kind": "marker_maybe"}' when 2 then '{"epoch_ms": true, "kind": "marker_maybe"}'
else '{"epoch_ms": ' || (1700000000000 + us // 1000 - 86400000 * (event_id % 3))::varchar || ', "kind": "' || case kind when 'purchase' then 'marker_definite' when 'signup' then 'marker_maybe' else kind end || '"}' end as line,
case when event_id % 7 > 2 then 1700000000000 + us // 1000 - 86400000 * (event_id % 3) end as ms, case kind when 'purchase' then 'marker_definite' when 'signup' then 'marker_maybe' else kind end as k from points join recordings using (recording_id)),
mk as (select recording_id, event_id, case when line = '' then 'blank' when ms is null then 'malformed' when not k like 'marker%' then 'unknown kind' when ms - anchor < 0 then 'before' when (ms - anchor) / 1000.0::double > duration then 'after' else 'kept' end as state, (ms - anchor) / 1000.0::double as t from ln)"""


def marker_lines(spark: Spark, d: str) -> DataFrame:
    p = T.points(spark, d).join(T.recordings(spark, d), "recording_id")
    kind = F.when(F.col("kind") == "purchase", "marker_definite").when(F.col("kind") == "signup", "marker_maybe").otherwise(F.col("kind"))
    ms = F.lit(1_700_000_000_000) + F.expr("us div 1000") - F.lit(86_400_000) * (F.col("event_id") % 3)
    n = F.col("event_id") % 7
    line = F.when(n == 0, "").when(n == 1, '{"epoch_ms": "x", "kind": "marker_maybe"}').when(n == 2, '{"epoch_ms": true, "kind": "marker_maybe"}').otherwise(F.concat(F.lit('{"epoch_ms": '), ms.cast("string"), F.lit(', "kind": "'), kind, F.lit('"}')))
    return p.select("recording_id", "event_id", "duration", F.lit(1_700_000_000_000).alias("anchor"), line.alias("line"))


@query(LINES + "select recording_id, event_id, round(t, 3) as t from mk where state = 'kept'")
def s4_markers(spark: Spark, d: str) -> DataFrame:
    return logs.markers(marker_lines(spark, d), "line", "anchor", "duration").where("state = 'kept'").select("recording_id", "event_id", F.round("t", 3).alias("t"))


@query(LINES + "select recording_id, state, count(*) as n from mk group by all")
def r3_drop_counters(spark: Spark, d: str) -> DataFrame:
    return logs.markers(marker_lines(spark, d), "line", "anchor", "duration").groupBy("recording_id", "state").agg(F.count("*").alias("n"))


@query(T.SQL + """, x as (select recording_id, us // 43200000000 as i, cast(json_extract(props, '$.k') as double) as v from points), b as (select recording_id, i, avg(v) as value, count(*) as n from x group by all)
select recording_id, i, value, case when n is null then 0 else 1 end as covered from grid left join b using (recording_id, i)""")
def s5_input_log(spark: Spark, d: str) -> DataFrame:
    """JSON samples averaged by bucket; a bucket without samples is null and not covered."""
    v = F.from_json("props", "k double")["k"]
    b = T.points(spark, d).groupBy("recording_id", F.expr(f"us div {T.STEP}000000").alias("i")).agg(F.avg(v).alias("value"), F.lit(1).alias("covered"))
    return T.grid(T.recordings(spark, d)).join(b, ["recording_id", "i"], "left").select("recording_id", "i", "value", F.coalesce("covered", F.lit(0)).alias("covered"))


TEXTLOG = """with l as (select conv_id, turn, '00:0' || (turn % 10)::varchar || ':05.500: ' || case turn % 4 when 0 then 'path /rec/' || role when 1 then 'start ' || role when 2 then 'scene ' || role else text end as line, turn % 4 as m, role from conversations)"""


@query(TEXTLOG + """, c as (select conv_id, turn, case when m = 0 then 'path' when m = 1 then 'start' when m = 2 then 'scene' end as what, case when m = 0 then '/rec/' || role when m < 3 then role end as value, (turn % 10) * 60 + 5.5::double as clock from l)
select conv_id, turn, what, value, clock, last_value(case when what = 'path' then value end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as path from c""")
def s6_text_log(spark: Spark, d: str) -> DataFrame:
    m = F.col("turn") % 4
    said = F.when(m == 0, F.concat(F.lit("path /rec/"), "role")).when(m == 1, F.concat(F.lit("start "), "role")).when(m == 2, F.concat(F.lit("scene "), "role")).otherwise(F.col("text"))
    lines = T.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("00:0"), (F.col("turn") % 10).cast("string"), F.lit(":05.500: "), said).alias("line"))
    out = logs.classified(lines, "conv_id", "turn", "line", {"path": r": path (/\S+)$", "start": r": start (\w+)$", "scene": r": scene (\w+)$"})
    return out.select("conv_id", "turn", "what", "value", "clock", "path")


@query(T.SQL + """, a as (select recording_id, t_start, t_end, speaker as track, text from segments), b as (select recording_id, t_start + 5, t_end + 5, 'party' as track, text from segments where seq % 2 = 0)
select recording_id, t_start, t_end, track, text, row_number() over (partition by recording_id order by t_start, t_end, track, text) - 1 as seq from (select * from a union all select * from b)""")
def s10_merge_passes(spark: Spark, d: str) -> DataFrame:
    s = T.segments(spark, d).select("recording_id", "seq", "t_start", "t_end", F.col("speaker").alias("track"), "text")
    other = s.where("seq % 2 = 0").withColumn("t_start", F.col("t_start") + 5).withColumn("t_end", F.col("t_end") + 5).withColumn("track", F.lit("party"))
    return store.merged_passes([s.drop("seq"), other.drop("seq")])


@query("select conv_id, turn from conversations where text is not null and trim(text) <> ''")
def s11_nonblank(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "conversations").where("trim(text) != ''").select("conv_id", "turn")


@query("select user_id, event_type, event_id, value from events where event_type <> 'click' union all select user_id, event_type, event_id, value + 1 from events where event_type = 'click' and event_id % 2 = 0 union all select user_id, event_type, event_id, value from events where event_type = 'click' and user_id not in (select user_id from events where event_type = 'click' and event_id % 2 = 0)")
def s12_refresh(spark: Spark, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    new = e.where("event_type = 'click' and event_id % 2 = 0").withColumn("value", F.col("value") + 1)
    return store.refresh(e, new, ["user_id", "event_type"])


CAND = T.SQL + ", cand as (select *, id % 3 as generation, id % 3 = 2 as is_current, case when recording_id % 2 = 0 then 'a' else 'b' end as config_version from windows)"


def candidates(spark: Spark, d: str) -> DataFrame:
    return T.windows(spark, d).withColumn("generation", F.col("id") % 3).withColumn("is_current", F.col("id") % 3 == 2).withColumn("config_version", F.when(F.col("recording_id") % 2 == 0, "a").otherwise("b"))


@query(CAND + """, cur as (select recording_id, max(generation) as c, max(config_version) as cfg from cand where is_current group by 1), rat as (select distinct recording_id from cand where is_current and id in (select id from ratings where source = 'operator'))
select recording_id, case when c is null or cfg <> 'a' or recording_id in (select recording_id from rat) then l + 1 else c end as generation, c is null or cfg <> 'a' or recording_id in (select recording_id from rat) as fresh from (select recording_id, max(generation) as l from cand group by 1) left join cur using (recording_id)""")
def s13_generations(spark: Spark, d: str) -> DataFrame:
    return store.next_generation(candidates(spark, d), T.ratings(spark, d), "a")


@query("select 'customer' as name, count(*) as n_rows from customer union all select 'events', count(*) from events union all select 'orders', count(*) from orders")
def s17_manifest(spark: Spark, d: str) -> DataFrame:
    return store.manifest({n: T.table(spark, d, n) for n in ("customer", "events", "orders")})


@query("select 'customer' as name, count(*) as expected, count(*) filter (c_custkey % 9 <> 0) as found, count(*) = count(*) filter (c_custkey % 9 <> 0) as ok from customer union all select 'orders', count(*), count(*), true from orders union all select 'part', null, count(*), false from part union all select 'events', count(*), null, false from events")
def s17_verified(spark: Spark, d: str) -> DataFrame:
    """A manifest against tables of which one lost rows, one is gone and one is new."""
    t = lambda n: T.table(spark, d, n)
    return store.verified(store.manifest({n: t(n) for n in ("customer", "events", "orders")}), {"customer": t("customer").where("c_custkey % 9 != 0"), "orders": t("orders"), "part": t("part")})


@query("""with b as (select distinct cast(o_orderdate as date) as day from orders), r as (select day, row_number() over (order by day desc) as n, row_number() over (partition by strftime(day, '%Y-%m') order by day desc) as m, dense_rank() over (order by strftime(day, '%Y-%m') desc) as k from b)
select day::varchar as day from r where n <= 7 or (m = 1 and k <= 12)""")
def s17_retention(spark: Spark, d: str) -> DataFrame:
    return store.retained(T.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "day", 7, 12).select(F.col("day").cast("string").alias("day"))


@query(T.SQL + "select w.recording_id, w.id, count(p.event_id) as n_in from windows w left join points p on p.recording_id = w.recording_id and p.t between w.t_start and w.t_end group by all")
def j4_points_in(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d)
    hits = J.points_in(T.points(spark, d).select("recording_id", "t", "event_id"), w.select("recording_id", "id", "t_start", "t_end"), "recording_id", "t", "t_start", "t_end", 3600.0)
    return w.select("recording_id", "id").join(hits.groupBy("recording_id", "id").agg(F.count("*").alias("n_in")), ["recording_id", "id"], "left").select("recording_id", "id", F.coalesce("n_in", F.lit(0)).alias("n_in"))


@query(T.SQL + " select w.recording_id, w.id from windows w where exists (select 1 from points p where p.recording_id = w.recording_id and p.kind = 'error' and p.t between w.t_start and w.t_end)")
def p3_inside(spark: Spark, d: str) -> DataFrame:
    hits = J.points_in(T.points(spark, d).where("kind = 'error'").select("recording_id", "t"), T.windows(spark, d).select("recording_id", "id", "t_start", "t_end"), "recording_id", "t", "t_start", "t_end", 3600.0)
    return hits.select("recording_id", "id").distinct()


OLD = T.SQL + ", old as (select recording_id, id as old_id, t_start + 600 * (id % 5) as old_start, t_end + 600 * (id % 5) as old_end from windows)"


@query(OLD + """, b as (select w.recording_id, w.id, old_id, greatest(least(t_end, old_end) - greatest(t_start, old_start), 0) / (greatest(t_end, old_end) - least(t_start, old_start)) as iou from windows w join old o on o.recording_id = w.recording_id and t_start <= old_end and old_start <= t_end)
select recording_id, id, old_id, round(iou, 6) as iou from (select *, row_number() over (partition by recording_id, id order by iou desc, old_id) as n from b) where n = 1 and iou >= 0.5""")
def j5_best_overlap(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).select("recording_id", "id", "t_start", "t_end")
    shift = 600 * (F.col("id") % 5)
    old = T.windows(spark, d).select("recording_id", F.col("id").alias("old_id"), (F.col("t_start") + shift).alias("old_start"), (F.col("t_end") + shift).alias("old_end"))
    return J.best_overlap(w, old, "recording_id", 3600.0).select("recording_id", "id", "old_id", F.round("iou", 6).alias("iou"))


@query(OLD + """, o as (select old.*, r.rating as old_rating from old join ratings r on r.id = old.old_id), b as (select w.recording_id, w.id, old_id, old_rating, greatest(least(t_end, old_end) - greatest(t_start, old_start), 0) / (greatest(t_end, old_end) - least(t_start, old_start)) as iou from windows w join o on o.recording_id = w.recording_id and t_start <= old_end and old_start <= t_end),
k as (select * from (select *, row_number() over (partition by recording_id, id order by iou desc, old_id) as n from b) where n = 1 and iou >= 0.5)
select w.recording_id, w.id, coalesce(r.rating, k.old_rating) as rating, case when r.rating is not null then r.source when k.old_rating is not null then 'inherited' end as source, case when r.rating is null then k.old_id end as from_id from windows w left join ratings r on r.id = w.id and w.id % 3 = 0 left join k on k.recording_id = w.recording_id and k.id = w.id""")
def x12_carried(spark: Spark, d: str) -> DataFrame:
    """Ratings that a new generation of windows takes over from the old one."""
    w, r = T.windows(spark, d), T.ratings(spark, d)
    new = w.select("recording_id", "id", "t_start", "t_end").join(r.where("id % 3 = 0"), "id", "left")
    shift = 600 * (F.col("id") % 5)
    old = w.select("recording_id", "id", (F.col("t_start") + shift).alias("old_start"), (F.col("t_end") + shift).alias("old_end")).join(r.select("id", F.col("rating").alias("old_rating")), "id").withColumnRenamed("id", "old_id")
    return store.carried(new, old, 3600.0)


@query(T.SQL + """select p.recording_id, p.event_id, (select w.id from windows w where w.recording_id = p.recording_id and p.t between w.t_start and w.t_end order by w.score desc, w.id limit 1) as id from points p where kind = 'view'""")
def j6_covering(spark: Spark, d: str) -> DataFrame:
    p = T.points(spark, d).where("kind = 'view'").select("recording_id", "event_id", "t")
    hits = J.points_in(p, T.windows(spark, d).select("recording_id", "id", "t_start", "t_end", "score"), "recording_id", "t", "t_start", "t_end", 3600.0)
    best = hits.groupBy("recording_id", "event_id").agg(F.max_by("id", F.struct(F.col("score"), (-F.col("id")).alias("r"))).alias("id"))
    return p.select("recording_id", "event_id").join(best, ["recording_id", "event_id"], "left")


SNAP = T.SQL + """, m as (select recording_id, t from points where kind = 'view'), p as (select recording_id, event_id, t from points where kind = 'purchase'),
s as (select *, (select max(m.t) from m where m.recording_id = p.recording_id and m.t <= p.t) as b, (select min(m.t) from m where m.recording_id = p.recording_id and m.t >= p.t) as a from p)"""


@query(SNAP + "select recording_id, event_id, round(case when t - b <= 7200 then b when a - t <= 7200 then a else t end, 6) as back, round(case when a - t <= 7200 then a when t - b <= 7200 then b else t end, 6) as ahead from s")
def j9_nearest(spark: Spark, d: str) -> DataFrame:
    p = T.points(spark, d)
    out = J.nearest(p.where("kind = 'purchase'").select("recording_id", "event_id", "t"), p.where("kind = 'view'").select("recording_id", F.col("t").alias("m")), "recording_id", "t", "m", "event_id")
    t, b, a = F.col("t"), F.col("before"), F.col("after")
    return out.select("recording_id", "event_id", F.round(J.snapped(t, b, a, 7200, True), 6).alias("back"), F.round(J.snapped(t, b, a, 7200, False), 6).alias("ahead"))


@query(T.SQL + """, smp as (select recording_id, i, value from series where kind = 'click'), kn as (select * from smp where value is not null), last as (select recording_id, max(i) as l from smp group by 1),
g as (select recording_id, unnest(range(0, l * 2 + 3)) as g, l from last), x as (select recording_id, g, least(greatest(g * 0.5::double, 0), l) as x from g),
n as (select x.*, s.value as nv from x join smp s on s.recording_id = x.recording_id and s.i = round_even(x, 0)),
ab as (select n.*, (select max(i) from kn where kn.recording_id = n.recording_id and i <= x) as ia, (select min(i) from kn where kn.recording_id = n.recording_id and i >= x) as ic from n)
select ab.recording_id, ab.g, round(case when nv is null then null when ia is null then c.value when ic is null or ia = ic then a.value else a.value + (c.value - a.value) * (x - ia) / (ic - ia) end, 9) as value
from ab left join kn a on a.recording_id = ab.recording_id and a.i = ia left join kn c on c.recording_id = ab.recording_id and c.i = ic""")
def j10_resample(spark: Spark, d: str) -> DataFrame:
    s = T.series(spark, d).where("kind = 'click'").select("recording_id", "i", "value")
    last = s.groupBy("recording_id").agg(F.max("i").alias("last"))
    g = last.select("recording_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") * 2 + 2)).alias("g")).withColumn("t", F.col("g") * 0.5)
    return J.resample(s, g, "recording_id", 1.0, "last").select("recording_id", "g", F.round("value", 9).alias("value"))


@query(T.SQL + """, m as (select w.recording_id, w.id, avg(power(10.0::double, p.value / 100)) as power from windows w join points p on p.recording_id = w.recording_id and p.kind = 'view' and p.t between w.t_start and w.t_end group by all)
select w.recording_id, w.id, round(power, 9) as power from windows w left join m using (recording_id, id)""")
def j15_mean_power(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d)
    p = T.points(spark, d).where("kind = 'view'").select("recording_id", "t", (F.col("value") / 10).alias("db"))
    hits = J.points_in(p, w.select("recording_id", "id", "t_start", "t_end"), "recording_id", "t", "t_start", "t_end", 3600.0).groupBy("recording_id", "id").agg(F.round(A.mean_power(F.col("db")), 6).alias("power"))
    return w.select("recording_id", "id").join(hits, ["recording_id", "id"], "left")


@query(T.SQL + """select recording_id, kind, count(*) as n, count(value) as observed, min(value) as min, round(quantile_cont(value, 0.05), 9) as p05, round(quantile_cont(value, 0.5), 9) as median, round(quantile_cont(value, 0.95), 9) as p95, max(value) as max, round(avg(value), 9) as mean from series group by all""")
def a4_summary(spark: Spark, d: str) -> DataFrame:
    out = A.summary(T.series(spark, d), ["recording_id", "kind"], "value")
    return out.select("recording_id", "kind", "n", "observed", "min", *(F.round(c, 9).alias(c) for c in ("p05", "median", "p95")), "max", F.round("mean", 9).alias("mean"))


@query(T.SQL + """, c as (select *, count(*) over (partition by recording_id, kind) as n from series) select recording_id, kind, i // 4 as i, round(avg(value), 9) as value from c where i < n // 4 * 4 group by recording_id, kind, i // 4""")
def a8_downsample(spark: Spark, d: str) -> DataFrame:
    return A.downsample(T.series(spark, d), ["recording_id", "kind"], "i", "value", 4).select("recording_id", "kind", "i", F.round("value", 9).alias("value"))


@query("""with x as (select p_brand, p_retailprice as v, p_size > 25 as pos from part), r as (select *, rank() over (partition by p_brand order by v) - 1 + (count(*) over (partition by p_brand, v) - 1) / 2.0::double as r from x),
a as (select p_brand, sum(r) filter (pos) as s, count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg from r group by 1)
select p_brand, n_pos, n_neg, case when n_pos >= 10 and n_neg >= 10 then round_even((s - n_pos * (n_pos - 1) / 2) / (n_pos * n_neg), 4) end as auc from a""")
def a13_separation(spark: Spark, d: str) -> DataFrame:
    return A.separation(T.table(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("v"), (F.col("p_size") > 25).alias("pos")), ["p_brand"], "v", "pos")


@query("""with r as (select l_suppkey, l_quantity, l_extendedprice, l_orderkey * 10 + l_linenumber as id from lineitem),
k as (select *, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0::double as a, rank() over (partition by l_suppkey order by l_extendedprice) + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2.0::double as b,
row_number() over (partition by l_suppkey order by l_quantity desc, id) <= 20 as ta, row_number() over (partition by l_suppkey order by l_extendedprice desc, id) <= 20 as tb from r)
select l_suppkey, round_even(corr(a, b), 4) as spearman, count(*) filter (ta and tb) as shared, count(*) as n from k group by 1""")
def a16_rank_agreement(spark: Spark, d: str) -> DataFrame:
    x = T.table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return A.rank_agreement(x, ["l_suppkey"], "l_quantity", "l_extendedprice", 20, "id")


@query("select o_custkey, round(sum(o_totalprice + case when o_custkey % 3 = 0 then 1 else 0 end), 2) as total, case when o_custkey % 3 = 0 then 4 else 2 end as seq from orders group by o_custkey")
def r7_refreshed(spark: Spark, d: str) -> DataFrame:
    """Totals by customer kept up to date: a third of the customers change, and only theirs are computed a second time."""
    book = ledger.Ledger(spark, new_path(spark, "ledger"))
    o = T.table(spark, d, "orders").select("o_custkey", "o_totalprice")
    refresh = lambda: book.refresh("totals", ["orders"], "o_custkey", {"stage": 1}, lambda rows: rows.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")))
    book.put("orders", o, "o_custkey")
    refresh()
    book.put("orders", o.where("o_custkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_custkey")
    refresh()
    return book.read("totals", "o_custkey").join(book.heads("totals", "o_custkey"), "o_custkey").select("o_custkey", F.round("total", 2).alias("total"), "seq")


@query(T.SQL + """, w as (select recording_id, count(*) as n, bool_or(id in (select id from ratings where source = 'operator')) as rated from windows group by 1)
select recording_id, 1 + rated::int + (recording_id % 2 = 0)::int as generation, n as n_current, n * (1 + rated::int + (recording_id % 2 = 0)::int) as n_all from w""")
def s13_scored(spark: Spark, d: str) -> DataFrame:
    """Windows scored, rated, scored again under the same settings and, for half of the recordings, under others: what is current and what is kept."""
    scores = ledger.Scores(spark, new_path(spark, "scores"))
    w = T.windows(spark, d).withColumnRenamed("id", "moment")
    scores.score(w, "a", 3600.0)
    rated = scores.candidates().join(T.ratings(spark, d).where("source = 'operator'").select(F.col("id").alias("moment"), "rating"), "moment")
    scores.rate(rated.select("id", "rating"))
    moved = w.withColumn("t_start", F.col("t_start") + 60).withColumn("t_end", F.col("t_end") + 60)
    scores.score(moved, "a", 3600.0)
    scores.score(moved.where("recording_id % 2 = 0"), "b", 3600.0)
    return scores.candidates().groupBy("recording_id").agg(F.max(F.when(F.col("is_current"), F.col("generation"))).alias("generation"), F.count_if("is_current").alias("n_current"), F.count("*").alias("n_all"))


DAY = 86_400_000


@query(f"""with e as (select user_id % 5 as user_id, event_id, value, epoch_ms(ts) as ms from events), r as (select user_id, min(ms) + {DAY} as anchor, 9 * 86400 as duration from e group by 1),
l as (select e.*, anchor, duration, (ms - anchor) / 1000.0::double as t from e join r using (user_id) where ms // {DAY} between anchor // {DAY} and (anchor + duration * 1000) // {DAY}),
s as (select *, case when event_id % 11 = 0 then 'malformed' when t < 0 then 'before' when t > duration then 'after' when event_id % 9 = 0 then 'malformed' else 'kept' end as state from l)
select user_id as machine, state, count(*) as n, round(sum(case when state = 'kept' then value + 1 end), 6) as rate from s group by all""")
def s5_daily_files(spark: Spark, d: str) -> DataFrame:
    """Rates logged by machine and day, read back from the files for a recording of nine days: what is kept, and what falls out and why."""
    e = T.table(spark, d, "events").select((F.col("user_id") % 5).alias("user_id"), "event_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    n = F.col("event_id")
    good = F.to_json(F.struct(F.col("ms").alias("epoch_ms"), F.col("value").alias("keys_per_s"), F.lit(1.0).alias("clicks_per_s"), (n % 50).cast("double").alias("mouse_vel_px_s")))
    bad = F.to_json(F.struct(F.col("ms").alias("epoch_ms"), F.lit("x").alias("keys_per_s"), F.lit(1.0).alias("clicks_per_s"), F.lit(1.0).alias("mouse_vel_px_s")))
    line = F.when(n % 11 == 0, '{"epoch_ms":').when(n % 9 == 0, bad).otherwise(good)
    path = new_path(spark, "input-logs")
    e.select(F.col("user_id").alias("machine"), F.to_date(F.timestamp_millis("ms")).alias("day"), line.alias("value")).repartition("day").sortWithinPartitions("machine").write.partitionBy("day", "machine").text(path)
    recordings = e.groupBy(F.col("user_id").alias("machine")).agg((F.min("ms") + DAY).alias("anchor")).withColumn("duration", F.lit(9 * 86_400))
    rows = logs.input_samples(logs.cut(logs.files(spark, path), recordings, "machine", "day", "anchor", "duration"), "line", "anchor", "duration")
    return rows.groupBy("machine", "state").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("state") == "kept", F.col("rate"))), 6).alias("rate"))


@query("""with l as (select conv_id, turn, case turn % 5 when 0 then 'path' when 1 then 'start' when 2 then 'scene' when 3 then 'stop' end as what, turn * 60 + 5.5::double as clock, '/rec/' || role || turn as p from conversations),
n as (select *, sum(case when what = 'start' then 1 else 0 end) over (partition by conv_id order by turn) as k, coalesce(last_value(case when what in ('start', 'stop') then what end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) = 'start', false) as open from l),
o as (select *, case when what = 'path' and not open then k + 1 else k end as n from n)
select conv_id, n, max(clock) filter (what = 'start') as start, min(clock) filter (what = 'stop' and open) as stop, arg_max(p, turn) filter (what = 'path') as path from o group by conv_id, n having max(clock) filter (what = 'start') is not null""")
def s6_recordings(spark: Spark, d: str) -> DataFrame:
    """Recordings in text logs, one file for each conversation: when they start and stop, and their path."""
    t, m = F.col("turn"), F.col("turn") % 5
    said = F.when(m == 0, F.concat(F.lit("path /rec/"), "role", t.cast("string"))).when(m == 1, "start rec").when(m == 2, "scene main").when(m == 3, "stop rec").otherwise(F.regexp_replace("text", r"\s+", " "))
    line = F.concat(F.lpad(F.floor(t / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"), F.lit(":05.500: "), said)
    path = new_path(spark, "text-logs")
    T.table(spark, d, "conversations").select("conv_id", "turn", line.alias("value")).repartition("conv_id").sortWithinPartitions("conv_id", "turn").drop("turn").write.partitionBy("conv_id").text(path)
    lines = logs.numbered(logs.files(spark, path))
    patterns = {"path": r": path (/\S+)$", "start": r": start (\w+)$", "stop": r": stop (\w+)$", "scene": r": scene (\w+)$"}
    out = logs.recorded(logs.classified(lines.drop("path"), "file", "number", "line", patterns).withColumnRenamed("path", "seen"), "conv_id", "number")
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), "n", "start", "stop", "path")
