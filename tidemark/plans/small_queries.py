"""Queries of the remaining small operators (F, H, M, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chapters as Ch
from ..operators import edits as E
from ..operators import joins as J
from ..operators.captions import caption_groups
from ..sources import tables as T
from .registry import query

Spark = SparkSession


@query()
def h6_ranged_chapters(spark: Spark, d: str) -> DataFrame:
    """Chapters opened by purchases, split at sign-ups when over eight days, at least two days long."""
    p = T.points(spark, d).where("kind in ('purchase', 'signup')").select("recording_id", "t", F.col("value").alias("strength"), (F.col("kind") == "signup").alias("spare"))
    return Ch.chapters(T.recordings(spark, d).select("recording_id", "duration").join(p, "recording_id", "left"), 172_800.0, 691_200.0)


@query(T.SQL + "select w.recording_id, w.id, round(greatest(least(t_peak - 300, duration - 600), 0), 6) as p_start, round(least(greatest(least(t_peak - 300, duration - 600), 0) + 600, duration), 6) as p_end from windows w join recordings using (recording_id)")
def f22_preview(spark: Spark, d: str) -> DataFrame:
    """Ten minutes about each peak, slid inside the recording rather than cut short."""
    w = T.windows(spark, d).join(T.recordings(spark, d), "recording_id")
    start = F.greatest(F.least(F.col("t_peak") - 300, F.col("duration") - 600), F.lit(0.0))
    return w.select("recording_id", "id", F.round(start, 6).alias("p_start"), F.round(F.least(start + 600, F.col("duration")), 6).alias("p_end"))


WORDS = "w as (select conv_id, turn, string_split_regex(trim(text), '\\s+') as w from conversations)"


@query(f"""with recursive {WORDS}, c(conv_id, turn, k, place, n, last) as (select conv_id, turn, 1::bigint, 0::bigint, 1::bigint, w[1] from w
union all select c.conv_id, c.turn, c.k + 1, case when c.n >= 4 or regexp_matches(c.last, '[.!?]$') then c.place + 1 else c.place end, case when c.n >= 4 or regexp_matches(c.last, '[.!?]$') then 1 else c.n + 1 end, w.w[c.k + 1] from c join w using (conv_id, turn) where c.k < len(w.w))
select conv_id, turn, place, string_agg(last, ' ' order by k) as caption from c group by all""")
def f23_captions(spark: Spark, d: str) -> DataFrame:
    """Words in captions of up to four; a caption also ends with a sentence."""
    c = T.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), "\\s+")).alias("k", "w"))
    by = Window.partitionBy("conv_id", "turn").orderBy("k")
    ended = F.regexp_like(F.lag("w").over(by), F.lit(r"[.!?]$"))
    c = c.withColumn("sentence", F.sum(F.when(F.coalesce(ended, F.lit(False)), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("four", F.floor((F.row_number().over(Window.partitionBy("conv_id", "turn", "sentence").orderBy("k")) - 1) / 4))
    lines = c.groupBy("conv_id", "turn", "sentence", "four").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("sentence", "four")) - 1
    return lines.select("conv_id", "turn", place.cast("long").alias("place"), F.array_join("words.w", " ").alias("caption"))


SPOKEN = "w as (select conv_id, turn, role, unnest(string_split_regex(trim(text), '\\s+')) as w, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) as k from conversations), s as (select conv_id as key, turn * 1000 + k as id, role, w as text, turn * 3.0::double + k * 0.2::double as w_start, turn * 3.0::double + k * 0.2::double + 0.05::double * length(w) as w_end from w), l as (select *, regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g') as said from s)"


def spoken(spark: Spark, d: str) -> DataFrame:
    """Words with made times: a turn begins three seconds after the last, whatever its length, so that turns talk over one another."""
    w = T.table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split(F.trim("text"), "\\s+")))
    start = F.col("turn") * 3.0 + (F.col("pos") + 1) * F.lit(0.2)
    return w.select(F.col("conv_id").alias("key"), (F.col("turn") * 1000 + F.col("pos") + 1).alias("id"), "role", F.col("col").alias("text"), start.alias("w_start"), (start + F.lit(0.05) * F.length("col")).alias("w_end"))


@query(f"""with {SPOKEN}, a as (select *, lag(w_end) over o as pe, lag(text) over o as pt from l window o as (partition by key order by id)), r as (select *, sum(case when w_start - pe > 1.2 or regexp_matches(pt, '[.!?…][\\s"''”’)\\]]*$') then 1 else 0 end) over (partition by key order by id) as run from a),
c as (select *, (row_number() over (partition by key, run order by id) - 1) // 4 as chunk from r), g as (select *, dense_rank() over (partition by key order by run, chunk) - 1 as g from c), n as (select *, max(g) over (partition by key) as top, row_number() over (partition by key, g order by id) as n, count(*) over (partition by key, g) as size from g),
z as (select *, max(case when g = top then size end) over (partition by key) as ls, max(case when g = top - 1 then size end) over (partition by key) as bs from n)
select key, id, case when top > 0 and ls < 3 and ls + bs < 6 and g = top then g - 1 when top > 0 and ls < 3 and ls + bs >= 6 and g = top - 1 and n > bs - least(3 - ls, bs - 3) then g + 1 else g end as place from z""")
def f23_balanced(spark: Spark, d: str) -> DataFrame:
    """Timed words in captions that end at pauses and sentences too, the last one not too short."""
    return caption_groups(spoken(spark, d), ["key"], "id", "text", "w_start", "w_end").select("key", "id", "place")


@query(f"with {SPOKEN}, c as (select key, id, greatest(w_start - 0.08, 1.0) - 1.0 as a, least(w_end + 0.08, 13.0) - 1.0 as b from l where said in ('the', 'of', 'to') and w_end + 0.08 > 1.0 and w_start - 0.08 < 13.0), o as (select *, max(b) over (partition by key order by a, b, id rows between unbounded preceding and 1 preceding) as m from c), n as (select *, sum(case when m is null or a > m then 1 else 0 end) over (partition by key order by a, b, id) as g from o) select key, round(min(a), 6) as m_start, round(max(b), 6) as m_end from n group by key, g")
def f26_mutes(spark: Spark, d: str) -> DataFrame:
    """What to mute in the part from second 1 to second 13 of each conversation."""
    w = spoken(spark, d)
    plans = w.select("key").distinct().select("key", F.lit(1.0).alias("p_start"), F.lit(13.0).alias("p_end"))
    return E.mutes(w, plans, ("the", "of", "to")).select("key", F.round("m_start", 6).alias("m_start"), F.round("m_end", 6).alias("m_end"))


@query(f"""with {SPOKEN}, p as (select key, max(w_end) - min(w_start) as duration from s group by 1), f as (select * from l where said in ('the', 'of', 'to', 'and')),
t as (select f.*, case when role <> 'user' then 'role' when round(w_end - w_start, 9) < 0.12 then 'short' when exists (select 1 from s o where o.key = f.key and o.role <> f.role and o.w_start < f.w_end - 1e-9 and f.w_start < o.w_end - 1e-9) then 'overlap' else 'cut' end as state from f),
k as (select *, max(w_end) over (partition by key order by w_start, w_end, id rows between unbounded preceding and 1 preceding) as m from t where state = 'cut'),
g as (select *, sum(case when m is null or w_start - m > 0.35 then 1 else 0 end) over (partition by key order by w_start, w_end, id) as g from k), h as (select key, max(w_end) - min(w_start) as n from g group by key, g), r as (select key, sum(n) as taken from h group by 1)
select t.key, t.id, case when state = 'cut' and round(taken, 9) > round(duration * 0.02, 9) then 'share' else state end as state from t left join r using (key) left join p using (key)""")
def f26_fillers(spark: Spark, d: str) -> DataFrame:
    """Which filler words of the user can be cut, and why the others can't."""
    w = spoken(spark, d)
    plans = w.groupBy("key").agg((F.max("w_end") - F.min("w_start")).alias("duration"))
    return E.filler_cuts(w, plans, ("the", "of", "to", "and"), ("user",), most_share=0.02).select("key", "id", "state")


RECT = "with r as (select p_partkey as id, p_brand as g, (p_partkey * 37 % 90)::int as x, (p_partkey * 53 % 90)::int as y, 10 + p_size % 20 as w, 10 + (p_size * 7) % 20 as h from part)"


@query(RECT + " select a.id, b.id as other, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as area from r a join r b on a.g = b.g and a.id < b.id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h")
def f24_overlapping_crops(spark: Spark, d: str) -> DataFrame:
    """Pairs of rectangles of one group that overlap, and by how much."""
    n = F.col("p_partkey")
    r = T.table(spark, d, "part").select(n.alias("id"), F.col("p_brand").alias("g"), (n * 37 % 90).cast("int").alias("x"), (n * 53 % 90).cast("int").alias("y"), (10 + F.col("p_size") % 20).alias("w"), (10 + F.col("p_size") * 7 % 20).alias("h"))
    both = J.overlapping_boxes(r, "g", "id", "x", "y", "w", "h", 15)
    return both.select("id", "other", F.col("area").cast("long").alias("area"))


@query("""with n as (select lower(p_name) as k, min(p_partkey) as place, arg_min(p_name, p_partkey) as name, arg_min(p_brand, p_partkey) as g from part group by 1), r as (select *, row_number() over (partition by g order by place) as r, sum(length(name) + 1) over (partition by g order by place) as used from n), s as (select *, min(case when used > 120 then r end) over (partition by g) as stop from r)
select g, name, r as place from s where r <= 160 and (stop is null or r < stop)""")
def f27_vocabulary(spark: Spark, d: str) -> DataFrame:
    """Names once each in order of first sight, by group as many as fit a budget of 120 characters."""
    n = T.table(spark, d, "part").groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("first"), F.min_by("p_name", "p_partkey").alias("name"), F.min_by("p_brand", "p_partkey").alias("g"))
    w = Window.partitionBy("g").orderBy("first")
    r = n.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(F.length("name") + 1).over(w))
    stop = F.min(F.when(F.col("used") > 120, F.col("place"))).over(Window.partitionBy("g"))
    return r.withColumn("stop", stop).where("place <= 160 and (stop is null or place < stop)").select("g", "name", "place")


@query("with o(name, state) as (values ('1-URGENT', 'rush'), ('2-HIGH', 'fast'), ('default', 'plain')) select o_orderkey, coalesce(a.name, 'default') as preset, coalesce(a.state, b.state) as settings, case when o_totalprice > 200000 then 'over cap' else 'ok' end as state from orders left join o a on a.name = o_orderpriority cross join o b where b.name = 'default'")
def m13_preset(spark: Spark, d: str) -> DataFrame:
    """The preset by its name, else the default one, and a warning over the cap."""
    presets = {"1-URGENT": "rush", "2-HIGH": "fast", "default": "plain"}
    table = F.create_map(*(F.lit(x) for kv in presets.items() for x in kv))
    name = F.when(F.map_contains_key(table, F.col("o_orderpriority")), F.col("o_orderpriority")).otherwise("default")
    return T.table(spark, d, "orders").select("o_orderkey", name.alias("preset"), F.try_element_at(table, name).alias("settings"), F.when(F.col("o_totalprice") > 200_000, "over cap").otherwise("ok").alias("state"))


@query("""with f as (select s_nationkey as dir, s_suppkey % 50 as name, s_suppkey as size from supplier), w as (select c_custkey as id, c_custkey % 50 as name, c_custkey % 100 as size from customer)
select w.id, arg_min(f.dir, (f.dir, f.size)) filter (f.size % 100 = w.size) as dir, count(f.name) filter (f.size % 100 <> w.size) as mismatches from w left join f using (name) group by 1""")
def m10_located(spark: Spark, d: str) -> DataFrame:
    """Files found by name in the first directory where the size is right too, and how many had the name only."""
    f = T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("dir"), (F.col("s_suppkey") % 50).alias("name"), F.col("s_suppkey").alias("size"))
    w = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("name"), (F.col("c_custkey") % 100).alias("want"))
    # Both sides are counted before they meet, so that no file is paired with all of its name.
    w = w.groupBy("id", "name", "want").agg(F.count("*").alias("times"))
    by_size = f.where("name is not null").groupBy("name", (F.col("size") % 100).alias("want")).agg(F.min_by("dir", F.when(F.col("dir").isNotNull(), F.struct("dir", "size"))).alias("dir"), F.count("*").alias("right"))
    by_name = by_size.groupBy("name").agg(F.sum("right").alias("named"))
    both = w.join(by_name, "name", "left").join(by_size, ["name", "want"], "left")
    return both.select("id", "dir", ((F.coalesce("named", F.lit(0)) - F.coalesce("right", F.lit(0))) * F.col("times")).alias("mismatches"))


@query("select user_id, case when count(distinct event_type) filter (value > 190) = 1 then max(event_type) filter (value > 190) when count(distinct event_type) = 1 then max(event_type) else 'ambiguous' end as pick from events group by 1")
def m15_only_one(spark: Spark, d: str) -> DataFrame:
    """The one that fits, else the only one there is, else none: ambiguity is refused."""
    good = F.when(F.col("value") > 190, F.col("event_type"))
    return T.table(spark, d, "events").groupBy("user_id").agg(F.when(F.countDistinct(good) == 1, F.max(good)).when(F.countDistinct("event_type") == 1, F.max("event_type")).otherwise("ambiguous").alias("pick"))


@query(T.SQL + "select recording_id, event_id, 1700000000000 + round_even((t + 0.25) * 1000, 0)::bigint as epoch_ms from points where kind = 'purchase'")
def m17_synthetic_presses(spark: Spark, d: str) -> DataFrame:
    return T.points(spark, d).where("kind = 'purchase'").select("recording_id", "event_id", (F.lit(1_700_000_000_000) + F.bround((F.col("t") + 0.25) * 1000).cast("long")).alias("epoch_ms"))


@query(T.SQL + "select recording_id, kind, min(value) as low, round(median(value), 9) as median, max(value) as high, count(value) as n from series where t between 86400 and 432000 group by all")
def m18_inspect(spark: Spark, d: str) -> DataFrame:
    s = T.series(spark, d).where("t between 86400 and 432000")
    return s.groupBy("recording_id", "kind").agg(F.min("value").alias("low"), F.round(F.median("value"), 9).alias("median"), F.max("value").alias("high"), F.count("value").alias("n"))


@query("select o_orderkey, date_diff('second', o_orderdate, timestamp '2001-01-01') as age_s, date_diff('second', o_orderdate, timestamp '2001-01-01') between 0 and 8640000 and o_custkey % 7 <> 3 as live_elsewhere from orders")
def m6_heartbeat(spark: Spark, d: str) -> DataFrame:
    age = F.expr("timestampdiff(SECOND, o_orderdate, timestamp_ntz '2001-01-01 00:00:00')")
    return T.table(spark, d, "orders").select("o_orderkey", age.alias("age_s"), (age.between(0, 8_640_000) & (F.col("o_custkey") % 7 != 3)).alias("live_elsewhere"))


@query("select o_orderkey, coalesce(o_orderstatus, 'unknown') as status, coalesce(nullif(o_orderpriority, '1-URGENT'), 'default') as priority from orders")
def m5_rebuilt(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select("o_orderkey", F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"), F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("default")).alias("priority"))


@query("select doc_id, case doc_id % 3 when 0 then '{\"a\": ' || doc_id || '}' when 1 then '{\"b\": {\"c\": 2}}' end as reply from documents")
def p11_tail_json(spark: Spark, d: str) -> DataFrame:
    """The last JSON object in a text that talks around it."""
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, F.concat(F.lit('so {x} then {"a": '), n.cast("string"), F.lit("} ok"))).when(n % 3 == 1, 'well {"b": {"c": 2}}').otherwise("no } object {")
    return T.table(spark, d, "documents").select("doc_id", X.tail_json(said).alias("reply"))
