"""Queries of predicates (P), plain joins (J) and counts (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..sources import logs
from ..sources import tables as T
from .registry import query

Spark = SparkSession


@query(T.SQL + "select recording_id, event_id, round((1700000000000 + us // 1000 - 1700000000000) / 1000.0::double, 3) as t from points")
def p1_relative_seconds(spark: Spark, d: str) -> DataFrame:
    ms = F.lit(1_700_000_000_000) + F.expr("us div 1000")
    return T.points(spark, d).select("recording_id", "event_id", F.round(logs.relative_seconds(ms, F.lit(1_700_000_000_000)), 3).alias("t"))


@query(T.SQL + "select recording_id, seq from segments where t_end >= 15 and t_start <= 30")
def p2_lines_in(spark: Spark, d: str) -> DataFrame:
    return T.segments(spark, d).where("t_end >= 15 and t_start <= 30").select("recording_id", "seq")


@query("select vec_id from embeddings where label = 3 and len(embedding) = 64")
def p4_one_model(spark: Spark, d: str) -> DataFrame:
    """Vectors of one model; another size under it is an error."""
    e = T.table(spark, d, "embeddings").where("label = 3")
    return e.where(F.when(F.size("embedding") == 64, True).otherwise(F.raise_error(F.lit("vectors of one model differ in size")).cast("boolean"))).select("vec_id")


@query(T.SQL + "select recording_id, id, coalesce(case when id % 4 = 0 then t_start + 60 end, t_start) as t_start, coalesce(case when id % 4 = 1 then t_end - 60 end, t_end) as t_end from windows")
def p5_adjusted_bounds(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).withColumn("adjusted_start", F.when(F.col("id") % 4 == 0, F.col("t_start") + 60)).withColumn("adjusted_end", F.when(F.col("id") % 4 == 1, F.col("t_end") - 60))
    return w.select("recording_id", "id", F.coalesce("adjusted_start", "t_start").alias("t_start"), F.coalesce("adjusted_end", "t_end").alias("t_end"))


@query(T.SQL + "select w.recording_id, w.id, t_end > t_start and t_start >= 0 and t_end <= duration + 0.001 and isfinite(t_start) and isfinite(t_end) as valid from windows w join recordings using (recording_id)")
def p6_valid_window(spark: Spark, d: str) -> DataFrame:
    a, b = F.col("t_start"), F.col("t_end")
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return T.windows(spark, d).join(T.recordings(spark, d), "recording_id").select("recording_id", "id", ((b > a) & (a >= 0) & (b <= F.col("duration") + 0.001) & finite).alias("valid"))


@query("select o_orderkey, o_totalprice as total, o_custkey::double as context from orders")
def p7_split_map(spark: Spark, d: str) -> DataFrame:
    """Contributions and context (keys that begin with _) of one map."""
    m = F.create_map(F.lit("total"), F.col("o_totalprice"), F.lit("_context"), F.col("o_custkey").cast("double"))
    o = T.table(spark, d, "orders").select("o_orderkey", m.alias("m"))
    hidden = lambda k, v: k.startswith("_")
    return o.select("o_orderkey", F.map_filter("m", lambda k, v: ~hidden(k, v))["total"].alias("total"), F.map_filter("m", hidden)["_context"].alias("context"))


@query("select event_id, case when event_type in ('view', 'click') then value > 60 else value > 0 end as fires from events")
def p8_fires(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), F.col("value") > 60).otherwise(F.col("value") > 0).alias("fires"))


@query(T.SQL + """, a as (select w.recording_id, w.id, count(p.event_id) > 0 as inside, w.score > 50 as contributed from windows w left join points p on p.recording_id = w.recording_id and p.kind = 'signup' and p.t between w.t_start and w.t_end group by w.recording_id, w.id, w.score)
select *, inside or contributed as anchored from a""")
def p9_anchored(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d)
    hits = J.points_in(T.points(spark, d).where("kind = 'signup'").select("recording_id", "t"), w.select("recording_id", "id", "t_start", "t_end"), "recording_id", "t", "t_start", "t_end", 3600.0).select("recording_id", "id").distinct().withColumn("hit", F.lit(True))
    out = w.join(hits, ["recording_id", "id"], "left").select("recording_id", "id", F.coalesce("hit", F.lit(False)).alias("inside"), (F.col("score") > 50).alias("contributed"))
    return out.withColumn("anchored", F.col("inside") | F.col("contributed"))


CLAIM = """with c as (select doc_id, case doc_id % 5 when 0 then 'x' || doc_id when 1 then (doc_id + 900000)::varchar else doc_id::varchar end as raw, case doc_id % 3 when 0 then '' when 1 then upper(substr(text, 1, 12)) else 'no such words' end as quote from documents),
k as (select c.*, d.text as body, try_cast(raw as bigint) as n, d.doc_id is not null as known from c left join documents d on d.doc_id = try_cast(raw as bigint)),
r as (select doc_id, case when n is null then 'malformed' when not known then 'unknown-id' when quote = '' then 'no-quote' when not contains(trim(regexp_replace(lower(body), '\\s+', ' ', 'g')), trim(regexp_replace(lower(quote), '\\s+', ' ', 'g'))) then 'bad-quote' else 'kept' end as reason from k)"""


@query(CLAIM + "select * from r")
def p10_validated(spark: Spark, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    raw = F.when(n % 5 == 0, F.concat(F.lit("x"), n.cast("string"))).when(n % 5 == 1, (n + 900_000).cast("string")).otherwise(n.cast("string"))
    quote = F.when(n % 3 == 0, "").when(n % 3 == 1, X.raised(F.substring("text", 1, 12))).otherwise("no such words")
    claims = docs.select("doc_id", raw.alias("raw"), quote.alias("quote"))
    return X.validated(claims, docs.select(F.col("doc_id").alias("known_id"), F.col("text").alias("body")), "raw", "quote").select("doc_id", "reason")


@query(CLAIM + "select round_even(count(*) filter (reason = 'unknown-id') / count(*)::double, 4) as invalid_id_rate, count(*) as returned from r")
def p10_invalid_rate(spark: Spark, d: str) -> DataFrame:
    return p10_validated(spark, d).agg(F.bround(F.count_if(F.col("reason") == "unknown-id") / F.count("*"), 4).alias("invalid_id_rate"), F.count("*").alias("returned"))


@query("select page_id, case when starts_with(url, 'http://') then 'https://' || substr(url, 8) else url end as url from pages")
def p12_relink(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "pages").select("page_id", X.relinked(F.col("url"), "http://", "https://").alias("url"))


@query("select conv_id, turn, case when role = 'user' then 'mic' when turn % 2 = 0 and role = 'assistant' then 'party' else '' end as role from conversations")
def p13_role(spark: Spark, d: str) -> DataFrame:
    by_track, by_speaker = F.create_map(F.lit("user"), F.lit("mic")), F.create_map(F.lit("even-assistant"), F.lit("party"))
    c = T.table(spark, d, "conversations")
    speaker = F.concat(F.when(F.col("turn") % 2 == 0, "even-").otherwise("odd-"), "role")
    return c.select("conv_id", "turn", F.coalesce(F.try_element_at(by_track, F.col("role")), F.try_element_at(by_speaker, speaker), F.lit("")).alias("role"))


@query(T.SQL + "select w.recording_id, w.id, r.rating from windows w join ratings r on r.id = w.id where r.source = 'operator'")
def j1_rated(spark: Spark, d: str) -> DataFrame:
    return T.windows(spark, d).join(T.ratings(spark, d).where("source = 'operator'"), "id").select("recording_id", "id", "rating")


@query(T.SQL + "select w.recording_id, w.id, r.rating, r.source from windows w left join ratings r on r.id = w.id")
def j2_with_ratings(spark: Spark, d: str) -> DataFrame:
    return T.windows(spark, d).join(T.ratings(spark, d), "id", "left").select("recording_id", "id", "rating", "source")


@query("select e.vec_id, e.label, d.lang, d.source from embeddings e join documents d on d.doc_id = e.vec_id")
def j3_hydrated(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").select("vec_id", "label").join(T.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")


@query("select doc_id from documents where not exists (select 1 from embeddings where vec_id = doc_id)")
def j7_missing(spark: Spark, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return T.table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left_anti")


@query("select doc_id from documents where exists (select 1 from conversations where conv_id = doc_id)")
def j8_present(spark: Spark, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return T.table(spark, d, "documents").select("doc_id").join(c, "doc_id", "left_semi")


@query(T.SQL + "select recording_id, kind, i, value, least(greatest(round_even(t / 86400, 0), 0), 3)::bigint as day from series where t between 86400 and 259200")
def j11_nearest_sample(spark: Spark, d: str) -> DataFrame:
    s = T.series(spark, d).where("t between 86400 and 259200")
    return s.select("recording_id", "kind", "i", "value", F.least(F.greatest(F.bround(F.col("t") / 86400), F.lit(0.0)), F.lit(3.0)).cast("long").alias("day"))


@query(T.SQL + """select a.recording_id, a.id, exists (select 1 from windows b where b.recording_id = a.recording_id and b.id <> a.id and b.t_start < a.t_end - 1e-9 and a.t_start < b.t_end - 1e-9) as overlaps from windows a""")
def j13_overlaps_other(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).select("recording_id", "id", "t_start", "t_end")
    o = w.select("recording_id", F.col("id").alias("o_id"), F.col("t_start").alias("o_start"), F.col("t_end").alias("o_end"))
    hit = J.overlapping(w, o, "recording_id", "t_start", "t_end", "o_start", "o_end", 3600.0).where((F.col("id") != F.col("o_id")) & (F.col("o_start") < F.col("t_end") - 1e-9) & (F.col("t_start") < F.col("o_end") - 1e-9))
    return w.join(hit.select("recording_id", "id").distinct().withColumn("hit", F.lit(True)), ["recording_id", "id"], "left").select("recording_id", "id", F.coalesce("hit", F.lit(False)).alias("overlaps"))


@query("select o_orderkey, l_linenumber, o_orderdate, l_quantity from orders join lineitem on l_orderkey = o_orderkey")
def j14_items(spark: Spark, d: str) -> DataFrame:
    items = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return T.table(spark, d, "orders").select("o_orderkey", "o_orderdate").join(items, "o_orderkey")


@query(T.SQL + "select w.recording_id, w.id, w.score from windows w join ratings r on r.id = w.id and r.rating >= 2 where exists (select 1 from points p where p.recording_id = w.recording_id and p.kind = 'click' and p.t between w.t_start and w.t_end) order by w.score desc, w.id limit 40")
def j16_compilation(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).join(T.ratings(spark, d).where("rating >= 2"), "id", "left_semi")
    hit = J.points_in(T.points(spark, d).where("kind = 'click'").select("recording_id", "t"), w.select("recording_id", "id", "t_start", "t_end"), "recording_id", "t", "t_start", "t_end", 3600.0).select("recording_id", "id").distinct()
    return w.join(hit, ["recording_id", "id"], "left_semi").select("recording_id", "id", "score").orderBy(F.desc("score"), "id").limit(40)


@query(T.SQL + "select rating, source, count(*) as n from ratings group by grouping sets ((rating), (source))")
def a1_marginals(spark: Spark, d: str) -> DataFrame:
    r = T.ratings(spark, d)
    return r.groupingSets([[r.rating], [r.source]], r.rating, r.source).agg(F.count("*").alias("n"))


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select count(*) from events where user_id = c_custkey) as n_events, (select count(distinct event_type) from events where user_id = c_custkey) as n_kinds from customer")
def a2_counts(spark: Spark, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    e = T.table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"), F.countDistinct("event_type").alias("n_kinds"))
    return T.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left").na.fill(0)


@query("select count(*) as n, count(lang) as n_lang, count(distinct source) as n_sources, list_aggregate(list_sort(list(distinct lang)), 'string_agg', ',') as langs from documents")
def a3_survey(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "documents").agg(F.count("*").alias("n"), F.count("lang").alias("n_lang"), F.countDistinct("source").alias("n_sources"), F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("langs"))


@query(T.SQL + ", b as (select recording_id, us // 43200000000 as i, avg(value) as value from points where kind = 'view' group by all) select recording_id, i, round(value, 9) as value, (value is not null)::int as covered from grid left join b using (recording_id, i)")
def a5_buckets(spark: Spark, d: str) -> DataFrame:
    s = T.series(spark, d).where("kind = 'view'")
    return s.select("recording_id", "i", F.round("value", 9).alias("value"), F.col("value").isNotNull().cast("int").alias("covered"))


@query(T.SQL + "select recording_id, kind, round(avg((value is not null)::int), 9) as coverage, round(avg(case when value is not null then (value > 90)::int end), 9) as rail from series group by all")
def a6_fractions(spark: Spark, d: str) -> DataFrame:
    v = F.col("value")
    return T.series(spark, d).groupBy("recording_id", "kind").agg(F.round(F.avg(v.isNotNull().cast("int")), 9).alias("coverage"), F.round(F.avg((v > 90).cast("int")), 9).alias("rail"))


@query(T.SQL + "select recording_id, kind, i // 4 as bucket, round(median(value), 9) as median from series group by all")
def a7_bucket_median(spark: Spark, d: str) -> DataFrame:
    return T.series(spark, d).groupBy("recording_id", "kind", F.floor(F.col("i") / 4).alias("bucket")).agg(F.round(F.median("value"), 9).alias("median"))


@query("""with f as (select vec_id, unnest(range(0, (64 - 16) // 8 + 1)) as frame, embedding from embeddings)
select vec_id, frame, round(20 * log10(greatest(sqrt(list_sum(list_transform(list_slice(embedding, frame * 8 + 1, frame * 8 + 16), lambda x: x::double * x::double)) / 16), power(10, -120 / 20.0::double))), 6) as db from f""")
def a9_frame_rms(spark: Spark, d: str) -> DataFrame:
    """Level of frames of 16 samples, 8 apart, in decibels with a floor of -120."""
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit((64 - 16) // 8))).alias("frame"))
    square = F.aggregate(F.slice("embedding", F.col("frame") * 8 + 1, F.lit(16)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(20 * F.log10(F.greatest(F.sqrt(square / 16), F.lit(10.0**-6))), 6).alias("db"))


@query(T.SQL + ", r as (select w.score as ms, rating from windows w left join ratings r on r.id = w.id) select floor(median(ms) filter (rating is not null))::bigint as median_ms, round(avg(ms) filter (rating is not null), 9) as mean_ms, round_even(count(*) filter (rating = 2) / nullif(count(*), 0)::double, 4) as approval from r")
def a10_review(spark: Spark, d: str) -> DataFrame:
    r = T.windows(spark, d).join(T.ratings(spark, d), "id", "left")
    ms = F.when(F.col("rating").isNotNull(), F.col("score"))
    return r.agg(F.floor(F.median(ms)).alias("median_ms"), F.round(F.avg(ms), 9).alias("mean_ms"), F.bround(F.try_divide(F.count_if(F.col("rating") == 2), F.count("*")), 4).alias("approval"))


@query("select event_type, count(*) as n, count(*) filter (cast(json_extract(props, '$.k') as int) > 5) as extended, count(*) filter (cast(json_extract(props, '$.k') as int) < 5) as trimmed, round(avg(cast(json_extract(props, '$.k') as double)), 9) as mean_k from events group by 1")
def a11_nudges(spark: Spark, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(k > 5).alias("extended"), F.count_if(k < 5).alias("trimmed"), F.round(F.avg(k.cast("double")), 9).alias("mean_k"))


@query("select cast(json_extract(props, '$.k') as int) as stage, round(sum(value), 4) as total from events group by 1")
def a12_stage_totals(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy(F.from_json("props", "k int")["k"].alias("stage")).agg(F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("total"))


@query("""with v as (select p_brand, case when p_size > 40 then 2 when p_size > 25 then 1 else 0 end as rating, unnest([{'s': 'price', 'x': p_retailprice > 1200}, {'s': 'name', 'x': length(p_name) > 12}], recursive := true) from part)
select s as signal, count(*) filter (rating = 2) as n_clip, count(*) filter (rating = 0) as n_skip, round(avg(x::int) filter (rating = 2), 9) as fired_clip, round(avg(x::int) filter (rating = 0), 9) as fired_skip from v where rating <> 1 group by 1""")
def a14_firing(spark: Spark, d: str) -> DataFrame:
    p = T.table(spark, d, "part").withColumn("rating", F.when(F.col("p_size") > 40, 2).when(F.col("p_size") > 25, 1).otherwise(0)).where("rating != 1")
    m = F.create_map(F.lit("price"), F.col("p_retailprice") > 1200, F.lit("name"), F.length("p_name") > 12)
    x = p.select("rating", F.explode(m).alias("signal", "x"))
    rate = lambda r: F.round(F.avg(F.when(F.col("rating") == r, F.col("x").cast("int"))), 9)
    return x.groupBy("signal").agg(F.count_if(F.col("rating") == 2).alias("n_clip"), F.count_if(F.col("rating") == 0).alias("n_skip"), rate(2).alias("fired_clip"), rate(0).alias("fired_skip"))


@query(T.SQL + """, a as (select w.id, r.rating = 2 as approved, exists (select 1 from points p where p.recording_id = w.recording_id and p.kind = 'signup' and p.t between w.t_start and w.t_end) as anchored from windows w join ratings r on r.id = w.id)
select round_even(count(*) filter (anchored and approved) / nullif(count(*) filter (anchored), 0)::double, 4) as precision, round_even(count(*) filter (approved and not anchored) / nullif(count(*) filter (approved), 0)::double, 4) as unmarked from a""")
def a15_marker_value(spark: Spark, d: str) -> DataFrame:
    a = p9_anchored(spark, d).join(T.ratings(spark, d), "id").select((F.col("rating") == 2).alias("approved"), F.col("inside").alias("anchored"))
    n = F.count_if
    return a.agg(F.bround(F.try_divide(n(F.col("anchored") & F.col("approved")), n("anchored")), 4).alias("precision"), F.bround(F.try_divide(n(F.col("approved") & ~F.col("anchored")), n("approved")), 4).alias("unmarked"))


@query("select string_agg(distinct event_type, '+' order by event_type) as found_by, user_id from events group by user_id")
def a17_found_by(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy("user_id").agg(F.concat_ws("+", F.array_sort(F.collect_set("event_type"))).alias("found_by"))


@query("select user_id, round(avg((value > 50)::int), 9) as share from events group by 1")
def a18_share(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("value") > 50).cast("int")), 9).alias("share"))


@query(T.SQL + """, p as (select recording_id, avg(power(10.0::double, value / 100)) filter (kind = 'view') as mic, avg(power(10.0::double, value / 100)) filter (kind = 'click') as party from points group by 1)
select recording_id, case when mic is null and party is null then 'unknown' when party is null or mic >= 1.5 * party then 'mic' when mic is null or party >= 1.5 * mic then 'party' else 'both' end as speaker from p""")
def a19_speaker(spark: Spark, d: str) -> DataFrame:
    """Louder by half in mean power wins; near ties are both."""
    power = lambda k: F.avg(F.when(F.col("kind") == k, F.pow(F.lit(10.0), F.col("value") / 100)))
    p = T.points(spark, d).groupBy("recording_id").agg(power("view").alias("mic"), power("click").alias("party"))
    m, q = F.col("mic"), F.col("party")
    return p.select("recording_id", F.when(m.isNull() & q.isNull(), "unknown").when(q.isNull() | (m >= 1.5 * q), "mic").when(m.isNull() | (q >= 1.5 * m), "party").otherwise("both").alias("speaker"))


@query(T.SQL + "select recording_id, round(least(sum(greatest(t_end - t_start, 0)) / 100, 1), 9) as coverage from segments where length(text) > 20 group by 1")
def a20_coverage(spark: Spark, d: str) -> DataFrame:
    s = T.segments(spark, d).where(F.length("text") > 20)
    return s.groupBy("recording_id").agg(F.round(F.least(F.sum(F.greatest(F.col("t_end") - F.col("t_start"), F.lit(0.0))) / 100, F.lit(1.0)), 9).alias("coverage"))


@query("select vec_id, round(20 * log10(greatest(list_max(list_transform(embedding, lambda x: abs(x)::double)), 1e-6)), 6) as peak_db from embeddings")
def a21_peak(spark: Spark, d: str) -> DataFrame:
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x).cast("double")))
    return T.table(spark, d, "embeddings").select("vec_id", F.round(20 * F.log10(F.greatest(peak, F.lit(1e-6))), 6).alias("peak_db"))


@query(T.SQL + """, s as (select recording_id, kind, t, coalesce(lead(t) over (partition by recording_id order by t, event_id), duration) as e from points join recordings using (recording_id)) select kind, round(sum(e - t), 3) as seconds, count(*) as n from s group by 1""")
def a22_held(spark: Spark, d: str) -> DataFrame:
    from ..operators import windows as W

    sw = T.points(spark, d).join(T.recordings(spark, d), "recording_id").withColumn("e", F.coalesce(F.lead("t").over(W.ordered(["recording_id"], ["t", "event_id"])), F.col("duration")))
    return sw.groupBy("kind").agg(F.round(F.sum(F.col("e") - F.col("t")), 3).alias("seconds"), F.count("*").alias("n")).orderBy(F.desc("seconds"))


@query(T.SQL + "select count(*) as n, count(*) filter (rating = 2) as approved, count(*) filter (rating = 0) as refused from ratings where source = 'operator'")
def a23_corpus(spark: Spark, d: str) -> DataFrame:
    return T.ratings(spark, d).where("source = 'operator'").agg(F.count("*").alias("n"), F.count_if(F.col("rating") == 2).alias("approved"), F.count_if(F.col("rating") == 0).alias("refused"))
