"""Queries of selection (T), segmentation (H), functions (F), small operators (M), streaming in batch (R) and extensions (Z)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as C
from ..functions import text as X
from ..operators import density as D
from ..operators import graphs as G
from ..operators import joins as J
from ..operators import selection as S
from ..operators import windows as W
from ..operators.boundaries import embedding_boundaries
from ..operators.framing import constant_rate
from ..operators.phrases import phrase_hits
from ..sources import store
from ..sources import tables as T
from .registry import query

Spark = SparkSession
DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::double * z[2]::double))"


@query(f"select e.vec_id, round({DOT}, 6) as score from embeddings e, (select embedding from embeddings where vec_id = 7) q order by round_even({DOT}, 5) desc, vec_id limit 20")
def t1_top_k(spark: Spark, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings")
    q = e.where("vec_id = 7").select("embedding").limit(1).collect()[0].embedding
    return S.top_k(e, q, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("select coalesce(max(lang) filter (lang = 'xx'), min(lang)) as model from documents")
def t2_default_model(spark: Spark, d: str) -> DataFrame:
    return S.default_model(T.table(spark, d, "documents").select(F.col("lang").alias("model")), "xx")


@query(T.SQL + """, x as (select recording_id, id, t_peak, score, id % 7 = 0 as anchored, (id * 37 % 100)::double as e, (id * 53 % 100)::double as g from windows),
r as (select *, row_number() over (partition by recording_id order by score desc, t_peak, id) as r from x), s as (select *, case when r <= 3 then 'combined' when anchored then 'markers' when e >= g then 'entertainment' else 'gameplay' end as section from r)
select recording_id, id, section, row_number() over (partition by recording_id, section order by case section when 'markers' then t_peak when 'entertainment' then -e when 'gameplay' then -g else -score end, id) as place from s""")
def t3_sections(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).withColumn("anchored", F.col("id") % 7 == 0).withColumn("e", (F.col("id") * 37 % 100).cast("double")).withColumn("g", (F.col("id") * 53 % 100).cast("double"))
    return S.sections(w, 3).select("recording_id", "id", "section", "place")


@query(T.SQL + "select recording_id, id, score, t_peak, row_number() over (order by score desc, t_peak, id) as place from windows")
def t4_order(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d).select("recording_id", "id", "score", "t_peak")
    # Places over all rows without one task for all: by score class first, then within.
    classed = w.withColumn("c", F.floor("score"))
    base = classed.groupBy("c").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "t_peak", "id")) + F.col("base")
    return classed.join(base, "c").select("recording_id", "id", "score", "t_peak", place.alias("place"))


@query(T.SQL + """, rt as (select w.recording_id, w.id, t_start, t_end, rating, id % 4 = 0 as adjusted, id % 3 = 2 as is_current, t_peak as rated_at from windows w join ratings r using (id)),
o as (select *, max(t_end) over (partition by recording_id order by t_start, t_end, id rows between unbounded preceding and 1 preceding) as b from rt), c as (select *, sum(case when b is null or t_start > b then 1 else 0 end) over (partition by recording_id order by t_start, t_end, id)::bigint - 1 as cluster from o),
a as (select recording_id, cluster, arg_max(rating, (rated_at, id)) as verdict, coalesce(min(t_start) filter (rating >= 2 and adjusted), min(t_start) filter (rating >= 2)) as t_start, coalesce(max(t_end) filter (rating >= 2 and adjusted), max(t_end) filter (rating >= 2)) as t_end, not coalesce(bool_or(is_current) filter (rating >= 2), false) as rescued from c group by 1, 2)
select recording_id, cluster, verdict, round(t_start, 6) as t_start, round(t_end, 6) as t_end, rescued from a where verdict >= 2""")
def t5_approved(spark: Spark, d: str) -> DataFrame:
    r = T.windows(spark, d).join(T.ratings(spark, d), "id").withColumn("adjusted", F.col("id") % 4 == 0).withColumn("is_current", F.col("id") % 3 == 2).withColumn("rated_at", F.col("t_peak"))
    return S.approved(r, 2).select("recording_id", "cluster", "verdict", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "rescued")


@query("select p_type as name, min(p_partkey) as place from part group by 1 order by 2 limit 8")
def t6_first_seen(spark: Spark, d: str) -> DataFrame:
    return S.first_seen(T.table(spark, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("place")), "name", "place", 8)


@query("select l_orderkey, list_aggregate(list_slice(list(l_linenumber order by l_extendedprice desc, l_linenumber), 1, 3), 'string_agg', ',') as top from lineitem group by 1")
def t7_top_contributors(spark: Spark, d: str) -> DataFrame:
    x = F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("k"), "l_linenumber")))
    return T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(x, 1, 3).alias("t")).select("l_orderkey", F.array_join(F.transform("t", lambda v: v["l_linenumber"].cast("string")), ",").alias("top"))


@query("select o_custkey, max(o_orderkey) as version, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1")
def t8_latest_version(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@query(T.SQL + "select recording_id, count(*) as n, count(*) >= 12 as rankable from windows group by 1")
def t9_rankable(spark: Spark, d: str) -> DataFrame:
    return T.windows(spark, d).groupBy("recording_id").agg(F.count("*").alias("n"), (F.count("*") >= 12).alias("rankable"))


@query(T.SQL + """, q as (select recording_id, i, bool_and(value is null) as quiet from series group by 1, 2), g as (select *, i - row_number() over (partition by recording_id, quiet order by i) as g from q)
select recording_id, (max(i) + 1) * 43200.0::double as t, count(*) * 43200.0::double as strength from g where quiet group by recording_id, g having count(*) >= 2""")
def h1_silence(spark: Spark, d: str) -> DataFrame:
    """Boundaries at the ends of silences of two buckets or more."""
    q = T.series(spark, d).groupBy("recording_id", "i").agg(F.bool_and(F.col("value").isNull()).alias("quiet"))
    r = W.runs(q, ["recording_id"], "i", "quiet").where("end - start >= 2")
    return r.select("recording_id", (F.col("end") * 43200.0).alias("t"), ((F.col("end") - F.col("start")) * 43200.0).alias("strength"))


@query("""with e as (select label, vec_id, row_number() over (partition by label order by vec_id) as r, embedding from embeddings), u as (select label, r, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from e),
s as (select label, k, r, sum(x) over (partition by label, k order by r rows between 2 preceding and current row) as b, sum(x) over (partition by label, k order by r rows between 1 following and 3 following) as a, count(*) over (partition by label, k order by r rows between 2 preceding and current row) as nb, count(*) over (partition by label, k order by r rows between 1 following and 3 following) as na from u)
select e.label, e.vec_id, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) as depth from s join e using (label, r) where nb = 3 and na = 3 group by all""")
def h2_shift(spark: Spark, d: str) -> DataFrame:
    return S.embedding_shift(T.table(spark, d, "embeddings"), "label", "vec_id", "embedding", 3).select("label", "vec_id", F.round("depth", 6).alias("depth"))


@query("""with e as (select label, vec_id, row_number() over (partition by label order by vec_id) as r, embedding from embeddings), u as (select label, r, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from e),
s as (select label, k, r, sum(x) over (partition by label, k order by r rows between 2 preceding and current row) as b, sum(x) over (partition by label, k order by r rows between 1 following and 3 following) as a, count(*) over (partition by label, k order by r rows between 2 preceding and current row) as nb, count(*) over (partition by label, k order by r rows between 1 following and 3 following) as na from u),
d as (select label, r, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) as x from s where nb = 3 and na = 3 group by all), v as (select *, lag(x) over w as px, lead(x) over w as nx, stddev_pop(x) over (partition by label) as sd, count(*) over (partition by label) as n from d window w as (partition by label order by r)),
pk as (select p.*, (select max(r) from v where v.label = p.label and v.r < p.r and v.x > p.x) as lo, (select min(r) from v where v.label = p.label and v.r > p.r and v.x > p.x) as hi from v p where px < x and nx < x and n >= 3),
pr as (select label, r, sd, x - greatest((select min(x) from v where v.label = pk.label and v.r <= pk.r and v.r > coalesce(lo, -1)), (select min(x) from v where v.label = pk.label and v.r >= pk.r and v.r < coalesce(hi, 1000000000))) as p from pk)
select pr.label, (a.vec_id * 10 + 7 + b.vec_id * 10) / 2.0::double as t, round(p / sd, 6) as strength from pr join e a on a.label = pr.label and a.r = pr.r join e b on b.label = pr.label and b.r = pr.r + 1 where p >= sd""")
def h2_boundaries(spark: Spark, d: str) -> DataFrame:
    """Boundaries between vectors that stand for segments of seven seconds, at peaks of one standard deviation or more."""
    e = T.table(spark, d, "embeddings").select("label", "vec_id", "embedding", (F.col("vec_id") * 10.0).alias("t_start"), (F.col("vec_id") * 10.0 + 7).alias("t_end"))
    return embedding_boundaries(e, "label", "vec_id", "embedding", "t_start", "t_end", 3).select("label", "t", F.round("strength", 6).alias("strength"))


@query(T.SQL + ", s as (select *, lag(kind) over w as was, t - lag(t) over w as held from points window w as (partition by recording_id order by t, event_id)) select recording_id, event_id, round(t, 6) as t from s where kind <> was and held >= 21600")
def h3_scene_boundaries(spark: Spark, d: str) -> DataFrame:
    """Where the scene becomes another after it was held for six hours or more."""
    w = Window.partitionBy("recording_id").orderBy("t", "event_id")
    s = T.points(spark, d).withColumn("was", F.lag("kind").over(w)).withColumn("held", F.col("t") - F.lag("t").over(w))
    return s.where("kind != was and held >= 21600").select("recording_id", "event_id", F.round("t", 6).alias("t"))


@query("with recursive " + T.SQL.strip()[5:] + """, b as (select distinct recording_id, t from points where kind = 'signup' and t > 0), c(recording_id, t) as (select recording_id, min(t) from b group by 1 union all select n.recording_id, n.t from (select c.recording_id, (select min(b.t) from b where b.recording_id = c.recording_id and b.t - c.t > 86400) as t from c) n where n.t is not null)
select recording_id, round(t, 6) as t from c""")
def h4_boundary_merge(spark: Spark, d: str) -> DataFrame:
    """Boundaries within a day of the first of their cluster are one."""
    out = S.anchored_clusters(T.points(spark, d).where("kind = 'signup' and t > 0").select("recording_id", "t"), 86_400.0)
    return out.select("recording_id", F.round("t", 6).alias("t"))


@query(T.SQL + """, quiet as (select recording_id, i, bool_and(value is null) as q from series group by 1, 2), g as (select *, i - row_number() over (partition by recording_id, q order by i) as g from quiet), sil as (select recording_id, (max(i) + 1) * 43200.0::double as t from g where q group by recording_id, g having count(*) >= 2),
found as (select recording_id, 'silence' as input, t from sil union all select recording_id, 'shift', t from points where kind = 'purchase' and value > 190 union all select recording_id, 'scene', t from points where kind = 'signup'),
data as (select distinct recording_id, 'silence' as input from points union all select distinct recording_id, 'shift' from points where kind = 'purchase' union all select distinct recording_id, 'scene' from points where kind = 'signup'),
n as (select f.recording_id, input, count(*) as n from found f join recordings r using (recording_id) where t > 0 and t < duration group by all)
select r.recording_id, i.input, coalesce(n.n, 0) as n, case when i.input = 'game' then 'nothing produces it' when data.input is null then 'no data' when n.n is null then 'no boundary met the threshold' end as reason
from recordings r cross join (values ('silence'), ('shift'), ('scene'), ('game')) i(input) left join n on n.recording_id = r.recording_id and n.input = i.input left join data on data.recording_id = r.recording_id and data.input = i.input""")
def h7_inputs(spark: Spark, d: str) -> DataFrame:
    """What each input of the segmentation gave, or why it gave nothing."""
    p = T.points(spark, d)
    q = T.series(spark, d).groupBy("recording_id", "i").agg(F.bool_and(F.col("value").isNull()).alias("quiet"))
    silence = W.runs(q, ["recording_id"], "i", "quiet").where("end - start >= 2").select("recording_id", (F.col("end") * 43200.0).alias("t"))
    bought, joined = p.where("kind = 'purchase'"), p.where("kind = 'signup'")
    return S.input_reasons(T.recordings(spark, d), {"silence": (p, silence), "shift": (bought, bought.where("value > 190")), "scene": (joined, joined)}, ("game",))


@query(T.SQL + """, o as (select p.recording_id, t from points p join recordings s using (recording_id) where kind = 'signup' and t > 0 and t < duration union select recording_id, 0.0 from recordings)
select recording_id, row_number() over (partition by recording_id order by t) - 1 as chapter, round(t, 6) as t_start, round(coalesce(lead(t) over (partition by recording_id order by t), duration), 6) as t_end from o join recordings using (recording_id)""")
def h5_tiling(spark: Spark, d: str) -> DataFrame:
    out = S.tiling(T.points(spark, d).where("kind = 'signup'").select("recording_id", "t"), T.recordings(spark, d).select("recording_id", "duration"))
    return out.select("recording_id", "chapter", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"))


@query("select event_id, round(case when value > 0 then 12 * log2(value / 100) end, 6) as semitones, round(power(10.0::double, value / 100), 6) as power, round(0.5 * (1 - cos(pi() * least(greatest(value / 100, 0), 1))), 6) as cosine from events")
def f1_scales(spark: Spark, d: str) -> DataFrame:
    from ..operators.signals import semitones

    v = F.col("value")
    x = F.least(F.greatest(v / 100, F.lit(0.0)), F.lit(1.0))
    return T.table(spark, d, "events").select("event_id", F.round(semitones(v), 6).alias("semitones"), F.round(F.pow(F.lit(10.0), v / 100), 6).alias("power"), F.round(0.5 * (1 - F.cos(F.lit(3.141592653589793) * x)), 6).alias("cosine"))


NORMAL = r"trim(regexp_replace(replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s'']', ' ', 'g'), '''', ''), '\s+', ' ', 'g'))"


@query(f"select conv_id, turn, {NORMAL} as words from conversations")
def f3_normal(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "conversations").select("conv_id", "turn", X.normal(F.col("text")).alias("words"))


@query(f"with w as (select conv_id, string_split({NORMAL}, ' ') as w from conversations where {NORMAL} <> ''), g as (select conv_id, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram from w, range(2, 4) t(n), unnest(range(1, len(w) - n + 2)) u(i)) select gram, count(*) as n, count(distinct conv_id) as n_recordings from g group by 1 having count(*) >= 5")
def f6_ngrams(spark: Spark, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations").select("conv_id", X.normal(F.col("text")).alias("t")).where("t != ''")
    g = c.select("conv_id", F.explode(X.ngrams(F.split("t", " "), 2, 3)).alias("gram")).groupBy("gram", "conv_id").agg(F.count("*").alias("n"))
    return g.groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("n_recordings")).where("n >= 5")


@query(f"select conv_id, turn, contains(' ' || {NORMAL} || ' ', ' of the ') as has, len(list_filter(string_split({NORMAL}, ' '), lambda x: not list_contains([{', '.join(repr(w) for w in X.FILLER)}], x))) = 0 as filler from conversations union all select -1, 0, false, true union all select -1, 1, true, false")
def f7_contains_words(spark: Spark, d: str) -> DataFrame:
    """Which turns have a phrase as whole words, and which are nothing but filler; two made ones among them."""
    c = T.table(spark, d, "conversations").select("conv_id", "turn", "text")
    made = spark.createDataFrame([(-1, 0, "Oh, um... you and I!"), (-1, 1, "It was one of the")], "conv_id long, turn long, text string").select(F.col("conv_id").cast(dict(c.dtypes)["conv_id"]), F.col("turn").cast(dict(c.dtypes)["turn"]), "text")
    t = X.normal(F.col("text"))
    return c.unionByName(made).select("conv_id", "turn", X.contains_words(t, F.lit("of the")).alias("has"), X.is_filler(F.split(t, " ")).alias("filler"))


PHRASES = ("of the", "to", "on the")
APART = r"[^\p{L}\p{M}\p{N}_]"
WANTED = " union all ".join(f"""select conv_id, turn, '{p}' as phrase from conversations where regexp_matches(text, '(?i)(^|{APART}){(APART + "+").join("".join(c + r"\s*''?\s*" for c in w[:-1]) + w[-1] for w in p.split())}($|{APART})')""" for p in PHRASES)


@query(WANTED)
def f8_phrase(spark: Spark, d: str) -> DataFrame:
    """One row for each listed phrase that a turn has."""
    return phrase_hits(T.table(spark, d, "conversations"), ["conv_id", "turn"], "text", spark.createDataFrame([(p,) for p in PHRASES], "phrase string"))


SAID = "select conv_id, turn, '[' || list_aggregate(list_transform(range(1, 3 + turn % 9), lambda i: '{{\"start\": ' || case when i % 4 = 0 then 'null' else (i * 2)::varchar end || ', \"end\": ' || (i * 2 + 1)::varchar || '}}'), 'string_agg', ', ') || ']' as words from conversations".replace("{{", "{").replace("}}", "}")


@query(f"""with s as ({SAID}), p as (select conv_id, turn, json_transform(words::json, '[{{"start": "DOUBLE", "end": "DOUBLE"}}]') as w from s), c as (select conv_id, turn, len(w) as total, list_transform(list_filter(w, lambda x: x.start is not null and x.end is not null), lambda x: (x.start + x.end) / 2) as c from p) select conv_id, turn, len(c)::bigint as aligned, total::bigint as total, list_sum(c) as centres from c""")
def f10_aligned_words(spark: Spark, d: str) -> DataFrame:
    """Centres of the words that have times, out of JSON; words without are counted only."""
    i = F.transform(F.sequence(F.lit(1), F.lit(2) + F.col("turn") % 9), lambda i: F.concat(F.lit('{"start": '), F.when(i % 4 == 0, "null").otherwise((i * 2).cast("string")), F.lit(', "end": '), (i * 2 + 1).cast("string"), F.lit("}")))
    a = T.table(spark, d, "conversations").select("conv_id", "turn", X.aligned_words(F.concat(F.lit("["), F.array_join(i, ", "), F.lit("]"))).alias("a"))
    return a.select("conv_id", "turn", "a.aligned", "a.total", F.aggregate("a.centres", F.lit(0.0), lambda s, x: s + x).alias("centres"))


@query("with w as (select conv_id, turn, unnest(string_split_regex(trim(text), '\\s+')) as w, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) as k from conversations) select conv_id, turn, k, round(turn * 10.0::double + k * 0.1, 3) as t from w where regexp_full_match(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'the|of')")
def f9_word_times(spark: Spark, d: str) -> DataFrame:
    """When listed words are said."""
    w = T.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.trim("text"), "\\s+")))
    k = (F.col("pos") + 1).cast("long")
    return w.where(F.regexp_like(F.regexp_replace(F.lower("col"), "[^a-z]", ""), F.lit("^(?:the|of)$"))).select("conv_id", "turn", k.alias("k"), F.round(F.col("turn") * 10.0 + k * F.lit(0.1), 3).alias("t"))


SLUG = "regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40), '_+$', '')"


@query(f"with s as (select page_id, {SLUG} as s from pages) select page_id, case when row_number() over (partition by s order by page_id) = 1 then s else s || '_' || row_number() over (partition by s order by page_id) end as id from s")
def f11_slug(spark: Spark, d: str) -> DataFrame:
    p = T.table(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("s"))
    n = F.row_number().over(Window.partitionBy("s").orderBy("page_id"))
    return p.withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("s")).otherwise(F.concat_ws("_", "s", F.col("n").cast("string"))).alias("id"))


@query("select o_orderkey, printf('%d:%02d:%02d', floor(o_totalprice / 3600)::bigint, floor(o_totalprice / 60)::bigint % 60, floor(o_totalprice)::bigint % 60) as clock from orders")
def f12_clock(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select("o_orderkey", C.clock(F.col("o_totalprice")).alias("clock"))


@query("select p_partkey, '&H00' || upper(substr(c, 6, 2) || substr(c, 4, 2) || substr(c, 2, 2)) as color from (select p_partkey, '#' || substr(md5(p_name), 1, 6) as c from part)")
def f13_color(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", C.subtitle_color(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))).alias("color"))


@query(T.SQL + "select recording_id, id, floor(t_start * 30000 / 1001 + 1e-9)::bigint as first, ceil(t_end * 30000 / 1001 - 1e-9)::bigint as last from windows")
def f14_frames(spark: Spark, d: str) -> DataFrame:
    w = T.windows(spark, d)
    return w.select("recording_id", "id", C.frame_floor(F.col("t_start"), 30000, 1001).alias("first"), C.frame_ceil(F.col("t_end"), 30000, 1001).alias("last"))


@query("with r(n, d) as (values (24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1), (120, 1)), x as (select p_partkey, p_size * 1.001::double as rate from part), b as (select p_partkey, arg_min(n || '/' || d, abs(rate - n / d::double)) as name, min(abs(rate - n / d::double)) as gap, arg_min(n / d::double, abs(rate - n / d::double)) as std from x, r group by 1) select p_partkey, case when gap <= 0.005 * std then name end as rate from b")
def f15_standard_rate(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", C.standard_rate(F.col("p_size") * F.lit(1.001)).alias("rate"))


@query("select c_custkey, case when contains(lower(c_mktsegment), 'auto') then 'mic' when contains(lower(c_mktsegment), 'house') then 'party' when contains(lower(c_mktsegment), 'mach') then 'game' else '' end as role from customer")
def f16_track_role(spark: Spark, d: str) -> DataFrame:
    s = F.lower("c_mktsegment")
    return T.table(spark, d, "customer").select("c_custkey", F.when(F.contains(s, F.lit("auto")), "mic").when(F.contains(s, F.lit("house")), "party").when(F.contains(s, F.lit("mach")), "game").otherwise("").alias("role"))


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings")
def f19_norm(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(S.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@query(T.SQL + """, c as (select recording_id, t as c_start, least(t + 600, coalesce(lead(t) over (partition by recording_id order by t, event_id), t + 600)) as c_end from points where kind = 'error'), p as (select recording_id, event_id, t from points where kind = 'view')
select p.recording_id, p.event_id, round(p.t - coalesce(sum(least(c_end, p.t) - c_start), 0), 6) as mapped from p left join c on c.recording_id = p.recording_id and c_start <= p.t group by p.recording_id, p.event_id, p.t""")
def f20_cut_time(spark: Spark, d: str) -> DataFrame:
    p = T.points(spark, d)
    nxt = F.lead("t").over(Window.partitionBy("recording_id").orderBy("t", "event_id"))
    cuts = p.where("kind = 'error'").select("recording_id", F.col("t").alias("c_start"), F.least(F.col("t") + 600, F.coalesce(nxt, F.col("t") + 600)).alias("c_end"))
    return C.cut_time(p.where("kind = 'view'").select("recording_id", "event_id", "t"), cuts, "recording_id", "t").select("recording_id", "event_id", F.round("mapped", 6).alias("mapped"))


@query(T.SQL + ", n as (select *, count(*) over (partition by recording_id, kind) as n from series) select recording_id, kind, ((i + 1) * 20 - 1) // n as bucket, max(value) as value from n group by all")
def f21_sparkline(spark: Spark, d: str) -> DataFrame:
    return C.sparkline(T.series(spark, d), ["recording_id", "kind"], "i", "value", 20)


@query("select event_id, case when -14 - (value - 40) > 20 then 'refuse' else printf('%.2f', -14 - (value - 40)) end as gain from events")
def f25_gain(spark: Spark, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", C.gain(F.col("value") - 40, -14.0).alias("gain"))


@query("select doc_id, case when doc_id % 4 = 0 then (doc_id % 50)::bigint when doc_id % 4 = 1 and doc_id % 150 > 0 then greatest(100 - doc_id % 150, 0)::bigint when doc_id % 4 = 2 and doc_id % 200 < 100 then (doc_id % 200)::bigint end as first, case when doc_id % 4 = 0 then least(doc_id % 50 + 10, 99)::bigint when doc_id % 4 = 1 and doc_id % 150 > 0 then 99 when doc_id % 4 = 2 and doc_id % 200 < 100 then 99 end as last from documents")
def m11_byte_range(spark: Spark, d: str) -> DataFrame:
    n = F.col("doc_id")
    form = F.when(n % 4 == 0, F.format_string("bytes=%d-%d", n % 50, n % 50 + 10)).when(n % 4 == 1, F.format_string("bytes=-%d", n % 150)).when(n % 4 == 2, F.format_string("bytes=%d-", n % 200)).otherwise("chars=1-2")
    r = C.byte_range(form, F.lit(100).cast("long"))
    return T.table(spark, d, "documents").select("doc_id", r["first"].alias("first"), r["last"].alias("last"))


@query("select doc_id from documents where doc_id not in (select vec_id from embeddings) and doc_id not in (select conv_id from conversations)")
def m1_orphans(spark: Spark, d: str) -> DataFrame:
    used = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).unionByName(T.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")))
    return T.table(spark, d, "documents").select("doc_id").join(used, "doc_id", "left_anti")


# Of each customer's orders the k-th, by number, needs number k / 2, every third also the one before it; what is dear comes late among those that are ready.
GRAPH = "with n as (select o_custkey as graph, o_orderkey as node, row_number() over (partition by o_custkey order by o_orderkey) as k, rank() over (partition by o_custkey order by o_totalprice) as rank from orders), e as (select a.graph, a.node, b.node as needs from n a join n b on a.graph = b.graph and a.k > 1 and (b.k = a.k // 2 or (a.k % 3 = 0 and b.k = a.k - 1)))"


def order_graph(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    by = Window.partitionBy("o_custkey")
    n = T.table(spark, d, "orders").select(F.col("o_custkey").alias("graph"), F.col("o_orderkey").alias("node"), F.row_number().over(by.orderBy("o_orderkey")).alias("k"), F.rank().over(by.orderBy("o_totalprice")).alias("rank"))
    needs = F.explode(F.array_compact(F.array(F.floor(F.col("k") / 2), F.when(F.col("k") % 3 == 0, (F.col("k") - 1).cast("long")))))
    e = n.where("k > 1").select("graph", "node", needs.alias("at")).join(n.select("graph", F.col("k").alias("at"), F.col("node").alias("needs")), ["graph", "at"])
    return n.select("graph", "node", "rank"), e.select("graph", "node", "needs").distinct()


@query("with recursive " + GRAPH[5:] + ", r(graph, node, needs) as (select * from e union select r.graph, r.node, e.needs from r join e on r.graph = e.graph and r.needs = e.node) select distinct graph, node, needs from r")
def m2_ancestors(spark: Spark, d: str) -> DataFrame:
    """What each order needs, directly or through others."""
    return G.closure(order_graph(spark, d)[1])


@query("with recursive " + GRAPH[5:] + """, w as (select n.graph, n.node, n.rank, coalesce(list(e.needs) filter (e.needs is not null), []) as needs from n left join e on n.graph = e.graph and n.node = e.node group by all),
o(graph, place, node, done) as (select graph, -1::bigint, null::bigint, []::bigint[] from (select distinct graph from n)
union all select graph, place + 1, node, list_append(done, node) from (select o.graph, o.place, o.done, w.node, row_number() over (partition by o.graph order by w.rank, w.node) as first from o join w on w.graph = o.graph and not list_contains(o.done, w.node) and len(list_filter(w.needs, lambda x: not list_contains(o.done, x))) = 0) where first = 1)
select graph, node, place from o where place >= 0""")
def m2_order(spark: Spark, d: str) -> DataFrame:
    """Each customer's orders, every one after those that it needs."""
    return G.topological_order(*order_graph(spark, d)).select("graph", "node", "place")


def number_sql(v: str) -> str:
    return f"regexp_replace(regexp_replace(try_cast({v} as decimal(38, 9))::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def hash_sql(j: str) -> str:
    return f"sha256(list_aggregate(list_transform(list_sort(json_keys({j}::json)), lambda k: k || '=' || coalesce({number_sql(f'json_extract_string({j}::json, k)')}, json_extract_string({j}::json, k), 'null')), 'string_agg', ';'))"


RUNS = """with p as (select o_custkey, o_orderkey, o_orderstatus, '{"priority": "' || o_orderpriority || '", "n": ' || o_custkey::varchar || '}' as then_, '{"n": ' || (o_custkey + case when o_custkey % 11 = 0 then 1 else 0 end)::varchar || '.0, "priority": "' || o_orderpriority || '"}' as now_,
row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as seq, min(o_orderkey) over (partition by o_custkey) as needs from orders)"""


@query(RUNS + f", h as (select *, max(case when o_orderkey = needs then seq end) over (partition by o_custkey) as needs_seq, {hash_sql('then_')} <> {hash_sql('now_')} as changed from p) select o_custkey, o_orderkey, case when o_orderstatus = 'P' then 'never run' when changed then 'parameters changed' when needs_seq > seq then 'stale input' else 'skip' end as decision from h")
def m3_staleness(spark: Spark, d: str) -> DataFrame:
    """Whether a run has to be made again: it never was, its parameters hash to something else, or what it needs was completed after it."""
    by, n = Window.partitionBy("o_custkey"), F.col("o_custkey")
    x = T.table(spark, d, "orders").withColumn("seq", F.row_number().over(by.orderBy("o_totalprice", "o_orderkey"))).withColumn("needs", F.min("o_orderkey").over(by))
    x = x.withColumn("needs_seq", F.max(F.when(F.col("o_orderkey") == F.col("needs"), F.col("seq"))).over(by))
    then = F.concat(F.lit('{"priority": "'), "o_orderpriority", F.lit('", "n": '), n.cast("string"), F.lit("}"))
    now = F.concat(F.lit('{"n": '), (n + F.when(n % 11 == 0, 1).otherwise(0)).cast("string"), F.lit('.0, "priority": "'), "o_orderpriority", F.lit('"}'))
    why = F.when(F.col("o_orderstatus") == "P", "never run").when(store.params_hash(then) != store.params_hash(now), "parameters changed").when(F.col("needs_seq") > F.col("seq"), "stale input").otherwise("skip")
    return x.select("o_custkey", "o_orderkey", why.alias("decision"))


CONFIG = """case event_id % 3 when 0 then '{"k": ' || value::decimal(18, 4)::varchar || ', "b": "x", "a": true}' when 1 then '{"a": true, "b": "x", "k": ' || value::decimal(18, 2)::varchar || '}' else props end"""


@query(f"with c as (select event_id, {CONFIG} as j from events) select event_id, {hash_sql('j')} as hash from c")
def f18_params_hash(spark: Spark, d: str) -> DataFrame:
    """One hash of settings however their keys are ordered and their numbers written."""
    n, v = F.col("event_id") % 3, lambda scale: F.col("value").cast(f"decimal(18,{scale})").cast("string")
    j = F.when(n == 0, F.concat(F.lit('{"k": '), v(4), F.lit(', "b": "x", "a": true}'))).when(n == 1, F.concat(F.lit('{"a": true, "b": "x", "k": '), v(2), F.lit("}"))).otherwise(F.col("props"))
    return T.table(spark, d, "events").select("event_id", store.params_hash(j).alias("hash"))


@query("select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as completed_seq from orders where o_orderstatus <> 'P'")
def m4_completed_seq(spark: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T.table(spark, d, "orders").where("o_orderstatus != 'P'").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("completed_seq"))


LEAVES = """with l as (select n_name as name, 'ui.region' as leaf, 0 as layer, 'r' || n_regionkey as value from nation union all select n_name, 'ui.contact', 0, null from nation
union all select n_name, 'ui.contact', 1, 's' || max(s_suppkey) from supplier join nation on n_nationkey = s_nationkey where s_acctbal > 0 group by 1 union all select n_name, 'ui.region', 2, 'c' || min(c_custkey) from customer join nation on n_nationkey = c_nationkey where n_nationkey % 3 = 0 group by 1)"""


@query(LEAVES + " select name, leaf, arg_max(value, layer) as value, max(layer) as layer from l where value is not null group by all")
def m7_layers(spark: Spark, d: str) -> DataFrame:
    """Settings by leaf: the last layer that has one wins, and its layer is kept."""
    n = T.table(spark, d, "nation")
    leaf = lambda df, name, layer, value: df.select(F.col("n_name").alias("name"), F.lit(name).alias("leaf"), F.lit(layer).alias("layer"), value.alias("value"))
    by = lambda table, key, what: T.table(spark, d, table).groupBy(F.col(key).alias("n_nationkey")).agg(what.cast("string").alias("v")).join(n, "n_nationkey")
    sold, bought = by("supplier", "s_nationkey", F.max(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")))), by("customer", "c_nationkey", F.min("c_custkey")).where("n_nationkey % 3 = 0")
    layers = [leaf(n, "ui.region", 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))), leaf(n, "ui.contact", 0, F.lit(None).cast("string")), leaf(sold, "ui.contact", 1, F.concat(F.lit("s"), "v")), leaf(bought, "ui.region", 2, F.concat(F.lit("c"), "v"))]
    return store.layered(reduce(DataFrame.unionByName, layers), ["name", "leaf"])


@query("select p_partkey, p_name, row_number() over (order by case when p_size < 10 then 0 when p_size < 30 then 1 else 2 end, lower(p_name), p_partkey) as place, (select count(*) from part) > 500 as truncated from part order by place limit 500")
def m9_listing(spark: Spark, d: str) -> DataFrame:
    bucket = F.when(F.col("p_size") < 10, 0).when(F.col("p_size") < 30, 1).otherwise(2)
    top = T.table(spark, d, "part").withColumn("b", bucket).orderBy("b", F.lower("p_name"), "p_partkey").limit(501)
    # One row more than is shown tells whether there are more.
    placed = top.select("p_partkey", "p_name", F.row_number().over(Window.orderBy("b", F.lower("p_name"), "p_partkey")).alias("place"), (F.count("*").over(Window.partitionBy()) > 500).alias("truncated"))
    return placed.where("place <= 500")


@query("select s_nationkey, arg_min(s_suppkey, (case s_nationkey % 3 when 0 then s_suppkey % 5 else s_suppkey % 7 end, s_suppkey)) as first_usable from supplier where s_acctbal > 0 group by 1")
def m12_first_usable(spark: Spark, d: str) -> DataFrame:
    pref = F.when(F.col("s_nationkey") % 3 == 0, F.col("s_suppkey") % 5).otherwise(F.col("s_suppkey") % 7)
    return T.table(spark, d, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct(pref, "s_suppkey")).alias("first_usable"))


@query("select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as upper_median from lineitem group by 1")
def m14_upper_median(spark: Spark, d: str) -> DataFrame:
    from ..operators.aggregates import upper_median

    return T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(upper_median(F.collect_list("l_quantity")).alias("upper_median"))


@query("select user_id, array_to_string(list_filter(['view', 'purchase', 'error'], lambda x: list_contains(list(distinct event_type), x)), ',') as roles from events group by 1")
def m16_ordered_intersect(spark: Spark, d: str) -> DataFrame:
    wanted = F.array(*(F.lit(k) for k in ("view", "purchase", "error")))
    return T.table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_intersect(wanted, F.collect_set("event_type")), ",").alias("roles"))


@query("select user_id, date_trunc('day', ts) as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def r2_tumbling(spark: Spark, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


@query("with d as (select date_trunc('day', ts) as day, event_type, count(*) as n from events group by all) select event_type, round(sum(n * exp(-date_diff('day', day, timestamp '2024-01-31') / 30.0::double)), 6) as recency, sum(n)::bigint as n from d group by 1")
def z1_recency(spark: Spark, d: str) -> DataFrame:
    """Counts that fade with age, by 1/e in 30 days."""
    x = T.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    age = F.date_diff(F.lit("2024-01-31").cast("date"), "day")
    return x.groupBy("event_type").agg(F.round(F.sum(F.col("n") * F.exp(-age / F.lit(30.0))), 6).alias("recency"), F.sum("n").alias("n"))


@query(T.SQL + ", x as (select recording_id, event_id, count(*) over (partition by recording_id order by us range between 86400000000 preceding and current row) as n from points where kind = 'click') select recording_id, event_id, n from x where n >= 3")
def z3_bursts(spark: Spark, d: str) -> DataFrame:
    """Events that end three or more within a day."""
    w = Window.partitionBy("recording_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return T.points(spark, d).where("kind = 'click'").select("recording_id", "event_id", F.count("*").over(w).alias("n")).where("n >= 3")


@query("with x as (select o_custkey, o_orderkey, o_totalprice, median(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 20 preceding and 1 preceding) as m from orders) select o_custkey, o_orderkey, round(o_totalprice / m, 6) as ratio from x")
def z4_against_median(spark: Spark, d: str) -> DataFrame:
    """Each order against the median of the customer's last twenty."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-20, -1)
    m = F.expr("percentile(o_totalprice, 0.5)").over(w)
    return T.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / m, 6).alias("ratio"))


@query(f"with o as (select conv_id, dense_rank() over (order by conv_id) as place from (select distinct conv_id from conversations)), c as (select place, string_split({NORMAL}, ' ') as w from conversations join o using (conv_id) where {NORMAL} <> ''), g as (select distinct place, array_to_string(list_slice(w, i, i + 1), ' ') as gram from c, unnest(range(1, len(w))) u(i)), s as (select gram, count(*) filter (place <= 20) as n_early, count(*) filter (place > (select count(*) from o) - 15) as n_late from g group by 1) select gram, n_late, n_early = 0 and n_late >= 2 as emerging from s where n_late > 0")
def z1_emerging(spark: Spark, d: str) -> DataFrame:
    """Pairs of words that two or more of the last fifteen conversations have and none of the first twenty."""
    c = T.table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), X.normal(F.col("text")).alias("t"))
    grams = c.where("t != ''").select("recording_id", F.explode(X.ngrams(F.split("t", " "), 2, 2)).alias("gram"))
    return S.emerging(grams, c.select("recording_id").distinct(), 20, 15, 2)


@query(T.SQL + """, c as (select recording_id, event_id, t, count(*) over (partition by recording_id order by us range between 86400000000 preceding and current row) as n from points where kind = 'click')
select recording_id, event_id, n >= 3 as burst, exists (select 1 from points p where p.recording_id = c.recording_id and p.kind = 'error' and p.t between c.t - 1800 and c.t + 1800) as flick, n >= 3 and exists (select 1 from points p where p.recording_id = c.recording_id and p.kind = 'signup' and p.t between c.t - 43200 and c.t) as after_signup from c""")
def z3_signatures(spark: Spark, d: str) -> DataFrame:
    """Clicks that end three or more within a day, those with an error within half an hour on either side, and bursts that a sign-up precedes by half a day at most."""
    p = T.points(spark, d)
    n = F.count("*").over(Window.partitionBy("recording_id").orderBy("us").rangeBetween(-86_400_000_000, 0))
    c = p.where("kind = 'click'").select("recording_id", "event_id", F.col("t").alias("at"), n.alias("n"))

    def near(kind: str, before: float, after: float, name: str) -> DataFrame:
        spans = c.select("recording_id", "event_id", (F.col("at") - before).alias("a"), (F.col("at") + after).alias("b"))
        return J.points_in(p.where(F.col("kind") == kind).select("recording_id", "t"), spans, "recording_id", "t", "a", "b", before + after).select("recording_id", "event_id").distinct().withColumn(name, F.lit(True))

    out = c.join(near("error", 1800.0, 1800.0, "flick"), ["recording_id", "event_id"], "left").join(near("signup", 43_200.0, 0.0, "signup"), ["recording_id", "event_id"], "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    return out.select("recording_id", "event_id", (F.col("n") >= 3).alias("burst"), yes("flick").alias("flick"), ((F.col("n") >= 3) & yes("signup")).alias("after_signup"))


@query(f"with c as (select conv_id, turn // 2 as chapter, bool_or(contains(' ' || {NORMAL} || ' ', ' the ')) as has from conversations group by all) select conv_id, count(*) as chapters, round(100.0 * count(*) filter (has) / count(*), 4) as coverage_pct from c group by 1")
def z5_coverage(spark: Spark, d: str) -> DataFrame:
    """In what share of a conversation's chapters an idea comes up."""
    c = T.table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("chapter")).agg(F.bool_or(X.contains_words(X.normal(F.col("text")), F.lit("the"))).alias("has"))
    return c.groupBy("conv_id").agg(F.count("*").alias("chapters"), F.round(F.lit(100.0) * F.count_if("has") / F.count("*"), 4).alias("coverage_pct"))


@query()
def z2_density(spark: Spark, d: str) -> DataFrame:
    """Each vector's cluster by density, and over how many labels the cluster spreads."""
    return D.density_clusters(T.table(spark, d, "embeddings"), "vec_id", "embedding", "label", 5)


@query("""with f as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as i from events), p as (select user_id, i, user_id % 3 as m, case user_id % 3 when 0 then 30.0::double when 1 then 30.0::double else 30000 / 1001.0::double end as rate from f),
t as (select *, round(case when m = 1 then i / 30.0::double + i * i / 20000.0::double else i / rate end, 3) as pts from p), w as (select user_id, m, rate, count(*) as n, max(abs(pts - i / rate)) as worst from t group by all)
select user_id, round(case when n >= 8 and worst > 0.0015 then 30000 / 1001.0::double else rate end, 6) as rate, n >= 8 and worst > 0.0015 as variable, round(case when n >= 8 then worst / 0.001 end, 3) as ticks from w""")
def s8_constant_rate(spark: Spark, d: str) -> DataFrame:
    """Frames as each recording's events number them, two thirds at a constant rate and rounded to milliseconds, the rest drifting."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    m, rate = F.col("user_id") % 3, F.when(F.col("user_id") % 3 < 2, F.lit(30.0)).otherwise(F.lit(30_000.0) / 1001)
    f = T.table(spark, d, "events").select("user_id", i.cast("double").alias("i"))
    f = f.select("user_id", F.round(F.when(m == 1, F.col("i") / 30.0 + F.col("i") * F.col("i") / 20_000.0).otherwise(F.col("i") / rate), 3).alias("pts"))
    declared = T.table(spark, d, "events").select("user_id").distinct().select("user_id", rate.alias("nominal"), F.lit(29.96).alias("average"), F.lit(0.001).alias("tick"))
    declared = declared.withColumn("average", F.when(m == 1, F.col("average")).otherwise(F.col("nominal")))
    return constant_rate(f, declared, "user_id").select("user_id", F.round("rate", 6).alias("rate"), "variable", F.round("ticks", 3).alias("ticks"))
