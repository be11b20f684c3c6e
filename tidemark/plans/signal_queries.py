"""Queries of derived signals (G), kernels (K), penalties (N), composites (C) and peaks (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import peaks as X
from ..operators import recursive as R
from ..operators import selection as Sel
from ..operators import signals as S
from ..operators import slices as L
from ..operators import windows as W
from ..sources import tables as T
from ..sources.scratch import written
from .registry import query

Spark = SparkSession
KIND_LIST = list(T.KINDS)
STEP = float(T.STEP)
WIDE = T.SQL + ", wide as (select recording_id, i, t, max(value) filter (kind = 'click') as click, max(value) filter (kind = 'error') as error, max(value) filter (kind = 'purchase') as purchase, max(value) filter (kind = 'signup') as signup, max(value) filter (kind = 'view') as view from series group by all)"


def wide(spark: Spark, d: str) -> DataFrame:
    return S.wide(T.series(spark, d), KIND_LIST)


def gate_sql(level: str, src: str, out: str, margin: int = 6) -> str:
    """CTEs of the speech gate over 11 samples, held for 2, runs of 2 or more."""
    return f""", {out}_a as (select recording_id, i, coalesce({level} > avg({level}) over (partition by recording_id order by i rows between 5 preceding and 5 following) + {margin}, false) as x from {src}),
{out}_b as (select recording_id, i, bool_or(x) over (partition by recording_id order by i rows between 2 preceding and current row) as x from {out}_a),
{out}_c as (select *, i - row_number() over (partition by recording_id, x order by i) as g from {out}_b),
{out} as (select recording_id, i, x and count(*) over (partition by recording_id, x, g) >= 2 as gate from {out}_c)"""


def gated(df: DataFrame, level: str, name: str) -> DataFrame:
    return S.speech_gate(df, level, name, 10, 6.0, 2, 2)


@query(T.SQL + "select * from grid")
def g1_grid(spark: Spark, d: str) -> DataFrame:
    return T.grid(T.recordings(spark, d))


@query(WIDE + gate_sql("view", "wide", "gv") + "select recording_id, i, gate from gv")
def g2_speech_gate(spark: Spark, d: str) -> DataFrame:
    return gated(wide(spark, d), "view", "gate").select("recording_id", "i", "gate")


@query(WIDE + ", st as (select recording_id, i, case when view > 0 then 12 * log2(view / 100) end as s from wide) select recording_id, i, case when count(s) over w >= 3 then round(stddev_pop(s) over w, 6) end as variation from st window w as (partition by recording_id order by i rows between 5 preceding and 5 following)")
def g3_pitch_variation(spark: Spark, d: str) -> DataFrame:
    return S.pitch_variation(wide(spark, d), "view", "variation", 10, 3).select("recording_id", "i", F.round("variation", 6).alias("variation"))


Z_VIEW = ", zv as (select recording_id, i, round((view - avg(view) over w) / greatest(coalesce(stddev_pop(view) over w, 0), 0.5), 9) as z from wide window w as (partition by recording_id order by i rows between 5 preceding and 5 following))"
QUIET = Z_VIEW + """, pk as (select *, max(z) over (partition by recording_id order by i rows between 5 preceding and current row) as p from zv), qu as (select recording_id, i, z, coalesce(p >= 1 and p - z >= 1.5 and z <= 0.5, false) as q from pk),
qg as (select *, i - row_number() over (partition by recording_id, q order by i) as g from qu), silence as (select recording_id, i, z, case when q then least(row_number() over (partition by recording_id, q, g order by i) / 2.0::double, 1) else 0.0::double end as level from qg)"""


@query(WIDE + QUIET + "select recording_id, i, level from silence")
def g4_sudden_silence(spark: Spark, d: str) -> DataFrame:
    return S.sudden_silence(wide(spark, d), "view", "level", 10, 0.5, 6, 2).select("recording_id", "i", "level")


@query(WIDE + gate_sql("view", "wide", "gv") + gate_sql("click", "wide", "gc") + "select recording_id, i, gv.gate and gc.gate as both from gv join gc using (recording_id, i)")
def g5_overlap(spark: Spark, d: str) -> DataFrame:
    return gated(gated(wide(spark, d), "view", "a"), "click", "b").select("recording_id", "i", (F.col("a") & F.col("b")).alias("both"))


@query(WIDE + """, s as (select recording_id, i, coalesce(click <= 20 and max(click) over (partition by recording_id order by i rows between 5 preceding and current row) >= 60, false) as q from wide), g as (select *, i - row_number() over (partition by recording_id, q order by i) as g from s)
select recording_id, i, case when q then least(row_number() over (partition by recording_id, q, g order by i) / 2.0::double, 1) else 0.0::double end as still from g""")
def g6_stillness(spark: Spark, d: str) -> DataFrame:
    return S.stillness(wide(spark, d), "click", "still", 20, 60, 6, 2).select("recording_id", "i", "still")


@query(WIDE + QUIET + gate_sql("view", "wide", "gv") + """, e as (select gv.recording_id, gv.i, gate and not lag(gate, 1, false) over (partition by gv.recording_id order by gv.i) as edge, max(level) over (partition by gv.recording_id order by gv.i rows between 9 preceding and current row) as was, z from gv join silence using (recording_id, i))
select recording_id, i from e where edge and was >= 0.5 and z >= 1""")
def g7_reactions(spark: Spark, d: str) -> DataFrame:
    df = S.sudden_silence(gated(wide(spark, d), "view", "gate"), "view", "level", 10, 0.5, 6, 2)
    df = W.rolling_zscore(df, ["recording_id"], "i", "view", 10, 0.5)
    return S.reaction_onsets(df, "gate", "level", "z", 10)


@query(WIDE + ", f as (select recording_id, i, coalesce(view > 40, false) as x from wide), g as (select *, i - row_number() over (partition by recording_id, x order by i) as g from f) select recording_id, min(i) as i, count(*) as size from g where x group by recording_id, g having count(*) >= 2")
def g8_long_runs(spark: Spark, d: str) -> DataFrame:
    return S.long_runs(wide(spark, d).withColumn("x", F.coalesce(F.col("view") > 40, F.lit(False))), "x", 2)


PLATEAU = "0.5 * (1 - cos(pi() * least(greatest(1 - greatest(-86400.0::double - (g.i * 43200 - p.t), (g.i * 43200 - p.t) - 43200.0::double, 0) / 43200.0::double, 0), 1)))"


@query(T.SQL + f", k as (select g.recording_id, g.i, max({PLATEAU}) as level from grid g join points p on p.recording_id = g.recording_id and p.kind = 'purchase' and g.i * 43200 between p.t - 129600 and p.t + 86400 group by all) select recording_id, i, round(coalesce(level, 0), 6) as level from grid left join k using (recording_id, i)")
def k1_plateau(spark: Spark, d: str) -> DataFrame:
    g = T.grid(T.recordings(spark, d)).withColumn("t", F.col("i") * STEP)
    return S.plateau_kernel(g, T.points(spark, d).where("kind = 'purchase'"), 2 * STEP, STEP, STEP, "level").select("recording_id", "i", F.round("level", 6).alias("level"))


@query(T.SQL + ", k as (select g.recording_id, g.i, sum(exp(-0.5 * ((g.i * 43200 - p.t) / 43200) * ((g.i * 43200 - p.t) / 43200))) as level from grid g join points p on p.recording_id = g.recording_id and p.kind = 'signup' group by all) select recording_id, i, round(coalesce(level, 0), 6) as level from grid left join k using (recording_id, i)")
def k2_gaussian(spark: Spark, d: str) -> DataFrame:
    g = T.grid(T.recordings(spark, d)).withColumn("t", F.col("i") * STEP)
    return S.gaussian_kernel(g, T.points(spark, d).where("kind = 'signup'"), STEP, "level").select("recording_id", "i", F.round("level", 6).alias("level"))


@query(T.SQL + """, g as (select kind, event_id, us / 1e6 - round_even(us / 43200000000.0::double, 0) * 43200 as gap from points)
select event_id, round(case when kind like 'purch%' or kind like 'sign%' then 0.5 * (1 - cos(pi() * least(greatest(1 - greatest(-7200.0::double - gap, gap - 3600.0::double, 0) / 3600.0::double, 0), 1))) else exp(-0.5 * (gap / 10800) * (gap / 10800)) end, 6) as level from g""")
def k3_dispatch(spark: Spark, d: str) -> DataFrame:
    """What each event gives to the grid point next to it, by the kernel of its kind."""
    gap = F.col("t") - F.bround(F.col("us") / F.lit(43_200_000_000.0)) * STEP
    return T.points(spark, d).select("event_id", F.round(S.dispatched(F.col("kind"), gap, ("purch", "sign"), 7200.0, 3600.0, 3600.0, 10_800.0), 6).alias("level"))


@query(WIDE + "select recording_id, i, round(coalesce(view, 0) + coalesce(click, 0), 6) as traffic, round((coalesce(view, 0) + coalesce(click, 0)) / 2, 6) as half, 'cold: heat' as lacking from wide")
def g9_derived(spark: Spark, d: str) -> DataFrame:
    """Derived signals in order; a later one may need an earlier one, and one whose input nothing makes is absent and named."""
    both = F.coalesce("view", F.lit(0.0)) + F.coalesce("click", F.lit(0.0))
    made, absent = S.derive(wide(spark, d), [S.Derivation("traffic", ("view", "click"), lambda x: x.withColumn("traffic", F.round(both, 6))), S.Derivation("cold", ("heat",), lambda x: x), S.Derivation("half", ("traffic",), lambda x: x.withColumn("half", F.round(both / 2, 6)))])
    return made.select("recording_id", "i", "traffic", "half", F.lit("; ".join(f"{name}: {', '.join(lack)}" for name, lack in absent.items())).alias("lacking"))


MENU = WIDE + gate_sql("view", "wide", "gv") + """, b as (select w.recording_id, w.i, w.click, w.purchase, w.error, gate, avg(view) over (partition by w.recording_id order by w.i rows between 5 preceding and 5 following) as base, view from wide w join gv using (recording_id, i)),
m as (select *, coalesce(error is null and not gate and coalesce(view <= base + 1e-9, true), false) as x, coalesce(coalesce(click, 0) <= 0 and coalesce(purchase, 0) <= 0 and not gate, false) as y from b),
mg as (select *, i - row_number() over (partition by recording_id, x order by i) as g, i - row_number() over (partition by recording_id, y order by i) as h from m),
mr as (select *, case when x then row_number() over (partition by recording_id, x, g order by i) else 0 end as r, case when y then row_number() over (partition by recording_id, y, h order by i) else 0 end as s from mg),
pen as (select recording_id, i, view, case when r >= 3 then least((r - 2) / 2.0::double, 1) else 0.0::double end as menu, case when s >= 4 then least((s - 3) / 2.0::double, 1) else 0.0::double end as afk from mr)"""


def with_penalties(spark: Spark, d: str) -> DataFrame:
    df = gated(wide(spark, d), "view", "gate")
    df = W.rolling_moments(df, ["recording_id"], "i", "view", 5).withColumnRenamed("mean", "base").drop("n", "std")
    df = df.withColumn("in_menu", F.col("error").isNull()).withColumn("rate", F.coalesce("click", F.lit(0.0))).withColumn("speed", F.coalesce("purchase", F.lit(0.0)))
    return S.afk_penalty(S.menu_penalty(df, "in_menu", "gate", {"view": "base"}, 3, 2), "rate", "speed", "gate", 4, 2)


@query(MENU + "select recording_id, i, menu from pen")
def n1_menu(spark: Spark, d: str) -> DataFrame:
    return with_penalties(spark, d).select("recording_id", "i", "menu")


@query(MENU + "select recording_id, i, afk from pen")
def n2_afk(spark: Spark, d: str) -> DataFrame:
    return with_penalties(spark, d).select("recording_id", "i", "afk")


@query(MENU + "select recording_id, i, round(coalesce(view, 0) - 2.0 * menu - 2.0 * afk, 6) as score from pen")
def n3_penalized(spark: Spark, d: str) -> DataFrame:
    return with_penalties(spark, d).select("recording_id", "i", F.round(S.penalized(F.coalesce("view", F.lit(0.0)), [F.col("menu"), F.col("afk")]), 6).alias("score"))


WEIGHTS = [("fun", "view", 1.0), ("fun", "purchase", 0.8), ("fun", "error", 0.0), ("play", "click", 1.0), ("play", "error", 0.5), ("play", "lag", 0.7)]
COMP = T.SQL + f""", wt(profile, signal, weight) as (values {', '.join(f"('{p}', '{s}', {w}::double)" for p, s, w in WEIGHTS)}),
zs as (select recording_id, kind as signal, i, (value - avg(value) over w) / greatest(coalesce(stddev_pop(value) over w, 0), 0.5) as z from series window w as (partition by recording_id, kind order by i rows between 5 preceding and 5 following)),
comp as (select profile, recording_id, i, round(sum(weight * coalesce(z, 0)), 6) + 0.0 as composite from zs join wt using (signal) where weight <> 0 group by all)"""


def weights(spark: Spark) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "profile string, signal string, weight double")


def zscores(spark: Spark, d: str) -> DataFrame:
    return W.rolling_zscore(T.series(spark, d), ["recording_id", "kind"], "i", "value", 10, 0.5).select("recording_id", F.col("kind").alias("signal"), "i", "z")


@query(COMP + "select profile, recording_id, i, round(composite, 4) as composite from comp")
def c1_composite(spark: Spark, d: str) -> DataFrame:
    out = S.composite(zscores(spark, d), weights(spark))
    return out.select("profile", "recording_id", "i", F.round(F.round("composite", 6) + 0.0, 4).alias("composite"))


@query(COMP + "select profile, signal, weight from wt where weight <> 0 and signal not in (select signal from zs)")
def c2_missing(spark: Spark, d: str) -> DataFrame:
    return S.missing(weights(spark), T.series(spark, d).select(F.col("kind").alias("signal")))


RAW = T.SQL + ", v as (select recording_id, i, round(coalesce(value, 0), 6) as x from series where kind = 'view')"
PEAKS = RAW + """, ch as (select *, case when x is distinct from lag(x) over (partition by recording_id order by i) then 1 else 0 end as c from v), rn as (select *, sum(c) over (partition by recording_id order by i) as r from ch),
isl as (select recording_id, r, min(i) as a, max(i) as b, max(x) as x from rn group by 1, 2), nb as (select *, lag(x) over (partition by recording_id order by r) as px, lead(x) over (partition by recording_id order by r) as nx from isl),
pk as (select recording_id, (a + b) // 2 as i, x from nb where px < x and nx < x),
lh as (select p.*, (select max(i) from v where v.recording_id = p.recording_id and v.i < p.i and v.x > p.x) as l, (select min(i) from v where v.recording_id = p.recording_id and v.i > p.i and v.x > p.x) as h from pk p),
pr as (select recording_id, i, x, greatest((select min(x) from v where v.recording_id = lh.recording_id and v.i <= lh.i and v.i > coalesce(l, -1)), (select min(x) from v where v.recording_id = lh.recording_id and v.i >= lh.i and v.i < coalesce(h, 1000000000))) as base from lh)"""


@query(PEAKS + "select recording_id, i, round(x, 6) as value, round(x - base, 6) as prominence from pr where x - base >= 20 and x > 30")
def x1_peaks(spark: Spark, d: str) -> DataFrame:
    """Peaks of a series with prominence 20 or more and a value above 30."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return pd.DataFrame([(rows["recording_id"].iloc[0], p.i, round(p.value, 6), round(p.value - p.base, 6)) for p in X.find(rows["x"].to_numpy(), 20, 30)], columns=["recording_id", "i", "value", "prominence"])

    s = T.series(spark, d).where("kind = 'view'").select("recording_id", "i", F.round(F.coalesce("value", F.lit(0.0)), 6).alias("x"))
    return s.groupBy("recording_id").applyInPandas(run, "recording_id long, i long, value double, prominence double")


def smoothed(spark: Spark, d: str) -> DataFrame:
    return S.composite(zscores(spark, d), weights(spark)).withColumn("composite", W.gaussian(F.round("composite", 6), ["profile", "recording_id"], "i", 2.0))


def windows(spark: Spark, d: str) -> DataFrame:
    return X.candidates(smoothed(spark, d), STEP, 3, 12, 2 * STEP, 8 * STEP, 3 * STEP)


@query()
def x3_calibrated_windows(spark: Spark, d: str) -> DataFrame:
    return windows(spark, d)


CLAMP = """case when t_end - t_start > {most} then t_peak - {most} / 2 else t_start - greatest({least} - (t_end - t_start), 0) / 2 end as a0, case when t_end - t_start > {most} then t_peak + {most} / 2 else t_end + greatest({least} - (t_end - t_start), 0) / 2 end as b0"""
CLAMPED = "least(greatest(greatest(a0, 0) - greatest(b0 + greatest(-a0, 0) - duration, 0), 0), t_peak) as c_start, greatest(least(b0 + greatest(-a0, 0), duration), t_peak) as c_end"


@query(T.SQL + f", c as (select w.recording_id, id, t_peak, duration, {CLAMP.format(least='7200.0::double', most='14400.0::double')} from (select * replace (t_start - 60 * (id % 97) as t_start, t_end + 60 * (id % 89) as t_end) from windows) w join recordings using (recording_id)), k as (select *, {CLAMPED} from c) select recording_id, id, round(c_start, 6) as c_start, round(c_end, 6) as c_end from k")
def x4_clamped(spark: Spark, d: str) -> DataFrame:
    """Windows of many lengths brought between two and four hours."""
    w = T.windows(spark, d).join(T.recordings(spark, d), "recording_id")
    a, b = J.clamped(F.col("t_start") - 60 * (F.col("id") % 97), F.col("t_end") + 60 * (F.col("id") % 89), F.col("t_peak"), 7200.0, 14_400.0, F.col("duration"))
    return w.select("recording_id", "id", F.round(a, 6).alias("c_start"), F.round(b, 6).alias("c_end"))


@query(T.SQL + """, w as (select w.*, duration from windows w join recordings using (recording_id)), st as (select recording_id, t as m from points where kind = 'view'), en as (select recording_id, t as m from points where kind = 'click'),
b as (select w.*, (select max(m) from st where st.recording_id = w.recording_id and m <= t_start) as sb, (select min(m) from st where st.recording_id = w.recording_id and m >= t_start) as sa, (select max(m) from en where en.recording_id = w.recording_id and m <= t_end) as eb, (select min(m) from en where en.recording_id = w.recording_id and m >= t_end) as ea from w),
s as (select *, case when t_start - sb <= 3600 then sb when sa - t_start <= 3600 then sa else t_start end as x, case when ea - t_end <= 3600 then ea when t_end - eb <= 3600 then eb else t_end end as y from b)
select recording_id, id, round(case when x >= 0 and y <= duration and y - x between 1800 and 7200 then x else t_start end, 6) as s_start, round(case when x >= 0 and y <= duration and y - x between 1800 and 7200 then y else t_end end, 6) as s_end from s""")
def x5_snapped(spark: Spark, d: str) -> DataFrame:
    """Windows opened and closed at marks nearby, unless they would leave their bounds."""
    w, p = T.windows(spark, d).join(T.recordings(spark, d).select("recording_id", "duration"), "recording_id"), T.points(spark, d)
    mark = lambda kind: p.where(F.col("kind") == kind).select("recording_id", F.col("t").alias("m"))
    out = J.snapped_spans(w, mark("view"), mark("click"), "recording_id", 3600.0, 1800.0, 7200.0, "duration")
    return out.select("recording_id", "id", F.round("s_start", 6).alias("s_start"), F.round("s_end", 6).alias("s_end"))


@query("with recursive " + T.SQL.strip()[5:] + """, r as (select recording_id, id, t_peak, score, row_number() over (partition by recording_id order by score desc, t_peak, id) as k from windows),
nms(recording_id, k, taken, near) as (select recording_id, 0::bigint, []::double[], null::double from (select distinct recording_id from r)
union all select n.recording_id, n.k + 1, case when len(list_filter(taken, lambda x: abs(x - t_peak) <= 86400)) > 0 then taken else list_append(taken, t_peak) end, list_filter(taken, lambda x: abs(x - t_peak) <= 86400)[1] from nms n join r on r.recording_id = n.recording_id and r.k = n.k + 1)
select r.recording_id, r.id, round(case when near is null then score else score * 0.5 end, 6) as score, round(near, 6) as suppressed_by from nms join r using (recording_id, k)""")
def x6_spaced(spark: Spark, d: str) -> DataFrame:
    """Windows within a day of a stronger accepted one count half."""
    return X.spaced(T.windows(spark, d), 86_400.0).select("recording_id", "id", F.round("score", 6).alias("score"), F.round("suppressed_by", 6).alias("suppressed_by"))


MOMENTS = T.SQL + """, m as (select recording_id, id, floor(t_peak / 43200)::bigint as i from windows), s as (select recording_id, i, max(value) filter (kind = 'view') as e, max(value) filter (kind = 'click') as g from series group by 1, 2),
x as (select m.recording_id, id, e, g, greatest(coalesce(e, 0), 0) / nullif(max(greatest(coalesce(e, 0), 0)) over w, 0) as en, greatest(coalesce(g, 0), 0) / nullif(max(greatest(coalesce(g, 0), 0)) over w, 0) as gn from m left join s using (recording_id, i) window w as (partition by m.recording_id))
"""


@query(MOMENTS + "select recording_id, id, round(e, 6) as e, round(g, 6) as g, round(sqrt(coalesce(en, 0)) * sqrt(coalesce(gn, 0)) * (coalesce(en, 0) + coalesce(gn, 0)), 6) as score from x")
def x8_scored_moments(spark: Spark, d: str) -> DataFrame:
    """Every moment with both profiles' values at its peak, and the score of both as shares of their largest."""
    m = T.windows(spark, d).select("recording_id", "id", F.floor(F.col("t_peak") / STEP).alias("i"))
    out = Sel.scored_moments(m, wide(spark, d).select("recording_id", "i", F.col("view").alias("e"), F.col("click").alias("g")), "e", "g")
    return out.select("recording_id", "id", *(F.round(c, 6).alias(c) for c in ("e", "g", "score")))


@query(T.SQL + f""", o as (select *, max(t_end) over (partition by recording_id order by t_start, t_end, id rows between unbounded preceding and 1 preceding) as b from windows), n as (select *, sum(case when b is null or t_start > b then 1 else 0 end) over (partition by recording_id order by t_start, t_end, id)::bigint - 1 as cluster from o),
h as (select recording_id, cluster, min(t_start) as t_start, max(t_end) as t_end, arg_max(t_peak, (score, -id)) as t_peak from n group by 1, 2), c as (select h.recording_id, cluster, t_peak, duration, {CLAMP.format(least='0.0::double', most='4500.0::double')} from h join recordings using (recording_id)), k as (select *, {CLAMPED} from c)
select recording_id, cluster, round(c_start, 6) as c_start, round(c_end, 6) as c_end from k""")
def x9_clamped_unions(spark: Spark, d: str) -> DataFrame:
    """Overlapping windows as one, cut back about the strongest peak where the union is too long."""
    n = W.overlap_clusters(T.windows(spark, d), ["recording_id"], "t_start", "t_end", "id")
    h = n.groupBy("recording_id", "cluster").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max_by("t_peak", F.struct("score", -F.col("id"))).alias("t_peak")).join(T.recordings(spark, d), "recording_id")
    a, b = J.clamped(F.col("t_start"), F.col("t_end"), F.col("t_peak"), 0.0, 4500.0, F.col("duration"))
    return h.select("recording_id", "cluster", F.round(a, 6).alias("c_start"), F.round(b, 6).alias("c_end"))


@query()
def x11_counterfactual(spark: Spark, d: str) -> DataFrame:
    """What the menu and rest penalties cost each recording, found on the score without them."""
    p = with_penalties(spark, d)
    return X.counterfactuals(p.select("recording_id", "i", F.coalesce("view", F.lit(0.0)).alias("score"), ((F.col("menu") > 0) | (F.col("afk") > 0)).alias("held")), 3, 6)


@query()
def w18_band_share(spark: Spark, d: str) -> DataFrame:
    """How much of each recording's views swings at two to five days, and how deep."""
    s = T.series(spark, d).where("kind = 'view'").select("recording_id", "i", F.coalesce("value", F.lit(0.0)).alias("x"))
    out = R.band_share(s, "recording_id", "i", "x", 2.0, 0.2, 0.5, 2, 11)
    return out.select("recording_id", "i", F.round("share", 6).alias("share"), F.round("depth", 6).alias("depth"))


@query()
def j12_merged_profiles(spark: Spark, d: str) -> DataFrame:
    composites = written(smoothed(spark, d).select("recording_id", "profile", "i", "composite"), "composites")
    return X.merge_profiles(X.candidates(composites, STEP, 3, 12, 2 * STEP, 8 * STEP, 3 * STEP, kept=True), composites, STEP, 2 * STEP, 8 * STEP)


@query(T.SQL + """, s as (select recording_id, i, max(value) filter (kind = 'view') as e, max(value) filter (kind = 'click') as g from series group by 1, 2), m as (select recording_id, i, greatest(coalesce(e, 0), 0) / nullif(max(greatest(coalesce(e, 0), 0)) over w, 0) as en, greatest(coalesce(g, 0), 0) / nullif(max(greatest(coalesce(g, 0), 0)) over w, 0) as gn from s window w as (partition by recording_id))
select recording_id, i, round(sqrt(coalesce(en, 0)) * sqrt(coalesce(gn, 0)) * (coalesce(en, 0) + coalesce(gn, 0)), 6) as score from m""")
def x7_combined(spark: Spark, d: str) -> DataFrame:
    """Two scores, each by its recording's largest, high only where both are."""
    w = Window.partitionBy("recording_id")

    def norm(c: str):
        x = F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
        return F.when(F.max(x).over(w) > 1e-12, x / F.max(x).over(w)).otherwise(0.0)

    s = wide(spark, d).withColumn("e", norm("view")).withColumn("g", norm("click"))
    return s.select("recording_id", "i", F.round(F.pow("e", F.lit(0.5)) * F.pow("g", F.lit(0.5)) * (F.col("e") + F.col("g")), 6).alias("score"))


@query(COMP + """, c as (select recording_id, i, signal, round_even(weight * coalesce(z, 0), 4) as part from zs join wt using (signal) where profile = 'fun' and weight <> 0), r as (select *, row_number() over (partition by recording_id, i order by abs(part) desc, signal) as n from c)
select recording_id, i, string_agg(signal, ',' order by n) as signals, round(sum(part), 4) as total from r group by 1, 2""")
def x10_breakdown(spark: Spark, d: str) -> DataFrame:
    """What each weighted signal adds, largest first."""
    live = weights(spark).where("profile = 'fun' and weight != 0")
    part = F.bround(F.col("weight") * F.coalesce("z", F.lit(0.0)), 4)
    c = zscores(spark, d).join(F.broadcast(live), "signal").withColumn("part", part)
    by = F.array_sort(F.collect_list(F.struct((-F.abs("part")).alias("k"), "signal", "part")))
    return c.groupBy("recording_id", "i").agg(by.alias("p")).select("recording_id", "i", F.array_join("p.signal", ",").alias("signals"), F.round(F.aggregate("p.part", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(T.SQL + """, h as (select recording_id, i, max(value) filter (kind = 'view') as v, max(value) filter (kind = 'purchase') as p from series group by 1, 2), c as (select recording_id, i, 0.7::double * coalesce(v, 0) + 0.3::double * coalesce(p, 0) as score from h),
m as (select *, lag(score) over w as l, lead(score) over w as r from c window w as (partition by recording_id order by i))
select recording_id, i, greatest((i - 1) * 43200, 0)::double as t_start, (i + 1) * 43200.0::double as t_end, round(score, 6) as score, rank from (select *, row_number() over (partition by recording_id order by score desc, i) as rank from m where score > l and score > r) where rank <= 10""")
def flagship(spark: Spark, d: str) -> DataFrame:
    """Ten strongest moments of each recording: events on a grid, weighted, local maxima, windows, rank."""
    s = wide(spark, d).withColumn("score", F.lit(0.7) * F.coalesce("view", F.lit(0.0)) + F.lit(0.3) * F.coalesce("purchase", F.lit(0.0)))
    w = W.ordered(["recording_id"], "i")
    m = s.withColumn("l", F.lag("score").over(w)).withColumn("r", F.lead("score").over(w)).where("score > l and score > r")
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("score"), "i"))
    m = m.withColumn("rank", rank).where("rank <= 10")
    return m.select("recording_id", "i", F.greatest((F.col("i") - 1) * STEP, F.lit(0.0)).alias("t_start"), ((F.col("i") + 1) * STEP).alias("t_end"), F.round("score", 6).alias("score"), "rank")


@query()
def flagship_chain(spark: Spark, d: str) -> DataFrame:
    """The whole way from signals to ranked moments: z-scores, weighted composites less penalties, smoothed; windows, merged, snapped to views and clicks, spaced, ranked."""
    pen = with_penalties(spark, d).select("recording_id", "i", "menu", "afk")
    scored = S.composite(zscores(spark, d), weights(spark)).join(pen, ["recording_id", "i"])
    scored = scored.withColumn("composite", S.penalized(F.round("composite", 6), [F.col("menu"), F.col("afk")]))
    smooth = L.sliced(scored, ["profile", "recording_id"], "i", 8, 8, lambda rows, by: rows.withColumn("composite", W.gaussian(F.col("composite"), by, "i", 2.0)))
    composites = written(smooth.select("recording_id", "profile", "i", "composite"), "composites")
    mark = lambda kind: T.points(spark, d).where(F.col("kind") == kind).select("recording_id", F.col("t").alias("m"))
    return X.ranked_moments(composites, mark("view"), mark("click"), STEP, 3, 12, 2 * STEP, 8 * STEP, 3 * STEP, STEP / 4, kept=True)
