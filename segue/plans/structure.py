"""Bars, phrases, sections, points, and interval joins over curves and regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions.basic import clip, r6, snap
from segue.operators import curves as C
from segue.operators import intervals as I
from segue.plans import _sql as S
from segue.registry import query
from segue.sources.tables import Tables

_c = F.col
SPAN, BAR = 744, 4  # hours in the month, hours per bar

CI = "ci as (select track_id, t, level as v, row_number() over (partition by track_id order by t) - 1 as i, count(*) over (partition by track_id) as n_points from curve)"
CB = f"""cb as (select track_id, k as bar_idx, k * {BAR} as bar_t from (select distinct track_id from curve), (select unnest(range(0, {SPAN // BAR})) as k)),
bm as (select track_id, t // {BAR} as bar_idx, avg(level / 500) as e from curve group by 1, 2),
be as (select cb.*, coalesce(bm.e, 0.5::double) as energy from cb left join bm using (track_id, bar_idx)),
jm as (select *, energy - lag(energy) over (partition by track_id order by bar_idx) as change from be)"""
BARS = "bars as (select track_id, k as bar_idx, round(k * (240 / bpm), 4) as bar_t from tracks, lateral (select unnest(range(0, cast(ceil(duration_sec * bpm / 240) as bigint) + 1)) as k) where k * (240 / bpm) < duration_sec)"


def _curve_bars(t: Tables) -> DataFrame:
    curve = t.curve()
    return C.bar_energy(curve, C.curve_bars(curve, BAR, SPAN), BAR, _c("level") / 500)


@query("bar_grid", "tracks", f", {BARS} select * from bars")
def bar_grid(t: Tables) -> DataFrame:
    return C.bar_grid(t.tracks())


@query("downbeats", "curve", f", {CI} select track_id, t as beat_t, i // 4 as bar_no from ci where i % 4 = 0")
def downbeats(t: Tables) -> DataFrame:
    ci = C.indexed(t.curve())
    return ci.where(_c("i") % 4 == 0).select("track_id", _c("t").alias("beat_t"), F.floor(_c("i") / 4).alias("bar_no"))


@query("beat_intervals", "curve", f""", {CI}, d as (select track_id, t - lag(t) over (partition by track_id order by i) as gap, n_points from ci)
select track_id, round(avg(gap), 6) as mean_interval, round(case when max(n_points) >= 3 then greatest(0, 1 - avg(abs(gap - 2.0::double)) / 2.0::double) else 0.3::double end, 6) as confidence from d group by 1""")
def beat_intervals(t: Tables) -> DataFrame:
    gap = _c("t") - F.lag("t").over(Window.partitionBy("track_id").orderBy("i"))
    expected = 2.0
    return C.indexed(t.curve()).withColumn("gap", gap).groupBy("track_id").agg(
        r6(F.avg("gap")).alias("mean_interval"),
        r6(F.when(F.max("n_points") >= 3, F.greatest(F.lit(0.0), 1 - F.avg(F.abs(_c("gap") - expected)) / expected)).otherwise(0.3)).alias("confidence"))


@query("bar_energy", "curve", f", {CB} select track_id, bar_idx, cast(bar_t as bigint) as bar_t, round(energy, 6) as energy from be")
def bar_energy(t: Tables) -> DataFrame:
    return _curve_bars(t).select("track_id", "bar_idx", _c("bar_t").cast("bigint").alias("bar_t"), r6(_c("energy")).alias("energy"))


@query("phrase_jumps", "curve", f", {CB} select track_id, bar_idx, round(change, 6) as change from jm where abs(round(change, 9)) >= 0.15")
def phrase_jumps(t: Tables) -> DataFrame:
    return C.jumps(_curve_bars(t)).select("track_id", "bar_idx", r6(_c("change")).alias("change"))


PH = """cl as (select track_id, list([-round(abs(change), 9), bar_idx] order by -round(abs(change), 9), bar_idx) as c from jm where abs(round(change, 9)) >= 0.15 group by 1),
kp as (select track_id, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda a, x: case when len(list_filter(a, lambda y: abs(y[2] - x[1][2]) < 8)) > 0 then a else list_concat(a, x) end)) as p from cl),
pk as (select track_id, cast(p[2] as bigint) as bar_idx, p[2] * 4 as time, least(1.0::double, -p[1] / 0.4::double) as confidence, -p[1] as energy_change from kp),
nx as (select *, lead(bar_idx) over (partition by track_id order by bar_idx) as nb, lead(time) over (partition by track_id order by bar_idx) as nt from pk),
ph as (select track_id, bar_idx, time, round(confidence, 6) as confidence, round(energy_change, 6) as energy_change from pk
 union all select track_id, (bar_idx + nb) // 2, (time + nt) / 2, 0.4::double, 0::double from nx where nb - bar_idx > 32)"""


@query("phrase_boundaries", "curve", f", {CB}, {PH} select * from ph")
def phrase_boundaries(t: Tables) -> DataFrame:
    return C.phrase_boundaries(_curve_bars(t))


SEC = f"""wh as (select track_id, avg(energy) as m from be group by 1),
cuts as (select distinct track_id, time from (select track_id, time from ph where time > 0 and time < {SPAN} union all select track_id, 0 from wh)),
sx as (select track_id, time as s, coalesce(lead(time) over (partition by track_id order by time), {SPAN}) as e from cuts),
st as (select sx.track_id, s, e, avg(be.energy) as en, round(stddev_pop(be.energy), 9) as sd from sx join be on be.track_id = sx.track_id and be.bar_idx >= floor(s / {BAR}) and be.bar_idx < greatest(floor(s / {BAR}) + 1, floor(e / {BAR})) group by 1, 2, 3),
sec as (select st.track_id, s as start_t, cast(e as double) as end_t, round(en + 1e-9, 6) as energy_level, case when s < {SPAN} * 0.15::double and en < m * 0.9::double then 'intro' when e > {SPAN} * 0.85::double and en < m * 0.9::double then 'outro'
 when (s + e) / 2 / {SPAN} > 0.88::double then 'outro' when en > m * 1.15::double and sd < 0.08 then 'chorus' when en < m * 0.85::double then 'verse' when sd > 0.1 then 'bridge' else 'verse' end as label from st join wh using (track_id))"""


@query("section_label", "curve", f", {CB}, {PH}, {SEC} select * from sec")
def section_label(t: Tables) -> DataFrame:
    bars = _curve_bars(t)
    return C.section_labels(bars, C.phrase_boundaries(bars), SPAN, BAR)


IO = """io0 as (select track_id, i, v, n_points, round(avg(v) over (partition by track_id order by i rows between current row and 3 following), 9) as fwd, round(avg(v) over (partition by track_id order by i rows between 15 preceding and current row), 9) as back from ci),
io as (select track_id, coalesce(min(i) filter (where v > 150 and least(16, n_points - i) >= 4 and fwd > 150), 0) as intro_end,
 coalesce(max(i) filter (where v > 150 and least(16, i + 1) >= 4 and back > 150), max(n_points) - 1) as outro_start from io0 group by 1)"""


@query("intro_outro", "curve", f", {CI}, {IO} select * from io")
def intro_outro(t: Tables) -> DataFrame:
    return C.intro_outro(C.indexed(t.curve()), 150.0, 4)


CTX = "px as (select track_id, bar_idx, bar_t, energy, round(stddev_pop(energy) over (partition by track_id order by bar_idx rows between 2 preceding and 2 following), 9) as spread, round(energy - lead(energy) over (partition by track_id order by bar_idx), 9) as dropv from be)"
_ENTRY_SQL = f"case when time < intro_end or time >= {SPAN} then 0::double else {S.clip(f'0.5::double + case when time > intro_end + {BAR} then 0.1::double else 0 end + case when on_bar then 0.2::double else 0 end + coalesce(0.2::double * (1 - least(1.0::double, spread * 5)), 0)')} end"
_EXIT_BASE = f"(0.3::double + case when time >= outro_start then 0.3::double when time >= {SPAN} * 0.6::double then 0.1::double else 0 end + case when on_bar then 0.2::double else 0 end + case when dropv > 0.05 then least(0.2::double, dropv * 2) else 0 end)"
_EXIT_SQL = f"case when time <= 0 or time >= {SPAN - 2} then 0::double else {S.clip(f'{_EXIT_BASE} * case when time < {SPAN} * 0.3::double and time < outro_start then 0.5::double else 1 end')} end"
CAND = f"""wh0 as (select distinct track_id from curve),
cand as (select track_id, cast(bar_t as double) as time from be union select track_id, round({SPAN} * f, 3) from wh0, (values (0.7::double), (0.75::double), (0.8::double), (0.85::double), (0.9::double)) q(f)),
pc as (select c.track_id, c.time, px.spread, px.dropv, io.intro_end, io.outro_start, abs(c.time - round(c.time / {BAR}) * {BAR}) < {BAR} * 0.1 and round(c.time / {BAR}) < {SPAN // BAR} as on_bar
 from cand c join px on px.track_id = c.track_id and px.bar_idx = floor(c.time / {BAR}) join io on io.track_id = c.track_id)"""


def _points(t: Tables) -> DataFrame:
    curve = t.curve()
    bars = _curve_bars(t)
    fractions = curve.select("track_id").distinct().select(
        "track_id", F.explode(F.array(*[F.round(F.lit(SPAN * f), 3) for f in (0.7, 0.75, 0.8, 0.85, 0.9)])).alias("time"))
    cand = bars.select("track_id", _c("bar_t").cast("double").alias("time")).union(fractions).distinct()
    near_bar = F.round(_c("time") / BAR)
    on_bar = (F.abs(_c("time") - near_bar * BAR) < BAR * 0.1) & (near_bar < SPAN // BAR)
    return (
        cand.withColumn("bar_idx", F.floor(_c("time") / BAR).cast("bigint"))
        .join(C.point_context(bars).drop("bar_t"), ["track_id", "bar_idx"])
        .join(C.intro_outro(C.indexed(curve), 150.0, 4), "track_id")
        .withColumn("on_bar", on_bar)
    )


_PTS = f", {CI}, {CB}, {IO}, {CTX}, {CAND}"


@query("entry_score", "curve", f"{_PTS} select track_id, time, round({_ENTRY_SQL}, 6) as score from pc")
def entry_score(t: Tables) -> DataFrame:
    s = C.entry_score(_c("time"), _c("intro_end"), SPAN, BAR, _c("on_bar"), _c("spread"))
    return _points(t).select("track_id", "time", r6(s).alias("score"))


@query("exit_score", "curve", f"{_PTS} select track_id, time, round({_EXIT_SQL}, 6) as score from pc")
def exit_score(t: Tables) -> DataFrame:
    s = C.exit_score(_c("time"), _c("outro_start"), SPAN, _c("on_bar"), _c("drop"))
    return _points(t).select("track_id", "time", r6(s).alias("score"))


@query("transition_points", "curve", f"""{_PTS}, sc as (select track_id, 'exit' as side, time, round({_EXIT_SQL}, 6) as score from pc union all select track_id, 'entry', time, round({_ENTRY_SQL}, 6) from pc where time > 0),
rk as (select *, row_number() over (partition by track_id, side order by score desc, time) as rank from sc where score > 0.2)
select track_id, side, time, score, rank from rk where rank <= 20""")
def transition_points(t: Tables) -> DataFrame:
    p = _points(t)
    out = C.exit_score(_c("time"), _c("outro_start"), SPAN, _c("on_bar"), _c("drop"))
    into = C.entry_score(_c("time"), _c("intro_end"), SPAN, BAR, _c("on_bar"), _c("spread"))
    exits = C.top_points(p.select("track_id", F.lit("exit").alias("side"), "time", r6(out).alias("score")))
    entries = C.top_points(p.where("time > 0").select("track_id", F.lit("entry").alias("side"), "time", r6(into).alias("score")))
    return exits.unionByName(entries)


@query("transition_bars", "handoff_pairs", """, x as (select set_id, pos, (a_mean_energy + b_mid_energy) / 2 as m from handoff_pairs)
select set_id, pos, cast(case when m > 0.85 then 24 when m > 0.75 then 20 when m > 0.6 then 12 when m > 0.45 then 8 else 4 end as bigint) as long_bars,
 cast(case when m > 0.75 then 16 when m > 0.6 then 12 when m > 0.45 then 8 else 4 end as bigint) as bars from x""")
def transition_bars(t: Tables) -> DataFrame:
    a, b = _c("a_mean_energy"), _c("b_mid_energy")
    return t.handoff_pairs().select("set_id", "pos", C.transition_bars(a, b, high=24).alias("long_bars"), C.transition_bars(a, b).alias("bars"))


@query("rms_frames", "curve", f""", {CI}, r as (select track_id, i, sqrt(avg(v * v) over (partition by track_id order by i rows between current row and 1 following)) as rms, n_points from ci),
k as (select * from r where i < greatest(1, n_points - 2)) select track_id, i, round(rms, 6) as rms, round(rms / max(rms) over (partition by track_id), 6) as scaled from k""")
def rms_frames(t: Tables) -> DataFrame:
    return C.rms_frames(C.indexed(t.curve())).select("track_id", "i", r6(_c("rms")).alias("rms"), r6(_c("scaled")).alias("scaled"))


def _islands(flag: str, src: str = "ci", key: str = "track_id") -> str:
    return f"isl as (select {key}, min(i) as start_i, max(i) + 1 as end_i, count(*) as n from (select *, i - row_number() over (partition by {key} order by i) as g from {src} where {flag}) group by {key}, g)"


@query("active_regions", "curve", f", {CI}, {_islands('v > 100')} select * from isl")
def active_regions(t: Tables) -> DataFrame:
    return I.runs(C.indexed(t.curve()), ["track_id"], "i", _c("v") > 100)


@query("longest_quiet_run", "curve", f", {CI}, {_islands('v <= 250')} select track_id, max(n) as longest from isl group by 1")
def longest_quiet_run(t: Tables) -> DataFrame:
    return I.runs(C.indexed(t.curve()), ["track_id"], "i", _c("v") <= 250).groupBy("track_id").agg(F.max("n").alias("longest"))


def _merge_sql(src: str, gap: float, key: str = "track_id", s: str = "start_t", e: str = "end_t") -> str:
    return f"""mg as (select {key}, min({s}) as {s}, max({e}) as {e} from (select *, sum(nw) over (partition by {key} order by {s}, {e} rows unbounded preceding) as g from
 (select *, case when {s} - max({e}) over (partition by {key} order by {s}, {e} rows between unbounded preceding and 1 preceding) < {gap} then 0 else 1 end as nw from {src})) group by {key}, g)"""


@query("merge_regions", "regions", f", {_merge_sql('regions', 30)} select * from mg")
def merge_regions(t: Tables) -> DataFrame:
    return I.merge_close(t.regions().select("track_id", "start_t", "end_t"), ["track_id"], "start_t", "end_t", 30.0)


@query("level_regions", "curve", f""", {CI}, fr as (select track_id, i, n_points, 20 * log10(sqrt(avg(v * v) over (partition by track_id order by i rows between current row and 3 following)) / 500 + 1e-10) as db from ci),
ff as (select * from fr where i <= greatest(0, n_points - 4)), {_islands('round(db, 9) > -14', 'ff')}, kept as (select track_id, start_i as start_t, end_i as end_t from isl where end_i - start_i >= 2), {_merge_sql('kept', 3)} select * from mg""")
def level_regions(t: Tables) -> DataFrame:
    w = Window.partitionBy("track_id").orderBy("i").rowsBetween(0, 3)
    frames = C.indexed(t.curve()).withColumn("rms", F.sqrt(F.avg(_c("v") * _c("v")).over(w))).where(_c("i") <= F.greatest(F.lit(0), _c("n_points") - 4))
    db = F.round(20 * F.log10(_c("rms") / 500 + 1e-10), 9)
    kept = I.runs(frames, ["track_id"], "i", db > -14).where(_c("end_i") - _c("start_i") >= 2)
    return I.merge_close(kept.select("track_id", _c("start_i").alias("start_t"), _c("end_i").alias("end_t")), ["track_id"], "start_t", "end_t", 3)


@query("smooth_score", "curve", f""", {CI}, sm as (select track_id, i, sum(v / 500) over (partition by track_id order by i rows between 2 preceding and 2 following) / 5 as s from ci),
{_islands('round(s, 9) > 0.15', 'sm')} select * from isl""")
def smooth_score(t: Tables) -> DataFrame:
    ci = C.indexed(t.curve()).withColumn("v", _c("v") / 500)
    return I.runs(C.smooth(ci, 5), ["track_id"], "i", F.round("smooth", 9) > 0.15)


@query("safe_exits", "regions", """, o as (select track_id, greatest(arg_max(end_t, (start_t, event_id)), 44640 * 0.65::double) as ostart from regions group by 1),
c as (select track_id, end_t as t from regions where end_t >= 3000 and end_t < 44640 - 3 union all select track_id, ostart from o where ostart < 44640 - 5 union all select track_id, ostart + 4 from o where ostart < 44640 - 5)
select distinct track_id, round(t, 3) as exit_t from c where t >= 3000 and t < 44640 - 2""")
def safe_exits(t: Tables) -> DataFrame:
    length, first = 44640.0, 3000.0
    r = t.regions()
    last = r.groupBy("track_id").agg(F.greatest(F.max_by("end_t", F.struct("start_t", "event_id")), F.lit(length * 0.65)).alias("o")).where(_c("o") < length - 5)
    ends = r.where((_c("end_t") >= first) & (_c("end_t") < length - 3)).select("track_id", _c("end_t").alias("t"))
    outro = last.select("track_id", F.explode(F.array(_c("o"), _c("o") + 4)).alias("t"))
    return ends.unionByName(outro).where((_c("t") >= first) & (_c("t") < length - 2)).select("track_id", F.round("t", 3).alias("exit_t")).distinct()


# --- windows over curves ---------------------------------------------------------

WIN = "wn as (select distinct track_id, k * 24 as start_t, k * 24 + 30 as end_t, k as win from curve, (select unnest(range(0, 31)) as k))"


def _windows(t: Tables) -> DataFrame:
    return t.curve().select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(30).cast("bigint"))).alias("win")).select(
        "track_id", "win", (_c("win") * 24).alias("start_t"), (_c("win") * 24 + 30).alias("end_t"))


_RATIO = f""", {CI}, {WIN}, nn as (select track_id, count(*) as n from curve group by 1),
w2 as (select wn.*, greatest(0, least(n - 1, floor(start_t / {SPAN} * n))) as first_i, greatest(greatest(0, least(n - 1, floor(start_t / {SPAN} * n))) + 1, least(n, ceil(end_t / {SPAN} * n))) as last_i from wn join nn using (track_id))"""


@query("curve_mean", "curve", f"""{_RATIO} select w2.track_id, win, round(avg(v), 6) as mean_v from w2 join ci on ci.track_id = w2.track_id and i >= first_i and i < last_i group by 1, 2""")
def curve_mean(t: Tables) -> DataFrame:
    return _curve_windows(t).select("track_id", "win", r6(F.coalesce("mean_v", F.lit(0.5))).alias("mean_v"))


@query("curve_slope", "curve", f"""{_RATIO} select w2.track_id, win, round(coalesce(regr_slope(v, i), 0), 5) as slope_v, count(*) as n_v from w2 join ci on ci.track_id = w2.track_id and i >= first_i and i < last_i group by 1, 2""")
def curve_slope(t: Tables) -> DataFrame:
    return _curve_windows(t).select("track_id", "win", F.round("slope_v", 5).alias("slope_v"), "n_v")


def _curve_windows(t: Tables) -> DataFrame:
    ci = C.indexed(t.curve())
    n = ci.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    w = _windows(t).join(n, "track_id")
    first, last = C.ratio_window(_c("start_t"), _c("end_t"), F.lit(float(SPAN)), _c("n"))
    return C.window_stats(w.withColumn("first_i", first).withColumn("last_i", last), ci, ["win"])


@query("sample_windows", "tracks", """select track_id, case when duration_sec <= 10 then 0 else round(least(greatest(0::double, f * duration_sec - 5), duration_sec - 10), 3) end as start_sec,
 round(case when duration_sec <= 10 then duration_sec else least(greatest(0::double, f * duration_sec - 5), duration_sec - 10) + 10 end, 3) as end_sec
from tracks, (values (0.10::double), (0.35::double), (0.60::double), (0.85::double)) q(f)""")
def sample_windows(t: Tables) -> DataFrame:
    d = _c("duration_sec")
    starts = F.array(*[F.least(F.greatest(F.lit(0.0), f * d - 5), d - 10) for f in (0.10, 0.35, 0.60, 0.85)])
    return t.tracks().select("track_id", d, F.explode(F.when(d <= 10, F.array(F.lit(0.0))).otherwise(F.array_distinct(starts))).alias("s")).select(
        "track_id", F.round("s", 3).alias("start_sec"), F.round(F.when(d <= 10, d).otherwise(_c("s") + 10), 3).alias("end_sec"))


@query("onset_envelope", "curve", f", {CI} select track_id, i, round(greatest(0, v - coalesce(lag(v) over (partition by track_id order by i), 0)), 6) as onset from ci")
def onset_envelope(t: Tables) -> DataFrame:
    prev = F.coalesce(F.lag("v").over(Window.partitionBy("track_id").orderBy("i")), F.lit(0.0))
    return C.indexed(t.curve()).select("track_id", "i", r6(F.greatest(F.lit(0.0), _c("v") - prev)).alias("onset"))


_LAG = """, lg as (select unnest(range(-6, 7)) as lag), a as (select track_id, t, level from curve), b as (select track_id - 1 as track_id, t, level from curve),
xc as (select a.track_id, lag, round(sum(a.level * b.level) + 1e-6, 4) as s from a cross join lg join b on b.track_id = a.track_id and b.t = a.t - lag group by 1, 2)"""


@query("lag_xcorr", "curve", f"{_LAG} select track_id, cast(arg_max(lag, (s, -lag)) as bigint) as best_lag, cast(abs(arg_max(lag, (s, -lag))) as bigint) as error, max(s) as strength from xc group by 1")
def lag_xcorr(t: Tables) -> DataFrame:
    """Best lag of each track against the next one, within half a period of 12."""
    curve = t.curve()
    a = curve.select("track_id", _c("level").alias("x"), "t", F.explode(F.sequence(F.lit(-6).cast("bigint"), F.lit(6).cast("bigint"))).alias("lag")).withColumn("bt", _c("t") - _c("lag"))
    b = curve.select((_c("track_id") - 1).alias("track_id"), _c("t").alias("bt"), _c("level").alias("y"))
    s = a.join(b, ["track_id", "bt"]).groupBy("track_id", "lag").agg(F.round(F.sum(_c("x") * _c("y")) + 1e-6, 4).alias("s"))
    best = F.max_by("lag", F.struct("s", -_c("lag")))
    return s.groupBy("track_id").agg(best.alias("best_lag"), F.abs(best).alias("error"), F.max("s").alias("strength"))


_SEAM = f""", {CI}, sm as (select distinct track_id, k * 48 as seam from ci, (select unnest(range(1, 15)) as k) where k * 48 < n_points),
tl as (select s.track_id, s.seam, ci.i - s.seam as o, ci.v from sm s join ci on ci.track_id = s.track_id and ci.i >= s.seam - 8 and ci.i < s.seam + 8),
ag as (select track_id, seam, sqrt(avg(v * v) filter (where o < 0)) as ra, sqrt(avg(v * v) filter (where o >= 0)) as rb, sqrt(avg(v * v)) as rr, max(v) filter (where o = -1) as la, max(v) filter (where o = 0) as fb from tl group by 1, 2),
cr as (select x.track_id, x.seam, case when isnan(corr(x.v, y.v)) then 0 else corr(x.v, y.v) end as c from tl x join tl y on y.track_id = x.track_id and y.seam = x.seam and y.o = x.o + 8 where x.o < 0 group by 1, 2)
select ag.track_id, ag.seam, round(abs(20 * log10(ra / rb)), 4) as rms_jump_db, round(coalesce(c, 0), 4) as correlation, round(abs(fb - la) / greatest(rr, 1e-6), 4) as sample_jump,
 round(abs(20 * log10(ra / rb)), 9) > 3 as rms_bad, round(coalesce(c, 0), 9) < 0.85 as corr_bad, abs(fb - la) / greatest(rr, 1e-6) > 8 as jump_bad from ag join cr using (track_id, seam)"""


@query("seam_check", "curve", _SEAM)
def seam_check(t: Tables) -> DataFrame:
    """Level jump, correlation and sample jump around a seam every 48 samples."""
    ci = C.indexed(t.curve())
    seam = F.round(_c("i") / 48) * 48
    near = ci.withColumn("seam", seam.cast("bigint")).where((_c("seam") > 0) & (_c("seam") < F.least(_c("n_points"), F.lit(15 * 48))))
    near = near.withColumn("o", _c("i") - _c("seam")).where((_c("o") >= -8) & (_c("o") < 8))
    sq = _c("v") * _c("v")
    # Both halves of a seam sit on one row per offset, so correlation needs no self-join.
    pairs = near.groupBy("track_id", "seam", ((_c("o") + 8) % 8).alias("k")).agg(
        F.max(F.when(_c("o") < 0, _c("v"))).alias("x"), F.max(F.when(_c("o") >= 0, _c("v"))).alias("y"))
    x, y = _c("x"), _c("y")
    a = pairs.groupBy("track_id", "seam").agg(
        F.sqrt(F.avg(x * x)).alias("ra"), F.sqrt(F.avg(y * y)).alias("rb"),
        F.sqrt((F.sum(F.coalesce(x * x, F.lit(0.0))) + F.sum(F.coalesce(y * y, F.lit(0.0)))) / (F.count(x) + F.count(y))).alias("rr"),
        F.max(F.when(_c("k") == 7, x)).alias("la"), F.max(F.when(_c("k") == 0, y)).alias("fb"), F.coalesce(F.corr(x, y), F.lit(0.0)).alias("c"))
    jump_db = F.abs(20 * F.log10(_c("ra") / _c("rb")))
    jump = F.abs(_c("fb") - _c("la")) / F.greatest(_c("rr"), F.lit(1e-6))
    return a.select("track_id", "seam", F.round(jump_db, 4).alias("rms_jump_db"), F.round("c", 4).alias("correlation"), F.round(jump, 4).alias("sample_jump"),
                    (F.round(jump_db, 9) > 3).alias("rms_bad"), (F.round("c", 9) < 0.85).alias("corr_bad"), (jump > 8).alias("jump_bad"))


# --- interval and nearest joins ------------------------------------------------------

VF = "vw as (select track_id, t, t * 60.0::double as ws, t * 60.0::double + 45 as we from curve)"


@query("vocal_fraction", "curve regions", f""", {VF}, ov as (select vw.track_id, vw.t, sum(case when end_t is null then 0 else greatest(0, least(we, end_t) - greatest(ws, start_t)) end) as c from vw left join regions r on r.track_id = vw.track_id and r.start_t < vw.we and r.end_t > vw.ws group by 1, 2)
select track_id, t, round(coalesce(c, 0), 6) as covered_sec, round(least(1, coalesce(c, 0) / 45), 6) as fraction from ov""")
def vocal_fraction(t: Tables) -> DataFrame:
    w = t.curve().select("track_id", "t", (_c("t") * 60.0).alias("ws"), (_c("t") * 60.0 + 45).alias("we"))
    out = I.covered(w, t.regions(), "track_id", ["t"], ("ws", "we"), ("start_t", "end_t"), 240.0)
    return out.select("track_id", "t", r6(_c("covered_sec")).alias("covered_sec"), r6(_c("fraction")).alias("fraction"))


_VO = """, h as (select set_id, pos, src % (select max(user_id) + 1 from events) as a_id, dst % (select max(user_id) + 1 from events) as b_id, src * 37 % 40000 as ax, dst * 53 % 40000 as bx, overlap_sec * 10 as ov from handoffs),
fa as (select h.set_id, h.pos, sum(greatest(0, least(ax + ov, end_t) - greatest(ax, start_t))) / max(ov) as f from h join regions r on r.track_id = a_id and r.start_t < ax + ov and r.end_t > ax group by 1, 2),
fb as (select h.set_id, h.pos, sum(greatest(0, least(bx + ov, end_t) - greatest(bx, start_t))) / max(ov) as f from h join regions r on r.track_id = b_id and r.start_t < bx + ov and r.end_t > bx group by 1, 2),
p as (select h.set_id, h.pos, coalesce(fa.f, 0) * coalesce(fb.f, 0) as p from h left join fa using (set_id, pos) left join fb using (set_id, pos))
"""


def _overlap_products(t: Tables) -> DataFrame:
    h = t.handoffs().select("set_id", "pos", "src", "dst", (_c("overlap_sec") * 10).alias("ov"))
    reg = t.regions()

    def side(track, start):
        w = h.select((track % t.n_curves()).alias("track_id"), "set_id", "pos", start.cast("double").alias("ws"), (start + _c("ov")).cast("double").alias("we"))
        return I.covered(w, reg, "track_id", ["set_id", "pos"], ("ws", "we"), ("start_t", "end_t"), 240.0).select("set_id", "pos", (_c("covered_sec") / (_c("we") - _c("ws"))).alias("f"))

    a = side(_c("src"), _c("src") * 37 % 40000).withColumnRenamed("f", "fa")
    b = side(_c("dst"), _c("dst") * 53 % 40000).withColumnRenamed("f", "fb")
    return h.join(a, ["set_id", "pos"]).join(b, ["set_id", "pos"]).withColumn("p", F.round(_c("fa") * _c("fb"), 9))


@query("vocal_overlap_score", "handoffs regions", _VO + "select set_id, pos, round(p + 1e-9, 6) as product, case when round(p, 9) > 0.5 then 0.3::double when round(p, 9) > 0.25 then 0.6::double when round(p, 9) > 0.1 then 0.8::double else 1::double end as score from p")
def vocal_overlap_score(t: Tables) -> DataFrame:
    return _overlap_products(t).select("set_id", "pos", snap(_c("p"), 6).alias("product"), P.vocal_overlap_score(_c("p"), _c("ov")).alias("score"))


@query("score_vocal_safety", "handoff_pairs regions", _VO.replace(", h as", ", h as", 1) + """, m as (select set_id, pos, case when a_mid_energy > 0.5 and b_mid_energy > 0.5 then 0.6::double when a_mid_energy > 0.5 or b_mid_energy > 0.5 then 0.75::double else 0.9::double end as base from handoff_pairs)
select m.set_id, m.pos, round(0.4::double * base + 0.6::double * case when round(p, 9) > 0.5 then 0.3::double when round(p, 9) > 0.25 then 0.6::double when round(p, 9) > 0.1 then 0.8::double else 1::double end, 6) as score, base from m join p using (set_id, pos)""")
def score_vocal_safety(t: Tables) -> DataFrame:
    pairs = t.handoff_pairs().select("set_id", "pos", "a_mid_energy", "b_mid_energy")
    over = _overlap_products(t).select("set_id", "pos", P.vocal_overlap_score(_c("p"), _c("ov")).alias("o"))
    base = P.vocal_safety(_c("a_mid_energy"), _c("b_mid_energy"))
    return pairs.join(over, ["set_id", "pos"]).select("set_id", "pos", r6(P.vocal_safety(_c("a_mid_energy"), _c("b_mid_energy"), _c("o"))).alias("score"), base.alias("base"))


_LBL = "case event_id % 5 when 0 then 'verse' when 1 then 'chorus' when 2 then 'bridge' when 3 then 'drop' else 'outro' end"


def _sections(t: Tables) -> DataFrame:
    return t.regions().select("track_id", _c("event_id").alias("section_id"), "start_t", "end_t").withColumn("label", F.expr(_LBL.replace("event_id", "section_id")))


@query("section_at", "curve regions", f""", sc as (select track_id, event_id, start_t, end_t, {_LBL} as label from regions), pt as (select track_id, t, t * 60.0::double as x from curve),
a as (select pt.track_id, pt.t, arg_min(label, (start_t, event_id)) as lab from pt join sc on sc.track_id = pt.track_id and start_t <= x and x < end_t group by 1, 2),
b as (select pt.track_id, pt.t, arg_min(label, (start_t, event_id)) as lab from pt join sc on sc.track_id = pt.track_id and start_t <= x and x <= end_t group by 1, 2)
select pt.track_id, pt.t, coalesce(a.lab, case when x <= 44640 * 0.08::double then 'intro' when x >= 40000 then 'outro' else 'unknown' end) as half_open, coalesce(b.lab, 'unknown') as closed
from pt left join a using (track_id, t) left join b using (track_id, t)""")
def section_at(t: Tables) -> DataFrame:
    pts = t.curve().select("track_id", "t", (_c("t") * 60.0).alias("x"))
    sec = _sections(t)
    both = I.label_at(pts, sec, "track_id", ["t"], "x", 240.0).withColumnRenamed("label", "a")
    both = I.label_at(both, sec, "track_id", ["t"], "x", 240.0, closed=True)
    fallback = F.when(_c("x") <= 44640 * 0.08, "intro").when(_c("x") >= 40000, "outro").otherwise("unknown")
    return both.select("track_id", "t", F.coalesce("a", fallback).alias("half_open"), F.coalesce("label", F.lit("unknown")).alias("closed"))


PT = "pt as (select set_id, pos, src as track_id, round((0.5::double + (src % 5) / 10.0::double) * a_duration_sec + pos * 0.37::double, 4) as x, a_bpm as bpm from handoff_pairs)"
NB = "nb as (select pt.*, arg_min(bar_idx, (round(abs(x - bar_t), 6), bar_t)) as bar_idx, arg_min(bar_t, (round(abs(x - bar_t), 6), bar_t)) as bar_t from pt join bars using (track_id) group by all)"
_ALIGN = "greatest(0, 1 - abs((x - bar_t) * 1000) / (greatest(40, 60000 / bpm * 0.2::double) * 4))"


def _exit_points(t: Tables) -> DataFrame:
    x = (0.5 + (_c("src") % 5) / 10.0) * _c("a_duration_sec") + _c("pos") * 0.37
    return t.handoff_pairs().select("set_id", "pos", _c("src").alias("track_id"), F.round(x, 4).alias("x"), _c("a_bpm").alias("bpm"))


def _nearest_bars(t: Tables) -> DataFrame:
    # The bar grid is regular, but measured grids are not: use the general nearest join.
    n = I.nearest(_exit_points(t), C.bar_grid(t.tracks()), "track_id", "x", "bar_t", 30.0, ["bar_idx"])
    score = F.greatest(F.lit(0.0), 1 - F.abs((_c("x") - _c("near.t")) * 1000) / (F.greatest(F.lit(40.0), 60000 / _c("bpm") * 0.2) * 4))
    return n.select("set_id", "pos", "track_id", "x", "bpm", _c("near.bar_idx").alias("bar_idx"), _c("near.t").alias("bar_t"), score.alias("bar_score"))


@query("nearest_bar", "handoff_pairs", f", {BARS}, {PT}, {NB} select set_id, pos, bar_idx, round((x - bar_t) * 1000, 4) as error_ms, round({_ALIGN}, 6) as score from nb")
def nearest_bar(t: Tables) -> DataFrame:
    return _nearest_bars(t).select("set_id", "pos", "bar_idx", F.round((_c("x") - _c("bar_t")) * 1000, 4).alias("error_ms"), r6(_c("bar_score")).alias("score"))


_PHR = f"""gs as (select *, greatest(0, 1 - least(bar_idx % 8, 8 - bar_idx % 8) / 4.0::double) * {_ALIGN} as g from nb),
np as (select gs.set_id, gs.pos, min(round(abs(x - b.bar_t), 6)) as d from gs join bars b on b.track_id = gs.track_id and b.bar_idx % 16 = 3 group by 1, 2)"""


@query("phrase_alignment", "handoff_pairs", f", {BARS}, {PT}, {NB}, {_PHR} select set_id, pos, round(g + 1e-9, 6) as grouped, round(greatest(g, coalesce(1 - d * 1000 / (8 * 240 / greatest(bpm, 60) * 500), 0)) + 1e-9, 6) as score from gs left join np using (set_id, pos)")
def phrase_alignment(t: Tables) -> DataFrame:
    near = _nearest_bars(t)
    phrases = C.bar_grid(t.tracks()).where(_c("bar_idx") % 16 == 3).select("track_id", _c("bar_t").alias("phrase_t"))
    df = I.nearest(near, phrases, "track_id", "x", "phrase_t", 30.0)
    group = F.least(_c("bar_idx") % 8, 8 - _c("bar_idx") % 8)
    grouped = F.greatest(F.lit(0.0), 1 - group / 4) * _c("bar_score")
    found = 1 - F.round("distance", 6) * 1000 / (8 * 240 / F.greatest(_c("bpm"), F.lit(60.0)) * 500)
    return df.select("set_id", "pos", snap(grouped, 6).alias("grouped"), snap(F.greatest(grouped, F.coalesce(found, F.lit(0.0))), 6).alias("score"))


CUT = "ct as (select conv_id as track_id, turn as idx, turn * 10 + conv_id % 100 / 10.0::double as cut from conversations)"


def _cuts(t: Tables) -> DataFrame:
    return t.raw("conversations").select(_c("conv_id").alias("track_id"), _c("turn").alias("idx"), (_c("turn") * 10 + (_c("conv_id") % 100) / 10).alias("cut"))


def word_margin(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Distance of each cut to the nearest word interval, and whether it falls inside one.

    Only words overlapping a neighbourhood can matter once the nearest start and end
    are known, so this is two nearest joins and one containment join.
    """
    a = I.neighbours(cuts, words, "track_id", "cut", "start_sec", 20.0).withColumn("ahead", _c("next.t") - _c("cut")).withColumn(
        "at_start", _c("prev.t") == _c("cut")).drop("prev", "next")
    b = I.neighbours(a, words, "track_id", "cut", "end_sec", 20.0).withColumn("behind", _c("cut") - _c("prev.t")).drop("prev", "next")
    point = cuts.select("track_id", "idx", "cut", _c("cut").alias("cut_e"))
    w = words.where(_c("end_sec") > _c("start_sec")).select("track_id", "start_sec", "end_sec")
    within = I.overlap_join(point, w, "track_id", ("cut", "cut_e"), ("start_sec", "end_sec"), 20.0).groupBy("track_id", "idx").agg(
        F.min(F.least(_c("cut") - _c("start_sec"), _c("end_sec") - _c("cut"))).alias("inner"))
    df = b.join(within, ["track_id", "idx"], "left")
    out = F.least(_c("ahead"), _c("behind"), F.when(_c("at_start"), F.lit(0.0)))
    inside = _c("inner").isNotNull() & (out.isNull() | (F.round(_c("inner"), 9) < F.round(out, 9)))
    return df.select("track_id", "idx", "cut", r6(F.least(out, _c("inner"))).alias("margin"), inside.alias("inside"))


WM = """wm0 as (select ct.track_id, ct.idx, ct.cut, start_sec < cut and cut < end_sec as ins, round(case when start_sec < cut and cut < end_sec then least(cut - start_sec, end_sec - cut) when cut <= start_sec then start_sec - cut else cut - end_sec end, 9) as d from ct join words w on w.track_id = ct.track_id and end_sec > start_sec),
wm as (select track_id, idx, any_value(cut) as cut, round(min(d), 6) as margin, arg_min(ins, (d, ins)) as inside from wm0 group by 1, 2)"""


@query("nearest_word_margin", "words", f", {CUT}, {WM} select * from wm")
def nearest_word_margin(t: Tables) -> DataFrame:
    return word_margin(_cuts(t), t.words())


_MP = """, b0 as (select track_id, bar_t from bars where bar_idx % 4 = 0), p as (select track_id, bar_t from bars where bar_idx % 16 = 3), x as (select track_id, round(duration_sec * f, 4) as bar_t from tracks, (values (0.25::double), (0.5::double), (0.75::double), (0.85::double)) q(f)),
few as (select track_id from bars group by 1 having count(*) < 8)"""


def _fractions(v: Column) -> Column:
    return F.array(*[F.round(v["duration_sec"] * f, 4) for f in (0.25, 0.5, 0.75, 0.85)])


def _track_points(t: Tables, times: Callable[[Column], Column], **facts: Column) -> DataFrame:
    """Distinct points of each track. A track is gathered before it is spread, so only its features are shuffled, never its points."""
    versions = t.tracks().groupBy("track_id").agg(F.collect_set(F.struct("bpm", "duration_sec")).alias("versions"))
    points = F.array_distinct(F.flatten(F.transform("versions", times)))
    return versions.withColumns(facts).select("track_id", F.explode(points).alias("point_t"))


@query("musical_points", "tracks", f""", {BARS}{_MP}, fb as (select track_id, k * (960 / greatest(bpm, 60)) as bar_t from tracks, lateral (select unnest(range(0, cast(ceil(duration_sec / (960 / greatest(bpm, 60))) as bigint))) as k) where track_id in (select track_id from few))
select distinct track_id, round(bar_t, 4) as point_t from (select * from b0 union all select * from p union all select * from x union all select * from fb)""")
def musical_points(t: Tables) -> DataFrame:
    step = lambda v: 960 / F.greatest(v["bpm"], F.lit(60.0))
    grid = lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.ceil(v["duration_sec"] / step(v)).cast("int")), lambda k: k < F.ceil(v["duration_sec"] / step(v))), lambda k: F.round(k * step(v), 4))
    marks = lambda v: C.bar_times(v["bpm"], v["duration_sec"], lambda k: (k % 4 == 0) | (k % 16 == 3))
    n_bars = F.aggregate("versions", F.lit(0), lambda n, v: n + F.size(C.bar_times(v["bpm"], v["duration_sec"])))
    few = n_bars.between(1, 7) & _c("track_id").isNotNull()
    none = F.array().cast("array<double>")
    return _track_points(t, lambda v: F.concat(marks(v), _fractions(v), F.when(_c("few"), grid(v)).otherwise(none)), few=few)


@query("boundary_grid", "tracks", f", {BARS}{_MP} select distinct track_id, round(bar_t, 4) as point_t from (select track_id, bar_t from bars union all select * from x union all select track_id, 0 from tracks union all select track_id, duration_sec from tracks)")
def boundary_grid(t: Tables) -> DataFrame:
    return _track_points(t, lambda v: F.concat(C.bar_times(v["bpm"], v["duration_sec"]), _fractions(v), F.array(F.lit(0.0), F.round(v["duration_sec"], 4))))


# --- segments ---------------------------------------------------------------------------

SG = f"""bt as (select distinct track_id, t from (select track_id, time as t from ph union all select track_id, 0 from wh union all select track_id, bar_t from be)),
sg0 as (select a.track_id, a.bar_t as s, b.bar_t as e, q.n as bars from be a cross join (values (4), (8), (16), (32)) q(n) join be b on b.track_id = a.track_id and b.bar_idx = a.bar_idx + q.n),
sg1 as (select sg0.*, arg_min(label, start_t) as label from sg0 left join sec on sec.track_id = sg0.track_id and start_t <= (s + e) / 2.0 and end_t >= (s + e) / 2.0 group by all),
sg as (select track_id, s, e, bars, coalesce(label, 'unknown') as role, round({S.clip("0.45::double + least(0.25::double, bars / 64.0::double) + case when coalesce(label, 'unknown') <> 'unknown' then 0.15::double else 0 end + 0.16::double")}, 4) as quality,
 left(sha1(concat(track_id, ':', s, ':', e)), 16) as segment_id from sg1)"""


def _segments(t: Tables) -> DataFrame:
    bars = _curve_bars(t)
    phrases = C.phrase_boundaries(bars)
    sec = C.section_labels(bars, phrases, SPAN, BAR).select("track_id", F.xxhash64("start_t").alias("section_id"), "start_t", "end_t", "label")
    n = F.explode(F.array(*[F.lit(x) for x in (4, 8, 16, 32)])).alias("bars")
    # A bar's partner n bars later exists while it lies inside the grid: no join needed.
    pairs = bars.select("track_id", "bar_idx", n).where(_c("bar_idx") + _c("bars") < SPAN // BAR).select(
        "track_id", (_c("bar_idx") * BAR).alias("s"), ((_c("bar_idx") + _c("bars")) * BAR).alias("e"), "bars")
    pairs = pairs.withColumn("mid", (_c("s") + _c("e")) / 2)
    labelled = I.label_at(pairs, sec, "track_id", ["s", "e"], "mid", 48.0, closed=True)
    role = F.coalesce("label", F.lit("unknown"))
    quality = clip(0.45 + F.least(F.lit(0.25), _c("bars") / 64) + F.when(role != "unknown", 0.15).otherwise(0.0) + 0.16)
    return labelled.select("track_id", "s", "e", _c("bars").cast("bigint").alias("bars"), role.alias("role"), F.round(quality, 4).alias("quality"),
                           F.substring(F.sha1(F.concat_ws(":", "track_id", "s", "e")), 1, 16).alias("segment_id"))


_SGO = f", {CB}, {PH}, {SEC}, {SG}"


@query("segment_candidates", "curve", f"{_SGO} select track_id, cast(s as bigint) as s, cast(e as bigint) as e, cast(bars as bigint) as bars, role, quality, segment_id from sg")
def segment_candidates(t: Tables) -> DataFrame:
    return _segments(t)


def shortlist(segments: DataFrame, k: int = 48, per_role: int = 4) -> DataFrame:
    """Up to four per role, then six per bar count, then the best of the rest, ``k`` in all."""
    best = [F.desc("quality"), F.desc(_c("e") - _c("s")), F.asc("s")]
    w = lambda *k_: Window.partitionBy("track_id", *k_).orderBy(*best)
    ranked = segments.withColumn("rr", F.row_number().over(w("role"))).withColumn("rb", F.row_number().over(w("bars")))
    tier = F.when(_c("rr") <= per_role, 0).when(_c("bars").isin(4, 8, 16, 32) & (_c("rb") <= max(2, k // 8)), 1).otherwise(2)
    ranked = ranked.withColumn("tier", tier.cast("bigint"))
    final = Window.partitionBy("track_id").orderBy("tier", *best)
    return ranked.withColumn("rank", F.row_number().over(final).cast("bigint")).where(_c("rank") <= k).drop("rr", "rb")


@query("segment_shortlist", "curve", f"""{_SGO}, r1 as (select *, row_number() over (partition by track_id, role order by quality desc, e - s desc, s) as rr, row_number() over (partition by track_id, bars order by quality desc, e - s desc, s) as rb from sg),
r2 as (select *, cast(case when rr <= 4 then 0 when rb <= 6 then 1 else 2 end as bigint) as tier from r1), r3 as (select *, row_number() over (partition by track_id order by tier, quality desc, e - s desc, s) as rank from r2)
select track_id, segment_id, tier, rank from r3 where rank <= 48""")
def segment_shortlist(t: Tables) -> DataFrame:
    return shortlist(_segments(t)).select("track_id", "segment_id", "tier", "rank")


# --- small aggregates -------------------------------------------------------------------------

@query("library_gain", "set_items tracks", """, j as (select s.set_id, s.pos, t.integrated_lufs as l from set_items s join tracks t using (track_id)), m as (select set_id, median(l) filter (where l > -60 and l < -1) as m from j group by 1)
select set_id, pos, round(case when l > -60 and l < -1 then greatest(-4, least(4, m - l)) else 0 end, 3) as gain_db from j join m using (set_id)""")
def library_gain(t: Tables) -> DataFrame:
    j = t.set_items().join(t.tracks().select("track_id", "integrated_lufs"), "track_id")
    valid = (_c("integrated_lufs") > -60) & (_c("integrated_lufs") < -1)
    m = j.where(valid).groupBy("set_id").agg(F.median("integrated_lufs").alias("m"))
    gain = F.when(valid, clip(_c("m") - _c("integrated_lufs"), -4.0, 4.0)).otherwise(0.0)
    return j.join(m, "set_id", "left").select("set_id", "pos", F.round(gain, 3).alias("gain_db"))


@query("analysis_confidence", "tracks curve", f""", {CB}, {PH}, np as (select track_id, count(*) as k from ph group by 1), nc as (select track_id, count(*) as k from curve group by 1)
select track_id, round((low_energy + mid_energy + least(1.0::double, coalesce(nc.k, 0) / 20.0::double) + least(1.0::double, coalesce(np.k, 0) / 4.0::double)) / 4, 6) as confidence from tracks left join np using (track_id) left join nc using (track_id)""")
def analysis_confidence(t: Tables) -> DataFrame:
    phrases = C.phrase_boundaries(_curve_bars(t)).groupBy("track_id").agg(F.count(F.lit(1)).alias("np"))
    beats = t.curve().groupBy("track_id").agg(F.count(F.lit(1)).alias("nc"))
    share = lambda c, n: F.least(F.lit(1.0), F.coalesce(_c(c), F.lit(0)) / n)
    return t.tracks().join(phrases, "track_id", "left").join(beats, "track_id", "left").select(
        "track_id", r6((_c("low_energy") + _c("mid_energy") + share("nc", 20.0) + share("np", 4.0)) / 4).alias("confidence"))
