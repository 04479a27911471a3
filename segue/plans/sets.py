"""Figures, scores and layout of ordered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions.basic import r6, snap
from segue.operators import pairs as pair_ops
from segue.operators import sets as ops
from segue.plans import _sql as S
from segue.registry import query
from segue.sources.tables import Tables

_c = F.col
SI = "si as (select s.set_id, s.pos, s.track_id, s.overlap_sec, s.transition_type, t.bpm, t.mean_energy, t.duration_sec, t.low_energy, t.mid_energy, t.title from set_items s join tracks t using (track_id))"
T_ = "set_items tracks"


def _items(t: Tables) -> DataFrame:
    tr = t.tracks().select("track_id", "bpm", "mean_energy", "duration_sec", "low_energy", "mid_energy", "title")
    return t.set_items().join(tr, "track_id")


@query("set_overview", T_ + " sets", f""", {SI}, a as (select set_id, count(*) as n_tracks, avg(bpm) as b, avg(mean_energy) as e from si group by 1)
select set_id, n_tracks, round(total_duration_sec / 60 + 1e-9, 4) as minutes, round(b + 1e-9, 4) as avg_bpm, round(e + 1e-9, 6) as avg_energy,
 case when round(e, 9) < 0.35 then 'low' when round(e, 9) < 0.55 then 'medium' when round(e, 9) < 0.75 then 'high' else 'very high' end as band from a join sets using (set_id)""")
def set_overview(t: Tables) -> DataFrame:
    return ops.overview(_items(t), t.sets())


@query("energy_journey", T_, f""", {SI}, d as (select *, mean_energy - lag(mean_energy) over (partition by set_id order by pos) as d, count(*) over (partition by set_id) as n from si)
select set_id, arg_min(mean_energy, pos) as start_energy, max(mean_energy) filter (where pos = n // 2 + 1) as mid_energy, arg_max(mean_energy, pos) as end_energy, max(mean_energy) as peak_energy,
 round((arg_max(pos, (mean_energy, -pos)) - 1) / max(n) * 100 + 1e-9, 4) as peak_pct, count(*) filter (where d > 0) as rises, max(n) - 1 - count(*) filter (where d > 0) as drops from d group by 1""")
def energy_journey(t: Tables) -> DataFrame:
    return ops.journey(_items(t))


@query("type_mix", "handoffs", """, p as (select set_id, transition_type, count(*) as n, min(pos) as f from handoffs group by 1, 2)
select set_id, arg_max(transition_type, (n, -f)) as dominant, max(n) as n_dominant, cast(sum(n) as bigint) as n, count(*) as n_types, round(max(n) / sum(n) + 1e-9, 6) as share from p group by 1""")
def type_mix(t: Tables) -> DataFrame:
    return ops.type_mix(t.handoffs())


@query("set_extremes", T_, f""", {SI} select set_id, arg_min(track_id, (mean_energy, pos)) as lowest, arg_max(track_id, (mean_energy, pos)) as highest, min(mean_energy) as low_energy, max(mean_energy) as high_energy,
 max(bpm) - min(bpm) as bpm_range, case when max(bpm) - min(bpm) < 5 then 'consistent' when max(bpm) - min(bpm) > 20 then 'varied' else 'normal' end as bpm_flag from si group by 1""")
def set_extremes(t: Tables) -> DataFrame:
    return ops.extremes(_items(t))


_SMOOTH = ["beatmatched_blend", "crossfade", "filter_sweep"]


@query("intent_alignment", T_ + " requests", f""", {SI}, j as (select si.*, r.* from si join orders o on o.o_orderkey = si.set_id join requests r on r.request_id = o.o_custkey)
select set_id, count(*) filter (where bpm between bpm_min and bpm_max) as bpm_hits, round(avg(case when bpm between bpm_min and bpm_max then 1 else 0 end) * 100 + 1e-9, 4) as bpm_pct,
 count(*) filter (where mean_energy between energy_min and energy_max) as energy_hits, round(avg(case when mean_energy between energy_min and energy_max then 1 else 0 end) * 100 + 1e-9, 4) as energy_pct,
 count(distinct transition_type) filter (where transition_type in ('beatmatched_blend', 'crossfade', 'filter_sweep')) as preferred_types from j group by 1""")
def intent_alignment(t: Tables) -> DataFrame:
    owner = t.raw("orders").select(_c("o_orderkey").alias("set_id"), _c("o_custkey").alias("request_id"))
    wanted = owner.join(t.requests(), "request_id").select("set_id", "bpm_min", "bpm_max", "energy_min", "energy_max")
    return ops.alignment(_items(t).join(wanted, "set_id").withColumn("preferred", _c("transition_type").isin(_SMOOTH)))


_OV = "('crossfade','bass_swap','loop_blend','filter_sweep','phase_lock','echo_tail')"
_CX = "('loop_roll','tape_stop','bass_swap','loop_blend')"
FADE = f"sum(case when transition_type in {_OV} and overlap_sec >= 0.5 then overlap_sec else 0 end)"


@query("fade_dominance", "handoffs sets", f", f as (select set_id, {FADE} as fade_sec from handoffs group by 1) select set_id, fade_sec, round(fade_sec / total_duration_sec + 1e-9, 6) as fade_dominance, fade_sec / total_duration_sec > 0.2 as violated from f join sets using (set_id) where total_duration_sec > 0")
def fade_dominance(t: Tables) -> DataFrame:
    return ops.fade_dominance(t.handoffs(), t.sets())


@query("technique_diversity", "handoffs", """, p as (select set_id, transition_type, count(*) as n from handoffs group by 1, 2), q as (select *, n / sum(n) over (partition by set_id) as p from p)
select set_id, count(*) as n_types, round(case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end + 1e-9, 6) as diversity from q group by 1""")
def technique_diversity(t: Tables) -> DataFrame:
    return ops.technique_diversity(t.handoffs())


@query("max_consecutive", "handoffs", f""", g as (select set_id, pos, transition_type in {_CX} as h, pos - sum(case when transition_type in {_CX} then 1 else 0 end) over (partition by set_id order by pos) as g from handoffs),
r as (select set_id, g, count(*) filter (where h) as run from g group by 1, 2) select set_id, max(run) as longest, max(run) > 3 as violated from r group by 1""")
def max_consecutive(t: Tables) -> DataFrame:
    return ops.longest_run(t.handoffs())


@query("timeline_stats", "set_items handoffs", f""", u as (select set_id, track_id, count(*) as n from set_items group by 1, 2), v as (select set_id, count(*) as unique_tracks, max(n) as max_reuse, cast(sum(n - 1) as bigint) as reused from u group by 1),
e as (select set_id, cast(sum(n - 1) as bigint) as rp from (select set_id, src, dst, count(*) as n from handoffs group by 1, 2, 3) group by 1),
b as (select set_id, count(*) as appearances, count(distinct transition_type) as type_variety, count(*) filter (where transition_type in {_CX}) as strong_count, round(avg(overlap_sec) + 1e-9, 6) as avg_overlap from set_items group by 1)
select b.*, v.unique_tracks, v.max_reuse, v.reused, coalesce(e.rp, 0) as repeated_pairs from b join v using (set_id) left join e using (set_id)""")
def timeline_stats(t: Tables) -> DataFrame:
    return ops.timeline_stats(t.set_items())


@query("set_arc", T_, f""", {SI}, d as (select *, count(*) over (partition by set_id) as n from si), a as (select set_id, max(n) as n, avg(mean_energy) filter (where pos <= greatest(1, n // 3)) as f, avg(mean_energy) filter (where pos > n - greatest(1, n // 3)) as l, max(mean_energy) - min(mean_energy) as s, count(distinct track_id) / max(n) as r from d group by 1)
select set_id, case when n < 2 then 'steady' when round(l - f, 9) > 0.12 then 'build' when round(l - f, 9) < -0.12 then 'release' when round(s, 9) > 0.25 then 'wave' else 'steady' end as arc,
 case when r >= 0.6 then 'high' when r < 0.4 then 'limited' else 'moderate' end as diversity from a""")
def set_arc(t: Tables) -> DataFrame:
    return ops.set_arc(_items(t))


@query("set_score", "handoff_pairs sets", f""", q as (select *, {S.overall()} as quality, (a_mid_energy + b_mid_energy) / 2 as conf from handoff_pairs), a as (select set_id, avg(quality) as q, avg(conf) as c, {FADE} as fade from q group by 1)
select set_id, round(greatest(0, q - greatest(0, fade / total_duration_sec - 0.2::double) * q * 0.5::double) + 1e-9, 6) as score, round(c + 1e-9, 6) as avg_confidence from a join sets using (set_id)""")
def set_score(t: Tables) -> DataFrame:
    df = pair_ops.score_pairs(t.handoff_pairs()).select(
        "set_id", "transition_type", "overlap_sec", _c("overall").alias("quality"), ((_c("a_mid_energy") + _c("b_mid_energy")) / 2).alias("confidence"))
    return ops.set_score(df, t.sets())


_PROG = "(pos / greatest(n - 1, 1))"
_BONUS = f"""case energy_profile when 'steady' then greatest(0, 1 - abs(d) * 2) * 0.1::double when 'slow_build' then case when d >= 0 then d * 0.15::double * (1 + {_PROG}) else d * 0.1::double end
 when 'warmup_to_peak' then case when {_PROG} < 0.7::double then case when d >= 0 then d * 0.2::double else -0.05::double end else greatest(0, 1 - abs(d) * 3) * 0.1::double end
 when 'wave' then -abs(mean_energy + d - (0.5::double + 0.4::double * sin({_PROG} * 2 * pi()))) * 0.1::double
 when 'cooldown' then case when {_PROG} > 0.5::double then case when d > 0 then -d * 0.15::double else 0.05::double end else greatest(0, 1 - abs(d) * 3) * 0.05::double end end"""


def _profiled(t: Tables) -> DataFrame:
    return _items(t).join(t.sets().select("set_id", "energy_profile"), "set_id")


@query("progression_bonus", T_ + " sets", f""", {SI}, d as (select si.set_id, pos, mean_energy, lead(mean_energy) over (partition by si.set_id order by pos) - mean_energy as d, count(*) over (partition by si.set_id) as n, energy_profile from si join sets using (set_id))
select set_id, pos, energy_profile, round({_BONUS} + 1e-9, 6) as bonus from d where d is not null""")
def progression_bonus(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = _profiled(t).select("set_id", "pos", "mean_energy", "energy_profile", F.lead("mean_energy").over(ops.by_set()).alias("after"),
                            F.count(F.lit(1)).over(Window.partitionBy("set_id")).alias("n")).where(_c("after").isNotNull())
    progress = _c("pos") / F.greatest(_c("n") - 1, F.lit(1))
    return d.select("set_id", "pos", "energy_profile", snap(ops.progression_bonus(_c("energy_profile"), progress, _c("mean_energy"), _c("after")), 6).alias("bonus"))


@query("trajectory_score", T_ + " sets", f""", {SI}, d0 as (select si.set_id, pos, mean_energy, round(mean_energy - lag(mean_energy) over (partition by si.set_id order by pos), 9) as d, count(*) over (partition by si.set_id) as n, energy_profile from si join sets using (set_id)),
d as (select *, case when sign(d) <> sign(lag(d) over (partition by set_id order by pos)) then 1 else 0 end as flip, floor(n * 0.7::double) as pk from d0),
a as (select set_id, energy_profile, max(n) as n, var_pop(mean_energy) as v, arg_min(mean_energy, pos) as e0, arg_max(mean_energy, pos) as e1, arg_max(d, pos) as ls, arg_max(pos, (mean_energy, -pos)) - 1 as peak,
 avg(case when d >= -0.02 then 1.0 when d is not null then 0 end) as calm, sum(least(d + 0.08::double, 0)) filter (where d is not null) as severe,
 avg(case when d > 0 then 1.0 else 0 end) filter (where d is not null and pos - 1 <= pk) as eu, sum(least(d + 0.05::double, 0)) filter (where d is not null and pos - 1 <= pk) as ed,
 max(mean_energy) filter (where pos = least(pk, n - 1) + 1) as e70, sum(flip) as flips from d group by 1, 2)
select set_id, energy_profile, round(case when n < 3 then 0 else case energy_profile when 'steady' then 0.15::double - v * 2 when 'slow_build' then calm * 0.18::double + (e1 - e0) * 0.35::double + severe * 1.2::double
 when 'warmup_to_peak' then case when peak < floor(n * 0.7::double) * 0.6::double then -0.25::double else 0 end - greatest(0, e0 - 0.6::double) * 0.8::double + coalesce(eu * 0.25::double + ed * 1.5::double, 0) + (e70 - e0) * 0.35::double
 when 'cooldown' then case when ls > 0.1 then -0.15::double else 0 end - greatest(0, 0.3::double - e0) * 0.2::double when 'wave' then flips * 0.02::double end end + 1e-9, 6) as score from a""")
def trajectory_score(t: Tables) -> DataFrame:
    return ops.trajectory_score(_profiled(t))


@query("expected_shape", T_ + " sets", """, d as (select set_id, pos, energy_profile, (pos - 1) / greatest(count(*) over (partition by set_id) - 1, 1) as x from set_items join sets using (set_id))
select set_id, pos, energy_profile, round(case energy_profile when 'warmup_to_peak' then greatest(0, least(1, 0.3::double + 0.6::double * least(x / 0.7::double, 1))) when 'cooldown' then greatest(0, least(1, 0.7::double - 0.5::double * greatest((x - 0.3::double) / 0.7::double, 0)))
 when 'wave' then 0.5::double + 0.3::double * sin(x * 2 * pi()) when 'slow_build' then 0.3::double + 0.5::double * x else 0.5::double end + 1e-9, 6) as expected,
 round(greatest(0, least(1, 0.4::double + 0.5::double * case when x < 0.3::double then x / 0.3::double else 1 - (x - 0.3::double) / 0.7::double end)) + 1e-9, 6) as peak_early,
 round(greatest(0, least(1, 0.4::double + 0.5::double * case when x < 0.6::double then x / 0.6::double * 0.5::double else (x - 0.6::double) / 0.4::double end)) + 1e-9, 6) as peak_late from d""")
def expected_shape(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = t.set_items().join(t.sets().select("set_id", "energy_profile"), "set_id").withColumn(
        "x", (_c("pos") - 1) / F.greatest(F.count(F.lit(1)).over(Window.partitionBy("set_id")) - 1, F.lit(1)))
    shape = lambda p: snap(ops.expected_shape(p, _c("x")), 6)
    return d.select("set_id", "pos", "energy_profile", shape(_c("energy_profile")).alias("expected"),
                    shape(F.lit("peak_early")).alias("peak_early"), shape(F.lit("peak_late")).alias("peak_late"))


@query("recency_penalty", "set_items", """, d as (select *, lag(track_id) over (partition by set_id order by pos) as prev from set_items),
w as (select set_id, pos, list_filter(list(transition_type) over (partition by set_id order by pos rows between 3 preceding and 1 preceding), lambda x: x = transition_type) as rt,
 list_filter(list(track_id) over (partition by set_id order by pos rows between 3 preceding and 1 preceding), lambda x: x = track_id) as rk,
 case when prev is not null then row_number() over (partition by set_id, prev, track_id order by pos) - 1 else 0 end as eu, row_number() over (partition by set_id, transition_type order by pos) - 1 as tu from d)
select set_id, pos, coalesce(len(rt), 0) as recent_type, round(least(0.16::double, 0.055::double * coalesce(len(rk), 0)), 6) as track_penalty, round(least(0.14::double, 0.07::double * eu), 6) as edge_penalty, round(least(0.08::double, 0.025::double * tu), 6) as type_penalty from w""")
def recency_penalty(t: Tables) -> DataFrame:
    return ops.recency_penalty(t.set_items())


_STYLES = "case set_id % 5 when 0 then 'experimental' when 1 then 'club' when 2 then 'story' when 3 then 'smooth' else 'quick_mix' end"
_TPL = "case style " + " ".join(f"when '{k}' then {v}" for k, v in ops.ARC_TEMPLATES.items()) + " end"
ARC = f"""ar0 as (select set_id, pos, pos - 1 as i, count(*) over (partition by set_id) as n, {_STYLES} as style from set_items), ar1 as (select *, {_TPL} as tpl from ar0),
ar as (select set_id, pos, style, case when n = 1 then 'INTRO' when n <= len(tpl) then tpl[cast(round_even(i * (len(tpl) - 1) / greatest(n - 1, 1), 0) as bigint) + 1] when i = 0 then 'INTRO' when i = n - 1 then 'OUTRO'
 when i < n * 0.25 then case when i = 1 then 'ESTABLISH' else 'DEVELOP' end when i < n * 0.55 then 'BUILD' when i < n * 0.72 then 'PEAK' when i < n * 0.86 then 'RELEASE' else 'CALLBACK' end as state from ar1)"""


def _arc(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = t.set_items().select("set_id", "pos", (_c("pos") - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("set_id")).alias("n"), F.expr(_STYLES).alias("style"))
    return d.select("set_id", "pos", "style", ops.arc_state(_c("style"), _c("i"), _c("n")).alias("state"))


@query("arc_states", "set_items", f", {ARC} select * from ar")
def arc_states(t: Tables) -> DataFrame:
    return _arc(t)


@query("boundary_role", "set_items", f""", {ARC}, b as (select *, lead(state) over (partition by set_id order by pos) as nxt from ar), r as (select set_id, pos, state, nxt, case when nxt = 'BUILD' then 'BUILD' when nxt = 'PEAK' then 'REVEAL' when nxt = 'RELEASE' then 'RELEASE' when nxt = 'CALLBACK' then 'CALLBACK' when nxt = 'OUTRO' then 'CLOSE'
 when state in ('INTRO','ESTABLISH') then 'CONTINUE' when nxt in ('DEVELOP','ESTABLISH') then 'LIFT' else 'CONTINUE' end as role from b where nxt is not null)
select set_id, pos, state, nxt as next_state, role, cast(case when role in ('BUILD','REVEAL','RESET') then 2 else 1 end as bigint) as preparation_bars, cast(case when role in ('REVEAL','RESET','CALLBACK') then 4 else 2 end as bigint) as landing_bars from r""")
def boundary_role(t: Tables) -> DataFrame:
    d = _arc(t).withColumn("next_state", F.lead("state").over(ops.by_set())).where(_c("next_state").isNotNull())
    role = ops.boundary_role(_c("state"), _c("next_state"))
    return d.select("set_id", "pos", "state", "next_state", role.alias("role")).select(
        "*", F.when(_c("role").isin("BUILD", "REVEAL", "RESET"), 2).otherwise(1).cast("bigint").alias("preparation_bars"),
        F.when(_c("role").isin("REVEAL", "RESET", "CALLBACK"), 4).otherwise(2).cast("bigint").alias("landing_bars"))


@query("unique_in_order", "set_items", ", f as (select set_id, track_id, min(pos) as pos from set_items group by 1, 2) select set_id, track_id, pos, row_number() over (partition by set_id order by pos) as ord from f")
def unique_in_order(t: Tables) -> DataFrame:
    return ops.unique_in_order(t.set_items())


@query("timeline_reorder", T_, f""", {SI}, d as (select set_id, pos, track_id, duration_sec, lag(duration_sec) over (partition by set_id order by pos) as pd from si),
e as (select *, case when pd is null then 0::double else least(3, pd * 0.2::double, duration_sec * 0.2::double) end as ov from d),
f as (select *, sum(coalesce(pd, 0) - ov) over (partition by set_id order by pos) as st from e)
select set_id, pos, track_id, round(ov, 6) as overlap, round(st, 6) as out_start, round(st + duration_sec, 6) as out_end from f""")
def timeline_reorder(t: Tables) -> DataFrame:
    d = ops.reorder(_items(t).select("set_id", "pos", "track_id", "duration_sec"), 3.0)
    return d.select("set_id", "pos", "track_id", r6(_c("overlap")).alias("overlap"), r6(_c("out_start")).alias("out_start"), r6(_c("out_end")).alias("out_end"))


# Exit, entry and overlap of each handoff: exit at 60-100 % of the source, entry at 0-30 s of the target.
_HD = """hd as (select h.set_id, h.pos, a.duration_sec as adur, b.duration_sec as bdur, a.bpm as abpm, b.bpm as bbpm, a.duration_sec * (0.6::double + (src % 5) / 10.0::double) as exit_t, (dst % 7) * 5.0::double as entry_t, h.overlap_sec, h.transition_type
 from handoffs h join tracks a on a.track_id = h.src join tracks b on b.track_id = h.dst),
hc as (select *, entry_t + case when transition_type = 'beatmatched_blend' and abs(abpm - bbpm) > 0.5 then overlap_sec * abpm / bbpm else overlap_sec end as cursor_t from hd)"""


def _handoff_times(t: Tables) -> DataFrame:
    p = t.handoff_pairs()
    consumed = target_consumed(_c("transition_type"), _c("overlap_sec"), _c("a_bpm"), _c("b_bpm"))
    return p.select(
        "set_id", "pos", "src", "dst", "overlap_sec", "transition_type", "a_bpm", "b_bpm", "a_duration_sec", "b_duration_sec",
        (_c("a_duration_sec") * (0.6 + (_c("src") % 5) / 10.0)).alias("exit_t"), ((_c("dst") % 7) * 5.0).alias("entry_t"), consumed.alias("consumed"),
    ).withColumn("cursor_t", _c("entry_t") + _c("consumed"))


def target_consumed(kind, overlap, a_bpm, b_bpm):
    """Seconds of the target used up by a blend; a stretched target is read faster or slower."""
    stretch = (kind == "beatmatched_blend") & (a_bpm > 0) & (b_bpm > 0) & (F.abs(a_bpm - b_bpm) > 0.5)
    return F.when(stretch, overlap * a_bpm / b_bpm).otherwise(overlap)


@query("target_consumed", "handoff_pairs", "select set_id, pos, round(case when transition_type = 'beatmatched_blend' and abs(a_bpm - b_bpm) > 0.5 then overlap_sec * a_bpm / b_bpm else overlap_sec end + 1e-9, 6) as consumed_sec from handoff_pairs")
def target_consumed_query(t: Tables) -> DataFrame:
    return _handoff_times(t).select("set_id", "pos", snap(_c("consumed"), 6).alias("consumed_sec"))


@query("set_duration", T_ + " handoffs sets", f""", {_HD}, d as (select *, lead(exit_t) over (partition by set_id order by pos) as nx, row_number() over (partition by set_id order by pos) as k from hc),
a as (select set_id, sum(case when k = 1 then exit_t else 0 end + overlap_sec + case when nx is not null then greatest(0, nx - cursor_t) else 0 end) as base, arg_max(bdur, pos) as ld, arg_max(cursor_t, pos) as lc from d group by 1),
b as (select a.*, least(180, greatest(70, ld * 0.48::double)) as pref, least(300, greatest(120, ld * 0.78::double)) as mx, total_duration_sec as target from a join sets using (set_id))
select set_id, round(base + greatest(0, least(ld, lc + least(mx, greatest(pref, target - base), greatest(0, ld - lc))) - lc) + 1e-9, 4) as duration_sec from b""")
def set_duration(t: Tables) -> DataFrame:
    d = _handoff_times(t).withColumn("nx", F.lead("exit_t").over(ops.by_set()))
    body = F.when(_c("nx").isNotNull(), F.greatest(F.lit(0.0), _c("nx") - _c("cursor_t"))).otherwise(0.0)
    first = F.when(_c("pos") == 1, _c("exit_t")).otherwise(0.0)
    a = d.groupBy("set_id").agg(F.sum(first + _c("overlap_sec") + body).alias("base"), F.max_by("b_duration_sec", "pos").alias("ld"), F.max_by("cursor_t", "pos").alias("lc"))
    a = a.join(t.sets().select("set_id", "total_duration_sec"), "set_id")
    _, preferred, longest = playtime_bounds(_c("ld"))
    body = F.least(longest, F.greatest(preferred, _c("total_duration_sec") - _c("base")), F.greatest(F.lit(0.0), _c("ld") - _c("lc")))
    end = F.least(_c("ld"), _c("lc") + body)
    return a.select("set_id", snap(_c("base") + F.greatest(F.lit(0.0), end - _c("lc")), 4).alias("duration_sec"))


def playtime_bounds(duration):
    """Minimum, preferred and maximum useful seconds of a track."""
    d = F.greatest(F.lit(1.0), duration)
    between = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    return between(d * 0.28, 55.0, 90.0), between(d * 0.48, 70.0, 180.0), between(d * 0.78, 120.0, 300.0)


@query("playtime_bounds", "tracks", """select track_id, round(least(90, greatest(55, duration_sec * 0.28::double)) + 1e-9, 4) as minimum, round(least(180, greatest(70, duration_sec * 0.48::double)) + 1e-9, 4) as preferred,
 round(least(300, greatest(120, duration_sec * 0.78::double)) + 1e-9, 4) as maximum, round(least(greatest(45, duration_sec * 0.3::double), 180, duration_sec) + 1e-9, 4) as entry_limit from tracks""")
def playtime(t: Tables) -> DataFrame:
    d = _c("duration_sec")
    lo, mid, hi = playtime_bounds(d)
    return t.tracks().select("track_id", snap(lo, 4).alias("minimum"), snap(mid, 4).alias("preferred"), snap(hi, 4).alias("maximum"),
                             snap(F.least(F.greatest(F.lit(45.0), d * 0.3), F.lit(180.0), d), 4).alias("entry_limit"))


# --- section and role joins ----------------------------------------------------------------

_NAMES = "case event_id % 9 when 0 then ' Intro' when 1 then 'verse' when 2 then 'Pre Chorus' when 3 then 'CHORUS' when 4 then 'hook' when 5 then 'solo' when 6 then 'drop' when 7 then 'bridge ' else 'outro' end"
_CLEAN = "case when replace(lower(trim({x})), ' ', '_') in ('intro','verse','pre_chorus','pre-chorus','chorus','hook','breakdown','build','drop','instrumental','outro','bridge') then replace(lower(trim({x})), ' ', '_') else 'unknown' end"


@query("section_clean", "", f"with n as (select event_id, {_NAMES} as raw_name from events) select event_id, raw_name, {_CLEAN.format(x='raw_name')} as section from n")
def section_clean(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr("event_id", f"{_NAMES} as raw_name").withColumn("section", ops.clean_section(_c("raw_name")))


_SEQ = f"sq as (select user_id as track_id, event_id, {_CLEAN.format(x='(' + _NAMES + ')')} as a, {_CLEAN.format(x='(' + _NAMES.replace('event_id', 'event_id // 3') + ')')} as b from events)"


def _section_pairs(t: Tables) -> DataFrame:
    df = t.raw("events").selectExpr("user_id as track_id", "event_id", f"{_NAMES} as x", f"{_NAMES.replace('event_id % 9', 'floor(event_id / 3) % 9')} as y")
    return df.select("track_id", "event_id", ops.clean_section(_c("x")).alias("a"), ops.clean_section(_c("y")).alias("b"))


@query("structure_fit", "", f"""with {_SEQ}, fit(a, b, s) as (values {', '.join(f"('{k.split('>')[0]}','{k.split('>')[1]}',{v}::double)" for k, v in ops.STRUCTURE_FIT.items())})
select sq.event_id, sq.a, sq.b, coalesce(fit.s, case when sq.b = 'chorus' then 0.35::double when sq.a = 'intro' then 0.3::double else 0.55::double end) as score from sq left join fit on fit.a = sq.a and fit.b = sq.b""")
def structure_fit(t: Tables) -> DataFrame:
    return _section_pairs(t).select("event_id", "a", "b", ops.structure_fit(_c("a"), _c("b")).alias("score"))


_FLOWS = ", ".join(f"('{a}','{b}')" for a, bs in ops.ROLE_FLOW.items() for b in bs)


@query("role_flow", "", f"""with {_SEQ}, fl(a, b) as (values {_FLOWS}) select event_id, sq.a, sq.b, case when sq.a = 'unknown' or sq.b = 'unknown' then 0.5::double when fl.a is not null then 1.0::double when sq.a = sq.b then 0.35::double else 0.65::double end as score,
 case when sq.a = 'unknown' or sq.b = 'unknown' then 0.5::double when fl.a is not null then 1.0::double when sq.a = sq.b then 0.45::double else 0.65::double end as local_score from sq left join fl on fl.a = sq.a and fl.b = sq.b""")
def role_flow(t: Tables) -> DataFrame:
    return _section_pairs(t).select("event_id", "a", "b", ops.role_flow(_c("a"), _c("b")).alias("score"), ops.role_flow(_c("a"), _c("b"), 0.45).alias("local_score"))


ORDER_SQL = """, bad as (select distinct track_id from feedback where action = 'dislike'), known as (select track_id from tracks where track_id % 11 <> 0),
v as (select set_id, 'unknown_track' as kind, track_id as ident, count(*) as n from set_items where track_id not in (select track_id from known) group by 1, 2, 3
 union all select set_id, 'duplicate_track', track_id, count(*) from set_items group by 1, 3 having count(*) > 1
 union all select set_id, 'too_few_tracks', null, count(*) from set_items group by 1 having count(*) < 2
 union all select set_id, 'excluded_track', track_id, count(*) from set_items where track_id in (select track_id from bad) group by 1, 3)"""


@query("order_check", "set_items tracks feedback", f"{ORDER_SQL} select * from v")
def order_check(t: Tables) -> DataFrame:
    items = t.set_items().select("set_id", "track_id")
    known = t.tracks().where(_c("track_id") % 11 != 0).select("track_id")
    excluded = t.feedback().where(_c("action") == "dislike").select("track_id").distinct()
    per = items.groupBy("set_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, kind: df.select("set_id", F.lit(kind).alias("kind"), _c("track_id").alias("ident"), "n")
    few = per.groupBy("set_id").agg(F.sum("n").alias("n")).where("n < 2").withColumn("track_id", F.lit(None).cast("bigint"))
    return (
        row(per.join(known, "track_id", "left_anti"), "unknown_track")
        .unionByName(row(per.where("n > 1"), "duplicate_track"))
        .unionByName(row(few, "too_few_tracks"))
        .unionByName(row(per.join(excluded, "track_id", "left_semi"), "excluded_track"))
    )


@query("set_report", "handoff_pairs", """select set_id, pos, a_title as source_title, b_title as target_title, transition_type, overlap_sec, round(a_bpm, 1) as source_bpm, round(b_bpm, 1) as target_bpm, abs(a_bpm - b_bpm) > 0.5 as requires_stretch,
 round(a_mean_energy + 1e-9, 3) as source_energy, round(b_mean_energy + 1e-9, 3) as target_energy, case when b_mean_energy > a_mean_energy + 0.1::double then 'rising' when b_mean_energy < a_mean_energy - 0.1::double then 'dropping' else 'similar' end as direction,
 a_mid_energy > 0.5 as source_has_vocals, b_mid_energy > 0.5 as target_has_vocals from handoff_pairs""")
def set_report(t: Tables) -> DataFrame:
    a, b = _c("a_mean_energy"), _c("b_mean_energy")
    return t.handoff_pairs().select(
        "set_id", "pos", _c("a_title").alias("source_title"), _c("b_title").alias("target_title"), "transition_type", "overlap_sec",
        F.round("a_bpm", 1).alias("source_bpm"), F.round("b_bpm", 1).alias("target_bpm"), (F.abs(_c("a_bpm") - _c("b_bpm")) > 0.5).alias("requires_stretch"),
        snap(a).alias("source_energy"), snap(b).alias("target_energy"),
        F.when(b > a + 0.1, "rising").when(b < a - 0.1, "dropping").otherwise("similar").alias("direction"),
        (_c("a_mid_energy") > 0.5).alias("source_has_vocals"), (_c("b_mid_energy") > 0.5).alias("target_has_vocals"))


@query("render_plan_check", T_ + " handoffs", f""", {_HD}, prevc as (select *, lag(cursor_t) over (partition by set_id order by pos) as cur from hc),
v as (select set_id, pos, 'no_overlap' as kind, overlap_sec as observed from prevc where overlap_sec < 3 union all select set_id, pos, 'backward_source', exit_t from prevc where exit_t < cur
 union all select set_id, pos, 'source_past_end', exit_t + overlap_sec from prevc where exit_t + overlap_sec > adur union all select set_id, pos, 'target_out_of_bounds', cursor_t from prevc where cursor_t > bdur
 union all select set_id, pos, 'no_crossfade_room', entry_t + overlap_sec from prevc where entry_t + overlap_sec > bdur) select set_id, pos, kind, round(observed + 1e-9, 6) as observed from v""")
def render_plan_check(t: Tables) -> DataFrame:
    d = _handoff_times(t).withColumn("cur", F.lag("cursor_t").over(ops.by_set()))
    rules = [
        ("no_overlap", _c("overlap_sec") < 3, _c("overlap_sec")),
        ("backward_source", _c("exit_t") < _c("cur"), _c("exit_t")),
        ("source_past_end", _c("exit_t") + _c("overlap_sec") > _c("a_duration_sec"), _c("exit_t") + _c("overlap_sec")),
        ("target_out_of_bounds", _c("cursor_t") > _c("b_duration_sec"), _c("cursor_t")),
        ("no_crossfade_room", _c("entry_t") + _c("overlap_sec") > _c("b_duration_sec"), _c("entry_t") + _c("overlap_sec")),
    ]
    # All rules are tested on the row; one explode instead of one scan per rule.
    hits = F.array(*[F.when(test, F.struct(F.lit(k).alias("kind"), v.alias("observed"))) for k, test, v in rules])
    return d.select("set_id", "pos", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("v")).select(
        "set_id", "pos", "v.kind", snap(_c("v.observed"), 6).alias("observed"))
