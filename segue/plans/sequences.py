"""Sequence building, role plans and technique choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions.basic import lookup, r6, snap
from segue.operators import feedback as fb
from segue.operators import ranking
from segue.operators import sequences as ops
from segue.operators import sets as set_ops
from segue.plans import _sql as S
from segue.plans.intent import _BASE, _PROFILE, HEARD, RANKED, TOP, _intents, start_preference, track_evidence
from segue.plans.sets import ORDER_SQL, SI, _items, order_check
from segue.plans.structure import _segments, shortlist
from segue.plans.transitions import SEARCH_SQL, transition_search
from segue.registry import query
from segue.session import cut_lineage
from segue.sources.tables import Tables

_c = F.col
#: Paths kept per request; a path grows until it meets the request's target or the pool is used up.
WIDTH = 15


def _pool(t: Tables) -> DataFrame:
    """The best tracks of the library for each request, with its features and what feedback adds to it."""
    best = ranking.top_tracks(_intents(t), track_evidence(t), TOP, HEARD).select("request_id", "track_id")
    liked = fb.feedback_state(t.feedback()).select("track_id", "liked")
    taste = F.when(_c("liked") == 1, 0.08).when(_c("liked") == -1, -0.12).otherwise(0.0)
    return cut_lineage(best.join(t.tracks().select("track_id", *ops.TRACK), "track_id").join(liked, "track_id", "left").withColumn("taste", taste).drop("liked"))


def _openers(t: Tables, pool: DataFrame) -> DataFrame:
    """The best openers of each request, with its own target duration."""
    goals = t.requests().select("request_id", _c("target_duration_sec").alias("goal"))
    s = snap(start_preference(_c("mean_energy"), F.lit("steady")), 6)
    w = Window.partitionBy("request_id").orderBy(F.desc("start"), "track_id")
    return pool.select("request_id", "track_id", s.alias("start")).withColumn("r", F.row_number().over(w)).where(_c("r") <= WIDTH).drop("r").join(goals, "request_id")


def _beam_sql(x: str = "") -> list[str]:
    """One beam search as CTEs named with prefix ``x``, as a recursion over steps; the result is ``{x}bs`` where rn = 1.
    With a prefix, tracks and edges of the first result cost extra."""
    held = lambda cost, who: f" - case when exists (select 1 from {x}used u where u.request_id = {who}.request_id and u.track_id = {who}.track_id) then {cost}::double else 0 end" if x else ""
    edge = f" - case when exists (select 1 from {x}edges g where g.request_id = b.request_id and g.src = b.path[-1] and g.dst = p.track_id) then 0.18::double else 0 end" if x else ""
    rank = "row_number() over (partition by request_id order by round(score / len(path), 9) desc, array_to_string(path, ','))"
    return [f"""{x}walk as (
 select o.request_id, o.goal, [o.track_id] as path, [o.mean_energy] as en, 0.35::double * (o.st{held(0.14, 'o')}) as score, o.duration_sec as dur,
  o.bpm as a_bpm, o.camelot as a_camelot, o.mean_energy as a_mean_energy, o.spectral_centroid as a_spectral_centroid, false as fin from o1 o where r <= {WIDTH}
 union all
 (with e as (select b.request_id, b.goal, list_concat(b.path, [p.track_id]) as path, list_concat(b.en, [p.mean_energy]) as en,
   b.score + least(1, greatest(0, {S.overall('b.a_', 'p.')}{edge} + p.taste)) + greatest(0, 1 - abs(p.mean_energy - b.a_mean_energy) * 2) * 0.1::double{held(0.1, 'p')} as score,
   b.dur + p.duration_sec - least(16 * 240 / greatest((b.a_bpm + p.bpm) / 2, 60), p.duration_sec * 0.5::double) as dur,
   p.bpm as a_bpm, p.camelot as a_camelot, p.mean_energy as a_mean_energy, p.spectral_centroid as a_spectral_centroid
   from {x}walk b join pool p on p.request_id = b.request_id and not list_contains(b.path, p.track_id) where not b.fin),
  k as (select * from e qualify {rank} <= {3 * WIDTH})
  select request_id, goal, path, en, score, dur, a_bpm, a_camelot, a_mean_energy, a_spectral_centroid, true as fin from k where dur >= goal
  union all select * exclude (fin), true from {x}walk w where not fin and request_id not in (select request_id from k)
  union all (select request_id, goal, path, en, score, dur, a_bpm, a_camelot, a_mean_energy, a_spectral_centroid, false from k where dur < goal qualify {rank} <= {WIDTH}))),
{x}sc as (select *, 0.6::double * score / len(path) + 0.15::double * (1 - abs(dur - goal) / goal)
 + 0.25::double * case when len(path) < 3 then 0 else 0.15::double - 2 * list_aggregate(en, 'var_pop') end as k from {x}walk where fin),
{x}bs as (select *, row_number() over (partition by request_id order by round(k, 9) desc, array_to_string(path, ',')) as rn from {x}sc)"""]


_BEAM = [RANKED.removeprefix(", "), "taste as (select track_id, arg_max(case action when 'like' then 1 else -1 end, (ts, event_id)) filter (where action <> 'play') as liked from feedback group by track_id)",
         "pool as (select rs.request_id, r.target_duration_sec as goal, t.*, case liked when 1 then 0.08::double when -1 then -0.12::double else 0.0::double end as taste from rs join tracks t using (track_id) join requests r on r.request_id = rs.request_id left join taste using (track_id))",
         "op as (select *, round(0.5::double + (1 - abs(mean_energy - 0.5::double)) * 0.5::double + 1e-9, 6) as st from pool)",
         "o1 as (select *, row_number() over (partition by request_id order by st desc, track_id) as r from op)", *_beam_sql()]
_PATH = "array_to_string(path, ',') as path, round(score + 1e-9, 6) as score, round(dur + 1e-9, 6) as duration_sec"


@query("beam_sequences", f"{_BASE} requests feedback", f", {', '.join(_BEAM)} select request_id, {_PATH} from bs where rn = 1", recursive=True)
def beam_sequences(t: Tables) -> DataFrame:
    """A path through the best tracks of the library for each request, as long as its target asks for."""
    pool = _pool(t)
    b = ops.beam_sequences(_openers(t, pool), pool, width=WIDTH)
    return b.select("request_id", F.concat_ws(",", "path").alias("path"), snap(_c("score"), 6).alias("score"), snap(_c("dur"), 6).alias("duration_sec"))


_AGAIN = [*_BEAM, "zused as (select request_id, unnest(path) as track_id from bs where rn = 1)",
          "zedges as (select request_id, path[i] as src, path[i + 1] as dst from bs, lateral (select unnest(range(1, len(path))) as i) where rn = 1)", *_beam_sql("z")]


@query("sequence_regenerate", f"{_BASE} requests feedback", f", {', '.join(_AGAIN)} select request_id, {_PATH} from zbs where rn = 1", recursive=True)
def sequence_regenerate(t: Tables) -> DataFrame:
    """Search again with the previous result's tracks and edges penalised."""
    pool = _pool(t)
    first = cut_lineage(ops.beam_sequences(_openers(t, pool), pool, width=WIDTH))
    used = first.select("request_id", F.explode("path").alias("track_id"))
    steps = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda src, i: F.struct(src.alias("src"), F.get("path", i + 1).alias("dst")))
    edges = first.select("request_id", F.inline(steps))
    penalty = used.withColumn("bad", F.lit(0.14))
    openers = _openers(t, pool).join(penalty, ["request_id", "track_id"], "left").withColumn("start", _c("start") - F.coalesce("bad", F.lit(0.0))).drop("bad")
    b = ops.beam_sequences(openers, pool, width=WIDTH, avoid_tracks=used, avoid_edges=edges)
    return b.select("request_id", F.concat_ws(",", "path").alias("path"), snap(_c("score"), 6).alias("score"), snap(_c("dur"), 6).alias("duration_sec"))


def _request_segments(t: Tables) -> DataFrame:
    """The best library tracks of each request, with how well each meets it and an array of its segments."""
    seg = cut_lineage(ops.of_track(shortlist(_segments(t)).select(_c("track_id").alias("cid"), "segment_id", "s", "e", "role", "quality"), "cid"))
    best = ranking.top_tracks(_intents(t), track_evidence(t), TOP, HEARD).select("request_id", "track_id", _c("score").alias("fit"))
    features = t.tracks().select("track_id", "bpm", "camelot", "spectral_centroid", _c("mean_energy").alias("energy"), ((_c("track_id") % 10) / 10).alias("vocal"), ((_c("track_id") % 7) / 7).alias("bass"))
    pool = cut_lineage(best.join(features, "track_id").withColumn("cid", _c("track_id") % t.n_curves()))
    named = F.transform("segments", lambda x: x.withField("segment_id", F.concat_ws(":", "track_id", x["segment_id"])))
    return pool.join(seg, "cid").drop("cid").withColumn("segments", named)


def _wishes(t: Tables) -> DataFrame:
    """Style, length and words of each request."""
    r = t.requests().select("request_id", _c("target_duration_sec").alias("target"), F.expr(_AV.format(x="request_id")).alias("style"), F.expr(_PROFILE).alias("profile"))
    return r.join(_intents(t).select("request_id", "raw_text", (F.size("desired_themes") + F.size("desired_lyrical_moods") > 0).alias("meaning")), "request_id")


@query("segment_sequences")
def segment_sequences(t: Tables) -> DataFrame:
    """A segment performance for each request, of as many appearances as its style and target ask for."""
    seg = _request_segments(t)
    n = seg.groupBy("request_id").agg(F.count_distinct("track_id").alias("n"))
    r = _wishes(t).join(n, "request_id").select("request_id", "style", "profile", ops.appearance_count(_c("style"), _c("target"), _c("n")).alias("count"), "target", ops.variety_target(_c("style"), _c("target"), _c("n")).alias("unique"))
    r = r.withColumn("each", _c("target") / F.greatest(_c("count") - 0.15 * (_c("count") - 1), F.lit(1.0)))
    g = ops.greedy_segments(r, seg)
    return g.select("request_id", F.concat_ws(",", "used").alias("segments"), r6(_c("score")).alias("score"))


@query("role_beam")
def role_beam(t: Tables) -> DataFrame:
    """A role plan for each request: its own roles, by style, length and words, over the best options of each role and track."""
    seg = _request_segments(t)
    coherence, callback = ops.priorities(_c("style"), _c("raw_text"), _c("meaning"))
    wish = _wishes(t).select("request_id", ops.role_template(_c("style"), _c("target"), _c("raw_text")).alias("roles"), coherence.alias("coherence"), callback.alias("callback"), "target")
    n = F.size("roles")
    acts = wish.withColumn("act", _c("target") / F.greatest(n - 0.18 * (n - 1), F.lit(1.0)))
    b = ops.role_plans(acts, seg)
    return b.select("request_id", F.concat_ws(",", "path").alias("segments"), r6(_c("score")).alias("score"), _c("stays").cast("bigint").alias("stays"))


@query("ordered_set", "handoff_pairs curve regions feedback", f"""{SEARCH_SQL}{ORDER_SQL} select * from found
 where set_id not in (select set_id from v where kind in ('unknown_track', 'duplicate_track', 'too_few_tracks'))""")
def ordered_set(t: Tables) -> DataFrame:
    """Transitions for user-given orders that pass the order check."""
    bad = order_check(t).where(_c("kind").isin("unknown_track", "duplicate_track", "too_few_tracks")).select("set_id").distinct()
    return transition_search(t).join(bad, "set_id", "left_anti")


_TLO = f""", {SI}, a as (select *, lag(duration_sec) over (partition by set_id order by pos) as pd, lag(bpm) over (partition by set_id order by pos) as pb from si), b as (select *, case when pd is null then 0::double else least(overlap_sec, pd * 0.3::double, duration_sec * 0.3::double) end as ov from a), c as (select *, sum(coalesce(pd, 0) - ov) over (partition by set_id order by pos) as os from b)
select set_id, pos, round(ov + 1e-9, 4) as overlap, round(os + 1e-9, 4) as out_start, round(os + duration_sec + 1e-9, 4) as out_end, round(case when pd is null then 0 else least(2 * 240 / greatest(pb, 60), greatest(0, pd - ov - 0.05::double)) end + 1e-9, 4) as preparation, round(case when pd is null then 0 else least(4 * 240 / greatest(bpm, 60), greatest(0, duration_sec - ov - 0.05::double)) end + 1e-9, 4) as landing from c"""


@query("timeline_layout", "set_items tracks", _TLO)
def timeline_layout(t: Tables) -> DataFrame:
    d = ops.timeline_layout(_items(t).select("set_id", "pos", "track_id", "overlap_sec", "duration_sec", "bpm"))
    return d.select("set_id", "pos", *[snap(_c(x), 4).alias(x) for x in ("overlap", "out_start", "out_end", "preparation", "landing")])


# --- role plans ------------------------------------------------------------------------------------

_ROLES = list(ops.ROLE_ENERGY)
_AR = f"{_ROLES}[cast((track_id + pos) % 9 as bigint) + 1]"
ACTS = f"""{SI}, ac as (select set_id, pos, track_id, {_AR} as role, mean_energy as role_fidelity, low_energy as meaning_score, mid_energy as sound_score, case when track_id % 3 = 0 then 'STAY' when track_id % 3 = 1 then 'VARIATE' else 'SWITCH' end as decision, overlap_sec / 100 as switch_cost,
 {_AR} = 'CALLBACK' and pos > 1 as has_callback, case {_AR} {' '.join(f"when '{k}' then {v}::double" for k, v in ops.ROLE_ENERGY.items())} end as energy_target, (pos - 1) / count(*) over (partition by set_id) as f0, pos / count(*) over (partition by set_id) - case when track_id % 17 = 0 then 1 else 0 end as f1 from si)"""


def _acts(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("set_id"))
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), ((_c("track_id") + _c("pos")) % 9 + 1).cast("int"))
    d = _items(t).withColumn("role", role).withColumn("n", n)
    return d.select("set_id", "pos", "track_id", "role", _c("mean_energy").alias("role_fidelity"), _c("low_energy").alias("meaning_score"), _c("mid_energy").alias("sound_score"),
                    F.when(_c("track_id") % 3 == 0, "STAY").when(_c("track_id") % 3 == 1, "VARIATE").otherwise("SWITCH").alias("decision"), (_c("overlap_sec") / 100).alias("switch_cost"),
                    ((_c("role") == "CALLBACK") & (_c("pos") > 1)).alias("has_callback"), lookup(_c("role"), ops.ROLE_ENERGY).alias("energy_target"),
                    ((_c("pos") - 1) / _c("n")).alias("f0"), (_c("pos") / _c("n") - F.when(_c("track_id") % 17 == 0, 1).otherwise(0)).alias("f1"))


@query("blueprint_score", "set_items tracks", f""", {ACTS}, d as (select *, lag(energy_target) over (partition by set_id order by pos) as pe, lag(role) over (partition by set_id order by pos) as pr from ac),
a as (select set_id, count(*) as n, avg(role_fidelity) as fid, avg(meaning_score) as me, avg(sound_score) as so, count(*) filter (where pos > 1 and decision in ('STAY','VARIATE')) as stay, count(distinct track_id) as u, count(*) filter (where role in ('VOCAL_IDENTITY','CALLBACK')) as nv, count(distinct track_id) filter (where role in ('VOCAL_IDENTITY','CALLBACK')) as uv,
 sum(case when pe is null then 0 when role = 'BUILD' then 0.18::double * greatest(0, pe - energy_target) when role = 'PEAK' then 0.2::double * greatest(0, pe - energy_target) when role in ('RELEASE','BREATHING_ROOM') and pr = 'PEAK' then 0.16::double * greatest(0, energy_target - pe) else 0 end) as loss, count(*) filter (where has_callback) as cb, count(*) filter (where role = 'CALLBACK') as ncb, sum(switch_cost) as cost from d group by 1),
p as (select set_id, 0.55::double * fid + 0.25::double * me + 0.2::double * so as request_fidelity, greatest(0, least(1, 1 - loss)) as energy_arc, me, so, 0.55::double * stay / greatest(1, n - 1) + 0.45::double * so as groove, case when nv = 0 then 1.0::double else 1 - least(1, (uv - 1) / nv) end as vocal_identity, least(1, cb / greatest(1, ncb)) as callback, greatest(0, 1 - least(1, cost / greatest(1, n - 1))) as switch_cost, least(1, u / greatest(3, n * 0.65::double)) as coverage from a)
select set_id, round(request_fidelity + 1e-9, 4) as request_fidelity, round(energy_arc + 1e-9, 4) as energy_arc, round(groove + 1e-9, 4) as groove, round(vocal_identity + 1e-9, 4) as vocal_identity, round(switch_cost + 1e-9, 4) as switch_cost, round(coverage + 1e-9, 4) as coverage,
 round(0.3::double * request_fidelity + 0.14::double * energy_arc + 0.055::double * me + 0.055::double * so + 0.055::double * groove + 0.08::double * vocal_identity * 0.68::double + 0.06::double * callback * 0.42::double + 0.06::double * switch_cost * 0.68::double + 0.04::double * coverage * 0.35::double + 1e-9, 6) as score from p""")
def blueprint_score(t: Tables) -> DataFrame:
    d = ops.whole_score(_acts(t))
    return d.select("set_id", *[snap(_c(x), 4).alias(x) for x in ("request_fidelity", "energy_arc", "groove", "vocal_identity", "switch_cost", "coverage")], snap(_c("score"), 6).alias("score"))


@query("energetic_occupancy", "set_items tracks", f", {ACTS} select set_id, round(coalesce(avg(case when sound_score >= 0.6 and role_fidelity >= 0.6 then 1.0 else 0 end) filter (where role not in ('INTRO','BREATHING_ROOM','RELEASE','OUTRO')), 0) + 1e-9, 4) as occupancy, count(*) filter (where role = 'PEAK') as peaks, count(*) filter (where pos > 1 and decision = 'SWITCH') as switches from ac group by 1")
def energetic_occupancy(t: Tables) -> DataFrame:
    active = ~_c("role").isin("INTRO", "BREATHING_ROOM", "RELEASE", "OUTRO")
    hit = (_c("sound_score") >= 0.6) & (_c("role_fidelity") >= 0.6)
    return _acts(t).groupBy("set_id").agg(snap(F.coalesce(F.avg(F.when(active, F.when(hit, 1.0).otherwise(0.0))), F.lit(0.0)), 4).alias("occupancy"),
                                          F.count_if(_c("role") == "PEAK").alias("peaks"), F.count_if((_c("pos") > 1) & (_c("decision") == "SWITCH")).alias("switches"))


@query("blueprint_validate", "set_items tracks", f""", {ACTS}, d as (select *, coalesce(lag(f1) over (partition by set_id order by pos), 0) as pf from ac), v as (select set_id, pos, 'unknown_role' as kind from d where role = 'OUTRO' and track_id % 5 = 0 union all select set_id, pos, 'unknown_track' from d where track_id % 13 = 0 union all select set_id, pos, 'invalid_range' from d where f0 < pf - 0.001 or f1 <= f0) select * from v""")
def blueprint_validate(t: Tables) -> DataFrame:
    prev = F.coalesce(F.lag("f1").over(set_ops.by_set()), F.lit(0.0))
    d = _acts(t).withColumn("pf", prev).withColumn("role", F.when((_c("role") == "OUTRO") & (_c("track_id") % 5 == 0), "MYSTERY").otherwise(_c("role")))
    hits = F.array(F.when(~_c("role").isin(_ROLES), "unknown_role"), F.when(_c("track_id") % 13 == 0, "unknown_track"), F.when((_c("f0") < _c("pf") - 0.001) | (_c("f1") <= _c("f0")), "invalid_range"))
    return d.select("set_id", "pos", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("kind"))


_RQ = "case c_custkey % 5 when 0 then 'club' when 1 then 'story' when 2 then 'smooth' when 3 then 'experimental' else 'quick_mix' end as style, cast(120 + c_custkey % 300 as double) as dur, case c_custkey % 4 when 0 then 'build to a peak and return' when 1 then 'emotional lyrics' when 2 then 'emotional remix' else null end as txt"


@query("role_template", "", f"""with r as (select c_custkey as request_id, {_RQ} from customer), s as (select *, style in ('experimental','story') or coalesce(txt like '%return%', false) as cb from r),
b as (select *, case when cb and coalesce(txt like '%build%' or txt like '%peak%', false) then {ops.ROLE_TEMPLATES['arc']} when style = 'club' then {ops.ROLE_TEMPLATES['club']} when style in ('story','smooth') or coalesce(txt like '%emotional%' and txt not like '%remix%', false) then {ops.ROLE_TEMPLATES['story']} else {ops.ROLE_TEMPLATES['open']} end as t0 from s),
c as (select *, case when dur >= 360 and style = 'club' then list_concat(t0[1:-2], ['GROOVE','RELEASE'], t0[-1:]) else t0 end as t1 from b), d as (select *, case when cb then t1 else list_transform(t1, lambda x: case when x = 'CALLBACK' then 'GROOVE' else x end) end as t2 from c),
e as (select *, t2[1:cast(case when dur < 150 then 5 when dur < 210 then 6 else 99 end as bigint)] as t3 from d), f as (select request_id, unnest(t3) as role, generate_subscripts(t3, 1) - 1 as i, len(t3) as n from e)
select request_id, i, role, case when role in ('INTRO','PEAK','BUILD','RELEASE','CALLBACK','OUTRO') then role when i = 1 then 'ESTABLISH' else 'DEVELOP' end as state, round(i / n, 6) as start_fraction, round((i + 1) / n, 6) as end_fraction from f""")
def role_template(t: Tables) -> DataFrame:
    r = t.raw("customer").selectExpr("c_custkey as request_id", *[x.strip() for x in _RQ.replace(" as style,", " as style|").replace(" as dur,", " as dur|").split("|")])
    d = r.select("request_id", ops.role_template(_c("style"), _c("dur"), _c("txt")).alias("roles")).select("request_id", F.size("roles").alias("n"), F.posexplode("roles").alias("i", "role"))
    return d.select("request_id", _c("i").cast("bigint").alias("i"), "role", ops.role_state(_c("role"), _c("i")).alias("state"), r6(_c("i") / _c("n")).alias("start_fraction"), r6((_c("i") + 1) / _c("n")).alias("end_fraction"))


_SECS = "case {x} % 7 when 0 then 'intro' when 1 then 'verse' when 2 then 'chorus' when 3 then 'hook' when 4 then 'drop' when 5 then 'instrumental' else 'outro' end"


@query("role_score", "set_items tracks", f""", {ACTS}, g as (select ac.set_id, ac.pos, ac.role, si.mid_energy as v, si.mean_energy as e, si.low_energy as b, {_SECS.format(x='si.track_id')} as sec, si.overlap_sec / 50 as q from ac join si using (set_id, pos)),
h as (select *, greatest(0, least(1, 0.48::double * (1 - least(1, v)) + 0.32::double * e + 0.2::double * b)) as gr from g), k as (select *, greatest(0, least(1, 0.72::double * 0.5::double + 0.28::double * gr)) as so from h)
select set_id, pos, role, round(greatest(0, least(1, (0.2::double * q + 0.16::double * 0.8::double + 0.075::double * 0.5::double + 0.095::double * so + 0.06::double * v + 0.055::double * gr) / (0.36::double + 0.075::double + 0.095::double + 0.06::double + 0.055::double) + case role when 'VOCAL_IDENTITY' then 0.38::double * v + case when sec in ('chorus','hook','verse') then 0.12::double else 0 end when 'GROOVE' then 0.22::double * (1 - v) + 0.2::double * e
 when 'BUILD' then 0.18::double * e + case when sec = 'instrumental' then 0.18::double else 0 end when 'PEAK' then 0.34::double * e + case when sec in ('drop','chorus','hook') then 0.18::double else 0 end + 0.1::double * b when 'INTRO' then 0.18::double * (1 - v) + case when sec in ('intro','instrumental','verse') then 0.2::double else 0 end
 when 'OUTRO' then 0.2::double * (1 - v) + case when sec in ('outro','instrumental') then 0.18::double else 0 end when 'CALLBACK' then 0.25::double * v + case when sec in ('chorus','hook','drop') then 0.24::double else 0 end else 0.25::double * (1 - v) + 0.12::double * (1 - e) + case when sec in ('instrumental','outro') then 0.15::double else 0 end end)) + 1e-9, 4) as score from k""")
def role_score(t: Tables) -> DataFrame:
    acts = _acts(t).select("set_id", "pos", "role")
    d = _items(t).join(acts, ["set_id", "pos"])
    c = {"quality": _c("overlap_sec") / 50, "duration_fit": F.lit(0.8), "meaning": F.lit(0.5), "sound": F.lit(0.5), "vocal": _c("mid_energy"), "energy": _c("mean_energy"), "bass": _c("low_energy"), "section": F.expr(_SECS.format(x="track_id"))}
    return d.select("set_id", "pos", "role", snap(ops.role_score(_c("role"), c), 4).alias("score"))


_AV = "case {x} % 5 when 0 then 'quick_mix' when 1 then 'club' when 2 then 'experimental' when 3 then 'story' else 'smooth' end"


@query("appearance_count", "sets", f""", a as (select set_id, {_AV.format(x='set_id')} as style, total_duration_sec / 10 as tgt, set_id % 12 as n, energy_profile, (set_id % 7) / 6.0::double as x from sets)
select set_id, style, cast(case style when 'quick_mix' then greatest(4, least(case when n <= 2 then 4 else 10 end, round_even(tgt / 30, 0))) when 'club' then greatest(3, least(8, round_even(tgt / 48, 0))) when 'experimental' then greatest(4, least(10, round_even(tgt / 28, 0))) else greatest(3, least(greatest(n, 3), round_even(tgt / 55, 0))) end as bigint) as appearances,
 cast(case when n <= 0 then 0 else least(n, case style when 'quick_mix' then greatest(3, least(8, round_even(tgt / 75, 0))) when 'club' then greatest(3, least(7, round_even(tgt / 120, 0))) when 'experimental' then greatest(4, least(9, round_even(tgt / 60, 0))) when 'story' then greatest(2, least(5, round_even(tgt / 150, 0))) else greatest(2, least(6, round_even(tgt / 120, 0))) end) end as bigint) as variety,
 round(case when energy_profile in ('slow_build','warmup_to_peak') then 0.25::double + 0.55::double * x when energy_profile = 'cooldown' then 0.75::double - 0.45::double * x else 0.5::double end + 1e-9, 6) as energy from a""")
def appearance_count(t: Tables) -> DataFrame:
    d = t.sets().select("set_id", F.expr(_AV.format(x="set_id")).alias("style"), (_c("total_duration_sec") / 10).alias("tgt"), (_c("set_id") % 12).alias("n"), "energy_profile", ((_c("set_id") % 7) / 6).alias("x"))
    return d.select("set_id", "style", ops.appearance_count(_c("style"), _c("tgt"), _c("n")).alias("appearances"), ops.variety_target(_c("style"), _c("tgt"), _c("n")).alias("variety"), snap(ops.target_energy(_c("energy_profile"), _c("x")), 6).alias("energy"))


@query("technique_rank")
def technique_rank(t: Tables) -> DataFrame:
    """Technique of each handoff, under the boundary role of its position and the set's budget."""
    from segue.plans.sets import boundary_role

    role = boundary_role(t).select("set_id", "pos", "role")
    total = t.sets().select("set_id", "total_duration_sec")
    p = t.handoff_pairs().join(role, ["set_id", "pos"]).join(total, "set_id").withColumn("style", F.expr(_AV.format(x="set_id")))
    decision = F.when(_c("src") % 3 == 0, "VARIATE").when(_c("src") % 3 == 1, "SWITCH").otherwise("CALLBACK")
    d = p.select(
        "set_id", "pos", "role", "style", _c("transition_type").alias("kind"), ops.strong_budget(_c("total_duration_sec"), _c("style")).alias("budget"),
        P.relative_gap(_c("a_bpm"), _c("b_bpm")).alias("gap"), P.tempo_score(_c("a_bpm"), _c("b_bpm")).alias("rhythm"), P.key_score(_c("a_camelot"), _c("b_camelot")).alias("harmonic"),
        (1 - (_c("src") % 10) / 30).alias("downbeat"), (1 - (_c("dst") % 10) / 30).alias("phrase"), P.energy_score(_c("a_mean_energy"), _c("b_mean_energy")).alias("local"),
        _c("a_low_energy").alias("a_bass"), _c("b_low_energy").alias("b_bass"), (_c("b_mean_energy") - _c("a_mean_energy") > 0.1).alias("lift"),
        (_c("a_mid_energy") >= 0.55).alias("a_dense"), (_c("b_mid_energy") >= 0.55).alias("b_dense"), (_c("src") == _c("dst")).alias("same_track"),
        ((_c("a_low_energy") > 0.3) & (_c("b_low_energy") > 0.3)).alias("stems"), decision.alias("decision"), _c("role").isin("BUILD", "REVEAL").alias("payoff"),
        (_c("dst") % 2 == 0).alias("groove"), (_c("dst") % 5 == 0).alias("clearance"), (_c("src") % 7 != 0).alias("allow_strong"))
    return ops.technique_rank(d).join(role, ["set_id", "pos"]).select("set_id", "pos", "role", "technique", "tier", r6(_c("score")).alias("score"))
