"""Pair scores, best partners, and type recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions.basic import clip, lookup, r6
from segue.functions.vocab import KEY_CODES, TRANSITION_TYPES
from segue.operators import feedback as fb
from segue.operators import pairs as ops
from segue.plans import _sql as S
from segue.registry import query
from segue.sources.tables import Tables


# All ordered pairs for the SQL twins: gaps and key scores are computed once per pair or code.
_ALL_PAIRS = f"""
, codes as (select distinct camelot as c from tracks),
kd as (select x.c as c1, y.c as c2, {S.key('x.c', 'y.c')} as ke from codes x, codes y),
raw as (select a.track_id as src, b.track_id as dst, least(abs(a.bpm-b.bpm)/greatest(a.bpm,1.0::double), abs(2*a.bpm-b.bpm)/greatest(2*a.bpm,1.0::double), abs(a.bpm-2*b.bpm)/greatest(2*b.bpm,1.0::double)) as d,
  kd.ke, {S.energy('a.mean_energy', 'b.mean_energy')} as en, {S.spectral('a.spectral_centroid', 'b.spectral_centroid')} as sp
  from tracks a join tracks b on a.track_id <> b.track_id join kd on kd.c1 = a.camelot and kd.c2 = b.camelot),
comps as (select src, dst, case when d<=0.02::double then 1.0::double when d<=0.05::double then 0.9::double when d<=0.08::double then 0.9::double-(d-0.05::double)*(0.4::double/0.03::double)
  when d<=0.15::double then 0.5::double-(d-0.08::double)*(0.4::double/0.07::double) else greatest(0.05::double, 0.1::double-(d-0.15::double)*0.5::double) end as te, ke, en, sp from raw)"""


@query("pair_topk", "tracks", f"""{_ALL_PAIRS},
scored as (select src, dst, {S.snap('(0.4::double*te + 0.3::double*ke + 0.2::double*en + 0.1::double*sp)/1.0::double')} as overall from comps),
ranked as (select *, row_number() over (partition by src order by overall desc, dst) as rank from scored)
select src, dst, rank, overall from ranked where rank <= 5""")
def pair_topk(t: Tables) -> DataFrame:
    return ops.pair_topk(t.tracks(), 5)


@query("pair_matrix", "tracks", f"""{_ALL_PAIRS}
select src, count(*) as n_partners, round(avg(te),6) as mean_tempo, round(avg(ke),6) as mean_key, round(avg(en),6) as mean_energy,
  round(avg(sp),6) as mean_spectral,
  round(0.4::double*avg(te)+0.3::double*avg(ke)+0.2::double*avg(en)+0.1::double*avg(sp),6) as mean_overall
from comps group by src""")
def pair_matrix(t: Tables) -> DataFrame:
    return ops.pair_matrix_summary(t.tracks())


def _scalar(name: str, column, sql: str):
    """Query of one scalar score over the handoffs of every set."""

    @query(name, "handoff_pairs", f"select set_id, pos, src, dst, {sql} as score from handoff_pairs")
    def run(t: Tables) -> DataFrame:
        return t.handoff_pairs().select("set_id", "pos", "src", "dst", column().alias("score"))

    return run


_c = F.col
_scalar("score_tempo", lambda: r6(P.tempo_score(_c("a_bpm"), _c("b_bpm"))), f"round({S.tempo('a_bpm', 'b_bpm')},6)")
_scalar("camelot_distance", lambda: P.wheel_distance(_c("a_camelot"), _c("b_camelot")).cast("bigint"),
        f"cast({S.wheel('a_camelot', 'b_camelot')} as bigint)")
_scalar("score_key", lambda: P.key_score(_c("a_camelot"), _c("b_camelot")), S.key("a_camelot", "b_camelot"))
_scalar("score_energy", lambda: r6(P.energy_score(_c("a_mean_energy"), _c("b_mean_energy"))),
        f"round({S.energy('a_mean_energy', 'b_mean_energy')},6)")
_scalar("score_spectral", lambda: r6(P.spectral_score(_c("a_spectral_centroid"), _c("b_spectral_centroid"))),
        f"round({S.spectral('a_spectral_centroid', 'b_spectral_centroid')},6)")


_TYPE = S.snap(S.clip(f"{S.overall()} * {S.type_mod('transition_type', S.gap(), 'overlap_sec', 'a_low_energy', 'b_low_energy')}"))


@query("score_type", "handoff_pairs", f"select set_id, pos, src, dst, transition_type, {_TYPE} as score from handoff_pairs")
def score_type(t: Tables) -> DataFrame:
    df = ops.score_pairs(t.handoff_pairs())
    return df.select("set_id", "pos", "src", "dst", "transition_type", P.type_score(
        _c("overall"), _c("transition_type"), _c("a_bpm"), _c("b_bpm"), _c("overlap_sec"), _c("a_low_energy"), _c("b_low_energy"),
    ).alias("score"))


@query("reason_text", "handoff_pairs", f"""
, s as (select *, {S.tempo('a_bpm', 'b_bpm')} as te, {S.key('a_camelot', 'b_camelot')} as ke, {S.energy('a_mean_energy', 'b_mean_energy')} as en,
  cast(cast(round(a_bpm) as bigint) as varchar) as ab, cast(cast(round(b_bpm) as bigint) as varchar) as bb from handoff_pairs)
select set_id, pos, src, dst, concat_ws('; ',
  case when te>0.9 then 'very close BPM ('||ab||' vs '||bb||')' when te>0.7 then 'compatible BPM ('||ab||' vs '||bb||')'
    when te>0.4 then 'moderate BPM gap ('||ab||' vs '||bb||')' else 'large BPM gap ('||ab||' vs '||bb||')' end,
  case when ke>=0.9 then 'harmonically ideal ('||a_camelot||' -> '||b_camelot||')' when ke>=0.7 then 'harmonically compatible ('||a_camelot||' -> '||b_camelot||')'
    when ke<0.3 then 'key clash risk ('||a_camelot||' -> '||b_camelot||')' end,
  case when en>0.8 then 'similar energy' when en<0.4 and b_mean_energy>a_mean_energy then 'energy rise' when en<0.4 then 'energy drop' end) as reason
from s""")
def reason_text(t: Tables) -> DataFrame:
    df = ops.score_pairs(t.handoff_pairs())
    return df.select("set_id", "pos", "src", "dst", P.reason_text(
        _c("tempo"), _c("key"), _c("energy"), _c("a_bpm"), _c("b_bpm"), _c("a_camelot"), _c("b_camelot"),
        _c("a_mean_energy"), _c("b_mean_energy")).alias("reason"))


# Sections of the test tracks: fixed shares of the duration. Exit and entry times vary by id.
_SECTION_SQL = "(case when {t} <= 0.15::double*{d} then 'intro' when {t} <= 0.45::double*{d} then 'verse' when {t} <= 0.7::double*{d} then 'chorus' when {t} <= 0.85::double*{d} then 'verse' else 'outro' end)"


def _section(time, duration):
    return (F.when(time <= 0.15 * duration, "intro").when(time <= 0.45 * duration, "verse").when(time <= 0.7 * duration, "chorus")
            .when(time <= 0.85 * duration, "verse").otherwise("outro"))


_CONTEXT = f"""
, ctx as (select *, {S.gap()} as d, b_mean_energy - a_mean_energy as delta, {S.overall()} as base, {S.key('a_camelot', 'b_camelot')} as ke,
  {_SECTION_SQL.format(t='(0.5::double + (src % 5) / 10.0::double) * a_duration_sec', d='a_duration_sec')} as a_section,
  {_SECTION_SQL.format(t='((dst % 7) * 10.0::double)', d='b_duration_sec')} as b_section,
  a_mid_energy > 0.5 as av, b_mid_energy > 0.5 as bv, a_low_energy > 0.3 as a_st, b_low_energy > 0.3 as b_st,
  floor(a_duration_sec * a_bpm / 4800) as aph, floor(b_duration_sec * b_bpm / 4800) as bph from handoff_pairs),
typed as (select ctx.*, k.kind, k.ord from ctx, (values {', '.join(f"('{x}',{i})" for i, x in enumerate(TRANSITION_TYPES))}) k(kind, ord)),
q as (select *, {S.snap(S.clip('base * ' + S.type_mod('kind', 'd', '8', 'a_low_energy', 'b_low_energy')))} *
 (case kind
  when 'beatmatched_blend' then (case when abs(delta)<=0.1 then 1.2::double else 1 end)*(case when a_section='verse' and b_section='verse' then 1.1::double else 1 end)
  when 'bass_swap' then (case when delta>0.1 then 1.2::double else 1 end)*(case when b_section='chorus' then 1.15::double else 1 end)
     *(case when a_low_energy>0.45 and b_low_energy>0.45 then 0.6::double else 1 end)*(case when av and bv then 1.1::double else 1 end)
  when 'filter_sweep' then (case when delta>0.1 and b_section='chorus' then 1.3::double else 1 end)*(case when a_section='verse' and b_section='verse' then 1.1::double else 1 end)
  when 'echo_out' then (case when delta < -0.1 then 1.2::double else 1 end)*(case when a_section='outro' then 1.3::double else 1 end)*(case when d>0.1 then 1.15::double else 1 end)
  when 'phrase_cut' then (case when a_section<>b_section then 1.1::double else 1 end)*(case when aph>3 and bph>3 then 1.1::double else 1 end)*(case when av and bv then 1.1::double else 1 end)
  when 'crossfade' then (case when d<0.05 and abs(delta)<=0.1 then 0.85::double else 1 end)*(case when av and bv then 0.8::double else 1 end)
  when 'loop_blend' then (case when abs(delta)<=0.1 and a_section='verse' then 1.15::double else 1 end)*(case when av and bv then 0.75::double else 1 end)
  when 'mashup' then (case when a_st and b_st then 1.4::double*(case when av and bv then 1.2::double else 1 end)*(case when abs(delta)>0.15 then 1.1::double else 1 end) else 0.3::double end)
  end) as q0 from typed),
best as (select *, row_number() over (partition by set_id, pos order by round(q0, 9) desc, ord) as rn from q)
select set_id, pos, src, dst, kind as best_type, round(least(1.0::double, q0),6) as confidence,
  kind || ': ' || concat_ws(', ', case when d<0.03 then 'very close tempos' when d<0.08 then 'compatible tempos' else 'tempo difference' end,
   case when ke>0.8 then 'harmonically compatible' when ke<0.3 then 'key clash risk' end,
   case when delta>0.1 then 'energy rising' when delta < -0.1 then 'energy dropping' else 'similar energy' end,
   case when a_section<>'verse' then 'source in '||a_section end, case when b_section<>'verse' then 'target in '||b_section end) as reason
from best where rn=1"""


@query("recommend_type", "handoff_pairs", _CONTEXT)
def recommend_type(t: Tables) -> DataFrame:
    df = ops.score_pairs(t.handoff_pairs())
    df = df.select(
        "*",
        P.relative_gap(_c("a_bpm"), _c("b_bpm")).alias("gap"),
        (_c("b_mean_energy") - _c("a_mean_energy")).alias("delta"),
        _section((0.5 + (_c("src") % 5) / 10) * _c("a_duration_sec"), _c("a_duration_sec")).alias("a_section"),
        _section((_c("dst") % 7) * 10.0, _c("b_duration_sec")).alias("b_section"),
    )
    context = {
        "delta": _c("delta"), "gap": _c("gap"), "a_section": _c("a_section"), "b_section": _c("b_section"),
        "a_low": _c("a_low_energy"), "b_low": _c("b_low_energy"),
        "a_vocals": _c("a_mid_energy") > 0.5, "b_vocals": _c("b_mid_energy") > 0.5,
        "a_stems": _c("a_low_energy") > 0.3, "b_stems": _c("b_low_energy") > 0.3,
        "a_phrases": F.floor(_c("a_duration_sec") * _c("a_bpm") / 4800),
        "b_phrases": F.floor(_c("b_duration_sec") * _c("b_bpm") / 4800),
    }
    # One candidate per type as an array on the row: the best type needs no shuffle.
    options = F.array(*[
        F.struct(
            F.round(_type_quality(kind, context), 9).alias("q"),
            F.lit(-i).alias("ord"), F.lit(kind).alias("kind"),
        ) for i, kind in enumerate(TRANSITION_TYPES)
    ])
    df = df.withColumn("best", F.array_max(options))
    kind = _c("best.kind")
    return df.select(
        "set_id", "pos", "src", "dst", kind.alias("best_type"),
        r6(F.least(F.lit(1.0), _c("best.q"))).alias("confidence"),
        F.concat(kind, F.lit(": "), F.concat_ws(
            ", ",
            F.when(_c("gap") < 0.03, "very close tempos").when(_c("gap") < 0.08, "compatible tempos").otherwise("tempo difference"),
            F.when(_c("key") > 0.8, "harmonically compatible").when(_c("key") < 0.3, "key clash risk"),
            F.when(_c("delta") > 0.1, "energy rising").when(_c("delta") < -0.1, "energy dropping").otherwise("similar energy"),
            F.when(_c("a_section") != "verse", F.concat(F.lit("source in "), _c("a_section"))),
            F.when(_c("b_section") != "verse", F.concat(F.lit("target in "), _c("b_section"))),
        )).alias("reason"),
    )


def _type_quality(kind: str, c: dict):
    k = F.lit(kind)
    base = P.type_score(_c("overall"), k, _c("a_bpm"), _c("b_bpm"), F.lit(8.0), _c("a_low_energy"), _c("b_low_energy"))
    return base * P.type_context(k, c)


@query("preference_bonus", "handoff_pairs feedback ratings", f"""
, state as (select track_id, arg_max(case action when 'like' then 1 else -1 end, (ts, event_id)) filter (where action <> 'play') as liked from feedback group by track_id),
types as (select transition_type, avg(rating) as r from ratings group by 1 having count(*) >= 3),
kinds(kind, code) as (values ('crossfade','AF'),('bass_swap','AO'),('loop_blend','NF'),('filter_sweep','NO'),('phrase_cut','RF'),('beatmatched_blend','RO')),
b as (select h.set_id, h.pos, h.src, h.dst, {S.overall()} as base,
  {S.clip('''(case when s.liked = 1 then 0.08::double else 0 end) - (case when s.liked = -1 then 0.12::double else 0 end)
   + (case when b_bpm between 90 and 120 then 0.05::double else -0.03::double end) + (case when b_mean_energy between 0.3 and 0.7 then 0.05::double else -0.02::double end)
   + (case when y.r > 0 then 0.04::double else 0 end) - (case when y.r < 0 then 0.06::double else 0 end)''', -0.15, 0.15)} as bonus
  from handoff_pairs h left join state s on s.track_id = h.dst left join kinds k on k.kind = h.transition_type left join types y on y.transition_type = k.code)
select set_id, pos, src, dst, round(bonus, 6) as bonus, round({S.clip('base + bonus')}, 6) as score from b""")
def preference_bonus(t: Tables) -> DataFrame:
    taste = fb.feedback_state(t.feedback()).select(_c("track_id").alias("dst"), "liked")
    # Rated types are a handful of enumeration values, so their table is safe to broadcast.
    types = fb.preferred_types(t.ratings(), 3).select(_c("transition_type").alias("code"), "avg_rating")
    code = {"crossfade": "AF", "bass_swap": "AO", "loop_blend": "NF", "filter_sweep": "NO", "phrase_cut": "RF", "beatmatched_blend": "RO"}
    df = ops.score_pairs(t.handoff_pairs()).withColumn("code", lookup(_c("transition_type"), code))
    df = df.join(taste, "dst", "left").join(types, "code", "left")
    bonus = P.preference_bonus(
        _c("liked") == 1, _c("liked") == -1, _c("b_bpm").between(90, 120), _c("b_mean_energy").between(0.3, 0.7),
        _c("avg_rating") > 0, _c("avg_rating") < 0)
    return df.select("set_id", "pos", "src", "dst", r6(bonus).alias("bonus"), r6(clip(_c("overall") + bonus)).alias("score"))


@query("avoid_penalty", "handoffs feedback ratings", """
, bad as (select distinct track_id from feedback where action = 'dislike'),
edges as (select source_id as src, target_id as dst from ratings group by 1, 2 having avg(rating) < -0.9)
select set_id, pos, src, dst, case when pos = 1 and src in (select track_id from bad) then 0.14::double else 0::double end as start_penalty,
 case when dst in (select track_id from bad) then 0.10::double else 0::double end as step_penalty,
 case when exists (select 1 from edges e where e.src = h.src and e.dst = h.dst) then 0.18::double else 0::double end as edge_penalty
from handoffs h""")
def avoid_penalty(t: Tables) -> DataFrame:
    bad = t.feedback().where(_c("action") == "dislike").select("track_id")
    edges = (t.ratings().groupBy(_c("source_id").alias("src"), _c("target_id").alias("dst")).agg(F.avg("rating").alias("r"))
             .where(_c("r") < -0.9))
    items = t.handoffs().select("set_id", "pos", "src", "dst")
    return ops.avoid_penalty(items, bad, edges)


# --- keys and tempo -----------------------------------------------------------

_KEYDIM = f"dim(key_name, code) as (values {S.KEYS_VALUES})"


@query("key_to_camelot", "tracks", f", {_KEYDIM} select track_id, coalesce(d.key_name, '') as key_name, coalesce(e.code, '') as code from tracks t left join dim d on d.code = t.camelot left join dim e on e.key_name = d.key_name")
def key_to_camelot(t: Tables) -> DataFrame:
    name = F.coalesce(lookup(_c("camelot"), {v: k for k, v in KEY_CODES.items()}), F.lit(""))
    return t.tracks().select("track_id", name.alias("key_name")).select(
        "track_id", "key_name", F.coalesce(lookup(_c("key_name"), KEY_CODES), F.lit("")).alias("code"))


@query("camelot_to_key", "tracks", f", {_KEYDIM} select t.camelot as code, coalesce(d.key_name, '') as key_name, count(*) as n from tracks t left join dim d on d.code = t.camelot group by 1, 2")
def camelot_to_key(t: Tables) -> DataFrame:
    name = F.coalesce(lookup(_c("camelot"), {v: k for k, v in KEY_CODES.items()}), F.lit(""))
    return t.tracks().groupBy(_c("camelot").alias("code"), name.alias("key_name")).agg(F.count(F.lit(1)).alias("n"))


@query("camelot_parse", "tracks", """select track_id, cast(left(camelot, length(camelot)-1) as bigint) as hour, right(camelot, 1) as mode from tracks""")
def camelot_parse(t: Tables) -> DataFrame:
    return t.tracks().select("track_id", P.wheel_hour(_c("camelot")).cast("bigint").alias("hour"), P.wheel_mode(_c("camelot")).alias("mode"))


@query("tempo_fold", "tracks", """select track_id, case when bpm < 70 then bpm * 2 when bpm > 180 then bpm / 2 else bpm end as bpm,
  case when bpm * 2 < 70 then bpm * 4 when bpm * 2 > 180 then bpm else bpm * 2 end as doubled from tracks""")
def tempo_fold(t: Tables) -> DataFrame:
    fold = lambda x: F.when(x < 70, x * 2).when(x > 180, x / 2).otherwise(x)
    return t.tracks().select("track_id", fold(_c("bpm")).alias("bpm"), fold(_c("bpm") * 2).alias("doubled"))
