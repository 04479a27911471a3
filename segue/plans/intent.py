"""Requests: filters, validation, scores, pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import vectors as V
from segue.functions.basic import clip, r6, snap
from segue.functions.vocab import ACTIVITIES, MOODS
from segue.operators import intent as ops
from segue.operators import lyrics as lyr
from segue.operators import ranking
from segue.plans import _sql as S
from segue.plans.evidence import LABELS
from segue.plans.lyrics import KM, TEST_TERMS
from segue.registry import query
from segue.session import cut_lineage, fan
from segue.sources.tables import Tables

_c = F.col
_E = "cast(array() as array<string>)"
_RAW = "case c_custkey % 3 when 0 then null when 1 then 'only upbeat songs' else 'something nice' end"
INTENT = {
    "request_id": "c_custkey",
    "desired_themes": f"case c_custkey % 5 when 0 then array('love', 'hope') when 1 then array('loss') when 2 then array('party', 'freedom') else {_E} end",
    "avoid_themes": f"case c_custkey % 7 when 0 then array('heartbreak') when 1 then array('romance') else {_E} end",
    "desired_lyrical_moods": f"case c_custkey % 4 when 0 then array('sad') when 1 then array('happy', 'hopeful') else {_E} end",
    "avoid_lyrical_moods": f"case when c_custkey % 11 = 0 then array('angry') else {_E} end",
    "desired_moods": f"case c_custkey % 6 when 0 then array('happy', 'calm') when 1 then array('sad') when 2 then array('romantic') else {_E} end",
    "avoid_moods": f"case when c_custkey % 9 = 0 then array('dark') else {_E} end",
    "desired_activity": f"case c_custkey % 8 when 0 then array('party') when 1 then array('relaxing') else {_E} end",
    "mood_trajectory": _E,
    "meaning_trajectory": f"case when c_custkey % 10 = 3 then array('sad', 'hopeful') else {_E} end",
    "energy_min": "case when c_custkey % 2 = 0 then cast(c_custkey % 5 as double) / 10 end",
    "energy_max": "case when c_custkey % 2 = 0 then cast(c_custkey % 5 as double) / 10 + 0.5 end",
    "raw_text": _RAW,
    "target_sec": "cast(600 + c_custkey % 1200 as double)",
    "variety_on": "c_custkey % 4 = 1",
}


def _duck(expr: str) -> str:
    return expr.replace(_E, "cast([] as varchar[])").replace("array(", "list_value(")


IT = "it as (select " + ", ".join(f"{_duck(e)} as {n}" for n, e in INTENT.items()) + " from customer)"


def _intents(t: Tables) -> DataFrame:
    return t.raw("customer").selectExpr(*[f"{e} as {n}" for n, e in INTENT.items()])


# Evidence of a track: meaning from its lyrics, moods from its vector. Vectors are softmaxed sharply.
_SM = "sm0 as (select s.track_id, lb.grp, lb.label, exp(12 * (s.embedding[lb.k] - max(s.embedding[lb.k]) over (partition by s.track_id, lb.grp))) as ex from semantic s, lb where grp in ('mood', 'activity')), sm1 as (select track_id, grp, label, ex / sum(ex) over (partition by track_id, grp) as v from sm0)"
TRK = f"""{LABELS}, {_SM},
ms as (select track_id, map(list(label) filter (where grp = 'mood'), list(v) filter (where grp = 'mood')) as mood, map(list(label) filter (where grp = 'activity'), list(v) filter (where grp = 'activity')) as act from sm1 group by 1),
tk as (select tr.track_id, tr.mean_energy, tr.duration_sec, coalesce(km.ranked[1:3], []) as p, coalesce(km.ranked[4:6], []) as s2, coalesce(km.moods, []) as lm, km.sadness, km.hopefulness, km.party, km.romance, case when y.has_meaning then y.meaning_confidence end as mc, coalesce(y.transcription_confidence, 0) as tc, ms.mood, ms.act, sr.confidence as sc
 from tracks tr left join km using (track_id) left join lyric_rows y using (track_id) left join ms using (track_id) left join semantic_rows sr using (track_id))"""


def track_evidence(t: Tables) -> DataFrame:
    meaning = lyr.keyword_meaning(t.lyrics(), TEST_TERMS).drop("meaning_confidence")
    conf = t.derived("lyric_rows").select("track_id", F.when(_c("has_meaning"), _c("meaning_confidence")).alias("meaning_confidence"), "transcription_confidence")
    vec = lambda xs, at: F.map_from_arrays(ops.labels(*xs), V.softmax(F.slice("embedding", at, len(xs)), 12.0))
    moods = t.semantic().select("track_id", vec(MOODS, 1).alias("mood_scores"), vec(ACTIVITIES, len(MOODS) + 1).alias("activity_scores"))
    sem = t.derived("semantic_rows").select("track_id", _c("confidence").alias("semantic_confidence"))
    return (
        t.tracks().select("track_id", "mean_energy", "duration_sec").join(meaning, "track_id", "left").join(conf, "track_id", "left")
        .join(moods, "track_id", "left").join(sem, "track_id", "left")
    )


#: Tracks a request gets from the library. So many of the shortest tracks last longer than the longest target.
TOP = 40
#: Mood score from which a mood counts as heard; vectors of the test tables are flat.
HEARD = 0.2
PR = "pr as (select c_custkey as request_id, p_partkey as track_id from customer, part)"
OWN = "pr as (select distinct o.o_custkey as request_id, l.l_partkey as track_id from orders o join lineitem l on l.l_orderkey = o.o_orderkey)"


def scored_tracks(t: Tables, evidence: DataFrame | None = None) -> DataFrame:
    """The best tracks of the whole library for each request, with all parts of their scores and their rank.

    Scores depend on the wish alone: each distinct wish is scored once, and its rows go to the requests that have it.
    Requests are dealt first, so what follows per request needs no shuffle of the rows.
    """
    evidence = cut_lineage(track_evidence(t)) if evidence is None else evidence
    top, same = ranking.top_by_wish(_intents(t), evidence, TOP, HEARD)
    asked = _intents(t).join(same.select(_c("wish").alias("request_id")).distinct(), "request_id", "left_semi").withColumnRenamed("request_id", "wish")
    parts = ["theme_match", "mood_match", "audio_match", "activity_match", "energy_match", "penalty", "reliability", "status", "status_rank", "score"]
    scored = ops.score(top.select("wish", "track_id", "rank").join(asked, "wish").join(evidence, "track_id"), HEARD)
    scored = cut_lineage(scored.select("wish", "track_id", "rank", "duration_sec", *parts))
    return same.repartition(fan(t.spark), "request_id").join(scored, "wish").drop("wish")


def owned_pairs(t: Tables) -> DataFrame:
    """Requests and the tracks that their owners' sets hold."""
    owner = t.raw("orders").select(_c("o_orderkey").alias("set_id"), _c("o_custkey").alias("request_id"))
    items = t.raw("lineitem").select(_c("l_orderkey").alias("set_id"), _c("l_partkey").alias("track_id"))
    return owner.join(items, "set_id").select("request_id", "track_id").distinct()


def scored_items(t: Tables) -> DataFrame:
    """Each request against the tracks of its own sets."""
    return ops.score(owned_pairs(t).join(_intents(t), "request_id").join(track_evidence(t), "track_id"), HEARD)


def _lm(avail, want, prim=None):
    hits = f"list_intersect(list_distinct({want}), {avail})"
    graded = f"least(1.0::double, 0.85::double + 0.15::double * least(1.0::double, (len({hits}) - 1) / greatest(len({want}) - 1, 1)))"
    if prim:
        graded = f"case when list_has_any({hits}, {prim}) then 1.0::double else {graded} end"
    return f"(case when len({want}) = 0 then 0.5::double when len({hits}) = 0 then 0.0::double else {graded} end)"


def _best(m, ls):
    return f"coalesce(list_max(list_transform({ls}, lambda z: element_at({m}, z)[1])), 0)"


def _mm(m, want, avoid):
    return f"(case when len({want}) = 0 and len({avoid}) = 0 then 0.5::double else {S.clip(f'{_best(m, want)} - 0.45::double * {_best(m, avoid)}')} end)"


_OPP = " or ".join(f"(list_contains(requested, '{k}') and list_has_any(observed, {v}))" for k, v in ops.OPPOSITES.items())
_HEARD = "list_concat(map_keys(map_from_entries(list_filter(map_entries(mood), lambda e: e.value >= 0.2))), map_keys(map_from_entries(list_filter(map_entries(act), lambda e: e.value >= 0.2))))"
_EM = """case when energy_min is null and energy_max is null then case when list_has_any(list_concat(desired_moods, desired_activity), ['happy','euphoric','dance','party','workout']) then least(1, mean_energy / 0.75::double) when list_has_any(desired_moods, ['sad','melancholic','calm','dark']) or list_contains(desired_activity, 'relaxing') then greatest(0, least(1, 1 - mean_energy)) else 0.5::double end
 when greatest(energy_min - mean_energy, mean_energy - energy_max) <= 0 then 1.0::double else greatest(0, least(1, 1 - greatest(energy_min - mean_energy, mean_energy - energy_max) / 0.5::double)) end"""
_SCORED = f"""{KM}, {TRK}, {IT}, PAIRS,
j as (select pr.request_id, it.* exclude (request_id), tk.* from pr join it using (request_id) join tk using (track_id)),
j1 as (select *, mc is not null as hm, sc is not null as hs, case when mc is null then [] else list_distinct(list_concat(p, s2, case when party >= 0.55 then ['party','celebration'] else [] end, case when hopefulness >= 0.55 then ['hope'] else [] end, case when sadness >= 0.55 then ['loss','heartbreak'] else [] end, case when romance >= 0.55 then ['love','romance'] else [] end)) end as th,
 case when mc is null then [] else list_distinct(list_concat(lm, case when party >= 0.55 then ['happy','celebratory'] else [] end, case when hopefulness >= 0.55 then ['hopeful'] else [] end, case when sadness >= 0.55 then ['sad','melancholic'] else [] end, case when romance >= 0.55 then ['romantic'] else [] end)) end as mo,
 case when mc is null then 0 else mc * case when tc <> 0 then least(1, tc / 0.65::double) else 1 end end as rel, coalesce(sc, 0) as arel,
 len(desired_themes) + len(avoid_themes) + len(desired_lyrical_moods) + len(avoid_lyrical_moods) + len(meaning_trajectory) > 0 as mreq, len(desired_moods) + len(avoid_moods) + len(desired_activity) > 0 or energy_min is not null as areq,
 len(desired_themes) + len(avoid_themes) + len(desired_lyrical_moods) + len(avoid_lyrical_moods) + len(meaning_trajectory) + len(desired_moods) + len(avoid_moods) + len(desired_activity) > 0 as anyq from j),
j2 as (select *, case when hm then {_lm('th', 'desired_themes', 'p')} else 0.5::double end as tm, case when hm then {_lm('mo', 'desired_lyrical_moods')} else 0.5::double end as mm, case when hm then {_lm('list_concat(mo, th)', 'meaning_trajectory')} else 0.5::double end as tj,
 case when hs then {_mm('mood', 'desired_moods', 'avoid_moods')} else 0.5::double end as am, case when hs then {_mm('act', 'desired_activity', 'cast([] as varchar[])')} else 0.5::double end as ac, {_EM} as em,
 list_concat(th, mo) as words, case when hs then {_HEARD} else [] end as heard, hm and rel >= 0.6 as sure, list_concat(desired_themes, desired_lyrical_moods, desired_moods, desired_activity) as requested,
 list_concat(avoid_themes, avoid_lyrical_moods, avoid_moods) as avoided from j1),
j3 as (select *, list_concat(words, heard) as observed, case when len(meaning_trajectory) > 0 then greatest(tm, mm) else 0.75::double * tm + 0.25::double * mm end as lyric, 0.65::double * am + 0.25::double * ac + 0.1::double * em as audio,
 greatest(case when sure and list_has_any(list_concat(avoided, case when list_has_any(avoided, ['heartbreak','breakup']) then ['heartbreak','breakup'] else [] end, case when list_has_any(avoided, ['love','romance']) then ['love','romance'] else [] end), words) then 1.0::double else 0 end,
  case when hs and len(list_filter(avoid_moods, lambda z: element_at(mood, z)[1] >= 0.2)) > 0 then 0.85::double else 0 end) as penalty from j2),
j4 as (select *, ({_OPP}) as opp, areq and hs and arel >= 0.35 as hrd from j3),
j5 as (select *, case when mreq and sure then case when penalty >= 0.8 then 'contradiction' when round(lyric, 9) >= 0.72 then 'strong' when round(lyric, 9) >= 0.55 then 'partial' when opp or round(lyric, 9) < 0.25 then 'contradiction' else 'partial' end when mreq then 'unknown'
  when hrd then case when round(audio, 9) >= 0.62 then 'strong' when round(audio, 9) >= 0.35 then 'partial' when opp then 'contradiction' else 'unknown' end when anyq then 'unknown' else 'strong' end as status,
 case when mreq and sure then rel when mreq then greatest(arel * 0.55::double, rel) when hrd then arel when anyq then 0 else 1 end as reliability from j4),
j6 as (select *, case when mreq and sure then 0.62::double * lyric + case when areq then 0.16::double * am + 0.1::double * ac else 0 end + 0.07::double * em + 0.05::double * tj
  when mreq then (0.24::double + 0.1::double * am + 0.08::double * ac + 0.08::double * em) * greatest(0.65::double, 1 - 0.35::double * (1 - reliability)) when areq then 0.62::double * am + 0.2::double * ac + 0.13::double * em + 0.05::double * tj else 0.5::double end - 0.62::double * penalty as base from j5),
sc1 as (select *, round({S.clip("case when status = 'contradiction' and sure then least(base, 0.18::double) when status = 'unknown' then least(base, 0.48::double) else base end")} + 1e-9, 6) as score, cast(case status when 'strong' then 3 when 'partial' then 2 when 'unknown' then 1 else 0 end as bigint) as status_rank from j6)"""
SCORE, SCORE_OWN = _SCORED.replace("PAIRS", PR), _SCORED.replace("PAIRS", OWN)
RANKED = f"{SCORE}, rs as (select *, row_number() over (partition by request_id order by status_rank desc, score desc, track_id) as rank from sc1 qualify rank <= {TOP})"
_BASE = "lyrics semantic tracks lyric_rows semantic_rows"


@query("intent_score", _BASE, f", {RANKED} select request_id, track_id, status, round(tm, 6) as theme_match, round(mm, 6) as mood_match, round(am, 6) as audio_match, round(ac, 6) as activity_match, round(em + 1e-9, 6) as energy_match, penalty, round(reliability + 1e-9, 6) as reliability, score from rs")
def intent_score(t: Tables) -> DataFrame:
    return scored_tracks(t).select("request_id", "track_id", "status", r6(_c("theme_match")).alias("theme_match"), r6(_c("mood_match")).alias("mood_match"), r6(_c("audio_match")).alias("audio_match"),
                                  r6(_c("activity_match")).alias("activity_match"), snap(_c("energy_match"), 6).alias("energy_match"), "penalty", snap(_c("reliability"), 6).alias("reliability"), "score")


@query("intent_rank", _BASE, f", {RANKED} select request_id, track_id, status, score, rank from rs")
def intent_rank(t: Tables) -> DataFrame:
    return scored_tracks(t).select("request_id", "track_id", "status", "score", "rank")


POOL = f"""{SCORE}, rk as (select *, row_number() over (partition by request_id order by status_rank desc, score desc, track_id) as rank, duration_sec * 0.9::double as eff, coalesce(regexp_matches(lower(raw_text), 'only|avoid|exclude|never|without'), len(avoid_themes) + len(avoid_lyrical_moods) + len(avoid_moods) > 0) as excludes from sc1),
p0 as (select *, count(*) filter (where status in ('strong','partial')) over (partition by request_id) as nk, coalesce(sum(eff) filter (where status in ('strong','partial')) over (partition by request_id), 0) as dk, count(*) filter (where status = 'unknown') over (partition by request_id) as nu, coalesce(sum(eff) filter (where status = 'unknown') over (partition by request_id), 0) as du, count(*) over (partition by request_id) as na,
 count(*) filter (where status = 'unknown') over b as iu, coalesce(sum(eff) filter (where status = 'unknown') over b, 0) as su, count(*) filter (where status = 'contradiction') over b as ic, coalesce(sum(eff) filter (where status = 'contradiction') over b, 0) as sco from rk window b as (partition by request_id order by rank rows between unbounded preceding and 1 preceding)),
pool as (select *, case when not anyq then 'all' when status in ('strong','partial') then 'match' when status = 'unknown' and nk + iu < 2 then 'two_tracks' when status = 'unknown' and dk + su < target_sec then 'duration' when status = 'unknown' and variety_on and nk + iu < least(na, greatest(3, least(8, round_even(target_sec / 75, 0)))) then 'variety'
 when status = 'contradiction' and not excludes and nk + nu < 2 and (nk + nu + ic < 2 or dk + du + sco < target_sec) then 'last_resort' when status = 'contradiction' and excludes then 'excluded' else 'left_out' end as step from p0)"""


def _asks(d: DataFrame) -> DataFrame:
    """Adds whether the request excludes explicitly and whether it asks for semantics."""
    listed = (F.size("avoid_themes") + F.size("avoid_lyrical_moods") + F.size("avoid_moods")) > 0
    return d.withColumn("excludes", F.coalesce(F.lower("raw_text").rlike(ops.EXCLUDE_WORDS), listed)).withColumn("semantic", ops.requests_semantics())


def _pool(t: Tables, evidence: DataFrame | None = None) -> DataFrame:
    asks = _asks(_intents(t)).select("request_id", "target_sec", "variety_on", "excludes", "semantic")
    # both sides dealt alike, so that a request's few columns meet its rows without another shuffle
    return ops.candidate_pool(scored_tracks(t, evidence).join(asks.repartition(fan(t.spark), "request_id"), "request_id"))


@query("candidate_pool", _BASE, f", {POOL} select request_id, track_id, status, score, rank, step from pool")
def candidate_pool(t: Tables) -> DataFrame:
    """Every track of the library for each request, and how it gets into the request's pool or why not."""
    asks = _asks(_intents(t)).select("request_id", "target_sec", "variety_on", "excludes", "semantic")
    every = ranking.all_tracks(_intents(t), track_evidence(t), asks, HEARD)
    return ops.candidate_pool(every, ("dealt", "request_id")).select("request_id", "track_id", "status", "score", "rank", "step")


@query("excluded_minus_pool", _BASE, f", {POOL} select request_id, count(*) filter (where step in ('all','match','two_tracks','duration','variety','last_resort')) as n_pool, count(*) filter (where step = 'excluded') as n_excluded, count(*) filter (where step in ('two_tracks','duration','variety','last_resort')) as n_fallback, count(*) filter (where step = 'left_out') as n_left from pool group by 1")
def excluded_minus_pool(t: Tables) -> DataFrame:
    """Sizes of pool, exclusions and the rest over the whole library. Tracks that relax a request lie among
    its best TOP, which outlast any target; matches and contradictions are counted by status."""
    n = lambda test: F.coalesce(F.sum(F.when(test, _c("n"))), F.lit(0)).cast("bigint")
    evidence = cut_lineage(track_evidence(t))
    totals = ranking.status_totals(_intents(t), evidence, HEARD).groupBy("request_id").agg(
        n(F.lit(True)).alias("n_all"), n(_c("status_rank") >= 2).alias("known"), n(_c("status_rank") == 0).alias("against"))
    steps = _pool(t, evidence).groupBy("request_id").agg(F.count_if(_c("step").isin("two_tracks", "duration", "variety", "last_resort")).alias("n_fallback"))
    d = _asks(_intents(t)).join(totals, "request_id").join(steps, "request_id")
    pool = F.when(_c("semantic"), _c("known") + _c("n_fallback")).otherwise(_c("n_all"))
    out = F.when(_c("semantic") & _c("excludes"), _c("against")).otherwise(0).cast("bigint")
    return d.select("request_id", pool.alias("n_pool"), out.alias("n_excluded"), "n_fallback", (_c("n_all") - pool - out).alias("n_left"))


_COV = f"""{SCORE_OWN}, ci as (select l.l_orderkey as set_id, s.status, s.duration_sec from lineitem l join orders o on o.o_orderkey = l.l_orderkey join sc1 s on s.request_id = o.o_custkey and s.track_id = l.l_partkey),
cv as (select set_id, count(*) as n, count(*) filter (where status = 'strong') as strong, count(*) filter (where status = 'partial') as partial, count(*) filter (where status = 'unknown') as unknown, count(*) filter (where status = 'contradiction') as contradiction, sum(duration_sec) as selected_sec from ci group by 1),
cw as (select *, round((strong + 0.6::double * partial) / n + 1e-9, 3) as coverage, case when round((strong + 0.6::double * partial) / n, 9) >= 0.6 then 'Good' else 'Limited' end as g from cv)"""


def _covered_sets(t: Tables) -> DataFrame:
    owner = t.raw("orders").select(_c("o_orderkey").alias("set_id"), _c("o_custkey").alias("request_id"))
    items = t.raw("lineitem").select(_c("l_orderkey").alias("set_id"), _c("l_partkey").alias("track_id")).join(owner, "set_id")
    return items.join(scored_items(t).select("request_id", "track_id", "status", "duration_sec"), ["request_id", "track_id"])


@query("intent_coverage", _BASE, f", {_COV} select set_id, n, strong, partial, unknown, contradiction, selected_sec, coverage, case when contradiction > 0 then 'Limited' when strong = n then 'Strong' else g end as label, case when strong = n then 'Strong' else g end as segment_label from cw")
def intent_coverage(t: Tables) -> DataFrame:
    return ops.coverage(_covered_sets(t), "set_id")


_TL = """case when mc is not null and mc * case when tc <> 0 then least(1, tc / 0.65::double) else 1 end >= 0.6 then case when list_contains(list_concat(p, s2, lm), {l}) then 1.0::double when {l} in ('hope','hopeful') and hopefulness >= 0.55 then 1.0::double when {l} in ('happy','celebratory','party') and party >= 0.55 then 1.0::double when {l} in ('sad','melancholic') and sadness >= 0.55 then 1.0::double
 when ({o}) then 0.0::double else 0.15::double end when sc is not null then coalesce(element_at(mood, {l})[1], 0.5::double) else 0.5::double end"""
_TLO = " or ".join(f"({{l}} = '{k}' and list_has_any(list_concat(p, s2, lm), {v}))" for k, v in ops.OPPOSITES.items())


def _tl(l):
    return _TL.format(l=l, o=_TLO.format(l=l))


@query("meaning_trajectory", _BASE + " set_items", f""", {KM}, {TRK}, a as (select set_id, pos, track_id, count(*) over (partition by set_id) as n from set_items), b as (select *, ['sad', 'hopeful', 'happy'][cast(round_even((pos - 1) / greatest(n - 1, 1) * 2, 0) as bigint) + 1] as lab from a),
c as (select b.set_id, b.n, {_tl('b.lab')} as v from b join tk using (track_id)) select set_id, round(case when max(n) < 2 then 0 else avg(v) - 0.5::double end + 1e-9, 6) as score from c group by 1""")
def meaning_trajectory(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("set_id"))
    path = ops.labels("sad", "hopeful", "happy")
    d = t.set_items().select("set_id", "pos", "track_id", n.alias("n"))
    d = d.withColumn("lab", F.element_at(path, (F.bround((_c("pos") - 1) / F.greatest(_c("n") - 1, F.lit(1)) * 2) + 1).cast("int"))).join(track_evidence(t), "track_id")
    return d.groupBy("set_id").agg(snap(F.when(F.max("n") < 2, 0.0).otherwise(F.avg(ops.trajectory_label(_c("lab"))) - 0.5), 6).alias("score"))


@query("trajectory_support", _BASE + " set_items", f""", {SCORE_OWN}, ev as (select set_id, pos, s.track_id, hm and mc >= 0.6 as sure, {_tl("'hopeful'")} as v from set_items i join orders o on o.o_orderkey = i.set_id join sc1 s on s.request_id = o.o_custkey and s.track_id = i.track_id)
select set_id, bool_or(sure and v >= 0.8) as endpoint_available, arg_max(v, pos) >= 0.8 as ended_there, bool_or(sure and v >= 0.8) and arg_max(v, pos) >= 0.8 as supported from ev group by 1""")
def trajectory_support(t: Tables) -> DataFrame:
    d = t.set_items().select("set_id", "pos", "track_id").join(track_evidence(t), "track_id").withColumn("v", ops.trajectory_label(F.lit("hopeful")))
    reach = F.bool_or(F.coalesce(_c("meaning_confidence") >= 0.6, F.lit(False)) & (_c("v") >= 0.8))
    end = F.max_by("v", "pos") >= 0.8
    return d.groupBy("set_id").agg(reach.alias("endpoint_available"), end.alias("ended_there"), (reach & end).alias("supported"))


@query("label_match", _BASE, f", {KM} select track_id, {_lm('themes', chr(91) + chr(39) + 'love' + chr(39) + ',' + chr(39) + 'hope' + chr(39) + ',' + chr(39) + 'loss' + chr(39) + chr(93), 'ranked[1:3]')} as theme, round({_lm('moods', chr(91) + chr(39) + 'sad' + chr(39) + ',' + chr(39) + 'happy' + chr(39) + ',' + chr(39) + 'angry' + chr(39) + chr(93))}, 6) as mood from km")
def label_match(t: Tables) -> DataFrame:
    m = lyr.keyword_meaning(t.lyrics(), TEST_TERMS)
    return m.select("track_id", V.label_match(F.concat("primary_themes", "secondary_themes"), ops.labels("love", "hope", "loss"), _c("primary_themes")).alias("theme"),
                    r6(V.label_match(_c("lyrical_moods"), ops.labels("sad", "happy", "angry"))).alias("mood"))


@query("energy_match", "tracks", f""", {IT}, {PR}, e as (select pr.request_id, pr.track_id, round({_EM} + 1e-9, 6) as score from pr join it using (request_id) join tracks using (track_id))
select request_id, track_id, score from e qualify row_number() over (partition by request_id order by score desc, track_id) <= {TOP}""")
def energy_match(t: Tables) -> DataFrame:
    """The TOP tracks of the library that fit the energy of each request best. Many requests ask for the same
    energy, so each wish is met with each energy once, and an energy keeps its TOP least ids."""
    from pyspark.sql import Window

    wish = ["energy_min", "energy_max", "desired_moods", "desired_activity"]
    intents = _intents(t).select("request_id", *wish)
    heads = t.tracks().select("track_id", "mean_energy").withColumn("nth", F.row_number().over(Window.partitionBy("mean_energy").orderBy("track_id"))).where(_c("nth") <= TOP).drop("nth")
    levels = heads.groupBy(F.floor(_c("mean_energy") * 1000).alias("level")).agg(F.min("mean_energy").alias("low"), F.max("mean_energy").alias("high"), F.count("*").alias("n"), F.min("track_id").alias("first_id"))
    wishes = intents.select(*wish).distinct().withColumn("wish", F.xxhash64(*wish))
    best = lambda e: snap(ops.energy_match(_c(e), _c("energy_min"), _c("energy_max"), _c("desired_moods"), _c("desired_activity")), 6)
    # the score rises to the asked range and falls behind it, so its greatest value on a level is at an end or is 1
    inside = (F.coalesce("energy_min", F.lit(0.0)) <= _c("high")) & (F.coalesce("energy_max", F.lit(1.0)) >= _c("low")) & (_c("energy_min").isNotNull() | _c("energy_max").isNotNull())
    met = wishes.crossJoin(F.broadcast(levels)).withColumn("most", F.when(inside, 1.0).otherwise(F.greatest(best("low"), best("high"))))
    order = Window.partitionBy("wish").orderBy(F.desc("most"), "level")
    # a level is left out once TOP tracks lie on levels whose least score is no less than its greatest
    met = met.withColumn("least", F.least(best("low"), best("high"))).withColumn("sure", F.sum("n").over(Window.partitionBy("wish").orderBy(F.desc("least")).rangeBetween(Window.unboundedPreceding, 0)))
    bar = met.groupBy("wish").agg(F.max(F.when(_c("sure") >= TOP, _c("least"))).alias("bar"))
    near = met.join(bar, "wish").where(_c("bar").isNull() | (_c("most") >= _c("bar"))).select("wish", *wish, "level")
    d = near.join(heads.withColumn("level", F.floor(_c("mean_energy") * 1000)), "level").withColumn("score", best("mean_energy"))
    top = Window.partitionBy("wish").orderBy(F.desc("score"), "track_id")
    d = d.withColumn("rank", F.row_number().over(top)).where(_c("rank") <= TOP).select("wish", "track_id", "score")
    return intents.select("request_id", F.xxhash64(*wish).alias("wish")).join(d, "wish").select("request_id", "track_id", "score")


@query("intent_requests_semantics", "", f"with {IT} select request_id, len(desired_themes) + len(avoid_themes) + len(desired_lyrical_moods) + len(avoid_lyrical_moods) + len(meaning_trajectory) + len(desired_moods) + len(avoid_moods) + len(desired_activity) > 0 as asks from it")
def intent_requests_semantics(t: Tables) -> DataFrame:
    return _intents(t).select("request_id", ops.requests_semantics().alias("asks"))


# --- request table operators -------------------------------------------------------------------

_RF = {
    "request_id": "c_custkey", "preset": "case c_custkey % 9 when 0 then 'chill' when 1 then 'peak' when 2 then 'experimental' when 3 then 'late_night' when 4 then 'dreamland' when 5 then 'balanced' end",
    "energy_profile": "case when c_custkey % 4 = 0 then 'wave' end", "transition_style": "case c_custkey % 5 when 0 then 'minimal' when 1 then 'bold' end", "vocal_preference": "case when c_custkey % 3 = 0 then 'vocals' end",
    "target_duration_sec": "case when c_custkey % 6 = 0 then cast(c_custkey % 7 as double) * 100 end", "bpm_min": "case when c_custkey % 5 = 2 then 120.0D end", "bpm_max": "case when c_custkey % 7 = 2 then 110.0D end",
    "energy_min": "case when c_custkey % 5 = 3 then 0.6D end", "energy_max": "case when c_custkey % 8 = 3 then 1.2D when c_custkey % 8 = 4 then 0.4D end", "transition_length": "case c_custkey % 6 when 0 then 'short' when 1 then 'endless' when 2 then 'long' end",
    "performance_mode": "case when c_custkey % 12 = 0 then 'party' else 'classic' end", "desired_variety": "cast(c_custkey % 13 as double) / 10",
    "desired_moods": f"case when c_custkey % 14 = 0 then array('sleepy') else {_E} end", "desired_themes": f"case when c_custkey % 15 = 0 then array('robots') else {_E} end", "desired_lyrical_moods": _E,
}
RF = "rf as (select " + ", ".join(f"{_duck(e).replace('D end', '::double end').replace('D when', '::double when')} as {n}" for n, e in _RF.items()) + " from customer)"
PS = "ps(preset, f0, f1, f2, f3, f4, f5, f6, f7, f8) as (values " + ", ".join(
    "(" + ", ".join([f"'{k}'"] + [("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::double") for v in vs]) + ")" for k, vs in ops.PRESETS.items()) + ")"


def _request_fields(t: Tables) -> DataFrame:
    return t.raw("customer").selectExpr(*[f"{e} as {n}" for n, e in _RF.items()])


@query("preset_fill", "", f"with {RF}, {PS} select request_id, " + ", ".join(f"coalesce(rf.{f}, ps.f{i}) as {f}, coalesce(ps.f{i}, rf.{f}) as preset_{f}" for i, f in enumerate(ops.PRESET_FIELDS)) + " from rf left join ps using (preset)")
def preset_fill(t: Tables) -> DataFrame:
    r = _request_fields(t).select("request_id", "preset", *ops.PRESET_FIELDS)
    mine, theirs = ops.fill_preset(r), ops.fill_preset(r, override_wins=False)
    # Both directions are projections of the same row, so they are read together.
    p = ops.preset_columns(_c("preset"))
    assert mine.columns == theirs.columns
    return r.select("request_id", *[F.coalesce(_c(f), p[f]).alias(f) for f in ops.PRESET_FIELDS], *[F.coalesce(p[f], _c(f)).alias(f"preset_{f}") for f in ops.PRESET_FIELDS])


@query("intent_effective", "", f"""with {RF} select request_id, coalesce(energy_profile, 'steady') as energy_profile, coalesce(transition_style, 'safe') as transition_style, coalesce(vocal_preference, 'any') as vocal_preference,
 cast(case transition_length when 'short' then 4 when 'medium' then 8 when 'long' then 16 else 4 end as bigint) as min_bars, cast(case transition_length when 'short' then 8 when 'medium' then 16 when 'long' then 32 else 16 end as bigint) as max_bars,
 case coalesce(transition_style, 'safe') {' '.join(f"when '{k}' then '{','.join(v)}'" for k, v in ops.STYLE_TYPES.items())} else '{','.join(ops.STYLE_TYPES['varied'])}' end as allowed_types from rf""")
def intent_effective(t: Tables) -> DataFrame:
    e = ops.effective(_request_fields(t))
    return e.withColumn("allowed_types", F.concat_ws(",", "allowed_types"))


@query("intent_validate", "", f"""with {RF}, v as (select request_id, unnest([case when performance_mode not in ('classic','segment','auto') then 'performance_mode' end, case when desired_variety > 1 then 'desired_variety' end, case when preset not in ({', '.join(f"'{k}'" for k in ops.PRESETS)}) then 'preset' end, case when transition_style not in ('smooth','energetic','minimal','varied','safe') then 'transition_style' end,
 case when len(desired_moods) > 0 then 'desired_moods' end, case when len(desired_themes) > 0 then 'desired_themes' end, case when bpm_min > bpm_max then 'bpm_range' end, case when energy_min > energy_max then 'energy_range' end, case when energy_max > 1 then 'energy_max' end, case when target_duration_sec <= 0 then 'target_duration_sec' end, case when transition_length not in ('short','medium','long') then 'transition_length' end]) as field from rf)
select request_id, field from v where field is not null""")
def intent_validate(t: Tables) -> DataFrame:
    return ops.validate(_request_fields(t))


@query("intent_hard_filter", "requests tracks", f""", q as (select r.*, {_RAW.replace('c_custkey', 'request_id')} as raw_text from requests r), h as (select *, coalesce(regexp_matches(raw_text, 'only|without'), true) as hard from q),
k as (select request_id, count(*) as n_kept from h join tracks t on t.track_id = request_id % 100 or (t.track_id <> (request_id + 1) % 100 and (not hard or (bpm between bpm_min and bpm_max and mean_energy between energy_min and energy_max))) group by 1)
select h.request_id, coalesce(n_kept, 0) as n_kept, coalesce(n_kept, 0) < 2 as fallback, case when coalesce(n_kept, 0) < 2 then (select count(*) from tracks) else n_kept end as n_result from h left join k using (request_id)""")
def intent_hard_filter(t: Tables) -> DataFrame:
    r = t.requests().withColumn("raw_text", F.expr(_RAW.replace("c_custkey", "request_id")))
    include = r.select("request_id", (_c("request_id") % 100).alias("track_id"))
    exclude = r.select("request_id", ((_c("request_id") + 1) % 100).alias("track_id"))
    return ops.hard_filter(r, t.tracks(), include, exclude)


@query("request_merge", "", f"""with {RF} select a.request_id, coalesce(a.preset, b.preset) as preset, coalesce(a.energy_profile, b.energy_profile) as energy_profile, coalesce(a.bpm_min, b.bpm_min) as bpm_min, array_to_string(list_sort(list_distinct(list_concat(a.desired_moods, b.desired_themes))), ',') as labels from rf a join rf b on b.request_id = a.request_id + 1""")
def request_merge(t: Tables) -> DataFrame:
    """Two readings of one request: the primary wins, gaps are filled, label lists are united."""
    a = _request_fields(t)
    b = a.select((_c("request_id") - 1).alias("request_id"), *[_c(x).alias(f"b_{x}") for x in ("preset", "energy_profile", "bpm_min", "desired_themes")])
    pick = lambda x: F.coalesce(F.nullif(_c(x), F.lit("")) if x != "bpm_min" else _c(x), _c(f"b_{x}")).alias(x)
    return a.join(b, "request_id").select("request_id", pick("preset"), pick("energy_profile"), pick("bpm_min"),
                                          F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("desired_moods", "b_desired_themes")))).alias("labels"))


@query("match_band", "handoff_pairs", f""", q as (select set_id, pos, {S.overall()} as s, (a_mid_energy + b_mid_energy) / 2 as c from handoff_pairs)
select set_id, pos, concat_ws(' | ', case when s > 0.8 then 'excellent match' when s > 0.6 then 'good match' when s > 0.4 then 'decent match' else 'challenging pair' end, case when c > 0.8 then 'high confidence' when c < 0.4 then 'low confidence - fallback' end) as band from q""")
def match_band(t: Tables) -> DataFrame:
    from segue.operators.pairs import score_pairs

    d = score_pairs(t.handoff_pairs())
    s, conf = _c("overall"), (_c("a_mid_energy") + _c("b_mid_energy")) / 2
    return d.select("set_id", "pos", F.concat_ws(
        " | ", F.when(s > 0.8, "excellent match").when(s > 0.6, "good match").when(s > 0.4, "decent match").otherwise("challenging pair"),
        F.when(conf > 0.8, "high confidence").when(conf < 0.4, "low confidence - fallback")).alias("band"))


_START = "case energy_profile when 'warmup_to_peak' then greatest(0, 1 - e) when 'cooldown' then greatest(0, 1 - e * 0.5::double) when 'slow_build' then greatest(0, 1 - e * 0.8::double) else 0.5::double + (1 - abs(e - 0.5::double)) * 0.5::double end"


def start_preference(energy, profile):
    return (
        F.when(profile == "warmup_to_peak", F.greatest(F.lit(0.0), 1 - energy)).when(profile == "peak_early", energy)
        .when(profile == "cooldown", F.greatest(F.lit(0.0), 1 - energy * 0.5)).when(profile == "slow_build", F.greatest(F.lit(0.0), 1 - energy * 0.8))
        .otherwise(0.5 + (1 - F.abs(energy - 0.5)) * 0.5)
    )


_PROFILE = "case request_id % 5 when 0 then 'warmup_to_peak' when 1 then 'slow_build' when 2 then 'steady' when 3 then 'wave' else 'cooldown' end"


@query("openers", "tracks", f""", {OWN}, q as (select request_id, track_id, mean_energy as e, {_PROFILE} as energy_profile from pr join tracks using (track_id)), s as (select request_id, track_id, round({_START} - case when track_id % 10 = 0 then 0.14::double else 0 end + 1e-9, 6) as score from q),
r as (select *, row_number() over (partition by request_id order by score desc, track_id) as rank from s) select * from r where rank <= 15""")
def openers(t: Tables) -> DataFrame:
    """The 15 best openers of each request among the tracks that its owner's sets hold."""
    from pyspark.sql import Window

    d = owned_pairs(t).join(t.tracks().select("track_id", "mean_energy"), "track_id").withColumn("p", F.expr(_PROFILE))
    s = snap(start_preference(_c("mean_energy"), _c("p")) - F.when(_c("track_id") % 10 == 0, 0.14).otherwise(0.0), 6)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "track_id")
    return d.select("request_id", "track_id", s.alias("score")).withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 15")
