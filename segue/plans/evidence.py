"""Semantic evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions import vectors as V
from segue.functions.basic import clip, r6
from segue.functions.vocab import ACTIVITIES, MAJOR_PROFILE, MINOR_PROFILE, MOODS, PITCHES
from segue.operators import evidence as ops
from segue.plans import _sql as S
from segue.registry import query
from segue.sources.tables import Tables

_c = F.col
_ALL = [(g, i, x) for g, xs in ops.GROUPS.items() for i, x in enumerate(xs)]
LABELS = "lb(grp, ord, label, k) as (values " + ", ".join(f"('{g}',{i},'{x}',{n})" for n, (g, i, x) in enumerate(_ALL, 1)) + ")"
LONG = f"""{LABELS}, lw as (select s.label as track_id, s.track_id as win, lb.grp, lb.ord, lb.label, s.embedding[lb.k] as raw from semantic s, lb),
ls as (select *, exp(3 * (raw - max(raw) over (partition by win, grp))) as ex from lw), lr as (select *, ex / sum(ex) over (partition by win, grp) as rel from ls),
mn as (select track_id, grp, ord, label, avg(raw) as raw, avg(rel) as rel from lr group by 1, 2, 3, 4)"""
SEPARATE = f"""{LONG}, sp as (select lr.track_id, lr.grp, avg(abs(lr.rel - mn.rel)) as spread from lr join mn using (track_id, grp, ord) group by 1, 2),
rk as (select *, row_number() over (partition by track_id, grp order by rel desc, ord) as r, row_number() over (partition by track_id, grp order by raw desc) as rr, rel / sum(rel) over (partition by track_id, grp) as p from mn),
ag as (select track_id, grp, max(label) filter (where r = 1) as top_label, max(rel) filter (where r = 1) as top, max(rel) filter (where r = 2) as second, max(raw) filter (where rr = 1) - max(raw) filter (where rr = 2) as raw_margin, -sum(p * ln(p)) / ln(count(*)) as entropy from rk group by 1, 2),
me as (select ag.*, top - second as margin, {S.clip('1 - spread * 4')} as cons from ag join sp using (track_id, grp)),
sep as (select track_id, grp, top_label, round(top, 6) as top_score, round(second, 6) as second_score, round(margin, 6) as margin, round(entropy, 6) as entropy, round(raw_margin, 6) as raw_margin, round(cons, 6) as window_consistency,
 round({S.clip(f"0.35::double * {S.clip('margin / 0.08::double')} + 0.25::double * (1 - entropy) + 0.2::double * {S.clip('raw_margin / 0.12::double')} + 0.2::double * cons")}, 6) as reliability from me)"""


def _windows(t: Tables) -> DataFrame:
    """Rows of one label are the windows of one track."""
    return t.semantic().select(_c("label").alias("track_id"), _c("track_id").alias("win"), "embedding")


@query("label_softmax_mean", "semantic", f", {LONG} select track_id, grp, label, round(raw, 6) as raw, round(rel, 6) as rel from mn")
def label_softmax_mean(t: Tables) -> DataFrame:
    return ops.label_means(ops.group_scores(_windows(t))).select("track_id", "grp", "label", r6(_c("raw")).alias("raw"), r6(_c("rel")).alias("rel"))


def _separation(t: Tables) -> DataFrame:
    scores = ops.group_scores(_windows(t))
    means = ops.label_means(scores)
    return ops.separation(means, ops.variability(scores, means, ["track_id", "grp"]))


@query("score_separation", "semantic", f", {SEPARATE} select * from sep")
def score_separation(t: Tables) -> DataFrame:
    return _separation(t)


@query("semantic_tags", "semantic", f""", {SEPARATE}, o(grp, i) as (values ('mood', 0), ('activity', 1), ('intensity', 2), ('style', 3))
select track_id, coalesce(string_agg(case when reliability >= 0.22 and margin >= 0.001 then top_label end, ',' order by i), '') as tags, round(avg(reliability) + 1e-9, 6) as confidence from sep join o using (grp) group by 1""")
def semantic_tags(t: Tables) -> DataFrame:
    return ops.tags(_separation(t), 0.22, 0.001)


@query("semantic_variability", "semantic", f""", {LONG}, d as (select lr.track_id, lr.grp, lr.win, avg(abs(lr.rel - mn.rel)) as d from lr join mn using (track_id, grp, ord) group by 1, 2, 3) select track_id, round(avg(d), 6) as variability from d group by 1""")
def semantic_variability(t: Tables) -> DataFrame:
    scores = ops.group_scores(_windows(t))
    per_group = ops.variability(scores, ops.label_means(scores), ["track_id", "grp"])
    return per_group.groupBy("track_id").agg(r6(F.avg("spread")).alias("variability"))


@query("label_entropy", "semantic", f", {LONG} select win as track_id, grp, round(-sum(rel * ln(rel)) / ln(count(*)), 6) as entropy from lr group by 1, 2")
def label_entropy(t: Tables) -> DataFrame:
    parts, at = [], 1
    for g, labels in ops.GROUPS.items():
        parts.append(F.struct(F.lit(g).alias("grp"), r6(V.entropy(V.softmax(F.slice("embedding", at, len(labels))))).alias("entropy")))
        at += len(labels)
    return t.semantic().select("track_id", F.explode(F.array(*parts)).alias("e")).select("track_id", "e.grp", "e.entropy")


@query("embedding_centroid", "semantic", """, x as (select label as track_id, i - 1 as i, avg(embedding[i]) as x from semantic, (select unnest(range(1, 65)) as i) group by 1, 2)
select track_id, i, round(x / sqrt(sum(x * x) over (partition by track_id)), 6) as x from x""")
def embedding_centroid(t: Tables) -> DataFrame:
    return ops.centroid(_windows(t)).select("track_id", "i", r6(_c("x")).alias("x"))


@query("semantic_knn", "semantic", """, s as (select a.track_id as src, b.track_id as dst, round(greatest(0, least(1, (list_cosine_similarity(a.embedding, b.embedding) + 1) / 2)), 6) as similarity from semantic a join semantic b on a.track_id <> b.track_id),
r as (select *, row_number() over (partition by src order by similarity desc, dst) as rank from s) select * from r where rank <= 5""")
def semantic_knn(t: Tables) -> DataFrame:
    return ops.knn(t.semantic(), 5)


def _next_pairs(t: Tables) -> DataFrame:
    a = t.semantic()
    b = a.select((_c("track_id") - 1).alias("track_id"), _c("embedding").alias("other"))
    return a.join(b, "track_id")


_NX = "np as (select a.track_id, a.embedding as x, b.embedding as y from semantic a join semantic b on b.track_id = a.track_id + 1)"


@query("cosine01", "semantic", f", {_NX} select track_id, round(greatest(0, least(1, (list_cosine_similarity(x, y) + 1) / 2)), 6) as score from np")
def cosine01(t: Tables) -> DataFrame:
    return _next_pairs(t).select("track_id", r6(V.cosine01(_c("embedding"), _c("other"))).alias("score"))


def mood_map(vector, labels=MOODS, at=1):
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), V.softmax(F.slice(vector, at, len(labels))))


@query("map_similarity", "semantic", f", {LONG} select a.win as track_id, round(1 - avg(abs(a.rel - b.rel)), 6) as score from lr a join lr b on b.win = a.win + 1 and a.grp = 'mood' and b.grp = 'mood' and a.ord = b.ord group by 1")
def map_similarity(t: Tables) -> DataFrame:
    return _next_pairs(t).select("track_id", r6(V.map_similarity(mood_map(_c("embedding")), mood_map(_c("other")))).alias("score"))


_IM = """im as (select win as track_id, avg(rel) filter (where label in ('happy', 'calm')) as p, avg(rel) filter (where label = 'dark') as n, max(rel) filter (where label in ('happy', 'calm')) as mp, max(rel) filter (where label = 'dark') as mx,
 max(rel) filter (where label in ('sad', 'hopeful')) as tr from lr where grp = 'mood' group by 1), ia as (select win as track_id, avg(rel) filter (where label in ('dance', 'party')) as a from lr where grp = 'activity' group by 1)"""


def _labels(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


@query("intent_match", "semantic", f", {LONG}, {_IM} select track_id, round({S.clip('0.5::double + 0.5::double * p - 0.35::double * n')}, 6) as score from im")
def intent_match(t: Tables) -> DataFrame:
    return t.semantic().select("track_id", r6(V.intent_match(mood_map(_c("embedding")), _labels("happy", "calm", "unknown"), _labels("dark"))).alias("score"))


@query("map_match", "semantic", f", {LONG}, {_IM} select track_id, round({S.clip('mp - 0.45::double * mx')}, 6) as score from im")
def map_match(t: Tables) -> DataFrame:
    return t.semantic().select("track_id", r6(V.map_match(mood_map(_c("embedding")), _labels("happy", "calm"), _labels("dark"))).alias("score"))


@query("semantic_preference", "semantic semantic_rows", f""", {LONG}, {_IM}, r as (select s.track_id, s.confidence as ar, (s.track_id % 10) / 10.0::double as lr, 0.5::double as st,
 0.55::double * {S.clip('0.5::double + 0.5::double * p - 0.35::double * n')} + 0.3::double * {S.clip('0.5::double + 0.5::double * a')} + 0.15::double * tr as audio, (s.track_id % 7) / 7.0::double as lyric
 from semantic_rows s join im using (track_id) join ia using (track_id))
select track_id, round(case when ar + lr * st <= 0 then 0 else (audio * ar + lyric * lr * st) / (ar + lr * st) end, 6) as score from r""")
def semantic_preference(t: Tables) -> DataFrame:
    moods, acts = mood_map(_c("embedding")), mood_map(_c("embedding"), ACTIVITIES, len(MOODS) + 1)
    audio = audio_preference(moods, acts, _labels("happy", "calm"), _labels("dark"), _labels("dance", "party"), _labels("sad", "hopeful"))
    rel = t.derived("semantic_rows").select("track_id", _c("confidence").alias("ar"))
    df = t.semantic().join(rel, "track_id")
    lr, lyric = (_c("track_id") % 10) / 10, (_c("track_id") % 7) / 7
    return df.select("track_id", r6(weighted_preference(audio, _c("ar"), lyric, lr, F.lit(0.5))).alias("score"))


def audio_preference(moods, activities, wanted, avoided, acts, trajectory):
    """Mood, activity and trajectory agreement of the audio evidence."""
    best = F.coalesce(F.array_max(F.filter(F.transform(trajectory, lambda k: F.try_element_at(moods, k)), lambda v: v.isNotNull())), F.lit(0.5))
    return 0.55 * V.intent_match(moods, wanted, avoided) + 0.30 * V.intent_match(activities, acts, _labels()) + 0.15 * best


def weighted_preference(audio, audio_rel, lyric, lyric_rel, strength):
    """Reliability-weighted mix of audio and lyric preference; 0 without any evidence."""
    a, l = clip(audio_rel), clip(lyric_rel)
    total = a + l * clip(strength)
    return F.when(total <= 0, 0.0).otherwise((audio * a + lyric * l * strength) / total)


@query("top_labels", "semantic", f""", {LONG}, k as (select *, row_number() over (partition by win, grp order by round(rel, 9) desc, label) as r from lr where grp = 'mood') select win as track_id, string_agg(label, ',' order by r) filter (where r <= 3) as labels from k group by 1""")
def top_labels(t: Tables) -> DataFrame:
    ranked = F.array_sort(F.transform(F.map_entries(mood_map(_c("embedding"))), lambda e: F.struct((-F.round(e["value"], 9)).alias("n"), e["key"].alias("k"))))
    return t.semantic().select("track_id", F.concat_ws(",", F.transform(F.slice(ranked, 1, 3), lambda x: x["k"])).alias("labels"))


def _profile_rows() -> str:
    out = []
    for i, name in enumerate(PITCHES):
        for m, (mode, prof) in enumerate((("Major", MAJOR_PROFILE), ("Minor", MINOR_PROFILE))):
            vec = [prof[(j - i) % 12] for j in range(12)]
            out.append(f"('{name} {mode}', {i * 2 + m}, {[float(x) for x in vec]}::double[])")
    return ", ".join(out)


@query("key_from_chroma", "semantic", f""", pf(name, o, v) as (values {_profile_rows()}), c as (select s.track_id, pf.name, pf.o, round(corr(abs(s.embedding[j]), pf.v[j]), 9) as r from semantic s, pf, (select unnest(range(1, 13)) as j) group by 1, 2, 3),
b as (select track_id, arg_max(name, (r, -o)) as key_name, max(r) as r from c group by 1), d(key_name, code) as (values {S.KEYS_VALUES})
select b.track_id, b.key_name, coalesce(d.code, '') as camelot, round({S.clip('(r + 0.5) / 1.5')}, 6) as confidence from b left join d using (key_name)""")
def key_from_chroma(t: Tables) -> DataFrame:
    best = V.best_key(F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x)))
    return t.semantic().select("track_id", best.alias("k")).select(
        "track_id", _c("k.name").alias("key_name"), V.key_code(_c("k.name")).alias("camelot"), r6(clip((_c("k.r") + 0.5) / 1.5)).alias("confidence"))


@query("vector_normalise", "semantic", """, x as (select track_id, i - 1 as i, greatest(0, embedding[i]) as v from semantic, (select unnest(range(1, 13)) as i)) select track_id, i, round(case when sum(v) over (partition by track_id) <= 1e-9 then 1 / 12.0::double else v / sum(v) over (partition by track_id) end, 6) as v from x""")
def vector_normalise(t: Tables) -> DataFrame:
    return t.semantic().select("track_id", F.posexplode(V.normalise(F.slice("embedding", 1, 12))).alias("i", "v")).select("track_id", _c("i").cast("bigint").alias("i"), r6(_c("v")).alias("v"))


@query("camelot_one_hot", "tracks", """, p as (select track_id, ((cast(left(camelot, length(camelot) - 1) as bigint) - 1) * 7 + case when right(camelot, 1) = 'B' then 3 else 0 end) % 12 as pitch from tracks)
select track_id, i, case when i = pitch then 1.0::double else 0.0::double end as v from p, (select unnest(range(0, 12)) as i)""")
def camelot_one_hot(t: Tables) -> DataFrame:
    vec = V.one_hot_wheel(P.wheel_hour(_c("camelot")), P.wheel_mode(_c("camelot")))
    return t.tracks().select("track_id", F.posexplode(vec).alias("i", "v")).select("track_id", _c("i").cast("bigint").alias("i"), "v")
