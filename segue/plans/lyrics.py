"""Lyric and label-validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.functions import vectors as V
from segue.functions.basic import r6
from segue.operators import lyrics as ops
from segue.registry import query
from segue.sources.tables import Tables

_c = F.col

_SIDE = "concat('[0', cast(turn % 10 as string), ':1', cast(turn % 10 as string), '.5]', case when conv_id % 2 = 0 then concat('[1', cast(turn % 10 as string), ':20]') else '' end, text)"
_RX = "'\\[(\\d{1,2}):(\\d{2})(?:[.:](\\d{1,3}))?\\]'"


@query("sidecar_lines", "", f"""with f as (select conv_id, turn, unnest(string_split({_SIDE}, chr(10))) as line, generate_subscripts(string_split({_SIDE}, chr(10)), 1) - 1 as line_no from conversations),
c as (select *, trim(regexp_replace(line, '\\[\\d{{1,2}}:\\d{{2}}(?:[.:]\\d{{1,3}})?\\]', '', 'g')) as txt, regexp_extract_all(line, {_RX}, 0) as st from f),
e as (select conv_id, turn, line_no, txt, unnest(case when len(st) > 0 then st else [''] end) as stamp, generate_subscripts(case when len(st) > 0 then st else [''] end, 1) - 1 as k from c where txt <> '')
select conv_id, turn, line_no, k, txt as text, round(case when stamp = '' then 0 else cast(regexp_extract(stamp, {_RX}, 1) as integer) * 60 + cast(regexp_extract(stamp, {_RX}, 2) as integer)
 + case when regexp_extract(stamp, {_RX}, 3) <> '' then cast('0.' || regexp_extract(stamp, {_RX}, 3) as double) else 0 end end, 3) as start_sec from e""")
def sidecar_lines(t: Tables) -> DataFrame:
    return ops.sidecar_lines(t.raw("conversations").select("conv_id", "turn", F.expr(_SIDE).alias("text")), "text", ["conv_id", "turn"])


_CANDS = ["conv_id as track_id", "turn as ord", "case turn % 4 when 0 then 'txt' when 1 then 'lrc' when 2 then 'embedded' else 'txt' end as kind", "case when conv_id % 3 = 0 and turn % 4 = 2 then '  ' else text end as text"]


@query("lyrics_source_pick", "", f"""with c as (select {', '.join(_CANDS)} from conversations), r as (select *, row_number() over (partition by track_id order by trim(text) <> '' desc, case kind when 'embedded' then 3 when 'lrc' then 2 else 1 end desc, length(text) desc, ord) as rn from c)
select track_id, case when trim(text) = '' then 'unavailable' when kind = 'embedded' then 'embedded' else 'sidecar' end as source, case when trim(text) <> '' then kind end as kind, case when trim(text) <> '' then length(text) end as n_chars from r where rn = 1""")
def lyrics_source_pick(t: Tables) -> DataFrame:
    return ops.pick_source(t.raw("conversations").selectExpr(*_CANDS), "track_id")


_TQ = """tx as (select w.track_id, w.idx, w.start_sec, w.end_sec, c.text, trim(regexp_replace(lower(c.text), '[^a-z0-9\\x{80}-\\x{ffff}]+', ' ', 'g')) as norm, -(w.idx % 5) / 4.0::double as lp from words w join conversations c on c.conv_id = w.track_id and c.turn = w.idx),
tg as (select track_id, count(*) filter (where trim(text) <> '') as n, count(distinct norm) filter (where trim(text) <> '') as u, sum(length(norm)) as chars, greatest(1, arg_max(end_sec, idx) - arg_min(start_sec, idx)) as dur, avg(exp(greatest(-10, least(0, lp)))) as ac, 100 + track_id % 500 as td, 0.5::double + (track_id % 5) / 10.0::double as lg from tx group by track_id),
tq as (select track_id, round(greatest(0, least(1, 0.3::double * lg + 0.3::double * ac + 0.2::double * least(1, chars / (dur * 7)) + 0.2::double * least(1, dur / (td * 0.35::double)))) * case when n >= 3 and u <= greatest(1, n // 3) then 0.15::double else 1 end
 * case when dur / td < 0.1 then greatest(0.05::double, dur / td / 0.1::double) else 1 end + 1e-9, 4) as confidence, n >= 3 and u <= greatest(1, n // 3) as repeated from tg)"""


def _quality(t: Tables) -> DataFrame:
    seg = t.raw("conversations").select(_c("conv_id").alias("track_id"), _c("turn").alias("idx"), "text")
    w = t.words().select("track_id", "idx", "start_sec", "end_sec")
    seg = w.join(seg, ["track_id", "idx"]).withColumn("avg_logprob", -(_c("idx") % 5) / 4.0)
    track = seg.select("track_id").distinct().select("track_id", (100 + _c("track_id") % 500).alias("duration_sec"), (0.5 + (_c("track_id") % 5) / 10).alias("language_probability"))
    return ops.transcript_quality(seg, track)


@query("transcript_quality", "words", f", {_TQ} select * from tq")
def transcript_quality(t: Tables) -> DataFrame:
    return _quality(t)


@query("transcript_gate", "words lyric_rows", f""", {_TQ}, g as (select tq.track_id, case when y.track_id % 3 = 0 then y.text else '' end as existing, y.transcription_confidence as ec, case when y.track_id % 4 = 1 then y.text else '' end as own, case when tq.track_id % 5 = 0 then '' else 'x' end as asr, tq.confidence, tq.repeated, y.meaning_error <> '' as mf, y.meaning_confidence as mc from tq join lyric_rows y using (track_id)),
o as (select *, case when existing <> '' then 'reused' when own <> '' then 'own' when asr = '' then 'none' when repeated or confidence < 0.35 then 'rejected' else 'transcribed' end as outcome from g)
select track_id, outcome, length(case outcome when 'reused' then existing when 'own' then own when 'transcribed' then asr else '' end) as n_chars, round(case outcome when 'own' then 1 when 'reused' then ec when 'none' then 0 else confidence end, 6) as confidence, case when mf then least(mc, 0.25::double) else mc end as kept_meaning_confidence from o""")
def transcript_gate(t: Tables) -> DataFrame:
    y = t.derived("lyric_rows")
    k = _c("track_id")
    d = _quality(t).join(y, "track_id").select(
        "track_id", F.when(k % 3 == 0, _c("text")).otherwise("").alias("existing_text"), _c("transcription_confidence").alias("existing_confidence"),
        F.when(k % 4 == 1, _c("text")).otherwise("").alias("own_text"), F.when(k % 5 == 0, "").otherwise("x").alias("asr_text"),
        _c("confidence").alias("asr_confidence"), _c("repeated").alias("asr_repeated"), (_c("meaning_error") != "").alias("meaning_failed"), "meaning_confidence")
    return ops.transcript_gate(d).select("track_id", "outcome", F.length("text").cast("bigint").alias("n_chars"), r6(_c("confidence")).alias("confidence"), "kept_meaning_confidence")


# Fragments that occur in the invented test prose stand in for the real vocabulary.
TEST_TERMS = {"heartbreak": ["on th"], "love": ["the l"], "romance": ["ment", "verl"], "longing": ["ith"], "party": ["and"], "hope": ["ersa", "hope"],
              "anger": ["inin"], "loss": ["dede"], "freedom": ["free"]}


def _cnt(words):
    return " + ".join(f"(length(lt) - length(replace(lt, '{w}', ''))) // {len(w)}" for w in words)


KM = f"""k0 as (select track_id, lower(text) as lt from lyrics), k1 as (select track_id, {', '.join(f'{_cnt(w)} as n_{g}' for g, w in TEST_TERMS.items())} from k0),
kl as (select track_id, unnest([{', '.join(f"{{'g': '{g}', 'i': {i}, 'n': n_{g}}}" for i, g in enumerate(TEST_TERMS))}]) as x from k1),
kt as (select track_id, list(x.g order by x.n desc, x.i) filter (where x.n > 0) as ranked from kl group by 1),
km0 as (select k1.*, coalesce(ranked, []) as ranked, least(1, (n_heartbreak + n_longing + n_loss) / 5.0::double) as sadness, least(1, n_hope / 4.0::double) as hopefulness, least(1, n_party / 4.0::double) as party, least(1, (n_love + n_romance) / 6.0::double) as romance, least(1, n_anger / 4.0::double) as anger from k1 join kt using (track_id)),
km as (select *, list_filter([case when sadness > 0.25 then 'sad' end, case when sadness > 0.25 then 'melancholic' end, case when hopefulness > 0.25 then 'hopeful' end, case when party > 0.25 then 'happy' end, case when party > 0.25 then 'celebratory' end, case when romance > 0.25 then 'romantic' end, case when n_anger > 0 then 'angry' end], lambda x: x is not null)[1:4] as moods, ranked[1:6] as themes from km0)"""


@query("keyword_meaning", "lyrics", f", {KM} select track_id, array_to_string(ranked[1:3], ',') as primary_themes, array_to_string(ranked[4:6], ',') as secondary_themes, array_to_string(moods, ',') as moods, round(greatest(-1, least(1, hopefulness + party - sadness - n_anger / 5.0::double)), 6) as valence, round(least(1, ({' + '.join('n_' + g for g in TEST_TERMS)}) / 12.0::double), 6) as intensity, sadness, hopefulness, party, round(romance, 6) as romance, anger, case when len(ranked) > 0 then 0.25::double else 0::double end as confidence from km")
def keyword_meaning(t: Tables) -> DataFrame:
    m = ops.keyword_meaning(t.lyrics(), TEST_TERMS)
    s = lambda c: F.concat_ws(",", c)
    return m.select("track_id", s("primary_themes").alias("primary_themes"), s("secondary_themes").alias("secondary_themes"), s("lyrical_moods").alias("moods"),
                    r6(_c("emotional_valence")).alias("valence"), r6(_c("emotional_intensity")).alias("intensity"), "sadness", "hopefulness",
                    _c("party_context").alias("party"), r6(_c("romance")).alias("romance"), "anger", _c("meaning_confidence").alias("confidence"))


@query("label_jaccard", "lyrics", f""", {KM} select a.track_id, round(len(list_intersect(a.themes, b.themes)) / greatest(len(list_distinct(list_concat(a.themes, b.themes))), 1), 6) as theme, round(len(list_intersect(a.moods, b.moods)) / greatest(len(list_distinct(list_concat(a.moods, b.moods))), 1), 6) as mood,
 round(1 - least(1, abs(a.party - b.party) * 0.7::double + abs(a.sadness - b.sadness) * 0.3::double), 6) as context from km a join km b on b.track_id = a.track_id + 1""")
def label_jaccard(t: Tables) -> DataFrame:
    m = ops.keyword_meaning(t.lyrics(), TEST_TERMS).select("track_id", F.concat("primary_themes", "secondary_themes").alias("themes"), _c("lyrical_moods").alias("moods"), "party_context", "sadness")
    o = m.select((_c("track_id") - 1).alias("track_id"), *[_c(c).alias(f"o_{c}") for c in ("themes", "moods", "party_context", "sadness")])
    context = 1 - F.least(F.lit(1.0), F.abs(_c("party_context") - _c("o_party_context")) * 0.7 + F.abs(_c("sadness") - _c("o_sadness")) * 0.3)
    return m.join(o, "track_id").select("track_id", r6(V.jaccard(_c("themes"), _c("o_themes"))).alias("theme"), r6(V.jaccard(_c("moods"), _c("o_moods"))).alias("mood"), r6(context).alias("context"))


_LAB = ["doc_id as track_id", "case when doc_id % 5 = 0 then array('love', 'hope', 'love') when doc_id % 5 = 1 then array('party', 'sunshine') when doc_id % 5 = 2 then cast(array() as array<string>) else array('loss') end as themes",
        "case when doc_id % 3 = 0 then array('sad') else cast(array() as array<string>) end as lyrical_moods", "case when doc_id % 7 = 0 then array('happy', 'dance') when doc_id % 7 = 1 then array('loud', 'crisp') else cast(array() as array<string>) end as audio_tags"]
_LAB_SQL = "lb as (select doc_id as track_id, case when doc_id % 5 = 0 then ['love', 'hope'] when doc_id % 5 = 1 then ['party', 'sunshine'] when doc_id % 5 = 2 then [] else ['loss'] end as th, case when doc_id % 3 = 0 then ['sad'] else [] end as mo, case when doc_id % 7 = 0 then ['happy', 'dance'] when doc_id % 7 = 1 then ['loud', 'crisp'] else [] end as tg from documents)"


@query("label_validate", "", f"""with {_LAB_SQL} select track_id, array_to_string(th, ',') as themes, array_to_string(mo, ',') as lyrical_moods, array_to_string(tg, ',') as audio_tags,
 case when track_id % 5 = 1 and track_id % 7 = 1 then 'unknown labels in themes: sunshine; unknown labels in audio_tags: crisp, loud' when track_id % 5 = 1 then 'unknown labels in themes: sunshine' when track_id % 7 = 1 then 'unknown labels in audio_tags: crisp, loud' when len(th) + len(mo) + len(tg) = 0 then 'no labels' end as error from lb""")
def label_validate(t: Tables) -> DataFrame:
    v = ops.validate_labels(t.raw("documents").selectExpr(*_LAB))
    return v.select("track_id", *[F.concat_ws(",", c).alias(c) for c in ("themes", "lyrical_moods", "audio_tags")], "error")


@query("correction_overlay", "lyrics semantic", f""", {KM}, {_LAB_SQL}, cr as (select * from lb where track_id % 5 <> 1 and track_id % 7 <> 1 and len(th) + len(mo) + len(tg) > 0), l as (select distinct doc_id from labels where toxic = 1 or quality = 0)
select km.track_id, array_to_string(case when len(cr.th) > 0 then cr.th else km.themes end, ',') as themes, array_to_string(case when len(cr.mo) > 0 then cr.mo else km.moods end, ',') as moods,
 case when len(cr.th) > 0 or len(cr.mo) > 0 then 1.0::double when len(ranked) > 0 then 0.25::double else 0::double end as meaning_confidence, case when len(cr.tg) > 0 then 1.0::double else 0.4::double end as semantic_confidence,
 case when len(cr.tg) > 0 then 1.0::double else 0.2::double end as happy, coalesce(len(cr.th) > 0 or len(cr.mo) > 0, false) as corrected_words, coalesce(len(cr.tg) > 0, false) as corrected_tags
 from km left join l on l.doc_id = km.track_id left join cr on cr.track_id = km.track_id and l.doc_id is not null""")
def correction_overlay(t: Tables) -> DataFrame:
    scores = F.create_map(F.lit("happy"), F.lit(0.2), F.lit("dark"), F.lit(0.1))
    m = ops.keyword_meaning(t.lyrics(), TEST_TERMS).select("track_id", F.concat("primary_themes", "secondary_themes").alias("themes"), _c("lyrical_moods").alias("moods"),
                                                            "meaning_confidence", scores.alias("mood_scores"), F.lit(0.4).alias("semantic_confidence"))
    flagged = t.raw("labels").where("toxic = 1 or quality = 0").select(_c("doc_id").alias("track_id")).distinct()
    corrections = ops.validate_labels(t.raw("documents").selectExpr(*_LAB)).where(_c("error").isNull()).join(flagged, "track_id", "left_semi")
    return ops.overlay(m, corrections).select(
        "track_id", F.concat_ws(",", "themes").alias("themes"), F.concat_ws(",", "moods").alias("moods"), "meaning_confidence", "semantic_confidence",
        F.element_at("mood_scores", "happy").alias("happy"), "corrected_words", "corrected_tags")


_REPLY = "case event_id % 6 when 0 then 'no idea' when 1 then concat('Sure! {\"primary_themes\": [\"love\", \"love\", \"hope\"], \"lyrical_moods\": [\"sad\"], \"sadness\": ', cast(round(value / 100, 4) as string), ', \"emotional_valence\": -3} done') when 2 then '{\"primary_themes\": [\"sunshine\"]}' when 3 then '{\"relationship_context\": \"boss\", \"anger\": 0.5}' when 4 then '{\"meaning_confidence\": 0.75, \"relationship_context\": \"family\"}' else '{broken' end"


@query("meaning_from_json", "", """select event_id, case when event_id % 6 = 1 then 'love,hope' when event_id % 6 = 2 then 'sunshine' else '' end as primary_themes, case when event_id % 6 = 1 then 'sad' else '' end as lyrical_moods,
 round(case when event_id % 6 = 1 then least(1, round(value / 100, 4)) else 0 end, 6) as sadness, case when event_id % 6 = 1 then -1.0::double else 0::double end as valence, case when event_id % 6 = 4 then 0.75::double else 0::double end as confidence,
 case event_id % 6 when 0 then 'no JSON object' when 5 then 'no JSON object' when 2 then 'unknown labels in primary_themes: sunshine' when 3 then 'unknown relationship_context: boss' end as error from events""")
def meaning_from_json(t: Tables) -> DataFrame:
    m = ops.meaning_from_reply(t.raw("events").select("event_id", F.expr(_REPLY).alias("reply")), "reply")
    return m.select("event_id", F.concat_ws(",", "primary_themes").alias("primary_themes"), F.concat_ws(",", "lyrical_moods").alias("lyrical_moods"),
                    r6(_c("sadness")).alias("sadness"), _c("emotional_valence").alias("valence"), _c("meaning_confidence").alias("confidence"), "error")
