"""Request tagging and the provenance rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.operators import audit
from segue.operators import tagging as ops
from segue.operators.intent import PRESETS
from segue.plans.sets import _handoff_times
from segue.registry import query
from segue.sources.tables import Tables

_c = F.col
_A = "case c_custkey % 11 when 0 then 'Chill mix' when 1 then 'peak time bangers' when 2 then 'a smooth story' when 3 then 'energetic party' when 4 then 'late night driving' when 5 then 'experimental mashup' when 6 then 'mellow background' when 7 then 'club set with a steady wave' when 8 then 'diverse emotional songs' when 9 then 'sad songs that slowly become hopeful' else 'balanced mix' end"
_B = "case c_custkey % 7 when 0 then ', no sad songs' when 1 then ', 120 to 130 bpm' when 2 then ', about love and hope' when 3 then ' for 2 hours' when 4 then ', avoid any heartbreak, 45 minutes' when 5 then ', 128 bpm, vocal safe' else ', short transitions without repeats' end"
_TXT = f"concat({_A}, {_B})"


def _first(words):
    return "case " + " ".join(f"when contains(t, '{w}') then '{v}'" for w, v in words.items()) + " end"


def _sql(value):
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else f"{value}::double"


def _avoid(words, negation):
    return "list_distinct(list_filter([" + ", ".join(f"case when regexp_matches(t, {_sql(ops.negated(negation, w))}) then '{v}' end" for w, v in words.items()) + "], lambda z: z is not null))"


def _steps(rungs, rest):
    return "case " + " ".join(f"when not exact and regexp_matches(t, {_sql(p)}) then {_sql(v)}" for p, v in rungs) + f" else {_sql(rest)} end"


def _path(paths):
    return "case " + " ".join(f"when not exact and regexp_matches(t, {_sql(ops.change_of(a, b))}) then '{','.join(p)}'" for a, b, p in paths) + " else '' end"


def _found(words):
    return "list_distinct(list_filter([" + ", ".join(f"case when contains(t, '{w}') then '{v}' end" for w, v in words.items()) + "], lambda z: z is not null))"


def _preset(i):
    return "case preset " + " ".join(f"when '{k}' then " + (f"'{v[i]}'" if isinstance(v[i], str) else f"{v[i]}::double") for k, v in PRESETS.items() if v[i] is not None) + " end"


_J = "case when exact then '' else array_to_string(list_sort(list_filter({f}, lambda z: not list_contains({a}, z))), ',') end"
_F = "case when exact then '' else array_to_string(list_sort({f}), ',') end"
_LISTS = [("moods", ops.MOOD_WORDS, ops.NOT_MOOD), ("themes", ops.THEME_WORDS, ops.NOT_THEME), ("lyrical_moods", ops.LYRICAL_WORDS, ops.NOT_THEME)]
_FREE = "case when not exact then {x} end"


def _word(words):
    return _FREE.format(x=_first(words))


_TAG = f"""with r as (select c_custkey as request_id, lower(trim({_TXT})) as t from customer),
q as (select *, t in ({', '.join(f"'{k}'" for k in PRESETS)}) as exact, {_first(ops.LEVEL_WORDS)} as lvl,
 regexp_extract(t, '{ops.BPM}', 1) as b1, regexp_extract(t, '{ops.BPM}', 2) as b2, regexp_extract(t, '{ops.DURATION}', 1) as d1, regexp_extract(t, '{ops.DURATION}', 2) as d2,
 {', '.join(f"{_found(w)} as f_{n}, {_avoid(w, neg)} as a_{n}" for n, w, neg in _LISTS)}, {_found(ops.ACTIVITY_WORDS)} as f_activity from r),
p as (select *, case when exact then t else {_first(ops.PRESET_WORDS)} end as preset, {_path(ops.MOOD_PATHS)} as mood_trajectory, {_path(ops.MEANING_PATHS)} as meaning_trajectory from q)
select request_id, preset, coalesce({_word(ops.PROFILE_WORDS)}, {_preset(0)}, case when mood_trajectory <> '' then 'slow_build' end) as energy_profile,
 coalesce({_word(ops.STYLE_WORDS)}, {_preset(1)}) as transition_style, coalesce({_word(ops.VOCAL_WORDS)}, {_preset(2)}) as vocal_preference, coalesce({_word(ops.LENGTH_WORDS)}, {_preset(8)}) as transition_length,
 coalesce(case when exact then null when lvl = 'low' then 0.0::double when lvl = 'medium' then 0.3::double when lvl = 'high' then 0.6::double end, {_preset(6)}) as energy_min,
 coalesce(case when exact then null when lvl = 'low' then 0.35::double when lvl = 'medium' then 0.65::double when lvl = 'high' then 1.0::double end, {_preset(7)}) as energy_max,
 case when b1 <> '' and not exact then case when b2 <> '' then try_cast(b1 as double) else greatest(0, try_cast(b1 as double) - 5) end else {_preset(4)} end as bpm_min,
 case when b1 <> '' and not exact then case when b2 <> '' then try_cast(b2 as double) else try_cast(b1 as double) + 10 end else {_preset(5)} end as bpm_max,
 coalesce(case when not exact then try_cast(d1 as double) * case when d2 = 'h' then 3600 else 60 end end, {_preset(3)}, 1800.0::double) as target_duration_sec,
 true as avoid_key_clash, not exact and contains(t, 'harmonic') as prefer_harmonic, case when not exact and contains(t, 'stem') then true end as prefer_stems,
 {', '.join(f"{_J.format(f=f'f_{n}', a=f'a_{n}')} as desired_{n}, {_F.format(f=f'a_{n}')} as avoid_{n}" for n, _, _ in _LISTS)}, {_F.format(f='f_activity')} as desired_activity,
 mood_trajectory, meaning_trajectory, {', '.join(f"{_steps(rungs, rest)} as {n}" for n, rungs, rest in ops.WISHES)} from p"""


@query("request_tag", "", _TAG)
def request_tag(t: Tables) -> DataFrame:
    d = ops.tag(t.raw("customer").select(_c("c_custkey").alias("request_id"), F.expr(_TXT).alias("raw_text")))
    text = lambda c: F.concat_ws(",", _c(c) if c.endswith("trajectory") else F.array_sort(c)).alias(c)
    return d.select(*[text(c) if kind == "array<string>" else _c(c) for c, kind in d.dtypes])


@query("performance_provenance")
def performance_provenance(t: Tables) -> DataFrame:
    """Broken provenance rules of appearances, transitions and layers, counted per mix and kind."""
    tl = t.timeline()
    length = 130 + _c("track_id") % 20
    app = F.array(
        F.when((_c("src_start") < 0) | (_c("src_end") <= _c("src_start")) | (_c("src_end") > length), "appearance_out_of_bounds"),
        F.when((_c("out_start") < 0) | (_c("out_end") <= _c("out_start")), "invalid_appearance_output"))
    a = tl.select("mix_id", F.explode(F.filter(app, lambda x: x.isNotNull())).alias("kind"))
    dup = audit.first_overlap(tl, ["mix_id", "track_id"], 50)
    over = F.least(_c("src_end"), _c("first.src_end")) - F.greatest(_c("src_start"), _c("first.src_start"))
    exact = (_c("src_start") == _c("first.src_start")) & (_c("src_end") == _c("first.src_end"))
    d = dup.where(exact | (over > F.greatest(F.lit(1), F.floor(length * 0.01)))).select("mix_id", F.lit("unplanned_duplicate_source_region").alias("kind"))
    h = _handoff_times(t)
    n_ops = (_c("src") + _c("dst")) % 5
    tr = F.array(
        F.when(_c("exit_t") + _c("overlap_sec") > _c("a_duration_sec"), "transition_source_out_of_bounds"), F.when(_c("cursor_t") > _c("b_duration_sec"), "transition_source_out_of_bounds"),
        F.when(n_ops > 3, "too_many_transition_operations"), F.when(_c("overlap_sec") < n_ops, "generated_fx_provenance_invalid"),
        F.when(_c("exit_t") < 2 * 240 / _c("a_bpm"), "invalid_preparation_output"), F.when(_c("entry_t") + 4 * 240 / _c("b_bpm") > _c("b_duration_sec"), "preparation_target_out_of_bounds"))
    b = h.select(_c("set_id").alias("mix_id"), F.explode(F.filter(tr, lambda x: x.isNotNull())).alias("kind"))
    stem = F.element_at(F.array(*[F.lit(s) for s in ("vocals", "drums", "bass", "other", "noise")]), (_c("tie") % 5 + 1).cast("int"))
    lay = tl.select("mix_id", "track_id", "src_start", "src_end", (_c("out_end") - _c("out_start")).alias("len"), stem.alias("stem"), _c("out_start").alias("layer"))
    seen = F.row_number().over(Window.partitionBy("mix_id", "track_id", "stem", "src_start", "src_end").orderBy("layer"))
    lrules = F.array(
        F.when(_c("src_end") > 130 + _c("track_id") % 20, "layer_source_out_of_bounds"), F.when(_c("stem") == "noise", "unknown_layer_stem"),
        F.when(F.abs(_c("src_end") - _c("src_start") - _c("len")) > F.greatest(F.lit(2.0), F.bround(_c("len") * 0.005)), "layer_source_duration_mismatch"), F.when(_c("seen") > 1, "duplicate_layer_source_region"))
    c = lay.withColumn("seen", seen).select("mix_id", F.explode(F.filter(lrules, lambda x: x.isNotNull())).alias("kind"))
    per = lay.groupBy("mix_id", "layer").agg(
        F.collect_set(F.when(_c("stem").isin("drums", "bass", "other"), _c("stem"))).alias("backing"), F.count_if(_c("stem") == "vocals").alias("voc"))
    e = per.where((F.size("backing") > 0) & (F.size("backing") < 3)).select("mix_id", F.lit("incomplete_layer_backing").alias("kind"))
    same = lay.groupBy("mix_id", "layer", "track_id").agg(F.bool_or(_c("stem") == "vocals").alias("v"), F.bool_or(_c("stem").isin("drums", "bass", "other")).alias("k")).where("v and k")
    f = same.select("mix_id", F.lit("same_track_layered_sources").alias("kind")).distinct()
    return audit.merge([a, d, b, c, e, f]).groupBy("mix_id", "kind").agg(F.count(F.lit(1)).alias("n"))
