"""Requests against tracks: filters, validation, tagging, evidence-aware scores, candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import vectors as V
from segue.functions.basic import clip, lookup, snap
from segue.functions.vocab import ACTIVITIES, LYRICAL_MOODS, MOODS, THEMES

# fixed values: broad oppositions between labels
OPPOSITES = {
    "heartbreak": ["celebration", "party", "confidence", "success", "happy", "celebratory", "hopeful"],
    "breakup": ["celebration", "party", "happy", "celebratory", "hopeful"],
    "sad": ["happy", "euphoric", "celebratory", "celebration", "party"],
    "melancholic": ["happy", "euphoric", "celebratory", "celebration", "party"],
    "happy": ["sad", "melancholic", "dark", "heartbreak", "breakup", "loss", "loneliness"],
    "celebratory": ["sad", "melancholic", "heartbreak", "breakup", "loss"],
    "party": ["sad", "melancholic", "heartbreak", "breakup", "loneliness"],
    "romantic": ["angry", "anger", "aggressive"],
    "hopeful": ["sad", "melancholic", "heartbreak", "loss", "loneliness"],
    "relaxing": ["aggressive", "angry", "party"],
}
# fixed values: labels that count as each other when avoided
RELATED = {"breakup": ["breakup", "heartbreak"], "heartbreak": ["heartbreak", "breakup"], "love": ["love", "romance"], "romance": ["romance", "love"]}
STATUS_RANK = {"strong": 3, "partial": 2, "unknown": 1, "contradiction": 0}
# fixed values: words that make a wish a rule, and words that exclude
HARD_WORDS = r"\b(?:only|exclude|excluded|never|must|without|avoid)\b"
EXCLUDE_WORDS = r"\b(?:avoid|exclude|never|without|only)\b"

# fixed values: transition types allowed by style, bars by length word, energy by word
STYLE_TYPES = {
    "smooth": ["beatmatched_blend", "crossfade", "filter_sweep"],
    "energetic": ["bass_swap", "beatmatched_blend", "mashup", "phrase_cut"],
    "minimal": ["crossfade", "phrase_cut", "echo_out"],
    "varied": ["phrase_cut", "crossfade", "beatmatched_blend", "bass_swap", "filter_sweep", "echo_out", "loop_blend", "mashup"],
    "safe": ["crossfade", "phrase_cut", "beatmatched_blend", "filter_sweep"],
}
LENGTH_BARS = {"short": (4, 8), "medium": (8, 16), "long": (16, 32)}

# fixed values: presets (profile, style, vocals, seconds, bpm range, energy range, length)
PRESETS = {
    "chill": ("steady", "smooth", "any", 2400.0, 80.0, 115.0, 0.1, 0.45, "long"),
    "smooth": ("slow_build", "smooth", "vocal_safe", 2700.0, 100.0, 128.0, 0.2, 0.6, "medium"),
    "balanced": ("warmup_to_peak", "safe", "any", 3600.0, 110.0, 135.0, 0.15, 0.85, "medium"),
    "energetic": ("slow_build", "energetic", "any", 3600.0, 120.0, 140.0, 0.35, 0.95, "medium"),
    "peak": ("warmup_to_peak", "energetic", "any", 5400.0, 125.0, 150.0, 0.5, 1.0, "short"),
    "late_night": ("wave", "varied", "vocal_safe", 5400.0, 115.0, 132.0, 0.25, 0.75, "medium"),
    "vocal_safe": ("steady", "safe", "vocal_safe", 3000.0, 105.0, 130.0, 0.2, 0.7, "medium"),
    "experimental": ("wave", "varied", "any", 3600.0, None, None, None, None, None),
}
PRESET_FIELDS = ["energy_profile", "transition_style", "vocal_preference", "target_duration_sec", "bpm_min", "bpm_max", "energy_min", "energy_max", "transition_length"]


def labels(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def preset_columns(preset: Column) -> dict[str, Column]:
    """Preset values as lookups on the preset name (eight constant rows need no join)."""
    out = {}
    for i, field in enumerate(PRESET_FIELDS):
        table = {k: v[i] for k, v in PRESETS.items() if v[i] is not None}
        out[field] = lookup(preset, table)
    return out


def fill_preset(requests: DataFrame, override_wins: bool = True) -> DataFrame:
    """Fill null request fields from the preset named in ``preset``.

    With ``override_wins`` the request's own fields win; the other way round the preset
    replaces what it defines.
    """
    p = preset_columns(F.col("preset"))
    pick = lambda f: F.coalesce(F.col(f), p[f]) if override_wins else F.coalesce(p[f], F.col(f))
    return requests.select(*[c for c in requests.columns if c not in PRESET_FIELDS], *[pick(f).alias(f) for f in PRESET_FIELDS])


def effective(requests: DataFrame) -> DataFrame:
    """Defaults for profile, style and vocals; bar range by length word; allowed types by style."""
    style = F.coalesce(F.nullif(F.col("transition_style"), F.lit("")), F.lit("safe"))
    length = F.col("transition_length")
    return requests.select(
        "request_id", F.coalesce("energy_profile", F.lit("steady")).alias("energy_profile"), style.alias("transition_style"),
        F.coalesce("vocal_preference", F.lit("any")).alias("vocal_preference"),
        F.coalesce(lookup(length, {k: v[0] for k, v in LENGTH_BARS.items()}), F.lit(4)).cast("bigint").alias("min_bars"),
        F.coalesce(lookup(length, {k: v[1] for k, v in LENGTH_BARS.items()}), F.lit(16)).cast("bigint").alias("max_bars"),
        F.coalesce(lookup(style, {k: labels(*v) for k, v in STYLE_TYPES.items()}), labels(*STYLE_TYPES["varied"])).alias("allowed_types"),
    )


def validate(requests: DataFrame) -> DataFrame:
    """One row per broken rule of each request."""
    c = F.col
    out_of = lambda f: ~F.coalesce(c(f).between(0.0, 1.0), F.lit(True))
    unknown = lambda f, allowed: F.size(F.array_except(F.coalesce(c(f), labels()), labels(*allowed))) > 0
    rules = [
        (~c("performance_mode").isin("classic", "segment", "auto"), "performance_mode"),
        (out_of("desired_variety"), "desired_variety"),
        (c("preset").isNotNull() & ~c("preset").isin(list(PRESETS)), "preset"),
        (c("transition_style").isNotNull() & ~c("transition_style").isin(list(STYLE_TYPES)), "transition_style"),
        (unknown("desired_moods", MOODS + ACTIVITIES), "desired_moods"),
        (unknown("desired_themes", THEMES), "desired_themes"),
        (unknown("desired_lyrical_moods", LYRICAL_MOODS), "desired_lyrical_moods"),
        (c("bpm_min") > c("bpm_max"), "bpm_range"),
        (c("energy_min") > c("energy_max"), "energy_range"),
        (out_of("energy_min"), "energy_min"), (out_of("energy_max"), "energy_max"),
        (c("target_duration_sec") <= 0, "target_duration_sec"),
        (c("transition_length").isNotNull() & ~c("transition_length").isin(list(LENGTH_BARS)), "transition_length"),
    ]
    hits = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())
    return requests.select("request_id", F.explode(hits).alias("field"))


def hard_ranges(raw_text: Column) -> Column:
    return raw_text.isNull() | F.lower(raw_text).rlike(HARD_WORDS)


def range_candidates(requests: DataFrame, tracks: DataFrame, width: float = 10.0) -> DataFrame:
    """Track ids inside each distinct tempo and energy range.

    Requests share few distinct ranges, so ranges are joined once each, on tempo bins.
    """
    ranges = requests.select("bpm_min", "bpm_max", "energy_min", "energy_max").distinct()
    b = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("bpm_min") / width), F.floor(F.greatest("bpm_min", "bpm_max") / width))))
    t = tracks.select("track_id", "bpm", "mean_energy", F.floor(F.col("bpm") / width).alias("_b"))
    return b.join(t, "_b").where(F.col("bpm").between(F.col("bpm_min"), F.col("bpm_max")) & F.col("mean_energy").between(F.col("energy_min"), F.col("energy_max"))).drop("_b")


def hard_filter(requests: DataFrame, tracks: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """How many tracks each request keeps and whether it falls back to the whole library.

    Included tracks stay, excluded tracks go, then ranges apply when they are hard. The
    counts come from distinct ranges plus a correction per listed track, so no request is
    ever multiplied by the library.
    """
    keys = ["bpm_min", "bpm_max", "energy_min", "energy_max"]
    n_all = tracks.agg(F.count(F.lit(1)).alias("n_all"))
    req = requests.withColumn("hard", hard_ranges(F.col("raw_text")))
    in_range = range_candidates(req.where("hard"), tracks).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in"))
    listed = (
        include.select("request_id", "track_id", F.lit(True).alias("inc")).unionByName(exclude.select("request_id", "track_id", F.lit(False).alias("inc")))
        .groupBy("request_id", "track_id").agg(F.max("inc").alias("inc"))
        .join(tracks.select("track_id", "bpm", "mean_energy"), "track_id").join(req, "request_id")
    )
    passes = ~F.col("hard") | (F.col("bpm").between(F.col("bpm_min"), F.col("bpm_max")) & F.col("mean_energy").between(F.col("energy_min"), F.col("energy_max")))
    fix = F.when(F.col("inc") & ~passes, 1).when(~F.col("inc") & passes, -1).otherwise(0)
    fixes = listed.groupBy("request_id").agg(F.sum(fix).alias("fix"))
    d = req.join(in_range, keys, "left").join(fixes, "request_id", "left").crossJoin(F.broadcast(n_all))
    kept = F.when(F.col("hard"), F.coalesce("n_in", F.lit(0))).otherwise(F.col("n_all")) + F.coalesce("fix", F.lit(0))
    return d.select("request_id", kept.cast("bigint").alias("n_kept"), (kept < 2).alias("fallback"), F.when(kept < 2, F.col("n_all")).otherwise(kept).cast("bigint").alias("n_result"))


def requests_semantics() -> Column:
    fields = ["desired_themes", "avoid_themes", "desired_lyrical_moods", "avoid_lyrical_moods", "desired_moods", "avoid_moods", "desired_activity", "mood_trajectory", "meaning_trajectory"]
    out = F.lit(False)
    for f in fields:
        out = out | (F.size(F.coalesce(F.col(f), labels())) > 0)
    return out


def energy_match(energy: Column, low: Column, high: Column, moods: Column, activities: Column) -> Column:
    """1 inside the range, falling to 0 half a unit away; without a range, mood words imply a weak cue."""
    both = F.array_union(moods, activities)
    lo, hi = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1.0))
    gap = F.greatest(lo - energy, energy - hi)
    implied = (
        F.when(F.arrays_overlap(both, labels("happy", "euphoric", "dance", "party", "workout")), clip(energy / 0.75))
        .when(F.arrays_overlap(moods, labels("sad", "melancholic", "calm", "dark")) | F.array_contains(activities, "relaxing"), clip(1 - energy))
        .otherwise(0.5)
    )
    return F.when(low.isNull() & high.isNull(), implied).when(gap <= 0, 1.0).otherwise(clip(1 - gap / 0.5))


def widened(themes: Column, moods: Column) -> tuple[Column, Column]:
    """Labels plus what the bounded scores imply."""
    c = F.col
    party, hope, sad, love = (c("party_context") >= 0.55) | (c("celebration") >= 0.55), c("hopefulness") >= 0.55, c("sadness") >= 0.55, c("romance") >= 0.55
    more = lambda test, *xs: F.when(test, labels(*xs)).otherwise(labels())
    t = F.array_distinct(F.concat(themes, more(party, "party", "celebration"), more(hope, "hope"), more(sad, "loss", "heartbreak"), more(love, "love", "romance")))
    m = F.array_distinct(F.concat(moods, more(party, "happy", "celebratory"), more(hope, "hopeful"), more(sad, "sad", "melancholic"), more(love, "romantic")))
    return t, m


def _opposed(requested: Column, observed: Column) -> Column:
    out = F.lit(False)
    for k, xs in OPPOSITES.items():
        out = out | (F.array_contains(requested, k) & F.arrays_overlap(observed, labels(*xs)))
    return out


def _avoided(avoid: Column, present: Column) -> Column:
    wide = F.flatten(F.transform(avoid, lambda x: F.coalesce(lookup(x, {k: labels(*v) for k, v in RELATED.items()}), F.array(x))))
    return F.coalesce(F.arrays_overlap(wide, present), F.lit(False))


def score(pairs: DataFrame, strong_audio: float = 0.35) -> DataFrame:
    """Evidence-aware relevance of each (request, track) row.

    Expects the request's label arrays, ``energy_min``/``energy_max``, the track's
    ``mean_energy``, its meaning columns (null ``meaning_confidence`` = none) and its
    ``mood_scores``/``activity_scores`` maps (null ``semantic_confidence`` = none).
    Missing evidence is neutral and never looks like a match.
    """
    c = F.col
    none = labels()
    arr = lambda f: F.coalesce(c(f), none)
    has_m, has_s = c("meaning_confidence").isNotNull(), c("semantic_confidence").isNotNull()
    themes, moods = widened(F.concat(arr("primary_themes"), arr("secondary_themes")), arr("lyrical_moods"))
    trans = F.coalesce(c("transcription_confidence"), F.lit(0.0))
    d = pairs.select(
        "*",
        F.when(has_m, F.coalesce(themes, none)).otherwise(none).alias("_th"), F.when(has_m, F.coalesce(moods, none)).otherwise(none).alias("_mo"),
        F.when(has_m, clip(c("meaning_confidence")) * F.when(trans != 0, clip(trans / 0.65)).otherwise(1.0)).otherwise(0.0).alias("_rel"),
        clip(F.coalesce(c("semantic_confidence"), F.lit(0.0))).alias("_arel"),
        ((F.size(arr("desired_themes")) > 0) | (F.size(arr("avoid_themes")) > 0) | (F.size(arr("desired_lyrical_moods")) > 0)
         | (F.size(arr("avoid_lyrical_moods")) > 0) | (F.size(arr("meaning_trajectory")) > 0)).alias("_mreq"),
        ((F.size(arr("desired_moods")) > 0) | (F.size(arr("avoid_moods")) > 0) | (F.size(arr("desired_activity")) > 0)
         | (F.size(arr("mood_trajectory")) > 0) | c("energy_min").isNotNull() | c("energy_max").isNotNull()).alias("_areq"),
        requests_semantics().alias("_any"),
    )
    d = d.select(
        "*",
        F.when(has_m, V.label_match(c("_th"), arr("desired_themes"), arr("primary_themes"))).otherwise(0.5).alias("theme_match"),
        F.when(has_m, V.label_match(c("_mo"), arr("desired_lyrical_moods"))).otherwise(0.5).alias("mood_match"),
        F.when(has_m, V.label_match(F.array_union(c("_mo"), c("_th")), arr("meaning_trajectory"))).otherwise(0.5).alias("trajectory_match"),
        F.when(has_s, V.map_match(c("mood_scores"), arr("desired_moods"), arr("avoid_moods"))).otherwise(0.5).alias("audio_match"),
        F.when(has_s, V.map_match(c("activity_scores"), arr("desired_activity"), none)).otherwise(0.5).alias("activity_match"),
        energy_match(c("mean_energy"), c("energy_min"), c("energy_max"), arr("desired_moods"), arr("desired_activity")).alias("energy_match"),
        F.array_union(c("_th"), c("_mo")).alias("_words"),
        F.when(has_s, F.map_keys(F.map_filter(F.map_concat("mood_scores", "activity_scores"), lambda k, v: v >= strong_audio))).otherwise(none).alias("_heard"),
    )
    requested = F.array_union(F.array_union(arr("desired_themes"), arr("desired_lyrical_moods")), F.array_union(arr("desired_moods"), arr("desired_activity")))
    avoid = F.array_union(F.array_union(arr("avoid_themes"), arr("avoid_lyrical_moods")), arr("avoid_moods"))
    sure = has_m & (c("_rel") >= 0.6)
    d = d.select(
        "*", sure.alias("_sure"), _opposed(requested, F.array_union(c("_words"), c("_heard"))).alias("_opp"),
        F.greatest(F.when(sure & _avoided(avoid, c("_words")), 1.0).otherwise(0.0),
                   F.when(has_s & F.arrays_overlap(arr("avoid_moods"), F.map_keys(F.map_filter("mood_scores", lambda k, v: v >= strong_audio))), 0.85).otherwise(0.0)).alias("penalty"),
        F.when(F.size(arr("meaning_trajectory")) > 0, F.greatest("theme_match", "mood_match")).otherwise(0.75 * c("theme_match") + 0.25 * c("mood_match")).alias("_lyric"),
        (0.65 * c("audio_match") + 0.25 * c("activity_match") + 0.10 * c("energy_match")).alias("_audio"),
    )
    lyric, audio = F.round("_lyric", 9), F.round("_audio", 9)
    by_words = F.when(c("penalty") >= 0.8, "contradiction").when(lyric >= 0.72, "strong").when(lyric >= 0.55, "partial").when(c("_opp") | (lyric < 0.25), "contradiction").otherwise("partial")
    by_sound = F.when(audio >= 0.62, "strong").when(audio >= 0.35, "partial").when(c("_opp"), "contradiction").otherwise("unknown")
    heard = c("_areq") & has_s & (c("_arel") >= 0.35)
    status = F.when(c("_mreq") & c("_sure"), by_words).when(c("_mreq"), "unknown").when(heard, by_sound).when(c("_any"), "unknown").otherwise("strong")
    rel = F.when(c("_mreq") & c("_sure"), c("_rel")).when(c("_mreq"), F.greatest(c("_arel") * 0.55, c("_rel"))).when(heard, c("_arel")).when(c("_any"), 0.0).otherwise(1.0)
    d = d.select("*", status.alias("status"), rel.alias("reliability"))
    sound = F.when(c("_areq"), 0.16 * c("audio_match") + 0.10 * c("activity_match")).otherwise(0.0)
    base = (
        F.when(c("_mreq") & c("_sure"), 0.62 * c("_lyric") + sound + 0.07 * c("energy_match") + 0.05 * c("trajectory_match"))
        .when(c("_mreq"), (0.24 + 0.10 * c("audio_match") + 0.08 * c("activity_match") + 0.08 * c("energy_match")) * F.greatest(F.lit(0.65), 1 - 0.35 * (1 - c("reliability"))))
        .when(c("_areq"), 0.62 * c("audio_match") + 0.20 * c("activity_match") + 0.13 * c("energy_match") + 0.05 * c("trajectory_match"))
        .otherwise(0.5)
    ) - 0.62 * c("penalty")
    held = F.when((c("status") == "contradiction") & c("_sure"), F.least(base, F.lit(0.18))).when(c("status") == "unknown", F.least(base, F.lit(0.48))).otherwise(base)
    return d.withColumn("score", snap(clip(held), 6)).withColumn("status_rank", lookup(c("status"), STATUS_RANK).cast("bigint"))


def trajectory_label(label: Column) -> Column:
    """Evidence that a track can take a point of a meaning trajectory."""
    c = F.col
    words = F.concat(F.coalesce("primary_themes", labels()), F.coalesce("secondary_themes", labels()), F.coalesce("lyrical_moods", labels()))
    trans = F.coalesce(c("transcription_confidence"), F.lit(0.0))
    rel = clip(c("meaning_confidence")) * F.when(trans != 0, clip(trans / 0.65)).otherwise(1.0)
    sure = (
        F.when(F.array_contains(words, label), 1.0)
        .when(label.isin("hope", "hopeful") & (c("hopefulness") >= 0.55), 1.0)
        .when(label.isin("happy", "celebratory", "party") & ((c("celebration") >= 0.55) | (c("party_context") >= 0.55)), 1.0)
        .when(label.isin("sad", "melancholic") & (c("sadness") >= 0.55), 1.0)
        .when(_opposed(F.array(label), words), 0.0).otherwise(0.15)
    )
    heard = F.when(c("semantic_confidence").isNotNull(), clip(F.coalesce(F.try_element_at("mood_scores", label), F.lit(0.5)))).otherwise(0.5)
    return F.when(c("meaning_confidence").isNotNull() & (rel >= 0.6), sure).otherwise(heard)


def rank(scored: DataFrame, by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("status_rank"), F.desc("score"), F.asc("track_id"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def candidate_pool(scored: DataFrame, by: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """Which tracks enter a request's pool, and at which step of the relaxation ladder.

    ``scored`` needs request_id, track_id, status, score, duration_sec, target_sec, excludes
    (the request excludes explicitly), semantic (it asks for semantics), variety_on. Strong and
    partial tracks always enter; unknown ones until two tracks, then until the effective
    duration, then for variety; contradictions only as a last resort. ``by`` may name how rows are dealt besides the request.
    """
    r = rank(scored, by)
    c = F.col
    known = c("status").isin("strong", "partial")
    req = Window.partitionBy(*by)
    order = req.orderBy("rank")
    eff = F.greatest(F.lit(0.0), c("duration_sec") * 0.9)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n_known, d_known = F.sum(known.cast("int")).over(req), F.sum(F.when(known, eff)).over(req)
    unknown, contra = c("status") == "unknown", c("status") == "contradiction"
    i_unknown = F.coalesce(F.sum(unknown.cast("int")).over(before), F.lit(0))
    s_unknown = F.coalesce(F.sum(F.when(unknown, eff)).over(before), F.lit(0.0))
    d = r.select("*", F.coalesce(n_known, F.lit(0)).alias("_n"), F.coalesce(d_known, F.lit(0.0)).alias("_d"), i_unknown.alias("_i"), s_unknown.alias("_s"),
                 F.count(F.lit(1)).over(req).alias("_all"), F.sum(unknown.cast("int")).over(req).alias("_nu"), F.sum(F.when(unknown, eff)).over(req).alias("_du"),
                 F.coalesce(F.sum(contra.cast("int")).over(before), F.lit(0)).alias("_ci"), F.coalesce(F.sum(F.when(contra, eff)).over(before), F.lit(0.0)).alias("_cs"))
    goal = F.least(c("_all"), F.greatest(F.lit(3), F.least(F.lit(8), F.bround(c("target_sec") / 75).cast("int"))))
    by_min = unknown & (c("_n") + c("_i") < 2)
    by_time = unknown & (c("_d") + c("_s") < c("target_sec"))
    by_variety = unknown & c("variety_on") & (c("_n") + c("_i") < goal)
    # Contradictions are used only when known and unknown material gives fewer than two tracks.
    last = contra & ~c("excludes") & (c("_n") + c("_nu") < 2) & (
        (c("_n") + c("_nu") + c("_ci") < 2) | (c("_d") + F.coalesce("_du", F.lit(0.0)) + c("_cs") < c("target_sec")))
    step = (
        F.when(~c("semantic"), "all").when(known, "match").when(by_min, "two_tracks").when(by_time, "duration").when(by_variety, "variety")
        .when(last, "last_resort").when(contra & c("excludes"), "excluded").otherwise("left_out")
    )
    return d.withColumn("step", step).drop("_n", "_d", "_i", "_s", "_all", "_nu", "_du", "_ci", "_cs")


def coverage(items: DataFrame, key: str) -> DataFrame:
    """Counts by status, weighted coverage and label of each set."""
    n = lambda s: F.count_if(F.col("status") == s)
    a = items.groupBy(key).agg(F.count(F.lit(1)).alias("n"), n("strong").alias("strong"), n("partial").alias("partial"), n("unknown").alias("unknown"),
                               n("contradiction").alias("contradiction"), F.sum("duration_sec").alias("selected_sec"))
    cov = (F.col("strong") + 0.6 * F.col("partial")) / F.col("n")
    good = F.when(F.round(cov, 9) >= 0.6, "Good").otherwise("Limited")
    return a.withColumn("coverage", snap(cov)).withColumn(
        "label", F.when(F.col("contradiction") > 0, "Limited").when(F.col("strong") == F.col("n"), "Strong").otherwise(good)).withColumn(
        "segment_label", F.when(F.col("strong") == F.col("n"), "Strong").otherwise(good))
