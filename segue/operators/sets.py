"""Aggregates and window scores over ordered sets.

A set is one plan; its rows meet on ``set_id`` once and every figure of a query
comes from that single shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.basic import clip, lookup, r6, snap, steps

# fixed values: transition classes and limits of the pacing rules
OVERLAPPING = ["crossfade", "bass_swap", "loop_blend", "filter_sweep", "phase_lock", "echo_tail"]
COMPLEX = ["loop_roll", "tape_stop", "bass_swap", "loop_blend"]
MAX_FADE, MAX_COMPLEX, MIN_OVERLAP = 0.20, 3, 0.5

# fixed values: next roles that continue a section well
ROLE_FLOW = {
    "intro": ["verse", "hook", "chorus"],
    "verse": ["pre_chorus", "chorus", "hook", "instrumental", "bridge"],
    "pre_chorus": ["chorus", "drop", "hook"],
    "chorus": ["instrumental", "hook", "breakdown", "verse", "outro"],
    "hook": ["hook", "chorus", "instrumental", "drop", "outro"],
    "instrumental": ["hook", "chorus", "build", "drop", "breakdown"],
    "breakdown": ["build", "drop", "chorus", "verse"],
    "build": ["drop", "chorus", "hook"],
    "drop": ["breakdown", "hook", "outro", "chorus"],
    "bridge": ["chorus", "verse", "outro", "instrumental"],
    "outro": ["intro", "verse", "hook", "chorus"],
}
SECTION_NAMES = ["intro", "verse", "pre_chorus", "pre-chorus", "chorus", "hook", "breakdown", "build", "drop",
                 "instrumental", "outro", "bridge"]

# fixed values: section pairs with their fit
STRUCTURE_FIT = {
    "outro>intro": 1.0, "outro>verse": 0.95, "chorus>intro": 0.9, "chorus>verse": 0.85, "verse>intro": 0.85,
    "verse>verse": 0.8, "bridge>intro": 0.75, "bridge>verse": 0.7,
}


def clean_section(name: Column) -> Column:
    x = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("unknown")))), F.lit(" "), F.lit("_"))
    return F.when(x.isin(SECTION_NAMES), x).otherwise("unknown")


def structure_fit(a: Column, b: Column) -> Column:
    known = lookup(F.concat(a, F.lit(">"), b), STRUCTURE_FIT)
    return F.coalesce(known, F.when(b == "chorus", 0.35).when(a == "intro", 0.3).otherwise(0.55))


def role_flow(a: Column, b: Column, same: float = 0.35) -> Column:
    follows = None
    for role, nxt in ROLE_FLOW.items():
        test = (a == role) & b.isin(nxt)
        follows = test if follows is None else follows | test
    return F.when((a == "unknown") | (b == "unknown"), 0.5).when(follows, 1.0).when(a == b, same).otherwise(0.65)


def by_set(*order: str) -> Window:
    return Window.partitionBy("set_id").orderBy(*(order or ("pos",)))


def overview(items: DataFrame, sets: DataFrame) -> DataFrame:
    e = F.col("avg_energy")
    return items.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_tracks"), F.avg("bpm").alias("avg_bpm"), F.avg("mean_energy").alias("avg_energy"),
    ).join(sets.select("set_id", "total_duration_sec"), "set_id").select(
        "set_id", "n_tracks", snap(F.col("total_duration_sec") / 60, 4).alias("minutes"), snap(F.col("avg_bpm"), 4).alias("avg_bpm"),
        snap(e, 6).alias("avg_energy"),
        steps(F.round(e, 9), [("<", 0.35, "low"), ("<", 0.55, "medium"), ("<", 0.75, "high")], "very high").alias("band"),
    )


def journey(items: DataFrame) -> DataFrame:
    """Start, middle, end and peak energy, peak position, and number of rises and drops."""
    e = F.col("mean_energy")
    d = items.select("set_id", "pos", "mean_energy", (e - F.lag("mean_energy").over(by_set())).alias("d"),
                     F.count(F.lit(1)).over(Window.partitionBy("set_id")).alias("n"))
    return d.groupBy("set_id").agg(
        F.min_by("mean_energy", "pos").alias("start_energy"),
        F.max(F.when(F.col("pos") == F.floor(F.col("n") / 2) + 1, e)).alias("mid_energy"),
        F.max_by("mean_energy", "pos").alias("end_energy"),
        F.max("mean_energy").alias("peak_energy"),
        snap((F.max_by("pos", F.struct(e, -F.col("pos"))) - 1) / F.max("n") * 100, 4).alias("peak_pct"),
        F.count_if(F.col("d") > 0).alias("rises"),
        (F.max("n") - 1 - F.count_if(F.col("d") > 0)).alias("drops"),
    )


def type_mix(transitions: DataFrame) -> DataFrame:
    """Most used transition type (first seen on a tie), its count and share."""
    per = transitions.groupBy("set_id", "transition_type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = F.struct("n", -F.col("first"))
    return per.groupBy("set_id").agg(
        F.max_by("transition_type", best).alias("dominant"), F.max("n").alias("n_dominant"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_types"),
    ).withColumn("share", snap(F.col("n_dominant") / F.col("n"), 6))


def extremes(items: DataFrame) -> DataFrame:
    e = F.col("mean_energy")
    span = F.max("bpm") - F.min("bpm")
    return items.groupBy("set_id").agg(
        F.min_by("track_id", F.struct(e, F.col("pos"))).alias("lowest"), F.max_by("track_id", F.struct(e, F.col("pos"))).alias("highest"),
        F.min("mean_energy").alias("low_energy"), F.max("mean_energy").alias("high_energy"), span.alias("bpm_range"),
        F.when(span < 5, "consistent").when(span > 20, "varied").otherwise("normal").alias("bpm_flag"),
    )


def alignment(items: DataFrame) -> DataFrame:
    """Share of a set inside the requested tempo and energy ranges and using preferred types."""
    c = F.col
    return items.groupBy("set_id").agg(
        F.count_if(c("bpm").between(c("bpm_min"), c("bpm_max"))).alias("bpm_hits"),
        snap(F.avg(F.when(c("bpm").between(c("bpm_min"), c("bpm_max")), 1.0).otherwise(0.0)) * 100, 4).alias("bpm_pct"),
        F.count_if(c("mean_energy").between(c("energy_min"), c("energy_max"))).alias("energy_hits"),
        snap(F.avg(F.when(c("mean_energy").between(c("energy_min"), c("energy_max")), 1.0).otherwise(0.0)) * 100, 4).alias("energy_pct"),
        F.count_distinct(F.when(c("preferred"), c("transition_type"))).alias("preferred_types"),
    )


def _fade(kind: Column, overlap: Column) -> Column:
    return F.when(kind.isin(OVERLAPPING) & (overlap >= MIN_OVERLAP), overlap).otherwise(0.0)


def fade_dominance(transitions: DataFrame, sets: DataFrame) -> DataFrame:
    f = transitions.groupBy("set_id").agg(F.sum(_fade(F.col("transition_type"), F.col("overlap_sec"))).alias("fade_sec"))
    share = F.col("fade_sec") / F.col("total_duration_sec")
    return f.join(sets.select("set_id", "total_duration_sec"), "set_id").where("total_duration_sec > 0").select(
        "set_id", "fade_sec", snap(share, 6).alias("fade_dominance"), (share > MAX_FADE).alias("violated"))


def technique_diversity(transitions: DataFrame) -> DataFrame:
    """Shannon entropy of the types of a set over its maximum; 0 for a single type."""
    per = transitions.groupBy("set_id", "transition_type").agg(F.count(F.lit(1)).alias("n"))
    sums = per.groupBy("set_id").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlog"), F.count(F.lit(1)).alias("k"))
    entropy = F.log2("total") - F.col("nlog") / F.col("total")
    return sums.select("set_id", F.col("k").alias("n_types"), snap(F.when(F.col("k") > 1, entropy / F.log2("k")).otherwise(0.0), 6).alias("diversity"))


def longest_run(transitions: DataFrame) -> DataFrame:
    """Longest run of consecutive complex types."""
    hit = F.col("transition_type").isin(COMPLEX)
    g = transitions.select("set_id", "pos", hit.alias("h")).withColumn("g", F.col("pos") - F.sum(F.col("h").cast("int")).over(by_set()))
    return g.groupBy("set_id", "g").agg(F.count_if("h").alias("run")).groupBy("set_id").agg(F.max("run").alias("longest")).withColumn(
        "violated", F.col("longest") > MAX_COMPLEX)


def timeline_stats(items: DataFrame) -> DataFrame:
    """Reuse, repeated adjacent pairs, type variety and average overlap per set."""
    nxt = items.withColumn("dst", F.lead("track_id").over(by_set()))
    per_track = items.groupBy("set_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    reuse = per_track.groupBy("set_id").agg(F.count(F.lit(1)).alias("unique_tracks"), F.max("n").alias("max_reuse"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("reused"))
    edges = nxt.where(F.col("dst").isNotNull()).groupBy("set_id", "track_id", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("set_id").agg(
        F.sum(F.col("n") - 1).alias("repeated_pairs"))
    base = items.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("appearances"), F.count_distinct("transition_type").alias("type_variety"),
        F.count_if(F.col("transition_type").isin(COMPLEX)).alias("strong_count"), snap(F.avg("overlap_sec"), 6).alias("avg_overlap"))
    return base.join(reuse, "set_id").join(edges, "set_id", "left").withColumn("repeated_pairs", F.coalesce("repeated_pairs", F.lit(0)))


def set_arc(items: DataFrame, requested_variety: float = 0.65) -> DataFrame:
    """Build, release, wave or steady from the first and last third; variety label."""
    n = F.count(F.lit(1)).over(Window.partitionBy("set_id"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    d = items.withColumn("n", n).withColumn("third", third)
    e = F.col("mean_energy")
    a = d.groupBy("set_id").agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("pos") <= F.col("third"), e)).alias("first"),
        F.avg(F.when(F.col("pos") > F.col("n") - F.col("third"), e)).alias("last"),
        (F.max(e) - F.min(e)).alias("span"), F.count_distinct("track_id").alias("u"))
    rise = F.round(F.col("last") - F.col("first"), 9)
    ratio = F.col("u") / F.col("n")
    return a.select(
        "set_id",
        F.when(F.col("n") < 2, "steady").when(rise > 0.12, "build").when(rise < -0.12, "release").when(F.round("span", 9) > 0.25, "wave").otherwise("steady").alias("arc"),
        F.when((F.lit(requested_variety) >= 0.65) & (ratio >= 0.6), "high").when(ratio < 0.4, "limited").otherwise("moderate").alias("diversity"),
    )


def set_score(transitions: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean transition quality with a penalty for too much fading, and mean confidence."""
    a = transitions.groupBy("set_id").agg(
        F.avg("quality").alias("q"), F.avg("confidence").alias("c"), F.sum(_fade(F.col("transition_type"), F.col("overlap_sec"))).alias("fade"))
    excess = F.greatest(F.lit(0.0), F.col("fade") / F.col("total_duration_sec") - MAX_FADE)
    return a.join(sets.select("set_id", "total_duration_sec"), "set_id").select(
        "set_id", snap(F.greatest(F.lit(0.0), F.col("q") - excess * F.col("q") * 0.5), 6).alias("score"), snap(F.col("c"), 6).alias("avg_confidence"))


def progression_bonus(profile: Column, progress: Column, before: Column, after: Column) -> Column:
    """Reward of one energy step under a set profile."""
    d = after - before
    up = F.when(d >= 0, d * 0.2).otherwise(-0.05)
    still = lambda k, scale: F.greatest(F.lit(0.0), 1 - F.abs(d) * k) * scale
    return (
        F.when(profile == "steady", still(2, 0.1))
        .when(profile == "slow_build", F.when(d >= 0, d * 0.15 * (1 + progress)).otherwise(d * 0.1))
        .when(profile == "warmup_to_peak", F.when(progress < 0.7, up).otherwise(still(3, 0.1)))
        .when(profile == "wave", -F.abs(after - (0.5 + 0.4 * F.sin(progress * (2 * math.pi)))) * 0.1)
        .when(profile == "peak_early", F.when(progress < 0.3, up).when(d > 0, -d * 0.1).otherwise(0.05))
        .when(profile == "peak_late", F.when(progress > 0.6, up).otherwise(still(3, 0.05)))
        .when(profile == "cooldown", F.when(progress > 0.5, F.when(d > 0, -d * 0.15).otherwise(0.05)).otherwise(still(3, 0.05)))
        .otherwise(0.0)
    )


def expected_shape(profile: Column, x: Column) -> Column:
    """Ideal energy at relative position ``x`` for a profile."""
    return (
        F.when(profile == "warmup_to_peak", clip(0.3 + 0.6 * F.least(x / 0.7, F.lit(1.0))))
        .when(profile == "cooldown", clip(0.7 - 0.5 * F.greatest((x - 0.3) / 0.7, F.lit(0.0))))
        .when(profile == "wave", 0.5 + 0.3 * F.sin(x * (2 * math.pi)))
        .when(profile == "slow_build", 0.3 + 0.5 * x)
        .when(profile == "peak_early", clip(0.4 + 0.5 * F.when(x < 0.3, x / 0.3).otherwise(1.0 - (x - 0.3) / 0.7)))
        .when(profile == "peak_late", clip(0.4 + 0.5 * F.when(x < 0.6, x / 0.6 * 0.5).otherwise((x - 0.6) / 0.4)))
        .otherwise(0.5)
    )


def trajectory_score(items: DataFrame) -> DataFrame:
    """Whole-sequence score of ``set_id, pos, mean_energy, energy_profile``; 0 below three items."""
    e, n, p = F.col("mean_energy"), F.col("n"), F.col("energy_profile")
    w = by_set()
    d = items.select("set_id", "pos", "mean_energy", "energy_profile",
                     F.round(e - F.lag("mean_energy").over(w), 9).alias("d"), F.count(F.lit(1)).over(Window.partitionBy("set_id")).alias("n"))
    d = d.withColumn("flip", F.when(F.signum("d") != F.signum(F.lag("d").over(w)), 1).otherwise(0))
    at = lambda idx: F.max(F.when(F.col("pos") == idx + 1, e))
    peak70 = F.floor(n * 0.7)
    early = (F.col("pos") - 1) <= peak70
    a = d.groupBy("set_id", "energy_profile").agg(
        F.max("n").alias("n"), F.var_pop("mean_energy").alias("var"), F.min_by("mean_energy", "pos").alias("e0"), F.max_by("mean_energy", "pos").alias("e1"),
        F.max_by("d", "pos").alias("last_step"),
        (F.max_by("pos", F.struct(e, -F.col("pos"))) - 1).alias("peak"),
        F.avg(F.when(F.col("d") >= -0.02, 1.0).when(F.col("d").isNotNull(), 0.0)).alias("calm"),
        F.sum(F.least(F.col("d") + 0.08, F.lit(0.0))).alias("severe"),
        F.avg(F.when(early & (F.col("d") > 0), 1.0).when(early & F.col("d").isNotNull(), 0.0)).alias("early_up"),
        F.sum(F.when(early, F.least(F.col("d") + 0.05, F.lit(0.0)))).alias("early_drop"),
        at(F.least(peak70, n - 1)).alias("e70"), at(F.floor(n / 2)).alias("emid"), F.sum("flip").alias("flips"),
    )
    c = F.col
    flag = lambda test, v: F.when(test, v).otherwise(0.0)
    warm = (
        flag(c("peak") < F.floor(c("n") * 0.7) * 0.6, -0.25) - F.greatest(F.lit(0.0), c("e0") - 0.6) * 0.8
        + F.coalesce(c("early_up") * 0.25 + c("early_drop") * 1.5, F.lit(0.0)) + (c("e70") - c("e0")) * 0.35
    )
    score = (
        F.when(c("n") < 3, 0.0)
        .when(p == "steady", 0.15 - c("var") * 2)
        .when(p == "slow_build", c("calm") * 0.18 + (c("e1") - c("e0")) * 0.35 + c("severe") * 1.2)
        .when(p == "warmup_to_peak", warm)
        .when(p == "cooldown", flag(c("last_step") > 0.1, -0.15) - F.greatest(F.lit(0.0), 0.3 - c("e0")) * 0.2)
        .when(p == "wave", c("flips") * 0.02)
        .when(p == "peak_late", flag(c("peak") < F.floor(c("n") * 0.75) * 0.5, -0.12)
              + flag((c("n") > F.floor(c("n") / 2) + 1) & (c("e1") > c("emid")), 0.08))
        .when(p == "peak_early", flag(c("peak") > F.floor(c("n") * 0.25) * 2, -0.1))
        .otherwise(0.0)
    )
    return a.select("set_id", "energy_profile", snap(score, 6).alias("score"))


def recency_penalty(items: DataFrame) -> DataFrame:
    """Uses in the last three positions of a type and a track, earlier uses of an edge and a type."""
    w = by_set()
    last3 = w.rowsBetween(-3, -1)
    d = items.withColumn("prev", F.lag("track_id").over(w))
    seen = lambda c: F.size(F.filter(F.collect_list(c).over(last3), lambda x: x == F.col(c)))
    edge = F.row_number().over(Window.partitionBy("set_id", "prev", "track_id").orderBy("pos")) - 1
    used = F.row_number().over(Window.partitionBy("set_id", "transition_type").orderBy("pos")) - 1
    d = d.withColumn("recent_type", seen("transition_type")).withColumn("recent_track", seen("track_id"))
    d = d.withColumn("edge_uses", F.when(F.col("prev").isNotNull(), edge).otherwise(0)).withColumn("type_uses", used)
    return d.select(
        "set_id", "pos", F.col("recent_type").cast("bigint").alias("recent_type"),
        r6(F.least(F.lit(0.16), 0.055 * F.col("recent_track"))).alias("track_penalty"),
        r6(F.least(F.lit(0.14), 0.07 * F.col("edge_uses"))).alias("edge_penalty"),
        r6(F.least(F.lit(0.08), 0.025 * F.col("type_uses"))).alias("type_penalty"))


# fixed values: state path templates by style
ARC_TEMPLATES = {
    "experimental": ["INTRO", "ESTABLISH", "BUILD", "PEAK", "RELEASE", "CALLBACK", "PEAK", "OUTRO"],
    "club": ["INTRO", "ESTABLISH", "DEVELOP", "BUILD", "PEAK", "RELEASE", "PEAK", "OUTRO"],
    "story": ["INTRO", "DEVELOP", "RELEASE", "CALLBACK", "BUILD", "OUTRO"],
    "smooth": ["INTRO", "ESTABLISH", "DEVELOP", "BUILD", "RELEASE", "OUTRO"],
    "quick_mix": ["INTRO", "ESTABLISH", "BUILD", "PEAK", "RELEASE", "CALLBACK", "OUTRO"],
}


def arc_state(style: Column, i: Column, n: Column) -> Column:
    """State of position ``i`` (from 0) of ``n`` under a style's template."""
    template = lookup(style, {k: F.array(*[F.lit(x) for x in v]) for k, v in ARC_TEMPLATES.items()}, F.array(*[F.lit(x) for x in ARC_TEMPLATES["quick_mix"]]))
    size = F.size(template)
    short = F.element_at(template, (F.bround(i * (size - 1) / F.greatest(n - 1, F.lit(1))) + 1).cast("int"))
    long = (
        F.when(i == 0, "INTRO").when(i == n - 1, "OUTRO").when(i < n * 0.25, F.when(i == 1, "ESTABLISH").otherwise("DEVELOP"))
        .when(i < n * 0.55, "BUILD").when(i < n * 0.72, "PEAK").when(i < n * 0.86, "RELEASE").otherwise("CALLBACK")
    )
    return F.when(n == 1, "INTRO").when(n <= size, short).otherwise(long)


def boundary_role(state: Column, nxt: Column) -> Column:
    return (
        F.when(nxt == "BUILD", "BUILD").when(nxt == "PEAK", "REVEAL").when(nxt == "RELEASE", "RELEASE").when(nxt == "RESET", "RESET")
        .when(nxt == "CALLBACK", "CALLBACK").when(nxt == "OUTRO", "CLOSE").when(state.isin("INTRO", "ESTABLISH"), "CONTINUE")
        .when(nxt.isin("DEVELOP", "ESTABLISH"), "LIFT").otherwise("CONTINUE")
    )


def unique_in_order(items: DataFrame) -> DataFrame:
    """First occurrence of each track of a set, and its rank among first occurrences."""
    first = items.groupBy("set_id", "track_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("ord", F.row_number().over(by_set()).cast("bigint"))


def reorder(items: DataFrame, overlap: float) -> DataFrame:
    """Output times of a new order: each overlap is capped at a fifth of both neighbours.

    Starts are cumulative sums of duration minus overlap.
    """
    w = by_set()
    d = items.withColumn("prev_dur", F.lag("duration_sec").over(w))
    cut = F.when(F.col("prev_dur").isNull(), 0.0).otherwise(F.least(F.lit(overlap), F.col("prev_dur") * 0.2, F.col("duration_sec") * 0.2))
    d = d.withColumn("overlap", cut)
    start = F.sum(F.coalesce(F.col("prev_dur"), F.lit(0.0)) - F.col("overlap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("out_start", start).withColumn("out_end", F.col("out_start") + F.col("duration_sec")).drop("prev_dur")
