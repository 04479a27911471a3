"""Quality of one handoff (exit, entry, overlap, type) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue.functions.basic import clip, lookup

# fixed values: component weights and their changes by style, vocals and profile
WEIGHTS = {"phrase": 1.4, "bar": 0.7, "tempo": 1.0, "harmonic": 0.8, "energy": 1.3, "loudness": 1.2, "bass": 0.9, "vocal": 1.0,
           "structure": 1.1, "style": 1.0, "playtime": 1.0, "landing": 1.4, "floor": 1.4}
SMOOTH_WEIGHTS = {"energy": 1.7, "loudness": 1.6, "harmonic": 1.1, "bass": 1.2, "vocal": 2.0, "floor": 2.0}
ENERGETIC_WEIGHTS = {"phrase": 1.7, "landing": 1.7, "style": 1.4, "floor": 1.6}
WARMUP_WEIGHTS = {"energy": 2.0, "landing": 1.8}


def local_rms(lufs: Column, relative: Column, mean_energy: Column) -> Column:
    """Within-track shape on top of a loudness anchor."""
    return F.greatest(F.lit(1e-6), F.pow(F.lit(10.0), lufs / 20) * relative / F.greatest(mean_energy, F.lit(0.05)))


def pair_gain(a_lufs: Column, b_lufs: Column) -> tuple[Column, Column]:
    middle = (a_lufs + b_lufs) / 2
    return clip(middle - a_lufs, -4.0, 4.0), clip(middle - b_lufs, -4.0, 4.0)


def ratio_db(value: Column, reference: Column) -> Column:
    return 20 * F.log10(F.greatest(value, F.lit(1e-6)) / F.greatest(reference, F.lit(1e-6)))


def energy_continuity(delta_db: Column, profile: Column, style: Column) -> Column:
    rising = profile.isin("slow_build", "warmup_to_peak")
    lifted = (
        F.when(delta_db < -0.75, F.greatest(F.lit(0.0), 1 - F.abs(delta_db + 0.75) / 5))
        .when(delta_db <= 2.5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (delta_db - 2.5) / 5))
    )
    return F.when(rising, lifted).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(delta_db) / F.when(style == "energetic", 5.0).otherwise(3.5)))


def landing_score(to_landing_db: Column, entry_to_landing_db: Column, profile: Column) -> Column:
    drop = F.when((to_landing_db < -2.0) & (profile != "cooldown"), F.greatest(F.lit(0.0), 1 - F.abs(to_landing_db + 2) / 6)).otherwise(1.0)
    sag = F.when(entry_to_landing_db < -2.5, F.greatest(F.lit(0.35), 1 - F.abs(entry_to_landing_db + 2.5) / 8)).otherwise(1.0)
    return clip(drop * sag)


def bass_handoff(a_bass: Column, b_bass: Column, kind: Column) -> tuple[Column, Column]:
    a, b = a_bass >= 0.25, b_bass >= 0.25
    score = F.when(a & b, F.when(kind.isin("bass_swap", "filter_sweep", "crossfade"), 0.9).otherwise(0.55)).when(a | b, 0.85).otherwise(0.45)
    mode = F.when(a & b, "source_to_target").when(a, "source_dominant").when(b, "target_dominant").otherwise("low_bass_transition")
    return score, mode


def style_fit(c: dict[str, Column]) -> Column:
    """Fit of a type. ``c``: kind, style, phrase, tempo, delta_db, landing, a_bass, b_bass, a_vocal, b_vocal, a_section, bpm_conf, stems."""
    kind, style, ph, te, la = c["kind"], c["style"], c["phrase"], c["tempo"], c["landing"]
    smooth = style == "smooth"
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    mul = lambda test, x: F.when(test, x).otherwise(1.0)
    base = (
        F.when(kind == "crossfade", 0.75 + 0.20 * F.least(te, la) + add(smooth, 0.05))
        .when(kind == "beatmatched_blend", (0.55 * te + 0.25 * ph + 0.20 * la) * mul(c["bpm_conf"] < 0.6, 0.65))
        .when(kind == "bass_swap", (0.45 * te + 0.25 * ph + 0.30 * la + add((c["a_bass"] >= 0.25) & (c["b_bass"] >= 0.25), 0.12)) * mul(style != "energetic", 0.75))
        .when(kind == "filter_sweep", 0.35 * ph + 0.30 * la + 0.20 * te + 0.15 + add(smooth, 0.05))
        .when(kind == "phrase_cut", (0.55 * ph + 0.35 * la + 0.10 * te) * mul(smooth, 0.55) + add((style == "energetic") & (c["delta_db"] >= -1.0), 0.08))
        .when(kind == "echo_out", (0.55 * ph + 0.25 * la + 0.20) * mul((c["a_section"] != "outro") | (c["a_vocal"] > 0.35), 0.55))
        .when(kind == "loop_blend", (0.40 * ph + 0.30 * te + 0.30 * la) * mul((c["a_vocal"] > 0.2) | (style != "varied"), 0.4))
        .when(kind == "mashup", F.when(c["stems"], 0.8).otherwise(0.1))
        .otherwise(0.5)
    )
    clash = (c["a_vocal"] > 0.5) & (c["b_vocal"] > 0.5) & ~kind.isin("phrase_cut", "mashup")
    return clip(base * mul(clash, 0.7))


def playtime_score(body: Column, minimum: Column, preferred: Column, maximum: Column) -> Column:
    one = lambda x: F.greatest(x, F.lit(1.0))
    return (
        F.when(body < minimum, F.greatest(F.lit(0.0), body / one(minimum)) * 0.5)
        .when(body <= preferred, 0.5 + 0.5 * (body - minimum) / one(preferred - minimum))
        .when(body <= maximum, 1.0 - 0.25 * (body - preferred) / one(maximum - preferred))
        .otherwise(F.greatest(F.lit(0.2), 0.75 - (body - maximum) / one(maximum)))
    )


def weighted(components: dict[str, Column], style: Column, vocals: Column, profile: Column) -> Column:
    """Weighted mean of the thirteen components under the request's style, vocals and profile."""
    num, den = None, None
    for name, value in components.items():
        w = F.lit(WEIGHTS[name])
        if name in SMOOTH_WEIGHTS:
            w = F.when(style == "smooth", SMOOTH_WEIGHTS[name]).otherwise(w)
        if name in ENERGETIC_WEIGHTS:
            w = F.when(style == "energetic", ENERGETIC_WEIGHTS[name]).otherwise(w)
        if name in WARMUP_WEIGHTS:
            w = F.when(profile == "warmup_to_peak", WARMUP_WEIGHTS[name]).otherwise(w)
        if name == "vocal":
            w = F.when(vocals == "vocal_safe", 3.0).otherwise(w)
        num = w * value if num is None else num + w * value
        den = w if den is None else den + w
    return num / den


def confidence(mean_of_six: Column, phrase: Column, overall: Column) -> Column:
    return clip(0.55 * mean_of_six + 0.25 * phrase + 0.20 * overall)


def trough_db(progress: Column, a_db: Column, b_db: Column, a_anchor: Column, b_anchor: Column, kind: Column) -> Column:
    """How far the predicted sum of both tracks falls below the expected level at one instant."""
    cut = kind == "phrase_cut"
    ga = F.when(cut, 0.0).otherwise(F.cos(progress * (math.pi / 2)))
    gb = F.when(cut, 1.0).otherwise(F.sin(progress * (math.pi / 2)))
    power = F.pow(ga, F.lit(2.0)) * F.pow(F.lit(10.0), a_db / 10) + F.pow(gb, F.lit(2.0)) * F.pow(F.lit(10.0), b_db / 10)
    return a_anchor * (1 - progress) + b_anchor * progress - 10 * F.log10(F.greatest(power, F.lit(1e-12)))


def floor_score(worst_db: Column) -> Column:
    return clip(1 - F.greatest(F.lit(0.0), worst_db - 1.5) / 7.5)


# fixed values: bar counts tried per type
LENGTHS = {"phrase_cut": [4], "echo_out": [4], "loop_blend": [4, 8], "bass_swap": [4, 8], "mashup": [4, 8]}


def length_options(kind: Column, low: Column, high: Column) -> Column:
    """Bar counts of a type inside the limits; the limit itself (4 to 8) when none fits."""
    table = {k: F.array(*[F.lit(x) for x in v]) for k, v in LENGTHS.items()}
    wanted = lookup(kind, table, F.array(F.lit(8), F.lit(12), F.lit(16)))
    fit = F.filter(wanted, lambda b: (b <= high) & (b >= F.least(low, F.lit(8))))
    return F.when(F.size(fit) > 0, fit).otherwise(F.array(F.greatest(F.lit(4), F.least(high, F.lit(8)))))


def layer_score(tempo: Column, key: Column, phrase: Column, vocal: Column, instrumental: Column, energy: Column, local: Column) -> Column:
    base = 0.24 * tempo + 0.24 * key + 0.18 * phrase + 0.14 * vocal + 0.12 * instrumental + 0.08 * energy
    return 0.85 * base + 0.15 * local


def layer_tempo(a: Column, b: Column) -> Column:
    d = F.abs(a - b) / F.greatest(a, b)
    return F.when((a <= 0) | (b <= 0), 0.5).when(d <= 0.015, 1.0).when(d <= 0.04, 0.9).when(d <= 0.08, 0.7).otherwise(F.greatest(F.lit(0.0), 0.35 - d))


# fixed values: weights of the eight local similarities by style
LOCAL_WEIGHTS = {
    "smooth": [0.20, 0.18, 0.18, 0.12, 0.14, 0.10, 0.05, 0.03],
    "club": [0.18, 0.24, 0.14, 0.08, 0.08, 0.20, 0.05, 0.03],
    "quick_mix": [0.15, 0.22, 0.18, 0.10, 0.12, 0.12, 0.08, 0.03],
    "story": [0.15, 0.12, 0.18, 0.15, 0.10, 0.05, 0.18, 0.07],
    "experimental": [0.12, 0.16, 0.12, 0.08, 0.10, 0.10, 0.08, 0.04],
    "other": [0.17, 0.18, 0.17, 0.10, 0.12, 0.12, 0.08, 0.06],
}


def local_score(values: list[Column], conf: Column, style: Column) -> Column:
    """Weighted local similarities, scaled down where the evidence is thin."""
    weights = lookup(style, {k: F.array(*[F.lit(x) for x in v]) for k, v in LOCAL_WEIGHTS.items()}, F.array(*[F.lit(x) for x in LOCAL_WEIGHTS["other"]]))
    total = None
    for i, v in enumerate(values):
        part = v * F.element_at(weights, i + 1)
        total = part if total is None else total + part
    return clip(total * (0.65 + 0.35 * conf))
