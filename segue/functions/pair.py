"""Compatibility of two tracks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue.functions.basic import clip, joined, lit, lookup, snap, steps, total
from segue.functions.vocab import KEY_DISTANCE_SCORES

WEIGHTS = {"tempo": 0.40, "key": 0.30, "energy": 0.20, "spectral": 0.10}


def tempo_gap(a: Column, b: Column) -> Column:
    """Smallest relative gap at equal, double and half time."""
    return F.least(
        F.abs(a - b) / F.greatest(a, F.lit(1.0)),
        F.abs(a * 2 - b) / F.greatest(a * 2, F.lit(1.0)),
        F.abs(a - b * 2) / F.greatest(b * 2, F.lit(1.0)),
    )


def tempo_from_gap(d: Column) -> Column:
    return steps(d, [
        ("<=", 0.02, 1.0),
        ("<=", 0.05, 0.9),
        ("<=", 0.08, 0.9 - (d - 0.05) * (0.4 / 0.03)),
        ("<=", 0.15, 0.5 - (d - 0.08) * (0.4 / 0.07)),
    ], F.greatest(F.lit(0.05), 0.1 - (d - 0.15) * 0.5))


def tempo_score(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0.5).otherwise(tempo_from_gap(tempo_gap(a, b)))


def wheel_hour(code: Column) -> Column:
    """Number part of a wheel code; 0 when the code is too short or malformed."""
    return F.coalesce(F.substring(code, F.lit(1), F.length(code) - 1).try_cast("int"), F.lit(0))


def wheel_mode(code: Column) -> Column:
    return F.when(F.length(code) >= 2, F.substring(code, -1, 1)).otherwise("")


def _hour_distance(i: int, j: int) -> int:
    """Wheel distance of two of the 24 positions (two modes per hour)."""
    gap = abs(i // 2 - j // 2)
    hour, same = min(gap, 12 - gap), i % 2 == j % 2
    near = {0: (0, 1), 1: (1, 2), 2: (3, 3), 3: (4, 4)}
    return near[hour][0 if same else 1] if hour in near else min(hour, 6)


_DISTANCES = [_hour_distance(i, j) for i in range(24) for j in range(24)]


def wheel_index(code: Column) -> Column:
    """Position 0..23 on the wheel, null for anything that is not a wheel code."""
    h, m = wheel_hour(code), wheel_mode(code)
    return F.when(h.between(1, 12) & m.isin("A", "B"), (h - 1) * 2 + F.when(m == "B", 1).otherwise(0))


def _cell(c1: Column, c2: Column) -> Column:
    """Position in the 24 x 24 tables; the extra last cell stands for unknown codes."""
    return F.coalesce(wheel_index(c1) * 24 + wheel_index(c2) + 1, F.lit(len(_DISTANCES) + 1))


def wheel_distance(c1: Column, c2: Column) -> Column:
    """Distance 0..6 by one lookup in a constant 24 x 24 table; unknown codes are 6 apart."""
    return F.element_at(F.array(*[F.lit(d) for d in [*_DISTANCES, 6]]), _cell(c1, c2))


def key_score(c1: Column, c2: Column) -> Column:
    blank = (F.coalesce(c1, F.lit("")) == "") | (F.coalesce(c2, F.lit("")) == "")
    scores = F.array(*[F.lit(KEY_DISTANCE_SCORES[d]) for d in [*_DISTANCES, 6]])
    return F.when(blank, 0.5).otherwise(F.element_at(scores, _cell(c1, c2)))


def key_position(code: Column) -> Column:
    """Wheel position 0..23; 24 for unknown codes, 25 for blank ones."""
    return F.when(F.coalesce(code, F.lit("")) == "", 25).otherwise(F.coalesce(wheel_index(code), F.lit(24)))


def _position_score(i: int, j: int) -> float:
    if 25 in (i, j):
        return 0.5
    return 0.05 if 24 in (i, j) else KEY_DISTANCE_SCORES[_hour_distance(i, j)]


def key_score_at(i: Column, j: Column) -> Column:
    """Key score of two ``key_position`` values by one lookup."""
    return F.element_at(F.array(*[F.lit(_position_score(x, y)) for x in range(26) for y in range(26)]), i * 26 + j + 1)


def energy_score(e1: Column, e2: Column) -> Column:
    d = F.abs(e1 - e2)
    return F.when((e1 <= 0) & (e2 <= 0), 0.8).otherwise(
        steps(d, [("<", 0.1, 1.0), ("<", 0.2, 0.85), ("<", 0.3, 0.7), ("<", 0.5, 0.5)],
              F.greatest(F.lit(0.2), 1.0 - d))
    )


def spectral_score(s1: Column, s2: Column) -> Column:
    r = F.least(s1, s2) / F.greatest(s1, s2)
    return F.when((s1 <= 0) | (s2 <= 0), 0.5).otherwise(
        steps(r, [(">", 0.85, 1.0), (">", 0.7, 0.8), (">", 0.5, 0.6)], F.greatest(F.lit(0.2), r))
    )


def vocal_overlap_score(product: Column, overlap: Column) -> Column:
    """Step score of the product of both vocal fractions."""
    return F.when(overlap <= 0, 1.0).otherwise(
        steps(product, [(">", 0.5, 0.3), (">", 0.25, 0.6), (">", 0.1, 0.8)], 1.0)
    )


def vocal_safety(mid1: Column, mid2: Column, overlap_score: Column | None = None) -> Column:
    """Mid-band heuristic, blended with the measured overlap score where there is one."""
    n = (mid1 > 0.5).cast("int") + (mid2 > 0.5).cast("int")
    base = lookup(n, {2: 0.6, 1: 0.75}, 0.9)
    if overlap_score is None:
        return base
    return F.coalesce(0.4 * base + 0.6 * overlap_score, base)


def acoustic_score(tempo: Column, key: Column, energy: Column, spectral: Column,
                   weights: dict[str, float] | None = None) -> Column:
    w = weights or WEIGHTS
    parts = {"tempo": tempo, "key": key, "energy": energy, "spectral": spectral}
    return total([w[n] * c for n, c in parts.items()]) / sum(w.values())


def overall_score(acoustic: Column, semantic: Column | None = None, semantic_conf: Column | None = None,
                  lyric: Column | None = None, lyric_conf: Column | None = None) -> Column:
    """Acoustic score softened by evidence; null evidence columns mean "none"."""
    if semantic is None and lyric is None:
        return snap(acoustic)
    semantic, semantic_conf = lit(semantic), lit(semantic_conf)
    lyric_value, lyric_rel = F.coalesce(lit(lyric), F.lit(0.0)), F.coalesce(lit(lyric_conf), F.lit(0.0))
    sw = 0.10 * clip(semantic_conf)
    lw = 0.08 * clip(lyric_rel)
    both = F.least(F.lit(0.18), sw + lw)
    mixed = (1 - both) * acoustic + both * (sw * semantic + lw * lyric_value) / F.greatest(both, F.lit(1e-9))
    alone = 0.08 * lyric_rel
    return snap(
        F.when(semantic.isNotNull(), mixed)
        .when(lit(lyric).isNotNull(), (1 - alone) * acoustic + alone * lyric_value)
        .otherwise(acoustic)
    )


def relative_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, F.lit(1.0))


def type_score(base: Column, kind: Column, a_bpm: Column, b_bpm: Column, overlap: Column,
               a_low: Column, b_low: Column) -> Column:
    """Base score times the suitability of one transition type."""
    d = relative_gap(a_bpm, b_bpm)
    mod = (
        F.when(kind == "beatmatched_blend",
               steps(d, [(">", 0.08, 0.3), (">", 0.05, 0.7)], 1.0) * F.when(overlap < 4.0, 0.5).otherwise(1.0))
        .when(kind == "phrase_cut", F.when(d < 0.02, 0.8).otherwise(1.0))
        .when(kind == "crossfade", F.when(d > 0.10, 0.6).otherwise(1.0))
        .when(kind == "bass_swap",
              F.when(d > 0.05, 0.5).otherwise(1.0) * F.when((a_low > 0.4) & (b_low > 0.4), 0.7).otherwise(1.0))
        .when(kind == "filter_sweep", F.when(overlap < 3.0, 0.6).otherwise(1.0))
        .when(kind == "echo_out", F.when(d > 0.08, 1.1).otherwise(1.0))
        .when(kind == "loop_blend", F.when(d > 0.06, 0.5).otherwise(1.0))
        .otherwise(1.0)
    )
    return snap(clip(base * mod))


def type_context(kind: Column, c: dict[str, Column]) -> Column:
    """Contextual multiplier of a type.

    ``c`` holds: delta (energy change), gap (relative tempo gap), a_section, b_section,
    a_low, b_low, a_phrases, b_phrases, a_vocals, b_vocals, a_stems, b_stems.
    """
    rising, falling, similar = c["delta"] > 0.1, c["delta"] < -0.1, F.abs(c["delta"]) <= 0.1
    verses = (c["a_section"] == "verse") & (c["b_section"] == "verse")
    chorus = c["b_section"] == "chorus"
    stems, vocals = c["a_stems"] & c["b_stems"], c["a_vocals"] & c["b_vocals"]

    def boost(*rules):
        out = F.lit(1.0)
        for test, factor in rules:
            out = out * F.when(test, F.lit(factor)).otherwise(F.lit(1.0))
        return out

    return (
        F.when(kind == "beatmatched_blend", boost((similar, 1.2), (verses, 1.1)))
        .when(kind == "bass_swap",
              boost((rising, 1.2), (chorus, 1.15), ((c["a_low"] > 0.45) & (c["b_low"] > 0.45), 0.6), (vocals, 1.1)))
        .when(kind == "filter_sweep", boost((rising & chorus, 1.3), (verses, 1.1)))
        .when(kind == "echo_out", boost((falling, 1.2), (c["a_section"] == "outro", 1.3), (c["gap"] > 0.10, 1.15)))
        .when(kind == "phrase_cut",
              boost((c["a_section"] != c["b_section"], 1.1), ((c["a_phrases"] > 3) & (c["b_phrases"] > 3), 1.1), (vocals, 1.1)))
        .when(kind == "crossfade", boost(((c["gap"] < 0.05) & similar, 0.85), (vocals, 0.8)))
        .when(kind == "loop_blend", boost((similar & (c["a_section"] == "verse"), 1.15), (vocals, 0.75)))
        .when(kind == "mashup",
              F.when(stems, boost((stems, 1.4), (vocals, 1.2), (F.abs(c["delta"]) > 0.15, 1.1))).otherwise(0.3))
        .otherwise(1.0)
    )


def preference_bonus(liked: Column, disliked: Column, in_bpm: Column, in_energy: Column,
                     liked_type: Column, disliked_type: Column) -> Column:
    """Bounded taste bonus; ``in_bpm`` and ``in_energy`` are null when no range is set."""
    flag = lambda test, yes: F.when(test, F.lit(yes)).otherwise(F.lit(0.0))
    ranged = lambda test, yes, no: F.when(test.isNull(), 0.0).when(test, yes).otherwise(no)
    raw = (
        flag(liked, 0.08) - flag(disliked, 0.12) + ranged(in_bpm, 0.05, -0.03)
        + ranged(in_energy, 0.05, -0.02) + flag(liked_type, 0.04) - flag(disliked_type, 0.06)
    )
    return clip(raw, -0.15, 0.15)


def reason_text(tempo, key, energy, a_bpm, b_bpm, a_code, b_code, a_energy, b_energy,
                mood=None, activity=None, theme=None) -> Column:
    """Human-readable fragments for a pair score."""
    num = lambda c: F.round(c).cast("bigint").cast("string")
    bpms = F.concat(F.lit(" BPM ("), num(a_bpm), F.lit(" vs "), num(b_bpm), F.lit(")"))
    gap = F.concat(F.lit(" BPM gap ("), num(a_bpm), F.lit(" vs "), num(b_bpm), F.lit(")"))
    keys = F.concat(F.lit(" ("), a_code, F.lit(" -> "), b_code, F.lit(")"))
    parts = [
        steps(tempo, [(">", 0.9, F.concat(F.lit("very close"), bpms)), (">", 0.7, F.concat(F.lit("compatible"), bpms)),
                      (">", 0.4, F.concat(F.lit("moderate"), gap))], F.concat(F.lit("large"), gap)),
        F.when(key >= 0.9, F.concat(F.lit("harmonically ideal"), keys))
        .when(key >= 0.7, F.concat(F.lit("harmonically compatible"), keys))
        .when(key < 0.3, F.concat(F.lit("key clash risk"), keys)),
        F.when(energy > 0.8, "similar energy")
        .when((energy < 0.4) & (b_energy > a_energy), "energy rise")
        .when(energy < 0.4, "energy drop"),
    ]
    if mood is not None:
        parts.append(F.when(mood >= 0.7, "continuous mood").when(mood < 0.4, "contrasting mood"))
    if activity is not None:
        parts.append(F.when(activity >= 0.7, "compatible activity"))
    if theme is not None:
        parts.append(F.when(theme >= 0.5, "shared lyrical themes").when(theme < 0.2, "contrasting lyrical themes"))
    return joined(*parts)
