"""Vectors and label maps as array and map expressions (no Python in the row path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue.functions.basic import array_sum, clip, lookup
from segue.functions.vocab import KEY_CODES, MAJOR_PROFILE, MINOR_PROFILE, PITCHES


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; 0.5 for empty, unequal or zero vectors."""
    n = norm(a) * norm(b)
    known = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (n > 0)
    return F.when(known, clip((dot(a, b) / n + 1) / 2)).otherwise(0.5)


def softmax(a: Column, sharpness: float = 3.0) -> Column:
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) * sharpness))
    return F.transform(e, lambda x: x / F.greatest(array_sum(e), F.lit(1e-12)))


def normalise(a: Column) -> Column:
    """Non-negative vector over its sum; uniform when the sum vanishes, NaN counts as 0."""
    pos = F.transform(a, lambda x: F.greatest(F.lit(0.0), F.when(F.isnan(x), 0.0).otherwise(x)))
    s = array_sum(pos)
    return F.transform(pos, lambda x: F.when(s <= 1e-9, F.lit(1.0) / F.greatest(F.size(a), F.lit(1))).otherwise(x / s))


def map_similarity(a: Column, b: Column) -> Column:
    """1 minus the mean absolute difference over the union of keys; 0.5 when both are empty."""
    gaps = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))))
    return F.when(F.size(gaps) > 0, clip(1 - array_sum(gaps) / F.size(gaps))).otherwise(0.5)


def _present(scores: Column, labels: Column) -> Column:
    return F.filter(F.transform(labels, lambda k: F.try_element_at(scores, k)), lambda v: v.isNotNull())


def _mean(a: Column, default: float) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a)).otherwise(default)


def intent_match(scores: Column, wanted: Column, avoided: Column) -> Column:
    """0.5 + half the mean wanted score - 0.35 x the mean avoided score, over present labels."""
    w, a = _present(scores, wanted), _present(scores, avoided)
    return F.when((F.size(w) == 0) & (F.size(a) == 0), 0.5).otherwise(clip(0.5 + 0.5 * _mean(w, 0.5) - 0.35 * _mean(a, 0.0)))


def map_match(scores: Column, wanted: Column, avoided: Column) -> Column:
    """Best wanted score minus 0.45 x the worst avoided score; 0.5 when nothing is asked."""
    best = lambda labels: F.coalesce(F.array_max(_present(scores, labels)), F.lit(0.0))
    return F.when((F.size(wanted) == 0) & (F.size(avoided) == 0), 0.5).otherwise(clip(best(wanted) - 0.45 * best(avoided)))


def label_match(available: Column, wanted: Column, primary: Column | None = None) -> Column:
    """0.85 to 1 by the number of hits, 1 when a primary label is hit, 0 without hits, 0.5 when nothing is asked."""
    want = F.array_distinct(wanted)
    hits = F.array_intersect(want, available)
    n, m = F.size(hits), F.size(want)
    graded = 0.85 + 0.15 * F.least(F.lit(1.0), (n - 1) / F.greatest(m - 1, F.lit(1)))
    if primary is not None:
        graded = F.when(F.arrays_overlap(hits, primary), 1.0).otherwise(graded)
    return F.when(m == 0, 0.5).when(n == 0, 0.0).otherwise(clip(graded))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def entropy(values: Column) -> Column:
    """Normalised entropy of a score array; 1 for at most one label or a zero total."""
    v = F.transform(values, lambda x: F.greatest(x, F.lit(0.0)))
    s = array_sum(v)
    h = -array_sum(F.transform(v, lambda x: F.when(x > 0, x / s * F.ln(x / s)).otherwise(0.0)))
    return F.when((F.size(values) <= 1) | (s <= 0), 1.0).otherwise(clip(h / F.ln(F.size(values))))


def one_hot_wheel(hour: Column, mode: Column) -> Column:
    """Twelve bins with the pitch of a wheel code set; uniform for unknown codes."""
    pitch = ((hour - 1) * 7 + F.when(mode == "B", 3).otherwise(0)) % 12
    bins = F.sequence(F.lit(0), F.lit(11))
    return F.transform(bins, lambda i: F.when(hour == 0, F.lit(1 / 12)).when(i == pitch, 1.0).otherwise(0.0))


def _rotations():
    for i, name in enumerate(PITCHES):
        for mode, profile in (("Major", MAJOR_PROFILE), ("Minor", MINOR_PROFILE)):
            m = sum(profile) / 12
            centred = [p - m for p in profile]
            size = math.sqrt(sum(p * p for p in centred))
            yield f"{name} {mode}", [centred[(j - i) % 12] / size for j in range(12)]


def best_key(chroma: Column) -> Column:
    """Struct ``(r, order, name)`` of the key profile that correlates best with a 12-vector.

    Profiles are centred to unit length, so Pearson r is one dot product over the
    deviation of the vector; a flat vector gives null.
    """
    mean = array_sum(chroma) / 12
    spread = F.sqrt(array_sum(F.transform(chroma, lambda x: (x - mean) * (x - mean))))
    options = F.array(*[
        F.struct(F.round(array_sum(F.zip_with(chroma, F.array(*[F.lit(w) for w in vec]), lambda x, w: x * w)) / spread, 9).alias("r"),
                 F.lit(-k).alias("order"), F.lit(name).alias("name"))
        for k, (name, vec) in enumerate(_rotations())
    ])
    return F.when((array_sum(chroma) > 1e-10) & (spread > 1e-10), F.array_max(options))


def key_code(name: Column) -> Column:
    return F.coalesce(lookup(name, KEY_CODES), F.lit(""))
