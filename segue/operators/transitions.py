"""Full-context scores of handoff candidates.

Every candidate meets the prefix sums of both tracks' curves (bounded by track
length), so a window mean is two array lookups and no candidate is ever joined
with curve rows. Prefix sums stay inside the task that joins them: what a later
shuffle needs of one side are its means and the piece of a curve that the blend covers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import transition as Q
from segue.functions.basic import clip
from segue.functions.pair import key_score, tempo_score
from segue.operators.sets import structure_fit


def curve_prefix(curve: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Per track: number of points and, per value, the running sums ``[0, v0, v0+v1, ...]``."""
    rows = F.array_sort(F.collect_list(F.struct("t", *[v.alias(n) for n, v in values.items()])))
    a = curve.groupBy("track_id").agg(rows.alias("r"))

    def sums(name: str) -> Column:
        start = F.array(F.lit(0.0))
        return F.aggregate("r", start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x[name])))

    return a.select("track_id", F.size("r").alias("n"), *[sums(n).alias(f"p_{n}") for n in values])


def window_mean(prefix: Column, n: Column, start: Column, end: Column, duration: Column, fallback: Column, at: Column | int = 0) -> Column:
    """Mean of a curve over a time window by share of the duration; the fallback without curve or window.

    ``at`` is the place of the first sum that ``prefix`` holds.
    """
    first = F.greatest(F.lit(0), F.least(n - 1, F.floor(start / duration * n))).cast("int")
    last = F.greatest(first + 1, F.least(n, F.ceil(end / duration * n))).cast("int")
    mean = (F.element_at(prefix, last + 1 - at) - F.element_at(prefix, first + 1 - at)) / (last - first)
    return F.when(n.isNull() | (end <= start), fallback).otherwise(mean)


def piece(d: DataFrame, side: str, start: Column, end: Column) -> DataFrame:
    """``d`` with one side's prefix sums cut to what windows between ``start`` and ``end`` read, and their place ``{side}_at``."""
    n, duration = F.col(f"{side}_n"), F.col(f"{side}_duration_sec")
    first = F.greatest(F.lit(0), F.least(n - 1, F.floor(start / duration * n))).cast("int")
    last = F.least(n, F.greatest(first + 1, F.ceil(end / duration * n)) + 1).cast("int")
    sums = [x for x in d.columns if x.startswith(f"{side}_p_")]
    return d.select(*[x for x in d.columns if x not in sums], first.alias(f"{side}_at"), *[F.slice(x, first + 1, last - first + 1).alias(x) for x in sums])


def share_of(regions: Column, start: Column, length: Column) -> Column:
    """Summed overlap of a window with an array of regions (``s``, ``e``) as a share of its length, at most 1."""
    part = lambda r: F.greatest(F.lit(0.0), F.least(start + length, r["e"]) - F.greatest(start, r["s"]))
    got = F.aggregate(regions, F.lit(0.0), lambda acc, r: acc + part(r))
    return F.when(length > 0, F.least(F.lit(1.0), F.coalesce(got, F.lit(0.0)) / length)).otherwise(0.0)


def consumed() -> Column:
    """Seconds of the target that a blend uses: a beatmatched one is stretched."""
    f = F.col
    stretch = (f("kind") == "beatmatched_blend") & (F.abs(f("a_bpm") - f("b_bpm")) > 0.5)
    return F.when(stretch, f("overlap") * f("a_bpm") / f("b_bpm")).otherwise(f("overlap"))


def _mean(d: DataFrame, side: str):
    f, at = F.col, F.col(f"{side}_at") if f"{side}_at" in d.columns else 0
    return lambda p, s, e, fb: window_mean(f(f"{side}_p_{p}"), f(f"{side}_n"), s, e, f(f"{side}_duration_sec"), fb, at)


def leaving(d: DataFrame) -> list[Column]:
    """Means of the source's curve before and during the blend."""
    f, a, la = F.col, _mean(d, "a"), F.col("a_integrated_lufs")
    return [a("energy", f("exit_t") - 8, f("exit_t"), f("a_mean_energy")).alias("_ea"), (a("loud", f("exit_t") - 8, f("exit_t"), la) - la).alias("_la"),
            a("bass", f("exit_t"), f("exit_t") + f("overlap"), f("a_low_energy")).alias("a_bass")]


def entering(d: DataFrame) -> list[Column]:
    """Means of the target's curve during and after the blend."""
    f, b, lb = F.col, _mean(d, "b"), F.col("b_integrated_lufs")
    resume = f("entry_t") + f("consumed")
    return [b("energy", f("entry_t"), f("entry_t") + F.least(F.lit(8.0), f("consumed")), f("b_mean_energy")).alias("_eb"),
            b("energy", resume, resume + 10, f("b_mean_energy")).alias("_el"), (b("loud", resume, resume + 10, lb) - lb).alias("_lb"),
            b("bass", f("entry_t"), f("entry_t") + f("consumed"), f("b_low_energy")).alias("b_bass")]


def grid_alignment(time: Column, bpm: Column, duration: Column) -> tuple[Column, Column]:
    """Index of the nearest bar of a regular grid (earlier on a tie) and the alignment score."""
    step = 240 / bpm
    last = F.ceil(duration / step) - 1
    idx = F.greatest(F.lit(0), F.least(last, F.ceil(F.round(time / step - 0.5, 9))))
    error = F.abs(time - idx * step) * 1000
    return idx, F.greatest(F.lit(0.0), 1 - error / (F.greatest(F.lit(40.0), 60000 / bpm * 0.2) * 4))


def grouped_phrase(idx: Column, bar_score: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(idx % 8, 8 - idx % 8) / 4) * bar_score


def _worst_trough():
    """Column function: how far the sum of both tracks falls below the expected level at most, over windows of two seconds of
    the blend (``transition.trough_db``). All windows of a batch are worked out at once."""

    def real(x: pa.Array) -> np.ndarray:
        return x.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def worst(kind, exit_t, overlap, entry_t, consumed, la, lb, an, ad, al, bn, bd, bl, wa, pa_, wb, pb):
        overlap, cut = real(overlap), np.array([k == "phrase_cut" for k in kind.to_pylist()], bool)
        windows = np.fmax(4.0, np.ceil(overlap / 2)).astype(np.int64)
        start = np.cumsum(windows) - windows
        row = np.repeat(np.arange(len(windows)), windows)
        p = (np.arange(len(row)) - start[row] + 0.5) / windows[row]

        def level(sums, first, n, duration, at, length, anchor):
            """Mean level of each window less the track's own."""
            many = pa.compute.fill_null(pa.compute.list_value_length(sums), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            off, values = np.cumsum(many) - many, sums.flatten().to_numpy(zero_copy_only=False)
            n, duration, anchor = real(n)[row], real(duration)[row], real(anchor)[row]
            x = real(at)[row] + p * length[row]
            low = np.fmax(0.0, np.minimum(n - 1, np.floor((x - 1) / duration * n)))
            last = np.maximum(low + 1, np.minimum(n, np.ceil((x + 1) / duration * n)))
            ok = np.isfinite(low) & np.isfinite(last) & (many[row] > 0)
            i = (off - np.nan_to_num(real(first)).astype(np.int64))[row[ok]]
            out = np.zeros(len(row))
            out[ok] = (values[i + last[ok].astype(np.int64)] - values[i + low[ok].astype(np.int64)]) / (last[ok] - low[ok]) - anchor[ok]
            return out

        with np.errstate(all="ignore"):
            da, db = level(pa_, wa, an, ad, exit_t, overlap, al), level(pb, wb, bn, bd, entry_t, real(consumed), bl)
            cuts = cut[row]
            a, b = np.where(cuts, 0.0, np.cos(p * (math.pi / 2))), np.where(cuts, 1.0, np.sin(p * (math.pi / 2)))
            power = a**2 * 10.0 ** (da / 10) + b**2 * 10.0 ** (db / 10)
            fall = real(la)[row] * (1 - p) + real(lb)[row] * p - 10 * np.log10(np.fmax(power, 1e-12))
            most = np.fmax(0.0, np.fmax.reduceat(fall, start)) if len(fall) else fall
        return pa.array(most, pa.float64())

    return F.arrow_udf(worst, "double")


def quality(c: DataFrame, floor: bool = True) -> DataFrame:
    """Thirteen components, weighted overall score, confidence and handoff facts of each candidate.

    Expects ``a_``/``b_`` track features and prefix sums (``n``, ``p_energy``, ``p_loud``, ``p_bass``),
    ``exit_t, entry_t, overlap, kind, style, vocals, profile, cursor, a_vocal, b_vocal, a_section,
    b_section, confidence6, stems``. Prefix sums may be pieces (``piece``), and either side's means may be there
    already (``leaving``, ``entering``), as may ``consumed``. Without ``floor`` the trough counts as 0, which bounds the scores from above.
    """
    f = F.col
    keep = [x for x in c.columns if not x.startswith(("a_p_", "b_p_")) and x != "consumed"]
    d = c if "consumed" in c.columns else c.withColumn("consumed", consumed())
    la, lb = f("a_integrated_lufs"), f("b_integrated_lufs")

    def blend(side: str, start: Column, length: Column) -> list[Column]:
        """Prefix sums of loudness under the blend alone, and the place of the first."""
        p, n, duration = f(f"{side}_p_loud"), f(f"{side}_n"), f(f"{side}_duration_sec")
        if not floor:
            return [F.lit(0).alias(f"_w{side}"), F.lit(0).alias(f"_p{side}")]
        first = F.greatest(F.lit(0), F.least(n - 1, F.floor((start - 1) / duration * n))).cast("int")
        last = F.greatest(first + 1, F.least(n, F.ceil((start + length + 1) / duration * n))).cast("int")
        return [first.alias(f"_w{side}"), F.slice(p, first + 1 - (f(f"{side}_at") if f"{side}_at" in keep else 0), last - first + 2).alias(f"_p{side}")]

    ia, sa = grid_alignment(f("exit_t"), f("a_bpm"), f("a_duration_sec"))
    ib, sb = grid_alignment(f("entry_t"), f("b_bpm"), f("b_duration_sec"))
    d = d.select(
        *keep, "consumed", *blend("a", f("exit_t"), f("overlap")), *blend("b", f("entry_t"), f("consumed")), *([] if "_ea" in keep else leaving(d)), *([] if "_eb" in keep else entering(d)),
        ia.alias("_ia"), sa.alias("_sa"), ib.alias("_ib"), sb.alias("_sb"),
        tempo_score(f("a_bpm"), f("b_bpm")).alias("c_tempo"), key_score(f("a_camelot"), f("b_camelot")).alias("c_harmonic"),
    )
    # The higher-order function ends a generated method that would be too long with what follows.
    worst = _worst_trough() if floor else lambda *_: F.array_max(F.transform(F.array("overlap"), lambda x: x * 0))
    trough = worst("kind", "exit_t", "overlap", "entry_t", "consumed", "_la", "_lb", *[f"{s}_{x}" for s in "ab" for x in ("n", "duration_sec", "integrated_lufs")], "_wa", "_pa", "_wb", "_pb")
    d = d.withColumn("trough", trough)
    ga, gb = Q.pair_gain(la, lb)
    up = lambda g: F.pow(F.lit(10.0), g / 20)
    d = d.select(
        *[x for x in d.columns if x not in ("_pa", "_pb", "_wa", "_wb", "_ea", "_eb", "_el")],
        "trough",
        (Q.local_rms(la, f("_ea"), f("a_mean_energy")) * up(ga)).alias("src_energy"),
        (Q.local_rms(lb, f("_eb"), f("b_mean_energy")) * up(gb)).alias("entry_energy"),
        (Q.local_rms(lb, f("_el"), f("b_mean_energy")) * up(gb)).alias("landing_energy"),
    )
    d = d.select(
        "*", Q.ratio_db(f("landing_energy"), f("src_energy")).alias("delta_db"), Q.ratio_db(f("landing_energy"), f("entry_energy")).alias("_sag"),
        ((f("_sa") + f("_sb")) / 2).alias("c_bar"), ((grouped_phrase(f("_ia"), f("_sa")) + grouped_phrase(f("_ib"), f("_sb"))) / 2).alias("c_phrase"),
        (f("_lb") - f("_la")).alias("loud_delta"), Q.floor_score(f("trough")).alias("c_floor"), (f("a_vocal") * f("b_vocal")).alias("collision"),
    )
    bass, mode = Q.bass_handoff(f("a_bass"), f("b_bass"), f("kind"))
    span = F.greatest(F.lit(1.0), f("a_duration_sec"))
    lo, mid, hi = (F.least(F.lit(h), F.greatest(F.lit(l), span * k)) for k, l, h in ((0.28, 55.0, 90.0), (0.48, 70.0, 180.0), (0.78, 120.0, 300.0)))
    d = d.select(
        "*", Q.energy_continuity(f("delta_db"), f("profile"), f("style")).alias("c_energy"), Q.landing_score(f("delta_db"), f("_sag"), f("profile")).alias("c_landing"),
        F.greatest(F.lit(0.0), 1 - F.abs(f("loud_delta")) / 8).alias("c_loudness"), bass.alias("c_bass"), mode.alias("bass_mode"),
        F.greatest(F.lit(0.0), 1 - f("collision") * F.when(f("vocals") == "vocal_safe", 2.5).otherwise(1.0)).alias("c_vocal"),
        structure_fit(f("a_section"), f("b_section")).alias("c_structure"), Q.playtime_score(f("exit_t") - f("cursor"), lo, mid, hi).alias("c_playtime"),
    )
    d = d.withColumn("c_style", Q.style_fit({
        "kind": f("kind"), "style": f("style"), "phrase": f("c_phrase"), "tempo": f("c_tempo"), "delta_db": f("delta_db"), "landing": f("c_landing"),
        "a_bass": f("a_bass"), "b_bass": f("b_bass"), "a_vocal": f("a_vocal"), "b_vocal": f("b_vocal"), "a_section": f("a_section"),
        "bpm_conf": f("confidence6"), "stems": f("stems")}))
    d = d.withColumn("overall", Q.weighted({n: f(f"c_{n}") for n in Q.WEIGHTS}, f("style"), f("vocals"), f("profile")))
    return d.withColumn("confidence", Q.confidence(f("confidence6"), f("c_phrase"), f("overall"))).drop("_la", "_lb", "_ia", "_ib", "_sa", "_sb", "_sag")


AGGRESSIVE = ["bass_swap", "phrase_cut", "echo_out", "loop_blend", "mashup"]


def search(scored: DataFrame, key: list[str]) -> DataFrame:
    """Best candidate per pair: strict ones first, relaxed ones at 0.9, then the fallback at 0.25.

    One aggregation: the tier leads the ordering struct, so lower tiers win only when
    nothing above them exists.
    """
    f = F.col
    fits = (f("entry_t") + f("consumed") <= f("b_duration_sec")) & (f("exit_t") + f("overlap") <= f("a_duration_sec"))
    strict = fits & (f("trough") <= 3.5) & ~((f("vocals") == "vocal_safe") & (f("collision") > 0.16) & ~f("kind").isin("phrase_cut", "mashup")) & ~((f("style") == "smooth") & (f("collision") > 0.25))
    tier = F.when(strict, 3).when(fits, 2).otherwise(1)
    scale = F.when(strict, F.when(f("kind").isin(AGGRESSIVE) & (f("confidence") < 0.62), 0.65).otherwise(1.0)).when(fits, 0.9).otherwise(0.25)
    r9 = lambda x: F.round(x, 9)
    order = F.struct(tier.alias("tier"), r9(f("overall") * scale).alias("selection"), r9(f("c_phrase")).alias("p"), r9(f("c_landing")).alias("l"), (-f("exit_t")).alias("x"), (-f("entry_t")).alias("y"), f("kind").alias("k"))
    best = scored.groupBy(*key).agg(F.max(order).alias("b"))
    return best.select(*key, (4 - f("b.tier")).cast("bigint").alias("tier"), f("b.selection").alias("selection"), (-f("b.x")).alias("exit_t"), (-f("b.y")).alias("entry_t"), f("b.k").alias("kind"))


def layer_gate(pairs: DataFrame) -> DataFrame:
    """Vocal-over-instrumental score with hard gates and the reasons they failed.

    A track never layers over itself: such a pair has score 0 and that reason alone.
    """
    f = F.col
    same = f("src") == f("dst")
    phrase = F.when((f("a_bars") >= 4) & (f("b_bars") >= 4) & (F.abs(f("a_bars") - f("b_bars")) <= 4), 1.0).otherwise(0.5)
    d = pairs.select(
        "*", Q.layer_tempo(f("a_bpm"), f("b_bpm")).alias("tempo"), key_score(f("a_camelot"), f("b_camelot")).alias("key"), phrase.alias("phrase"),
        clip(f("a_vocal") * 1.4).alias("vocal"), clip(1 - f("b_vocal")).alias("instrumental"), F.greatest(F.lit(0.0), 1 - F.abs(f("a_mean_energy") - f("b_mean_energy")) * 1.5).alias("energy"))
    d = d.withColumn("score", F.when(same, 0.0).otherwise(F.round(Q.layer_score(f("tempo"), f("key"), f("phrase"), f("vocal"), f("instrumental"), f("energy"), f("local")), 9)))
    reasons = F.concat_ws(
        "; ", F.when(~f("stems"), "complete vocal and backing stem caches are required"), F.when(f("vocal") < 0.30, "source segment has insufficient vocal material"),
        F.when(f("instrumental") < 0.65, "target segment contains too much vocal material"), F.when(f("tempo") < 0.20, "tempo mismatch is too large for conservative layering"),
        F.when(f("key") < 0.75, "harmonic compatibility is below the layering gate"))
    reasons = F.when(same, "layering requires two different source tracks").otherwise(reasons)
    return d.withColumn("reason", reasons).withColumn("accepted", (f("reason") == "") & (f("score") >= 0.72))


def layer_events(gated: DataFrame, per_set: int = 2) -> DataFrame:
    """Accepted layers per set: adjacent pairs first, then best score, a few per set."""
    w = Window.partitionBy("set_id").orderBy(F.asc("distance"), F.desc("score"), F.asc("pos"))
    return gated.where("accepted").withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= per_set)
