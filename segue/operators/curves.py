"""Structure from curves and event times: bars, phrases, sections, entry and exit points.

A curve holds one row per track and time unit, so a track's window is bounded by
its length, never by the number of listeners or events behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.basic import clip, r6, snap

def _track():
    return Window.partitionBy("track_id")


def indexed(curve: DataFrame, value: str = "level") -> DataFrame:
    """Curve as list positions: ``track_id, i, v, n_points`` in time order."""
    return curve.select("track_id", "t", F.col(value).alias("v")).select(
        "track_id", "t", "v",
        (F.row_number().over(_track().orderBy("t")) - 1).cast("bigint").alias("i"),
        F.count(F.lit(1)).over(_track()).alias("n_points"),
    )


def bar_grid(tracks: DataFrame, phase: Column | None = None) -> DataFrame:
    """Regular bar onsets from the first beat up to the duration."""
    phase = phase if phase is not None else F.lit(0.0)
    step = 240 / F.col("bpm")
    last = F.ceil((F.col("duration_sec") - phase) / step).cast("bigint")
    return (
        tracks.where((F.col("bpm") > 0) & (F.col("duration_sec") > 0))
        .select("track_id", phase.alias("_p"), step.alias("_s"), "duration_sec", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_k"))
        .withColumn("bar_t", F.round(F.col("_p") + F.col("_k") * F.col("_s"), 4))
        .where((F.col("_p") + F.col("_k") * F.col("_s") < F.col("duration_sec")) & (F.col("bar_t") >= 0))
        .select("track_id", F.col("_k").alias("bar_idx"), "bar_t")
    )


def bar_times(bpm: Column, duration: Column, keep: Callable[[Column], Column] = lambda k: F.lit(True)) -> Column:
    """``bar_t`` of ``bar_grid`` as one array, of the bars whose index ``keep`` accepts."""
    step = 240 / bpm
    inside = F.filter(F.sequence(F.lit(0).cast("bigint"), F.ceil(duration / step).cast("bigint")), lambda k: (k * step < duration) & keep(k))
    return F.when((bpm > 0) & (duration > 0), F.transform(inside, lambda k: F.round(k * step, 4))).otherwise(F.array().cast("array<double>"))


def curve_bars(curve: DataFrame, bar_len: int, duration: int) -> DataFrame:
    """Bars of ``bar_len`` time units over the whole span of every track in ``curve``."""
    n = duration // bar_len - 1
    return curve.select("track_id").distinct().select(
        "track_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))).alias("bar_idx")).withColumn("bar_t", F.col("bar_idx") * bar_len)


def bar_energy(curve: DataFrame, bars: DataFrame, bar_len: int, value: Column, default: float = 0.5) -> DataFrame:
    """Mean curve value per bar; bars without samples get the default.

    Frames fall into exactly one bar, so the range join is an equi-join on the bar index.
    """
    means = curve.groupBy("track_id", F.floor(F.col("t") / bar_len).cast("bigint").alias("bar_idx")).agg(F.avg(value).alias("energy"))
    return bars.join(means, ["track_id", "bar_idx"], "left").withColumn("energy", F.coalesce("energy", F.lit(default)))


def jumps(bars: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Bars where the energy jumps by at least the threshold."""
    change = F.col("energy") - F.lag("energy").over(_track().orderBy("bar_idx"))
    return bars.withColumn("change", change).where(F.abs(F.round("change", 9)) >= threshold)


def phrase_boundaries(bars: DataFrame, min_bars: int = 8, max_bars: int = 32, threshold: float = 0.15) -> DataFrame:
    """Biggest jumps at least ``min_bars`` apart; gaps over ``max_bars`` get one midpoint.

    The greedy choice is a fold over the track's candidates, biggest first.
    """
    mag = F.round(F.abs(F.col("change")), 9)
    cand = jumps(bars, threshold).groupBy("track_id").agg(
        F.array_sort(F.collect_list(F.struct((-mag).alias("m"), F.col("bar_idx").alias("b"), F.col("bar_t").alias("t")))).alias("c"))
    empty = F.filter(F.col("c"), lambda x: F.lit(False))
    kept = F.aggregate("c", empty, lambda acc, x: F.when(
        F.exists(acc, lambda y: F.abs(y["b"] - x["b"]) < min_bars), acc).otherwise(F.concat(acc, F.array(x))))
    picked = cand.select("track_id", F.explode(kept).alias("p")).select(
        "track_id", F.col("p.b").alias("bar_idx"), F.col("p.t").cast("double").alias("time"), F.least(F.lit(1.0), -F.col("p.m") / 0.4).alias("confidence"),
        (-F.col("p.m")).alias("energy_change"))
    w = _track().orderBy("bar_idx")
    nxt_b, nxt_t = F.lead("bar_idx").over(w), F.lead("time").over(w)
    filled = picked.withColumn("_nb", nxt_b).withColumn("_nt", nxt_t).where(F.col("_nb") - F.col("bar_idx") > max_bars).select(
        "track_id", F.floor((F.col("bar_idx") + F.col("_nb")) / 2).cast("bigint").alias("bar_idx"),
        ((F.col("time") + F.col("_nt")) / 2).alias("time"), F.lit(0.4).alias("confidence"), F.lit(0.0).alias("energy_change"))
    return picked.unionByName(filled).select("track_id", "bar_idx", "time", r6(F.col("confidence")).alias("confidence"), r6(F.col("energy_change")).alias("energy_change"))


def section_labels(bars: DataFrame, boundaries: DataFrame, duration: float, bar_len: int) -> DataFrame:
    """Sections between boundaries, labelled by position, level and stability."""
    whole = bars.groupBy("track_id").agg(F.avg("energy").alias("m"), F.count(F.lit(1)).alias("nb"))
    cuts = boundaries.where((F.col("time") > 0) & (F.col("time") < duration)).select("track_id", "time").unionByName(
        whole.select("track_id", F.lit(0.0).alias("time"))).distinct()
    w = _track().orderBy("time")
    sec = cuts.select("track_id", F.col("time").alias("start_t"), F.coalesce(F.lead("time").over(w), F.lit(float(duration))).alias("end_t"))
    first = F.floor(F.col("start_t") / bar_len).cast("bigint")
    last = F.greatest(first + 1, F.floor(F.col("end_t") / bar_len).cast("bigint"))
    # Sections tile the bars, so a section's bars are listed and looked up by index.
    stats = (
        sec.withColumn("bar_idx", F.explode(F.sequence(first, last - 1)))
        .join(bars.select("track_id", "bar_idx", "energy"), ["track_id", "bar_idx"])
        .groupBy("track_id", "start_t", "end_t")
        .agg(F.avg("energy").alias("e"), F.stddev_pop("energy").alias("sd"))
    )
    e, m, sd, s, t = F.col("e"), F.col("m"), F.round("sd", 9), F.col("start_t"), F.col("end_t")
    label = (
        F.when((s < duration * 0.15) & (e < m * 0.9), "intro")
        .when((t > duration * 0.85) & (e < m * 0.9), "outro")
        .when((s + t) / 2 / duration > 0.88, "outro")
        .when((e > m * 1.15) & (sd < 0.08), "chorus")
        .when(e < m * 0.85, "verse")
        .when(sd > 0.1, "bridge")
        .otherwise("verse")
    )
    return stats.join(whole, "track_id").select("track_id", "start_t", "end_t", snap(e, 6).alias("energy_level"), label.alias("label"))


def intro_outro(curve: DataFrame, threshold: float, bar: int, bars: int = 4) -> DataFrame:
    """Index where the level first holds for a bar, and last held for ``bars`` bars."""
    ahead = _track().orderBy("i").rowsBetween(0, bar - 1)
    behind = _track().orderBy("i").rowsBetween(-(bar * bars - 1), 0)
    c = curve.select(
        "track_id", "i", "v", "n_points",
        F.round(F.avg("v").over(ahead), 9).alias("fwd"), F.round(F.avg("v").over(behind), 9).alias("back"),
        F.least(F.lit(bar * bars), F.col("n_points") - F.col("i")).alias("left_over"), F.least(F.lit(bar * bars), F.col("i") + 1).alias("seen"),
    )
    on = F.col("v") > threshold
    return c.groupBy("track_id").agg(
        F.coalesce(F.min(F.when(on & (F.col("left_over") >= bar) & (F.col("fwd") > threshold), F.col("i"))), F.lit(0)).cast("bigint").alias("intro_end"),
        F.coalesce(F.max(F.when(on & (F.col("seen") >= bar) & (F.col("back") > threshold), F.col("i"))), F.max("n_points") - 1).alias("outro_start"),
    )


def point_context(bars: DataFrame) -> DataFrame:
    """Per bar: energy spread over five bars and the drop to the next bar."""
    w = _track().orderBy("bar_idx")
    return bars.select(
        "track_id", "bar_idx", "bar_t", "energy",
        F.round(F.stddev_pop("energy").over(w.rowsBetween(-2, 2)), 9).alias("spread"),
        F.round(F.col("energy") - F.lead("energy").over(w), 9).alias("drop"),
    )


def entry_score(time: Column, intro_end: Column, duration: float, bar_len: float, on_bar: Column, spread: Column) -> Column:
    score = (
        0.5 + F.when(time > intro_end + bar_len, 0.1).otherwise(0.0) + F.when(on_bar, 0.2).otherwise(0.0)
        + F.coalesce(0.2 * (1 - F.least(F.lit(1.0), spread * 5)), F.lit(0.0))
    )
    return F.when((time < intro_end) | (time >= duration), 0.0).otherwise(clip(score))


def exit_score(time: Column, outro_start: Column, duration: float, on_bar: Column, drop: Column) -> Column:
    base = (
        0.3 + F.when(time >= outro_start, 0.3).when(time >= duration * 0.6, 0.1).otherwise(0.0)
        + F.when(on_bar, 0.2).otherwise(0.0) + F.when(drop > 0.05, F.least(F.lit(0.2), drop * 2)).otherwise(0.0)
    )
    early = (time < duration * 0.3) & (time < outro_start)
    return F.when((time <= 0) | (time >= duration - 2), 0.0).otherwise(clip(base * F.when(early, 0.5).otherwise(1.0)))


def top_points(scored: DataFrame, k: int = 20, floor: float = 0.2) -> DataFrame:
    """The ``k`` best points per track above the floor (ties: earlier first)."""
    w = _track().orderBy(F.desc("score"), F.asc("time"))
    return scored.where(F.col("score") > floor).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def transition_bars(a: Column, b: Column, low: int = 4, high: int = 16) -> Column:
    avg = (a + b) / 2
    bars = (
        F.when((avg > 0.85) & F.lit(high >= 24), 24).when((avg > 0.75) & F.lit(high >= 20), 20)
        .when(avg > 0.75, 16).when(avg > 0.6, 12).when(avg > 0.45, 8).otherwise(4)
    )
    held = F.greatest(F.lit(low), F.least(F.lit(high), bars))
    return (held - held % 2).cast("bigint")


def rms_frames(curve: DataFrame, size: int = 2) -> DataFrame:
    """RMS over frames of ``size`` samples, one hop apart, and the curve scaled by its maximum."""
    w = _track().orderBy("i").rowsBetween(0, size - 1)
    rms = curve.withColumn("rms", F.sqrt(F.avg(F.col("v") * F.col("v")).over(w))).where(F.col("i") < F.greatest(F.lit(1), F.col("n_points") - size))
    top = F.max("rms").over(_track())
    return rms.withColumn("scaled", F.when(top > 0, F.col("rms") / top).otherwise(F.col("rms")))


def smooth(curve: DataFrame, size: int) -> DataFrame:
    """Centred moving average; missing neighbours at the ends count as zero."""
    half = size // 2
    w = _track().orderBy("i").rowsBetween(-half, half)
    return curve.withColumn("smooth", F.sum("v").over(w) / size)


def ratio_window(start: Column, end: Column, duration: Column, n: Column) -> tuple[Column, Column]:
    """First and last (exclusive) list index of a time window, by share of the duration."""
    first = F.greatest(F.lit(0), F.least(n - 1, F.floor(start / duration * n)))
    last = F.greatest(first + 1, F.least(n, F.ceil(end / duration * n)))
    return first.cast("bigint"), last.cast("bigint")


def window_stats(windows: DataFrame, curve: DataFrame, wid: list[str]) -> DataFrame:
    """Mean, least-squares slope and count of curve values with index in ``[first_i, last_i)``.

    The window lists its own indexes, so the range join is an equi-join on (track, index).
    """
    spread = windows.withColumn("i", F.explode(F.sequence(F.col("first_i"), F.col("last_i") - 1)))
    got = spread.join(curve.select("track_id", "i", "v"), ["track_id", "i"]).groupBy("track_id", *wid).agg(
        F.avg("v").alias("mean_v"), F.coalesce(F.regr_slope(F.col("v"), F.col("i")), F.lit(0.0)).alias("slope_v"),
        F.count(F.lit(1)).alias("n_v"))
    return windows.join(got, ["track_id", *wid], "left")
