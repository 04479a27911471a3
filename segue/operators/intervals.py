"""Interval, containment and nearest-mark joins.

Spark has no interval or as-of join. Each helper cuts the time axis into bins and
joins on ``(key, bin)``, so even a key that holds a third of all rows spreads
over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.basic import clip


def _bin(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("bigint")


def overlap_join(left: DataFrame, right: DataFrame, key: str, l: tuple[str, str], r: tuple[str, str],
                 width: float, how_closed: bool = False) -> DataFrame:
    """Pairs whose intervals overlap (touching counts when ``how_closed``), each pair once.

    Both sides are spread over the bins they cover; a pair meets in several bins
    and is kept only in the first bin both share.
    """
    lb = left.withColumn("_b", F.explode(F.sequence(_bin(F.col(l[0]), width), _bin(F.greatest(F.col(l[0]), F.col(l[1])), width))))
    lb = lb.withColumn("_l0", _bin(F.col(l[0]), width))
    rb = right.withColumn("_b", F.explode(F.sequence(_bin(F.col(r[0]), width), _bin(F.greatest(F.col(r[0]), F.col(r[1])), width))))
    rb = rb.withColumn("_r0", _bin(F.col(r[0]), width))
    if how_closed:
        hit = (F.col(r[0]) <= F.col(l[1])) & (F.col(r[1]) >= F.col(l[0]))
    else:
        hit = (F.col(r[0]) < F.col(l[1])) & (F.col(r[1]) > F.col(l[0]))
    return lb.join(rb, [key, "_b"]).where((F.col("_b") == F.greatest("_l0", "_r0")) & hit).drop("_b", "_l0", "_r0")


def covered(windows: DataFrame, regions: DataFrame, key: str, wid: list[str], w: tuple[str, str], r: tuple[str, str],
            width: float) -> DataFrame:
    """``windows`` plus ``covered_sec`` (summed overlap with regions) and ``fraction`` (capped at 1)."""
    reg = regions.select(key, F.col(r[0]).alias("_rs"), F.col(r[1]).alias("_re"))
    hits = overlap_join(windows.select(key, *wid, w[0], w[1]), reg, key, w, ("_rs", "_re"), width)
    part = F.least(F.col(w[1]), F.col("_re")) - F.greatest(F.col(w[0]), F.col("_rs"))
    sums = hits.groupBy(key, *wid).agg(F.sum(part).alias("covered_sec"))
    out = windows.join(sums, [key, *wid], "left").withColumn("covered_sec", F.coalesce("covered_sec", F.lit(0.0)))
    span = F.col(w[1]) - F.col(w[0])
    return out.withColumn("fraction", F.when(span <= 0, 0.0).otherwise(clip(F.col("covered_sec") / span)))


def label_at(points: DataFrame, sections: DataFrame, key: str, pid: list[str], at: str, width: float,
             closed: bool = False) -> DataFrame:
    """``points`` plus ``label`` of the first section (by start, then id) that contains the time.

    Half-open ``[start, end)`` by default, ``[start, end]`` when ``closed``; null when none does.
    """
    p = points.withColumn("_b", _bin(F.col(at), width))
    s = sections.withColumn("_b", F.explode(F.sequence(_bin(F.col("start_t"), width), _bin(F.col("end_t"), width))))
    inside = (F.col("start_t") <= F.col(at)) & ((F.col("end_t") >= F.col(at)) if closed else (F.col("end_t") > F.col(at)))
    first = (
        p.select(key, "_b", at, *pid).join(s, [key, "_b"]).where(inside)
        .groupBy(key, *pid).agg(F.min_by("label", F.struct("start_t", "section_id")).alias("label"))
    )
    return points.join(first, [key, *pid], "left")


def neighbours(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, width: float,
               carry: list[str] | None = None) -> DataFrame:
    """``points`` plus the closest mark at or before (``prev``) and after (``next``) each time.

    An as-of join in both directions. Marks and points are merged per ``(key, bin)``;
    what lies outside the bin comes from per-bin minima and maxima, which are one row
    per bin. ``prev`` and ``next`` are structs of the mark time and ``carry`` columns.
    """
    carry = carry or []
    value = F.struct(F.col(mark).alias("t"), *carry)
    m = marks.where(F.col(mark).isNotNull()).select(key, _bin(F.col(mark), width).alias("_b"), F.col(mark).alias("_t"), value.alias("_m"))
    p = points.withColumn("_b", _bin(F.col(at), width)).withColumn("_t", F.col(at))
    bins = (
        m.groupBy(key, "_b").agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
        .unionByName(p.select(key, "_b").distinct(), allowMissingColumns=True)
        .groupBy(key, "_b").agg(F.first("_lo", True).alias("_lo"), F.first("_hi", True).alias("_hi"))
    )
    order = Window.partitionBy(key).orderBy("_b")
    edges = bins.select(
        key, "_b",
        F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    row = F.struct(*[F.col(c) for c in points.columns])
    both = p.select(key, "_b", "_t", F.lit(1).alias("_kind"), row.alias("_p")).unionByName(
        m.select(key, "_b", "_t", F.lit(0).alias("_kind"), "_m"), allowMissingColumns=True)
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind", "_m.t")
    near = both.select(
        "*",
        F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev"),
        F.first("_m", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    ).where("_kind = 1").join(edges, [key, "_b"])
    return near.select("_p.*", F.coalesce("_prev", "_before").alias("prev"), F.coalesce("_next", "_after").alias("next"))


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, width: float,
            carry: list[str] | None = None) -> DataFrame:
    """``points`` plus ``near`` (closest mark, the earlier one on a tie) and ``distance``."""
    n = neighbours(points, marks, key, at, mark, width, carry)
    back, ahead = F.col(at) - F.col("prev.t"), F.col("next.t") - F.col(at)
    use_next = F.col("prev").isNull() | (F.round(ahead, 9) < F.round(back, 9))
    return n.withColumn("near", F.when(use_next, F.col("next")).otherwise(F.col("prev"))).withColumn(
        "distance", F.abs(F.col(at) - F.col("near.t"))).drop("prev", "next")


def runs(frames: DataFrame, key: list[str], order: str, active: Column) -> DataFrame:
    """Gaps and islands: consecutive active frames as ``start_i``, ``end_i`` (exclusive), ``n``."""
    w = Window.partitionBy(*key).orderBy(order)
    hits = frames.select(*key, order, active.alias("_a")).withColumn("_g", F.col(order) - F.sum(F.col("_a").cast("int")).over(w))
    return hits.where("_a").groupBy(*key, "_g").agg(
        F.min(order).alias("start_i"), (F.max(order) + 1).alias("end_i"), F.count(F.lit(1)).alias("n")).drop("_g")


def merge_close(regions: DataFrame, key: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Merge intervals whose distance to everything before them is below ``gap``."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col(start) - before >= gap), 1).otherwise(0)
    grouped = regions.withColumn("_new", opened).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")
