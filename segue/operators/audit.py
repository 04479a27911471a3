"""Rule checks over timelines and edit points, as violation tables.

The order of events is a tuple of columns, not a row number, so no mix has to be
numbered in one task. Running maxima are taken per time bin plus a carry from
earlier bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["out_start", "tie", "track_id", "src_start", "src_end"]


def running_max_before(df: DataFrame, key: list[str], order: list[str], value: str, bin_col: Column, out: str) -> DataFrame:
    """Maximum of ``value`` over all rows before this one in ``order`` (null for the first).

    ``bin_col`` must be non-decreasing in ``order``; it splits a hot key.
    """
    d = df.withColumn("_bin", bin_col)
    tops = d.groupBy(*key, "_bin").agg(F.max(value).alias("_top"))
    before = tops.select(*key, "_bin", F.max("_top").over(
        Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    w = Window.partitionBy(*key, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("_in", F.max(value).over(w)).join(before, [*key, "_bin"]).withColumn(
        out, F.greatest("_in", "_carry")).drop("_in", "_carry", "_bin")


def timeline_gaps(timeline: DataFrame, width: int = 20) -> DataFrame:
    """Rows whose output start differs from the furthest end so far (0 at the beginning)."""
    d = running_max_before(timeline, ["mix_id"], ORDER, "out_end", F.floor(F.col("out_start") / width), "_prev")
    expected = F.greatest(F.coalesce("_prev", F.lit(0)), F.lit(0)).cast("bigint")
    return d.withColumn("expected", expected).where(F.col("out_start") != F.col("expected")).select(
        "mix_id", *ORDER, "expected", F.when(F.col("out_start") > F.col("expected"), "output_gap").otherwise("output_overlap").alias("kind"))


def first_overlap(timeline: DataFrame, key: list[str], width: int) -> DataFrame:
    """Rows that replay source material, with the first earlier row that overlaps them.

    Equal intervals are folded to their earliest row before the interval join, so a
    loop repeated millions of times joins as one interval.
    """
    from segue.operators.intervals import overlap_join

    at = F.struct(*ORDER)
    distinct = timeline.groupBy(*key, "src_start", "src_end").agg(F.min(at).alias("at"))
    k = F.xxhash64(*key) if len(key) > 1 else None
    left = distinct.select(*key, "src_start", "src_end") if k is None else distinct.select(k.alias("_k"), *key, "src_start", "src_end")
    right = distinct.select(*([F.col(c).alias(f"_{c}") for c in key]), F.col("src_start").alias("_s"), F.col("src_end").alias("_e"), "at")
    right = right.withColumn("_k", F.xxhash64(*[F.col(f"_{c}") for c in key])) if k is not None else right.withColumnRenamed(f"_{key[0]}", key[0])
    hits = overlap_join(left, right, "_k" if k is not None else key[0], ("src_start", "src_end"), ("_s", "_e"), float(width))
    if k is not None:
        for c in key:
            hits = hits.where(F.col(c) == F.col(f"_{c}"))
    first = hits.groupBy(*key, "src_start", "src_end").agg(F.min("at").alias("first"))
    return timeline.join(first, [*key, "src_start", "src_end"]).where(F.col("first") < at)


def source_rewind(timeline: DataFrame, length: Column, planned_exit: Column) -> DataFrame:
    """Backward jumps, replayed intervals, reads past the end and past the planned exit."""
    key = ["mix_id", "track_id"]
    d = running_max_before(timeline, key, ORDER, "src_end", F.floor(F.col("out_start") / 20), "latest")
    cols = ["mix_id", *ORDER]
    none = F.lit(None).cast("bigint")
    back = d.where(F.col("src_start") < F.col("latest")).select(*cols, F.lit("unexpected_backwards_source_jump").alias("kind"), F.col("latest").alias("ref"))
    dup = first_overlap(timeline, key, 50).select(*cols, F.lit("duplicate_source_interval").alias("kind"), F.col("first.out_start").alias("ref"))
    eof = timeline.where(F.col("src_end") > length).select(*cols, F.lit("body_after_eof").alias("kind"), none.alias("ref"))
    past = timeline.where(F.col("src_end") > planned_exit).select(*cols, F.lit("body_past_planned_exit").alias("kind"), none.alias("ref"))
    return back.unionByName(dup).unionByName(eof).unionByName(past)


def violation(df: DataFrame, module: str, metric: str, threshold: float, observed: Column, at: Column, ident: Column) -> DataFrame:
    return df.select(
        F.lit(module).alias("module"), F.lit(metric).alias("metric"), F.lit(float(threshold)).alias("threshold"),
        observed.cast("double").alias("observed"), at.cast("double").alias("at"), ident.cast("bigint").alias("ident"))


def merge(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
