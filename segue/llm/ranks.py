"""Gapless row numbers inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.store import saved


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... inside each value of the column ``by`` (not null) in the given order.

    ``by`` and ``order`` must tell all rows apart, else equal rows get their numbers in any order.
    Rows are partitioned by ranges of the whole key, so a group with a third of all rows spreads over many tasks. Each task
    writes its rows in order; what comes before a group's run in a task is a sum over runs, not rows.
    """
    at = F.monotonically_increasing_id()  # task << 33 | row
    placed = saved(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("__at", at), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    runs = placed.groupBy(by, "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(by, "__part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("__shift"))
    return placed.join(runs, [by, "__part"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")
