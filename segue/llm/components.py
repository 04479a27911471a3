"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.store import dropped, saved


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; component is the least node reachable.

    Each round takes the least label among the neighbours (a partial minimum before the
    shuffle, so a hub with a third of all links sends one row a task) and then the label of
    the label. Rounds grow with the logarithm of the longest path in usual graphs. Null ends
    and self links are left out; no links give no rows.
    """
    links = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = saved(links.union(links.select("dst", "src")).distinct(), "links")
    labels = saved(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("component"))
        least = saved(labels.union(near).groupBy("node").agg(F.min("component").alias("component")), "labels")
        up = least.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = saved(least.join(up, "component").select("node", F.col("up").alias("component")), "labels")
        sums = [x.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] for x in (labels, jumped)]
        dropped(least)
        dropped(labels)
        labels = jumped
        if sums[0] == sums[1]:  # labels only ever fall
            dropped(both)
            return labels
