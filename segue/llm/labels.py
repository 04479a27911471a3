"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(nth, label, text) of the ``rows`` labelled documents whose ids have the least hashes.

    Null ids and labels are left out; an id with several labels has the largest. The ids, no
    more than ``rows``, are broadcast, so no text is shuffled. A repeated doc_id counts as often.
    """
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    top = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    ids = spark.createDataFrame([(i, r.doc_id, r.label) for i, r in enumerate(top)], "nth long, doc_id long, label int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("nth", "label", "text")
