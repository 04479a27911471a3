"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segue.session import scratch_path

#: Shuffle files go when the query that wrote them has ended, not when the driver next collects garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: later steps don't compute it anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`saved` that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, for the number of buckets."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
