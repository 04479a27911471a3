"""Streaming twins of the keyed feedback operators.

Sources are Parquet folders read as streams; results go to Parquet tables or keyed
state. All of them run with ``availableNow`` for back-fills and with a processing
trigger for live feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.session import scratch_path


def read_stream(spark: SparkSession, folder: str, glob: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from the files at rest."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return the resulting table.

    With ``keys`` the stream runs in update mode: a batch writes only the keys it changed, and
    the table holds the last row of each key. Without, it runs in append mode. Batches land under
    the shared root with the batch id in the path, so a replayed batch overwrites itself.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.option("basePath", out).schema(schema).parquet(out)
    if not keys:
        return rows.drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return last.select("r.*")


def feedback_state(events: DataFrame) -> DataFrame:
    """Latest vote and event count per track as running state."""
    vote = F.when(F.col("action") == "like", 1).when(F.col("action") == "dislike", -1)
    return events.groupBy("track_id").agg(
        F.coalesce(F.max_by(vote, F.when(vote.isNotNull(), F.struct("ts", "event_id"))), F.lit(0)).cast("bigint").alias("liked"),
        F.count(F.lit(1)).alias("play_count"), F.max("ts").alias("updated_at"))


def transition_avg(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("source_id", "target_id", "transition_type").agg(
        F.round(F.avg("rating"), 6).alias("avg_rating"), F.count(F.lit(1)).alias("n"))


def plays_windowed(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Plays per track and event-time window; state of a window goes when the watermark has passed it.

    ``events.ts`` must be a TIMESTAMP: watermarks reject timestamps without a zone.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "track_id").agg(F.count(F.lit(1)).alias("plays")).select(
        "track_id", F.col("w.start").alias("window_start"), "plays")


def cache_upsert(rows: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Last write per key as running state; unlike a de-duplication it keeps the newest, not the first."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*order, *payload), F.struct(*order)).alias("r")).select(key, "r.*")
