"""Aggregations of ratings and listener feedback.

All of them are plain hash aggregations with map-side partials: a hot track or
user costs one partial row per task, never a whole group in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions.basic import clip, r6

# fixed values: rating words
RATING_WORDS = {"great": 1.0, "good": 0.7, "bad": -1.0, "too abrupt": -0.6, "too long": -0.4, "too weak": -0.3}


def transition_avg(ratings: DataFrame) -> DataFrame:
    """Average rating per (source, target) and per (source, target, type)."""
    r = ratings.select("source_id", "target_id", "transition_type", "rating")
    return r.groupingSets(
        [["source_id", "target_id"], ["source_id", "target_id", "transition_type"]],
        "source_id", "target_id", "transition_type",
    ).agg(r6(F.avg("rating")).alias("avg_rating"), F.count(F.lit(1)).alias("n"))


def preferred_types(ratings: DataFrame, min_samples: int = 3) -> DataFrame:
    return (
        ratings.groupBy("transition_type")
        .agg(r6(F.avg("rating")).alias("avg_rating"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_samples)
    )


def feedback_state(events: DataFrame) -> DataFrame:
    """Latest like flag (0 when never set) and number of events per track."""
    vote = F.when(F.col("action") == "like", 1).when(F.col("action") == "dislike", -1)
    at = F.struct("ts", "event_id")
    return events.groupBy("track_id").agg(
        F.coalesce(F.max_by(vote, F.when(vote.isNotNull(), at)), F.lit(0)).cast("bigint").alias("liked"),
        F.count(F.lit(1)).alias("play_count"),
        F.max("ts").alias("updated_at"),
    )


def most_played(state: DataFrame, k: int = 10) -> DataFrame:
    return state.orderBy(F.desc("play_count"), F.asc("track_id")).limit(k).select("track_id", "play_count")


def scoring_bonuses(events: DataFrame, ratings: DataFrame, ranges: DataFrame, min_samples: int = 3) -> DataFrame:
    """Everything the scorer reads, as rows ``(kind, item, low, high)``."""
    state = feedback_state(events).where(F.col("liked") != 0)
    none = F.lit(None).cast("double")
    tracks = state.select(
        F.when(F.col("liked") > 0, "liked_track").otherwise("disliked_track").alias("kind"),
        F.col("track_id").cast("string").alias("item"), none.alias("low"), none.alias("high"),
    )
    types = preferred_types(ratings, min_samples).where(F.col("avg_rating") != 0).select(
        F.when(F.col("avg_rating") > 0, "preferred_type").otherwise("disliked_type").alias("kind"),
        F.col("transition_type").alias("item"), F.col("avg_rating").alias("low"), none.alias("high"),
    )
    spans = ranges.select(
        F.concat(F.col("kind"), F.lit("_range")).alias("kind"), F.col("user_id").cast("string").alias("item"), "low", "high",
    )
    return tracks.unionByName(types).unionByName(spans)


def preference_ranges(log: DataFrame) -> DataFrame:
    """Last written range per user and kind."""
    last = F.max_by(F.struct("low", "high"), F.struct("ts", "event_id"))
    return log.groupBy("user_id", "kind").agg(last.alias("v")).select("user_id", "kind", "v.low", "v.high")


def mix_ratings(log: DataFrame) -> DataFrame:
    """Stored ratings are clamped to 1..5; the service rejects what lies outside. Newest first per mix."""
    newest = Window.partitionBy("mix_id").orderBy(F.desc("created_at"), F.desc("tie"))
    return log.select(
        "mix_id", "created_at", "tie",
        F.greatest(F.lit(1), F.least(F.lit(5), F.col("rating"))).cast("bigint").alias("stored"),
        F.col("rating").between(1, 5).alias("accepted"),
        F.row_number().over(newest).cast("bigint").alias("newest_rank"),
    )


def mix_average(log: DataFrame) -> DataFrame:
    stored = F.greatest(F.lit(1), F.least(F.lit(5), F.col("rating")))
    return log.groupBy("mix_id").agg(r6(F.avg(stored)).alias("avg_rating"), F.count(F.lit(1)).alias("n"))


def correction_latest(log: DataFrame) -> DataFrame:
    """Last correction per track as JSON with sorted keys."""
    last = F.max_by(F.struct("audio_tag", "theme_no"), F.struct("ts", "event_id"))
    return log.groupBy("track_id").agg(last.alias("c"), F.max("ts").alias("updated_at")).select(
        "track_id", F.to_json("c").alias("corrections_json"), "updated_at")


def preference_summary(events: DataFrame) -> DataFrame:
    """Per user: distinct tracks liked and disliked at last vote, events, plays."""
    vote = F.when(F.col("action") == "like", 1).when(F.col("action") == "dislike", -1)
    per_track = events.groupBy("user_id", "track_id").agg(
        F.max_by(vote, F.when(vote.isNotNull(), F.struct("ts", "event_id"))).alias("liked"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action") == "play").alias("plays"),
    )
    return per_track.groupBy("user_id").agg(
        F.count_if(F.col("liked") == 1).alias("liked_tracks"),
        F.count_if(F.col("liked") == -1).alias("disliked_tracks"),
        F.sum("n").alias("events"), F.sum("plays").alias("plays"),
    )


def rating_value(word: Column) -> Column:
    """Rating word to number; unknown words are null (the caller quarantines them)."""
    out = None
    for k, v in RATING_WORDS.items():
        out = F.when(word == k, F.lit(v)) if out is None else out.when(word == k, F.lit(v))
    return out


def clamp_rating(x: Column) -> Column:
    return clip(x, -1.0, 1.0)
