"""Keyed feature tables: fingerprints, upserts, versioned reads, pending work, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.functions.basic import lookup
from segue.functions.vocab import TRANSITION_TYPES
from segue.sources.catalog import extension


def library_summary(files: DataFrame) -> DataFrame:
    """Count, duration and size per extension plus the grand total (null extension)."""
    return files.withColumn("format", extension(F.col("path"))).rollup("format").agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.sum("n_bytes").cast("bigint").alias("total_bytes"),
        F.round(F.sum("duration_sec"), 6).alias("total_duration_sec"),
    )


def content_fingerprint(files: DataFrame) -> DataFrame:
    """Whole-content hash, copy count, and the canonical (lowest id) item of each hash.

    One aggregation on the hash, then a join back on it: a hot hash stays one row.
    """
    hashed = files.select("item_id", F.sha2("content", 256).alias("file_hash"))
    groups = hashed.groupBy("file_hash").agg(F.min("item_id").alias("canonical_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups, "file_hash").select(
        "item_id", "file_hash", "canonical_id", "copies", (F.col("item_id") == F.col("canonical_id")).alias("is_canonical"))


def upsert(base: DataFrame, delta: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write per key over base and delta (map-side combined, no sort)."""
    rows = base.unionByName(delta)
    rest = [c for c in rows.columns if c != key and c not in order]
    last = F.max_by(F.struct(*order, *rest), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def assemble(tracks: DataFrame, semantic: DataFrame, lyrics: DataFrame, key: str = "file_hash") -> DataFrame:
    """Profiles at the current version with optional semantic and lyric parts."""
    return tracks.join(semantic, key, "left").join(lyrics, key, "left")


def semantic_current(rows: DataFrame, model: str, version: str) -> DataFrame:
    """Rows of the wanted model and version whose source hash agrees; a blank hash is accepted."""
    return rows.where(
        (F.col("model_name") == model) & (F.col("model_version") == version)
        & (F.coalesce(F.nullif(F.col("source_hash"), F.lit("")), F.col("track_id").cast("string")) == F.col("track_id").cast("string"))
    )


def lyrics_raw(rows: DataFrame) -> DataFrame:
    own = F.col("track_id").cast("string")
    return rows.where(F.coalesce(F.nullif(F.col("source_hash"), F.lit("")), own) == own)


def lyrics_current(rows: DataFrame, version: str, model: str = "") -> DataFrame:
    out = lyrics_raw(rows).where(F.col("analysis_version") == version)
    if model:
        out = out.where((F.col("transcription_model") == "") | (F.col("transcription_model") == model))
    return out


# fixed values: lyric meaning states and versions
STATE_VIEW = {
    "MEANING_READY": "ready", "MEANING_LOW_CONFIDENCE": "low_confidence", "MEANING_INVALID": "failed",
    "TRANSCRIPT_READY_MEANING_MISSING": "meaning_missing", "TRANSCRIPTION_FAILED": "failed",
    "NO_LYRICS_AVAILABLE": "unavailable", "NOT_ANALYZED": "not_analyzed", "STALE_VERSION": "stale",
}
LYRICS_VERSION, MEANING_VERSION = "1", "2"


def meaning_state(model: str = "local-model", present: Column | None = None) -> Column:
    """State of a lyrics row; first matching condition wins."""
    c = F.col
    failed = c("transcription_error") != ""
    return (
        F.when((present if present is not None else c("analysis_version").isNotNull()) == F.lit(False), "NOT_ANALYZED")
        .when(c("analysis_version") != LYRICS_VERSION, "STALE_VERSION")
        .when((c("text") == "") & (c("source") == "unavailable") & ~failed, "NO_LYRICS_AVAILABLE")
        .when(c("text") == "", "TRANSCRIPTION_FAILED")
        .when(~c("has_meaning"), "TRANSCRIPT_READY_MEANING_MISSING")
        .when((c("meaning_error") != "") | (c("meaning_version") != MEANING_VERSION) | (c("meaning_model") != model), "MEANING_INVALID")
        .when((c("meaning_confidence") < 0.35) | (c("transcription_confidence") < 0.35), "MEANING_LOW_CONFIDENCE")
        .otherwise("MEANING_READY")
    )


def meaning_is_current(state: Column) -> Column:
    return state.isin("MEANING_READY", "MEANING_LOW_CONFIDENCE")


def pending_work(items: DataFrame, cache: DataFrame, lyrics: DataFrame, version: str, allow_transcription: bool = True) -> DataFrame:
    """Items that need audio analysis and items that need lyric analysis, with the reason."""
    c = F.col
    valid = cache.where(c("version") == version).select("item_id")
    audio = items.join(valid, "item_id", "left_anti").select("item_id", F.lit("audio").alias("job"), F.lit("not cached at this version").alias("reason"))
    state = items.join(lyrics, items["item_id"] == lyrics["track_id"], "left").select("item_id", meaning_state(present=c("track_id").isNotNull()).alias("state"))
    skip = meaning_is_current(c("state"))
    if not allow_transcription:
        skip = skip | (c("state") == "NO_LYRICS_AVAILABLE")
    words = state.where(~skip).select(
        "item_id", F.lit("lyrics").alias("job"),
        F.when(c("state").isin("TRANSCRIPT_READY_MEANING_MISSING", "MEANING_INVALID"), "retry meaning").otherwise("read lyrics").alias("reason"))
    return audio.unionByName(words)


def decimate(curve: DataFrame, key: str, order: str, target: int = 200) -> DataFrame:
    """Keep every ``len // 200``-th point of curves longer than 200 points."""
    w = Window.partitionBy(key)
    step = F.when(F.col("n_points") > target, F.floor(F.col("n_points") / target)).otherwise(1)
    return (
        curve.withColumn("n_points", F.count(F.lit(1)).over(w))
        .withColumn("i", F.row_number().over(w.orderBy(order)) - 1)
        .where(F.col("i") % step == 0)
        .drop("n_points", "i")
    )


def evict(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return table.join(removed.select(key).distinct(), key, "left_anti")


def parse_payload(rows: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Typed payload next to a flag for rows that do not parse (kept, never dropped)."""
    parsed = F.from_json(F.col(payload), schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.withColumn("parsed", parsed).withColumn("malformed", F.col("parsed._bad").isNotNull() | F.col("parsed").isNull())


PLAN_ITEM = T.ArrayType(T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("track_id", T.LongType()), T.StructField("transition_type", T.StringType()),
]))


def plan_pack(items: DataFrame) -> DataFrame:
    """One JSON document per set, items in order."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "track_id", "transition_type")))
    return items.groupBy("set_id").agg(F.to_json(rows).alias("plan_json"))


def plan_flatten(packed: DataFrame, fallback: str = "crossfade") -> DataFrame:
    """Items of packed sets; unknown transition types become the fallback."""
    item = F.explode(F.from_json("plan_json", PLAN_ITEM)).alias("item")
    kind = F.col("item.transition_type")
    return packed.select("set_id", item).select(
        "set_id", "item.pos", "item.track_id", F.when(kind.isin(TRANSITION_TYPES), kind).otherwise(fallback).alias("transition_type"))


def library_view(files: DataFrame, profiles: DataFrame, lyrics: DataFrame, failures: DataFrame) -> DataFrame:
    """Catalog joined with what is known about each item, with a status."""
    c = F.col
    lyr = lyrics.select(c("track_id").alias("item_id"), c("analysis_version").alias("_v"), "text", "source", "analysis_version",
                        "transcription_error", "has_meaning", "meaning_error", "meaning_version", "meaning_model",
                        "meaning_confidence", "transcription_confidence", F.lit(True).alias("has_lyrics"))
    failed = failures.select("item_id", F.lit(True).alias("failed")).distinct()
    df = files.join(profiles, "item_id", "left").join(lyr, "item_id", "left").join(failed, "item_id", "left")
    state = meaning_state(present=c("has_lyrics").isNotNull())
    return df.select(
        "item_id", "path",
        F.when(c("bpm").isNotNull(), "ready").when(c("has_lyrics"), "lyrics_only").when(c("failed"), "failed").otherwise("not_analyzed").alias("status"),
        F.round("bpm", 1).alias("bpm"), c("camelot").alias("key"), F.round(c("mean_energy") + 1e-9, 3).alias("energy"),
        F.round(c("meaning_confidence") + 1e-9, 3).alias("meaning_confidence"),
        state.alias("meaning_status"), lookup(state, STATE_VIEW, "uncertain").alias("lyrics_status"),
    )
