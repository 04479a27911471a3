"""Streaming queries, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.plans.feedback import STATE
from segue.registry import query
from segue.sources.tables import Tables
from segue.streaming import feedback as ops
from segue.streaming.violations import gap_stream


class StreamTables(Tables):
    """The same derivations with every raw table read as a stream."""

    def raw(self, name: str) -> DataFrame:
        return ops.read_stream(self.spark, self.sf_dir, f"{name}.parquet")


def _live(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


@query("stream_feedback_state", "feedback", f", {STATE} select * from state")
def stream_feedback_state(t: Tables) -> DataFrame:
    return ops.drain(ops.feedback_state(_live(t).feedback()), "feedback-state", ["track_id"])


@query("stream_transition_avg", "ratings", "select source_id, target_id, transition_type, round(avg(rating), 6) as avg_rating, count(*) as n from ratings group by 1, 2, 3")
def stream_transition_avg(t: Tables) -> DataFrame:
    return ops.drain(ops.transition_avg(_live(t).ratings()), "transition-avg", ["source_id", "target_id", "transition_type"])


@query("stream_plays_windowed", "feedback", "select track_id, date_trunc('day', ts) as window_start, count(*) as plays from feedback where action = 'play' group by 1, 2")
def stream_plays_windowed(t: Tables) -> DataFrame:
    """Update mode emits the open last day as well."""
    plays = _live(t).feedback().where(F.col("action") == "play").withColumn("ts", F.col("ts").cast("timestamp"))
    return ops.drain(ops.plays_windowed(plays), "plays", ["track_id", "window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_cache_upsert", "cache_rows", """select file_hash, updated_at, tie, version, payload from (select *, row_number() over (partition by file_hash order by updated_at desc, tie desc) as rn from cache_rows) where rn = 1""")
def stream_cache_upsert(t: Tables) -> DataFrame:
    return ops.drain(ops.cache_upsert(_live(t).cache_rows(), "file_hash", ["updated_at", "tie"], ["version", "payload"]), "cache", ["file_hash"])


@query("stream_violations", "timeline", """, g as (select *, greatest(0, coalesce(max(out_end) over (partition by mix_id order by out_start, tie, track_id, src_start, src_end rows between unbounded preceding and 1 preceding), 0)) as expected from timeline)
select mix_id, out_start, expected, case when out_start > expected then 'output_gap' else 'output_overlap' end as kind from g where out_start <> expected""")
def stream_violations(t: Tables) -> DataFrame:
    return ops.drain(gap_stream(t.spark, _live(t).timeline()), "violations")
