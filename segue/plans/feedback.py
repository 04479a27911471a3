"""Ratings, likes, plays, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.operators import feedback as ops
from segue.registry import query
from segue.sources.tables import Tables


@query("transition_avg", "ratings", """select source_id, target_id, transition_type, round(avg(rating), 6) as avg_rating, count(*) as n
from ratings group by grouping sets ((source_id, target_id), (source_id, target_id, transition_type))""")
def transition_avg(t: Tables) -> DataFrame:
    return ops.transition_avg(t.ratings())


@query("preferred_types", "ratings", """select transition_type, round(avg(rating), 6) as avg_rating, count(*) as n from ratings
group by 1 having count(*) >= 3 order by avg_rating desc""")
def preferred_types(t: Tables) -> DataFrame:
    return ops.preferred_types(t.ratings()).orderBy(F.desc("avg_rating"), "transition_type")


STATE = """state as (select track_id, cast(coalesce(arg_max(case action when 'like' then 1 else -1 end, (ts, event_id)) filter (where action <> 'play'), 0) as bigint) as liked,
  count(*) as play_count, max(ts) as updated_at from feedback group by track_id)"""


@query("feedback_state", "feedback", f", {STATE} select * from state")
def feedback_state(t: Tables) -> DataFrame:
    return ops.feedback_state(t.feedback())


@query("liked_tracks", "feedback", f", {STATE} select track_id from state where liked = 1")
def liked_tracks(t: Tables) -> DataFrame:
    return ops.feedback_state(t.feedback()).where("liked = 1").select("track_id")


@query("disliked_tracks", "feedback", f", {STATE} select track_id from state where liked = -1")
def disliked_tracks(t: Tables) -> DataFrame:
    return ops.feedback_state(t.feedback()).where("liked = -1").select("track_id")


@query("most_played", "feedback", f", {STATE} select track_id, play_count from state order by play_count desc, track_id limit 10")
def most_played(t: Tables) -> DataFrame:
    return ops.most_played(ops.feedback_state(t.feedback()), 10)


@query("mix_ratings", "mix_log", """select mix_id, created_at, tie, greatest(1, least(5, rating)) as stored, rating between 1 and 5 as accepted,
  row_number() over (partition by mix_id order by created_at desc, tie desc) as newest_rank from mix_log""")
def mix_ratings(t: Tables) -> DataFrame:
    return ops.mix_ratings(t.derived("mix_log"))


@query("mix_rating_avg", "mix_log", "select mix_id, round(avg(greatest(1, least(5, rating))), 6) as avg_rating, count(*) as n from mix_log group by 1")
def mix_rating_avg(t: Tables) -> DataFrame:
    return ops.mix_average(t.derived("mix_log"))


RANGES = "ranges as (select user_id, kind, arg_max(low, (ts, event_id)) as low, arg_max(high, (ts, event_id)) as high from taste_log group by 1, 2)"


@query("preference_ranges", "taste_log", f", {RANGES} select * from ranges")
def preference_ranges(t: Tables) -> DataFrame:
    return ops.preference_ranges(t.derived("taste_log"))


@query("scoring_bonuses", "feedback ratings taste_log", f""", {STATE}, {RANGES},
types as (select transition_type, round(avg(rating), 6) as r from ratings group by 1 having count(*) >= 3)
select case when liked > 0 then 'liked_track' else 'disliked_track' end as kind, cast(track_id as varchar) as item, null::double as low, null::double as high from state where liked <> 0
union all select case when r > 0 then 'preferred_type' else 'disliked_type' end, transition_type, r, null from types where r <> 0
union all select kind || '_range', cast(user_id as varchar), low, high from ranges""")
def scoring_bonuses(t: Tables) -> DataFrame:
    return ops.scoring_bonuses(t.feedback(), t.ratings(), ops.preference_ranges(t.derived("taste_log")))


@query("correction_latest", "correction_log", """
, last as (select track_id, arg_max(audio_tag, (ts, event_id)) as a, arg_max(theme_no, (ts, event_id)) as th, max(ts) as updated_at from correction_log group by 1)
select track_id, '{"audio_tag":"' || a || '","theme_no":' || th || '}' as corrections_json, updated_at from last""")
def correction_latest(t: Tables) -> DataFrame:
    return ops.correction_latest(t.derived("correction_log"))


@query("preference_summary", "feedback", """
, per as (select user_id, track_id, arg_max(case action when 'like' then 1 else -1 end, (ts, event_id)) filter (where action <> 'play') as liked,
  count(*) as n, count(*) filter (where action = 'play') as p from feedback group by 1, 2)
select user_id, count(*) filter (where liked = 1) as liked_tracks, count(*) filter (where liked = -1) as disliked_tracks,
  cast(sum(n) as bigint) as events, cast(sum(p) as bigint) as plays from per group by 1""")
def preference_summary(t: Tables) -> DataFrame:
    return ops.preference_summary(t.feedback())


_WORD = "case event_type when 'view' then 'great' when 'click' then 'good' when 'purchase' then 'bad' when 'error' then 'too abrupt' else 'superb' end"


@query("rating_label_score", "", f"""with w as (select event_id, {_WORD} as word from events)
select event_id, word, (case word when 'great' then 1.0::double when 'good' then 0.7::double when 'bad' then -1.0::double when 'too abrupt' then -0.6::double end) as rating,
 word not in ('great','good','bad','too abrupt','too long','too weak') as rejected from w""")
def rating_label_score(t: Tables) -> DataFrame:
    df = t.raw("events").selectExpr("event_id", f"{_WORD} as word").withColumn("rating", ops.rating_value(F.col("word")))
    return df.withColumn("rejected", F.col("rating").isNull())
