"""Catalog, cache and library queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.operators import catalog as ops
from segue.registry import query
from segue.sources.catalog import extension, keep_media
from segue.sources.tables import Tables

_c = F.col
_EXT = "lower(regexp_extract(path, '(\\.[^./\\\\]+)$', 1))"
_MEDIA = "('.mp3','.wav','.flac','.m4a','.aac','.ogg','.wma','.aiff')"


@query("catalog_scan", "files", f"select item_id, path, n_bytes, {_EXT} as format from files where {_EXT} in {_MEDIA} and not contains(path, 'blog.') and not contains(path, '/de/')")
def catalog_scan(t: Tables) -> DataFrame:
    files = t.derived("files").select("item_id", "path", "n_bytes")
    return keep_media(files, ["blog.", "/de/"]).withColumn("format", extension(_c("path")))


@query("library_summary", "files", f"""select {_EXT} as format, count(*) as n_tracks, cast(sum(n_bytes) as bigint) as total_bytes,
 round(sum(n_bytes / 1000.0::double), 6) as total_duration_sec from files where {_EXT} in {_MEDIA} group by rollup(1)""")
def library_summary(t: Tables) -> DataFrame:
    files = t.derived("files").select("path", "n_bytes", (_c("n_bytes") / 1000).alias("duration_sec"))
    return ops.library_summary(keep_media(files))


@query("content_fingerprint", "files", """, h as (select item_id, sha256(content) as file_hash from files)
select item_id, file_hash, min(item_id) over (partition by file_hash) as canonical_id, count(*) over (partition by file_hash) as copies,
 row_number() over (partition by file_hash order by item_id) = 1 as is_canonical from h""")
def content_fingerprint(t: Tables) -> DataFrame:
    return ops.content_fingerprint(t.derived("files"))


@query("profile_upsert", "cache_rows", """select file_hash, version, updated_at, tie, payload from
(select *, row_number() over (partition by file_hash order by updated_at desc, tie desc) as rn from cache_rows) where rn = 1""")
def profile_upsert(t: Tables) -> DataFrame:
    rows = t.cache_rows()
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return ops.upsert(rows.where(_c("updated_at") < cut), rows.where(_c("updated_at") >= cut), "file_hash", ["updated_at", "tie"])


_LATEST = "latest as (select * from (select *, row_number() over (partition by file_hash order by updated_at desc, tie desc) as rn from cache_rows) where rn = 1)"


def _latest(t: Tables) -> DataFrame:
    rows = t.cache_rows()
    return ops.upsert(rows, rows.limit(0), "file_hash", ["updated_at", "tie"])


@query("profile_assemble", "cache_rows semantic_rows lyric_rows", f""", {_LATEST}
select l.file_hash, l.payload, s.model_name, s.confidence, y.source as lyric_source, y.meaning_confidence
from latest l left join semantic_rows s on s.track_id = l.file_hash left join lyric_rows y on y.track_id = l.file_hash where l.version = 'F'""")
def profile_assemble(t: Tables) -> DataFrame:
    tracks = _latest(t).where(_c("version") == "F").select("file_hash", "payload")
    semantic = t.derived("semantic_rows").select(_c("track_id").alias("file_hash"), "model_name", "confidence")
    lyrics = t.derived("lyric_rows").select(_c("track_id").alias("file_hash"), _c("source").alias("lyric_source"), "meaning_confidence")
    return ops.assemble(tracks, semantic, lyrics)


@query("semantic_current", "semantic_rows", """select track_id, model_name, model_version, confidence from semantic_rows
where model_name = 'clap-b' and model_version = '2' and (source_hash = '' or source_hash = cast(track_id as varchar))""")
def semantic_current(t: Tables) -> DataFrame:
    return ops.semantic_current(t.derived("semantic_rows"), "clap-b", "2").select("track_id", "model_name", "model_version", "confidence")


@query("lyrics_current", "lyric_rows", """select track_id, source, length(text) as n_chars, transcription_model from lyric_rows
where analysis_version = '1' and source_hash in ('', cast(track_id as varchar)) and transcription_model in ('', 'large')""")
def lyrics_current(t: Tables) -> DataFrame:
    return ops.lyrics_current(t.derived("lyric_rows"), "1", "large").select(
        "track_id", "source", F.length("text").cast("bigint").alias("n_chars"), "transcription_model")


STATE_SQL = """case when analysis_version is null then 'NOT_ANALYZED' when analysis_version <> '1' then 'STALE_VERSION'
 when source = 'unavailable' and text = '' and transcription_error = '' then 'NO_LYRICS_AVAILABLE'
 when text = '' then 'TRANSCRIPTION_FAILED' when not has_meaning then 'TRANSCRIPT_READY_MEANING_MISSING'
 when meaning_error <> '' or meaning_version <> '2' or meaning_model <> 'local-model' then 'MEANING_INVALID'
 when meaning_confidence < 0.35 or transcription_confidence < 0.35 then 'MEANING_LOW_CONFIDENCE' else 'MEANING_READY' end"""
_VIEW_SQL = "case {s} when 'MEANING_READY' then 'ready' when 'MEANING_LOW_CONFIDENCE' then 'low_confidence' when 'MEANING_INVALID' then 'failed' when 'TRANSCRIPT_READY_MEANING_MISSING' then 'meaning_missing' when 'TRANSCRIPTION_FAILED' then 'failed' when 'NO_LYRICS_AVAILABLE' then 'unavailable' when 'NOT_ANALYZED' then 'not_analyzed' else 'stale' end"


@query("meaning_state", "lyric_rows", f", s as (select track_id, {STATE_SQL} as state from lyric_rows) select track_id, state, state in ('MEANING_READY','MEANING_LOW_CONFIDENCE') as is_current from s")
def meaning_state(t: Tables) -> DataFrame:
    return t.derived("lyric_rows").select("track_id", ops.meaning_state().alias("state")).withColumn("is_current", ops.meaning_is_current(_c("state")))


@query("meaning_summary", "lyric_rows", f", s as (select {STATE_SQL} as state from lyric_rows) select count(*) as total, count(*) filter (state='NOT_ANALYZED') as not_analyzed, count(*) filter (state='STALE_VERSION') as stale, count(*) filter (state='MEANING_READY') as ready, count(*) filter (state='MEANING_LOW_CONFIDENCE') as low_confidence, count(*) filter (state in ('MEANING_INVALID','TRANSCRIPTION_FAILED')) as failed, count(*) filter (state='NO_LYRICS_AVAILABLE') as unavailable, count(*) filter (state='TRANSCRIPT_READY_MEANING_MISSING') as missing from s")
def meaning_summary(t: Tables) -> DataFrame:
    s = t.derived("lyric_rows").select(ops.meaning_state().alias("state"))
    n = lambda *names: F.count_if(_c("state").isin(*names))
    return s.agg(
        F.count(F.lit(1)).alias("total"), n("NOT_ANALYZED").alias("not_analyzed"), n("STALE_VERSION").alias("stale"),
        n("MEANING_READY").alias("ready"), n("MEANING_LOW_CONFIDENCE").alias("low_confidence"),
        n("MEANING_INVALID", "TRANSCRIPTION_FAILED").alias("failed"), n("NO_LYRICS_AVAILABLE").alias("unavailable"),
        n("TRANSCRIPT_READY_MEANING_MISSING").alias("missing"))


@query("pending_work", "catalog cache_rows lyric_rows", f""", {_LATEST},
st as (select c.item_id, {STATE_SQL} as state from catalog c left join lyric_rows y on y.track_id = c.item_id)
select item_id, 'audio' as job, 'not cached at this version' as reason from catalog where item_id not in (select file_hash from latest where version = 'F')
union all select item_id, 'lyrics', case when state in ('TRANSCRIPT_READY_MEANING_MISSING','MEANING_INVALID') then 'retry meaning' else 'read lyrics' end from st
where state not in ('MEANING_READY','MEANING_LOW_CONFIDENCE')""")
def pending_work(t: Tables) -> DataFrame:
    cache = _latest(t).select(_c("file_hash").alias("item_id"), "version")
    return ops.pending_work(t.catalog().select("item_id"), cache, t.derived("lyric_rows"), "F")


@query("curve_decimate", "curve", """, x as (select *, count(*) over (partition by track_id) as c, row_number() over (partition by track_id order by t) - 1 as i from curve)
select track_id, t, level, n from x where i % (case when c > 200 then c // 200 else 1 end) = 0""")
def curve_decimate(t: Tables) -> DataFrame:
    return ops.decimate(t.curve(), "track_id", "t")


@query("cache_evict", "cache_rows semantic_rows lyric_rows", f""", {_LATEST}, gone as (select file_hash from latest where version = 'P')
select 'tracks' as tbl, count(*) as n_left from latest where file_hash not in (select file_hash from gone)
union all select 'semantic', count(*) from semantic_rows where track_id not in (select file_hash from gone)
union all select 'lyrics', count(*) from lyric_rows where track_id not in (select file_hash from gone)""")
def cache_evict(t: Tables) -> DataFrame:
    latest = _latest(t)
    gone = latest.where(_c("version") == "P").select("file_hash")
    out = None
    for name, df in [("tracks", latest), ("semantic", t.derived("semantic_rows").withColumnRenamed("track_id", "file_hash")),
                     ("lyrics", t.derived("lyric_rows").withColumnRenamed("track_id", "file_hash"))]:
        n = ops.evict(df, gone, "file_hash").agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n_left"))
        out = n if out is None else out.unionByName(n)
    return out


@query("cache_count", "cache_rows", f", {_LATEST} select count(*) as n_current from latest where version = 'F'")
def cache_count(t: Tables) -> DataFrame:
    return _latest(t).where(_c("version") == "F").agg(F.count(F.lit(1)).alias("n_current"))


@query("payload_parse", "reply_rows", "select event_id, case when json_valid(payload) then cast(json_extract(payload, '$.k') as bigint) end as k, not json_valid(payload) as malformed from reply_rows")
def payload_parse(t: Tables) -> DataFrame:
    return ops.parse_payload(t.derived("reply_rows"), "k bigint").select("event_id", _c("parsed.k").alias("k"), "malformed")


@query("plan_pack", "set_items", """select set_id, cast(to_json(list({'pos': pos, 'track_id': track_id, 'transition_type': transition_type} order by pos)) as varchar) as plan_json
from set_items group by set_id""")
def plan_pack(t: Tables) -> DataFrame:
    return ops.plan_pack(t.set_items())


@query("plan_flatten", "set_items", "select set_id, pos, track_id, case when track_id % 10 = 0 then 'crossfade' else transition_type end as transition_type from set_items")
def plan_flatten(t: Tables) -> DataFrame:
    items = t.set_items().withColumn("transition_type", F.when(_c("track_id") % 10 == 0, "mystery").otherwise(_c("transition_type")))
    return ops.plan_flatten(ops.plan_pack(items))


@query("library_view", "files tracks lyric_rows semantic_rows", f"""
, j as (select f.item_id, f.path, t.bpm, t.camelot, t.mean_energy, y.*, s.track_id is not null as failed
 from files f left join tracks t on t.track_id = f.item_id and t.track_id % 3 <> 0 left join lyric_rows y on y.track_id = f.item_id and y.track_id % 2 = 0
 left join semantic_rows s on s.track_id = f.item_id and s.label = 3)
select item_id, path, case when bpm is not null then 'ready' when track_id is not null then 'lyrics_only' when failed then 'failed' else 'not_analyzed' end as status,
 round(bpm, 1) as bpm, camelot as key, round(mean_energy + 1e-9, 3) as energy, round(meaning_confidence + 1e-9, 3) as meaning_confidence, {STATE_SQL} as meaning_status, {_VIEW_SQL.format(s='(' + STATE_SQL + ')')} as lyrics_status from j""")
def library_view(t: Tables) -> DataFrame:
    profiles = t.tracks().where(_c("track_id") % 3 != 0).select(_c("track_id").alias("item_id"), "bpm", "camelot", "mean_energy")
    lyrics = t.derived("lyric_rows").where(_c("track_id") % 2 == 0)
    failures = t.derived("semantic_rows").where(_c("label") == 3).select(_c("track_id").alias("item_id"))
    return ops.library_view(t.derived("files").select("item_id", "path"), profiles, lyrics, failures)
