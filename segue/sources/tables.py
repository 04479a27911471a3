"""Domain tables derived from the generic test tables.

Every method returns a lazy DataFrame over one Parquet scan, so Catalyst prunes
columns and pushes filters straight through the derivation. ``CTE`` holds the
same derivations as SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hours(ts: Column) -> Column:
    return ((F.dayofmonth(ts) - 1) * 24 + F.hour(ts)).cast("bigint")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def tracks(self) -> DataFrame:
        k = F.col("p_partkey")
        mode = F.when(F.floor(k / 12).cast("bigint") % 2 == 0, "A").otherwise("B")
        return self.raw("part").select(
            k.alias("track_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("artist"),
            F.lower("p_type").alias("format"),
            (60 + 2 * F.col("p_size")).cast("double").alias("bpm"),
            F.concat((k % 12 + 1).cast("string"), mode).alias("camelot"),
            F.round((F.col("p_retailprice") - 900) / 100, 4).alias("mean_energy"),
            (500 + 100 * (k % 37)).cast("double").alias("spectral_centroid"),
            ((k % 61).cast("double") / 60).alias("low_energy"),
            ((k % 67).cast("double") / 66).alias("mid_energy"),
            (120 + k % 181).cast("double").alias("duration_sec"),
            (-6 - k % 19).cast("double").alias("integrated_lufs"),
        )

    def curve(self) -> DataFrame:
        return (
            self.raw("events")
            .groupBy(F.col("user_id").alias("track_id"), _hours(F.col("ts")).alias("t"))
            .agg(F.round(F.avg("value"), 6).alias("level"), F.count(F.lit(1)).alias("n"))
        )

    def n_curves(self) -> Column:
        """Number of tracks that have a curve, as a scalar subquery: other keys fold onto them."""
        return self.raw("events").agg(F.max("user_id") + 1).scalar()

    def ratings(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("source_id"),
            F.col("l_suppkey").alias("target_id"),
            F.concat("l_returnflag", "l_linestatus").alias("transition_type"),
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round((F.col("l_discount") - 0.05) * 25, 4))).alias("rating"),
            F.col("l_shipdate").alias("created_at"),
        )

    def feedback(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").where(kind != "signup").select(
            "event_id",
            (F.col("event_id") % 97).alias("track_id"),
            "user_id",
            "ts",
            F.when(kind == "purchase", "like").when(kind == "error", "dislike").otherwise("play").alias("action"),
        )

    def set_items(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
        flags = F.concat("l_returnflag", "l_linestatus")
        kind = (
            F.when(flags == "AF", "crossfade").when(flags == "AO", "bass_swap").when(flags == "NF", "loop_blend")
            .when(flags == "NO", "filter_sweep").when(flags == "RF", "phrase_cut").otherwise("beatmatched_blend")
        )
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("set_id"),
            F.row_number().over(order).cast("bigint").alias("pos"),
            F.col("l_partkey").alias("track_id"),
            F.col("l_quantity").alias("overlap_sec"),
            kind.alias("transition_type"),
        )

    def sets(self) -> DataFrame:
        p = F.col("o_orderpriority")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("set_id"),
            F.round(F.col("o_totalprice") / 100, 4).alias("total_duration_sec"),
            F.when(p == "1-URGENT", "warmup_to_peak").when(p == "2-HIGH", "slow_build").when(p == "3-MEDIUM", "steady")
            .when(p == "4-NOT SPECIFIED", "wave").otherwise("cooldown").alias("energy_profile"),
        )

    def timeline(self) -> DataFrame:
        q = F.col("l_quantity")
        first = (F.col("l_linenumber") - 1) * 20
        src = F.col("l_partkey") % 100
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("mix_id"),
            (F.col("l_partkey") % 50).alias("track_id"),
            first.cast("bigint").alias("out_start"),
            (first + q).cast("bigint").alias("out_end"),
            src.alias("src_start"),
            (src + q).cast("bigint").alias("src_end"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("tie"),
        )

    def regions(self) -> DataFrame:
        ts = F.col("ts")
        minute = (_hours(ts) * 60 + F.minute(ts)).cast("double")
        return self.raw("events").where(F.col("event_type").isin("view", "click")).select(
            F.col("user_id").alias("track_id"),
            "event_id",
            minute.alias("start_t"),
            (minute + F.col("value")).alias("end_t"),
        )

    def words(self) -> DataFrame:
        start = (F.col("turn") * 10).cast("double")
        return self.raw("conversations").select(
            F.col("conv_id").alias("track_id"),
            F.col("turn").alias("idx"),
            start.alias("start_sec"),
            (start + F.least(F.lit(9.0), F.round(F.length("text").cast("double") / 20, 4))).alias("end_sec"),
            F.length("text").cast("bigint").alias("n_chars"),
        )

    def requests(self) -> DataFrame:
        k, n = F.col("c_custkey"), F.col("c_nationkey")
        low = (k % 5).cast("double") / 10
        return self.raw("customer").select(
            k.alias("request_id"),
            (60 + 2 * n).cast("double").alias("bpm_min"),
            (100 + 2 * n).cast("double").alias("bpm_max"),
            low.alias("energy_min"),
            (low + 0.5).alias("energy_max"),
            (600 + k % 1200).cast("double").alias("target_duration_sec"),
            F.lower("c_mktsegment").alias("style_word"),
        )

    def cache_rows(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_custkey").alias("file_hash"),
            F.col("o_orderstatus").alias("version"),
            F.col("o_orderdate").alias("updated_at"),
            F.col("o_orderkey").alias("tie"),
            F.col("o_totalprice").alias("payload"),
        )

    def semantic(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("track_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")
        )

    def lyrics(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("track_id"), "lang", "source", "n_chars",
            F.length("text").cast("bigint").alias("len"), "text",
        )

    def catalog(self) -> DataFrame:
        return self.raw("pages").select(
            F.col("page_id").alias("item_id"), F.col("url").alias("path"),
            F.sha2("html", 256).alias("file_hash"), F.length("html").cast("bigint").alias("n_bytes"),
        )

    def derived(self, name: str) -> DataFrame:
        """Fixture columns computed row by row from one raw table (see ``DERIVED``)."""
        base, exprs = DERIVED[name]
        return self.raw(base).selectExpr(*exprs)

    def handoffs(self) -> DataFrame:
        """Consecutive items of each set: the ordered pairs that really occur."""
        w = Window.partitionBy("set_id").orderBy("pos")
        return (
            self.set_items()
            .withColumn("dst", F.lead("track_id").over(w))
            .where(F.col("dst").isNotNull())
            .select("set_id", "pos", F.col("track_id").alias("src"), "dst", "overlap_sec", "transition_type")
        )

    def handoff_pairs(self) -> DataFrame:
        """``handoffs`` with the features of both ends as ``a_*`` and ``b_*``."""
        cols = ["title", "bpm", "camelot", "mean_energy", "spectral_centroid", "low_energy", "mid_energy",
                "duration_sec", "integrated_lufs"]
        tracks = self.tracks()
        a = tracks.select(F.col("track_id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in cols])
        b = tracks.select(F.col("track_id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in cols])
        return self.handoffs().join(a, "src").join(b, "dst")


CTE = {
    "tracks": """select p_partkey as track_id, p_name as title, p_brand as artist, lower(p_type) as format,
  cast(60 + 2 * p_size as double) as bpm,
  concat(cast(p_partkey % 12 + 1 as string), case when cast(floor(p_partkey / 12) as bigint) % 2 = 0 then 'A' else 'B' end) as camelot,
  round((p_retailprice - 900) / 100, 4) as mean_energy,
  cast(500 + 100 * (p_partkey % 37) as double) as spectral_centroid,
  cast(p_partkey % 61 as double) / 60 as low_energy,
  cast(p_partkey % 67 as double) / 66 as mid_energy,
  cast(120 + p_partkey % 181 as double) as duration_sec,
  cast(-6 - p_partkey % 19 as double) as integrated_lufs
from part""",
    "curve": """select user_id as track_id,
  cast((extract(day from ts) - 1) * 24 + extract(hour from ts) as bigint) as t,
  round(avg(value), 6) as level, count(*) as n
from events group by 1, 2""",
    "ratings": """select l_partkey as source_id, l_suppkey as target_id, concat(l_returnflag, l_linestatus) as transition_type,
  greatest(cast(-1 as double), least(cast(1 as double), round((l_discount - 0.05) * 25, 4))) as rating, l_shipdate as created_at
from lineitem""",
    "feedback": """select event_id, event_id % 97 as track_id, user_id, ts,
  case event_type when 'purchase' then 'like' when 'error' then 'dislike' else 'play' end as action
from events where event_type <> 'signup'""",
    "set_items": """select l_orderkey as set_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) as pos,
  l_partkey as track_id, l_quantity as overlap_sec,
  case concat(l_returnflag, l_linestatus) when 'AF' then 'crossfade' when 'AO' then 'bass_swap' when 'NF' then 'loop_blend'
    when 'NO' then 'filter_sweep' when 'RF' then 'phrase_cut' else 'beatmatched_blend' end as transition_type
from lineitem""",
    "sets": """select o_orderkey as set_id, round(o_totalprice / 100, 4) as total_duration_sec,
  case o_orderpriority when '1-URGENT' then 'warmup_to_peak' when '2-HIGH' then 'slow_build' when '3-MEDIUM' then 'steady'
    when '4-NOT SPECIFIED' then 'wave' else 'cooldown' end as energy_profile
from orders""",
    "timeline": """select l_orderkey as mix_id, l_partkey % 50 as track_id, cast((l_linenumber - 1) * 20 as bigint) as out_start,
  cast((l_linenumber - 1) * 20 + l_quantity as bigint) as out_end, l_partkey % 100 as src_start,
  cast(l_partkey % 100 + l_quantity as bigint) as src_end, cast(round(l_extendedprice * 100) as bigint) as tie
from lineitem""",
    "regions": """select user_id as track_id, event_id,
  cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) * 60 + extract(minute from ts) as double) as start_t,
  cast(((extract(day from ts) - 1) * 24 + extract(hour from ts)) * 60 + extract(minute from ts) as double) + value as end_t
from events where event_type in ('view', 'click')""",
    "words": """select conv_id as track_id, turn as idx, cast(turn * 10 as double) as start_sec,
  cast(turn * 10 as double) + least(cast(9 as double), round(cast(length(text) as double) / 20, 4)) as end_sec, length(text) as n_chars
from conversations""",
    "requests": """select c_custkey as request_id, cast(60 + 2 * c_nationkey as double) as bpm_min, cast(100 + 2 * c_nationkey as double) as bpm_max,
  cast(c_custkey % 5 as double) / 10 as energy_min, cast(c_custkey % 5 as double) / 10 + 0.5 as energy_max,
  cast(600 + c_custkey % 1200 as double) as target_duration_sec, lower(c_mktsegment) as style_word
from customer""",
    "cache_rows": """select o_custkey as file_hash, o_orderstatus as version, o_orderdate as updated_at, o_orderkey as tie, o_totalprice as payload
from orders""",
    "semantic": """select vec_id as track_id, label, cast(embedding as double[]) as embedding from embeddings""",
    "lyrics": """select doc_id as track_id, lang, source, n_chars, length(text) as len, text from documents""",
    "catalog": """select page_id as item_id, url as path, sha256(html) as file_hash, length(html) as n_bytes from pages""",
    "handoffs": """select set_id, pos, track_id as src, dst, overlap_sec, transition_type
from (select *, lead(track_id) over (partition by set_id order by pos) as dst from set_items) where dst is not null""",
    "handoff_pairs": """select h.*, a.title as a_title, a.bpm as a_bpm, a.camelot as a_camelot, a.mean_energy as a_mean_energy,
  a.spectral_centroid as a_spectral_centroid, a.low_energy as a_low_energy, a.mid_energy as a_mid_energy,
  a.duration_sec as a_duration_sec, a.integrated_lufs as a_integrated_lufs,
  b.title as b_title, b.bpm as b_bpm, b.camelot as b_camelot, b.mean_energy as b_mean_energy,
  b.spectral_centroid as b_spectral_centroid, b.low_energy as b_low_energy, b.mid_energy as b_mid_energy,
  b.duration_sec as b_duration_sec, b.integrated_lufs as b_integrated_lufs
from handoffs h join tracks a on a.track_id = h.src join tracks b on b.track_id = h.dst""",
}

# Row-wise fixture derivations whose expressions read the same in both engines.
DERIVED = {
    "files": ("pages", [
        "page_id as item_id",
        "concat(url, case page_id % 6 when 0 then '.mp3' when 1 then '.WAV' when 2 then '.flac' when 3 then '.txt' when 4 then '.m4a' else '.ogg' end) as path",
        "html as content", "cast(length(html) as bigint) as n_bytes",
    ]),
    "lyric_rows": ("documents", [
        "doc_id as track_id",
        "case when doc_id % 11 = 0 then '0' else '1' end as analysis_version",
        "case when doc_id % 7 = 0 then 'unavailable' else source end as source",
        "case when doc_id % 5 = 0 then '' else text end as text",
        "case when doc_id % 3 = 0 then 'decoder failed' else '' end as transcription_error",
        "doc_id % 4 <> 0 as has_meaning",
        "case when doc_id % 13 = 0 then 'bad reply' else '' end as meaning_error",
        "case when doc_id % 9 = 1 then '1' else '2' end as meaning_version",
        "case when doc_id % 8 = 1 then 'other-model' else 'local-model' end as meaning_model",
        "cast(doc_id % 10 as double) / 10 as meaning_confidence",
        "cast(doc_id % 12 as double) / 12 as transcription_confidence",
        "case when doc_id % 6 = 0 then '' when doc_id % 6 = 1 then cast(doc_id + 1 as string) else cast(doc_id as string) end as source_hash",
        "case doc_id % 3 when 0 then '' when 1 then 'large' else 'small' end as transcription_model",
    ]),
    "semantic_rows": ("embeddings", [
        "vec_id as track_id", "label",
        "case label % 3 when 0 then 'clap-a' else 'clap-b' end as model_name",
        "cast(vec_id % 2 + 1 as string) as model_version",
        "case vec_id % 4 when 0 then '' when 1 then cast(vec_id + 7 as string) else cast(vec_id as string) end as source_hash",
        "cast(vec_id % 20 as double) / 19 as confidence",
    ]),
    "taste_log": ("events", [
        "event_id", "user_id", "ts", "case when event_type in ('click', 'view') then 'bpm' else 'energy' end as kind",
        "round(value * 0.2 + 60, 4) as low", "round(value * 0.2 + 90, 4) as high",
    ]),
    "correction_log": ("events", [
        "event_id", "event_id % 97 as track_id", "ts", "event_type as audio_tag", "user_id % 20 as theme_no",
    ]),
    "mix_log": ("orders", [
        "o_custkey as mix_id", "o_orderdate as created_at", "o_orderkey as tie",
        "cast(floor(o_totalprice / 70000) as bigint) as rating",
    ]),
    "reply_rows": ("events", ["event_id", "case when event_id % 17 = 0 then left(props, 4) else props end as payload"]),
}
CTE.update({name: f"select {', '.join(exprs)} from {base}" for name, (base, exprs) in DERIVED.items()})

_NEEDS = {"handoffs": ["set_items"], "handoff_pairs": ["set_items", "handoffs", "tracks"]}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """SQL text: the named derivations as CTEs (space separated), then ``body``.

    ``body`` may open with its own CTE list, marked by a leading comma; ``recursive`` lets its CTEs use themselves.
    """
    ordered: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    head = ",\n".join(f"{n} as ({CTE[n]})" for n in ordered)
    body = body.strip()
    return f"with {'recursive ' if recursive else ''}{head}\n{body}" if ordered else body
