"""Lyric text: sidecar lines, source choice, transcript quality, keyword meaning, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue.functions.basic import clip, joined, lookup
from segue.functions.vocab import ACTIVITIES, INTENSITIES, LYRICAL_MOODS, MOODS, RELATIONSHIPS, STYLES, THEMES

# fixed values: keyword groups of the offline meaning fallback
MEANING_TERMS = {
    "heartbreak": ["heartbreak", "broken heart", "break up", "breakup", "goodbye"],
    "love": ["love", "lover", "darling", "kiss"],
    "romance": ["romance", "romantic", "together", "forever"],
    "longing": ["miss you", "missing you", "alone", "without you"],
    "party": ["party", "dance", "tonight", "celebrate"],
    "hope": ["hope", "heal", "better", "tomorrow", "rise"],
    "anger": ["hate", "angry", "fight", "rage"],
    "loss": ["lost", "loss", "gone", "dead"],
    "freedom": ["free", "freedom", "escape"],
}
STAMP = r"\[(\d{1,2}):(\d{2})(?:[.:](\d{1,3}))?\]"


def sidecar_lines(files: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per time stamp of each non-empty line; a line without stamps starts at 0."""
    lines = files.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    clean = F.trim(F.regexp_replace("line", r"\[\d{1,2}:\d{2}(?:[.:]\d{1,3})?\]", ""))
    found = F.regexp_extract_all("line", F.lit(STAMP), F.lit(0))
    stamps = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    rows = lines.select(*keys, "line_no", clean.alias("text"), stamps.alias("s")).where(F.col("text") != "")
    one = rows.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "text", F.posexplode("s").alias("k", "stamp"))
    part = lambda i: F.regexp_extract("stamp", STAMP, i)
    seconds = part(1).cast("int") * 60 + part(2).cast("int") + F.when(part(3) != "", F.concat(F.lit("0."), part(3)).cast("double")).otherwise(0.0)
    return one.select(*keys, "line_no", F.col("k").cast("bigint").alias("k"), "text",
                      F.round(F.when(F.col("stamp") == "", 0.0).otherwise(seconds), 3).alias("start_sec"))


def pick_source(candidates: DataFrame, key: str) -> DataFrame:
    """Embedded text (longest first) before .lrc before .txt; blank text never counts."""
    rank = lookup(F.col("kind"), {"embedded": 3, "lrc": 2, "txt": 1})
    usable = F.trim("text") != ""
    best = F.max_by(F.struct("kind", "text"), F.when(usable, F.struct(rank, F.length("text"), -F.col("ord"))))
    got = candidates.groupBy(key).agg(best.alias("b"))
    source = F.when(F.col("b").isNull(), "unavailable").when(F.col("b.kind") == "embedded", "embedded").otherwise("sidecar")
    return got.select(key, source.alias("source"), F.col("b.kind").alias("kind"), F.length("b.text").cast("bigint").alias("n_chars"))


def transcript_quality(segments: DataFrame, track: DataFrame) -> DataFrame:
    """Confidence and repetition flag of a transcript.

    ``segments``: track_id, idx, start_sec, end_sec, text, avg_logprob; ``track``: track_id,
    duration_sec, language_probability.
    """
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9\u0080-￿]+", " "))
    a = segments.withColumn("norm", norm).groupBy("track_id").agg(
        F.count_if(F.trim("text") != "").alias("n"),
        F.count_distinct(F.when(F.trim("text") != "", F.col("norm"))).alias("u"),
        F.sum(F.length("norm")).alias("chars"),
        F.greatest(F.lit(1.0), F.max_by("end_sec", "idx") - F.min_by("start_sec", "idx")).alias("dur"),
        F.avg(F.exp(clip(F.col("avg_logprob"), -10.0, 0.0))).alias("acoustic"),
    ).join(track, "track_id")
    c = F.col
    repeated = (c("n") >= 3) & (c("u") <= F.greatest(F.lit(1), F.floor(c("n") / 3)))
    base = clip(0.30 * c("language_probability") + 0.30 * F.coalesce("acoustic", F.lit(0.0)) + 0.20 * F.least(F.lit(1.0), c("chars") / (c("dur") * 7))
                + 0.20 * F.least(F.lit(1.0), c("dur") / (c("duration_sec") * 0.35)))
    share = c("dur") / c("duration_sec")
    thin = F.when(share < 0.10, F.greatest(F.lit(0.05), share / 0.10)).otherwise(1.0)
    conf = base * F.when(repeated, 0.15).otherwise(1.0) * thin
    empty = c("n") == 0
    return a.select("track_id", F.when(empty, 0.0).otherwise(F.round(conf + 1e-9, 4)).alias("confidence"), (repeated & ~empty).alias("repeated"))


def transcript_gate(rows: DataFrame) -> DataFrame:
    """Which text is kept, from where, and with what confidence.

    ``rows``: existing_text, own_text, own_source, asr_text, asr_confidence, asr_repeated, meaning_failed, meaning_confidence.
    """
    c = F.col
    bad = c("asr_repeated") | (c("asr_confidence") < 0.35)
    case = F.when(c("existing_text") != "", "reused").when(c("own_text") != "", "own").when(c("asr_text") == "", "none").when(bad, "rejected").otherwise("transcribed")
    d = rows.withColumn("outcome", case)
    return d.select(
        "*",
        F.when(c("outcome") == "reused", c("existing_text")).when(c("outcome") == "own", c("own_text")).when(c("outcome") == "transcribed", c("asr_text")).otherwise("").alias("text"),
        F.when(c("outcome") == "own", 1.0).when(c("outcome") == "reused", c("existing_confidence")).when(c("outcome") == "none", 0.0).otherwise(c("asr_confidence")).alias("confidence"),
        F.when(c("meaning_failed"), F.least(c("meaning_confidence"), F.lit(0.25))).otherwise(c("meaning_confidence")).alias("kept_meaning_confidence"),
    )


def occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("bigint")


def keyword_meaning(lyrics: DataFrame, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """Themes, moods and bounded scores from keyword counts over the whole text.

    The vocabulary is small and fixed, so counts are expressions on the row.
    """
    terms = terms or MEANING_TERMS
    low = lyrics.withColumn("_t", F.lower("text"))
    counts = []
    for g, words in terms.items():
        n = None
        for w in words:
            n = occurrences(F.col("_t"), w) if n is None else n + occurrences(F.col("_t"), w)
        counts.append(n.alias(f"n_{g}"))
    d = low.select("track_id", *counts)
    n = lambda g: F.col(f"n_{g}") if g in terms else F.lit(0)
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-n(g)).alias("c"), F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(terms)]), lambda x: x["c"] < 0))
    cap = lambda x: F.least(F.lit(1.0), x)
    d = d.select(
        "*", F.transform(ranked, lambda x: x["g"]).alias("ranked"),
        cap((n("heartbreak") + n("longing") + n("loss")) / 5.0).alias("sadness"), cap(n("hope") / 4.0).alias("hopefulness"),
        cap(n("party") / 4.0).alias("party_context"), cap((n("love") + n("romance")) / 6.0).alias("romance"), cap(n("anger") / 4.0).alias("anger"),
    )
    c = F.col
    moods = F.filter(F.array(
        F.when(c("sadness") > 0.25, "sad"), F.when(c("sadness") > 0.25, "melancholic"), F.when(c("hopefulness") > 0.25, "hopeful"),
        F.when(c("party_context") > 0.25, "happy"), F.when(c("party_context") > 0.25, "celebratory"),
        F.when(c("romance") > 0.25, "romantic"), F.when(n("anger") > 0, "angry")), lambda x: x.isNotNull())
    every = None
    for g in terms:
        every = n(g) if every is None else every + n(g)
    return d.select(
        "track_id", F.slice("ranked", 1, 3).alias("primary_themes"), F.slice("ranked", 4, 3).alias("secondary_themes"), F.slice(moods, 1, 4).alias("lyrical_moods"),
        clip(c("hopefulness") + c("party_context") - c("sadness") - n("anger") / 5.0, -1.0, 1.0).alias("emotional_valence"),
        cap(every / 12.0).alias("emotional_intensity"), "party_context", "hopefulness", "sadness", "romance", "anger",
        c("party_context").alias("celebration"), F.when(F.size("ranked") > 0, 0.25).otherwise(0.0).alias("meaning_confidence"),
    )


LABEL_FIELDS = {"themes": THEMES, "lyrical_moods": LYRICAL_MOODS, "audio_tags": MOODS + ACTIVITIES + INTENSITIES + STYLES}


def _unknown(labels: Column, allowed: list[str]) -> Column:
    return F.array_sort(F.array_except(labels, F.array(*[F.lit(x) for x in allowed])))


def validate_labels(rows: DataFrame, fields: dict[str, list[str]] | None = None, cap: int = 8) -> DataFrame:
    """Distinct, capped label lists and an ``error`` for rows with unknown labels or no label at all."""
    fields = fields or LABEL_FIELDS
    errors, total = [], F.lit(0)
    for f, allowed in fields.items():
        bad = _unknown(F.col(f), allowed)
        errors.append(F.when(F.size(bad) > 0, F.concat(F.lit(f"unknown labels in {f}: "), F.concat_ws(", ", bad))))
        total = total + F.size(F.col(f))
    message = joined(*errors)
    kept = [F.slice(F.array_distinct(F.col(f)), 1, cap).alias(f) for f in fields]
    others = [c for c in rows.columns if c not in fields]
    return rows.select(*others, *kept, F.when(message != "", message).when(total == 0, "no labels").alias("error"))


MEANING_SCHEMA = T.StructType(
    [T.StructField(f, T.ArrayType(T.StringType())) for f in ("primary_themes", "secondary_themes", "lyrical_moods")]
    + [T.StructField("relationship_context", T.StringType())]
    + [T.StructField(f, T.DoubleType()) for f in ("emotional_valence", "emotional_intensity", "party_context", "hopefulness", "sadness", "romance", "anger", "celebration", "meaning_confidence")]
)


def meaning_from_reply(rows: DataFrame, reply: str) -> DataFrame:
    """First JSON object of a model reply, validated and clamped; bad replies carry an error."""
    body = F.regexp_extract(F.col(reply), r"(?s)(\{.*\})", 1)
    m = rows.withColumn("m", F.from_json(F.when(body != "", body), MEANING_SCHEMA))
    keep = [c for c in rows.columns if c != reply]
    lists = {"primary_themes": THEMES, "secondary_themes": THEMES, "lyrical_moods": LYRICAL_MOODS}
    empty = F.array().cast("array<string>")
    flat = m.select(*keep, "m", *[F.coalesce(F.col(f"m.{f}"), empty).alias(f) for f in lists],
                    F.coalesce("m.relationship_context", F.lit("")).alias("relationship_context"),
                    *[clip(F.coalesce(F.col(f"m.{s.name}"), F.lit(0.0)), -1.0 if s.name == "emotional_valence" else 0.0, 1.0).alias(s.name) for s in MEANING_SCHEMA.fields[4:]])
    bad = [F.when(F.size(_unknown(F.col(f), a)) > 0, F.concat(F.lit(f"unknown labels in {f}: "), F.concat_ws(", ", _unknown(F.col(f), a)))) for f, a in lists.items()]
    rel = F.when(~F.col("relationship_context").isin(RELATIONSHIPS), F.concat(F.lit("unknown relationship_context: "), F.col("relationship_context")))
    error = F.when(F.col("m").isNull(), "no JSON object").otherwise(F.nullif(joined(*bad, rel), F.lit("")))
    cols = [F.slice(F.array_distinct(F.col(c)), 1, 6).alias(c) if c in lists else F.col(c) for c in flat.columns if c not in ("m", *keep)]
    return flat.select(*keep, *cols, error.alias("error"))


def overlay(profiles: DataFrame, corrections: DataFrame) -> DataFrame:
    """User labels replace automatic labels at confidence 1.0; automatic columns stay untouched.

    ``profiles``: track_id, themes, moods, meaning_confidence, mood_scores, semantic_confidence;
    ``corrections``: track_id, themes, lyrical_moods, audio_tags.
    """
    c = corrections.select("track_id", F.col("themes").alias("c_themes"), F.col("lyrical_moods").alias("c_moods"), F.col("audio_tags").alias("c_tags"))
    d = profiles.join(c, "track_id", "left")
    has = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    words = has("c_themes") | has("c_moods")
    ones = F.map_from_arrays("c_tags", F.transform("c_tags", lambda x: F.lit(1.0)))
    merged = F.map_from_entries(F.concat(
        F.filter(F.map_entries("mood_scores"), lambda e: ~F.array_contains("c_tags", e["key"])), F.map_entries(ones)))
    return d.select(
        "track_id", F.when(has("c_themes"), F.col("c_themes")).otherwise(F.col("themes")).alias("themes"),
        F.when(has("c_moods"), F.col("c_moods")).otherwise(F.col("moods")).alias("moods"),
        F.when(words, 1.0).otherwise(F.col("meaning_confidence")).alias("meaning_confidence"),
        F.when(has("c_tags"), merged).otherwise(F.col("mood_scores")).alias("mood_scores"),
        F.when(has("c_tags"), 1.0).otherwise(F.col("semantic_confidence")).alias("semantic_confidence"),
        words.alias("corrected_words"), has("c_tags").alias("corrected_tags"),
    )
