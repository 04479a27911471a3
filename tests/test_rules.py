"""Boundary cases on tiny frames."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from segue.functions import pair as P
from segue.functions import vectors as V
from segue.operators import catalog, feedback, intervals, pairs, sets
from segue.sources.catalog import keep_media, scan_directory


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,want", [(120.0, 120.0, 1.0), (120.0, 60.0, 1.0), (0.0, 120.0, 0.5), (100.0, 104.0, 0.9)])
def test_tempo_score(spark, a, b, want):
    got = one(spark, P.tempo_score(F.lit(a), F.lit(b)))
    if want is not None:
        assert got == pytest.approx(want)
    assert 0.05 <= got <= 1.0


@pytest.mark.parametrize("a,b,want", [("8A", "8A", 0), ("8A", "8B", 1), ("12A", "1A", 1), ("12A", "1B", 2), ("1A", "7A", 6), ("", "1A", 6), ("8A", "10B", 3)])
def test_wheel_distance(spark, a, b, want):
    assert one(spark, P.wheel_distance(F.lit(a), F.lit(b))) == want


def test_blank_key_is_neutral(spark):
    assert one(spark, P.key_score(F.lit(""), F.lit("8A"))) == 0.5


def test_merge_close_and_runs(spark):
    r = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.4, 2.0), (1, 2.5, 3.0), (1, 0.2, 5.0), (1, 6.0, 7.0)], "track_id int, s double, e double")
    got = sorted(tuple(x) for x in intervals.merge_close(r, ["track_id"], "s", "e", 0.5).collect())
    assert got == [(1, 0.0, 5.0), (1, 6.0, 7.0)]
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 1, 1, 0, 1])], "track_id int, i long, v int")
    assert sorted((x.start_i, x.end_i) for x in intervals.runs(f, ["track_id"], "i", F.col("v") > 0).collect()) == [(1, 3), (4, 5)]


def test_overlap_join_matches_nested_loop(spark):
    rng = random.Random(7)
    a = [(rng.randint(0, 1), i, s := rng.uniform(0, 100), s + rng.uniform(0, 30)) for i in range(60)]
    b = [(rng.randint(0, 1), i, s := rng.uniform(0, 100), s + rng.uniform(0, 30)) for i in range(60)]
    da = spark.createDataFrame(a, "k int, ai int, s double, e double")
    db = spark.createDataFrame(b, "k int, bi int, rs double, re double")
    for width in (3.0, 50.0):
        got = sorted((r.ai, r.bi) for r in intervals.overlap_join(da, db, "k", ("s", "e"), ("rs", "re"), width).collect())
        assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] < x[3] and y[3] > x[2])


def test_nearest_matches_brute_force_with_ties(spark):
    rng = random.Random(3)
    marks = [(k, float(rng.randint(0, 200))) for k in (1, 2) for _ in range(15)]
    pts = [(k, i, float(rng.randint(-20, 220)) / 2) for k in (1, 2, 3) for i in range(40)]
    got = {(r.k, r.i): (r.near.t if r.near else None) for r in intervals.nearest(
        spark.createDataFrame(pts, "k int, i int, x double"), spark.createDataFrame(marks, "k int, m double"), "k", "x", "m", 13.0).collect()}
    for k, i, x in pts:
        mine = sorted({m for kk, m in marks if kk == k})
        assert got[(k, i)] == (min(mine, key=lambda m: (abs(m - x), m)) if mine else None)


def _py_score(a, b):
    def tempo(x, y):
        if x <= 0 or y <= 0:
            return 0.5
        d = min(abs(x - y) / x, abs(2 * x - y) / (2 * x), abs(x - 2 * y) / (2 * y))
        for lim, v in ((0.02, 1.0), (0.05, 0.9)):
            if d <= lim:
                return v
        if d <= 0.08:
            return 0.9 - (d - 0.05) * (0.4 / 0.03)
        return 0.5 - (d - 0.08) * (0.4 / 0.07) if d <= 0.15 else max(0.05, 0.1 - (d - 0.15) / 2)

    def key(x, y):
        if not x or not y:
            return 0.5
        if "zz" in (x, y):
            return 0.05
        i, j = ((int(c[:-1]) - 1) * 2 + (c[-1] == "B") for c in (x, y))
        return {0: 1.0, 1: 0.9, 2: 0.7, 3: 0.5, 4: 0.3, 5: 0.15, 6: 0.05}[P._hour_distance(i, j)]

    def step(d, rungs, rest):
        return next((v for t, v in rungs if d < t), rest)

    e = step(abs(a[3] - b[3]), ((0.1, 1.0), (0.2, 0.85), (0.3, 0.7), (0.5, 0.5)), max(0.2, 1 - abs(a[3] - b[3])))
    if a[3] <= 0 and b[3] <= 0:
        e = 0.8
    r = min(a[4], b[4]) / max(a[4], b[4], 1e-9)
    s = 0.5 if min(a[4], b[4]) <= 0 else 1.0 if r > 0.85 else 0.8 if r > 0.7 else 0.6 if r > 0.5 else max(0.2, r)
    return int((0.4 * tempo(a[1], b[1]) + 0.3 * key(a[2], b[2]) + 0.2 * e + 0.1 * s + 1e-9) * 1000 + 0.5) / 1000


@pytest.mark.parametrize("n", [3, 150])
def test_pair_topk_equals_full_ranking_with_a_hot_group(spark, n):
    """A third of the tracks share one feature vector; others lack tempo, key, brightness or energy."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, 120.0, "8A", 0.5, 1500.0))
        elif i % 3 == 1:
            rows.append((i, 120.0 + rng.uniform(-1, 1), "8A", 0.5 + rng.uniform(-0.02, 0.02), 1500.0 + rng.uniform(-20, 20)))
        else:
            rows.append((i, rng.uniform(60, 180), f"{rng.randint(1, 12)}{rng.choice('AB')}", rng.random(), rng.uniform(500, 4000)))
    for i in range(n, n + n // 3):
        rows.append((i, rng.choice([0.0, 120.0, 121.0]), rng.choice(["", "8A", "zz", "8A"]), rng.choice([0.0, 0.5, 0.52]), rng.choice([0.0, 1500.0, 1520.0])))
    df = spark.createDataFrame(rows, "track_id long, bpm double, camelot string, mean_energy double, spectral_centroid double")
    got = {}
    for r in pairs.pair_topk(df, 3).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.overall))
    for a in rows:
        want = sorted(((-_py_score(a, b), b[0]) for b in rows if b[0] != a[0]))[:3]
        assert [(d, round(s, 3)) for _, d, s in sorted(got[a[0]])] == [(d, round(-s, 3)) for s, d in want]


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 8}, {"cell_rows": 30, "block": 16}])
def test_knn_equals_all_pairs_with_clusters_and_zero_vectors(spark, kw):
    import numpy as np

    from segue.operators.evidence import knn

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    v = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist() if i % 3 else [0.0] * 8 if i % 2 else rng.normal(size=8).tolist()) for i in range(150)]
    x = np.array([e for _, e in v])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = np.round(np.clip((x @ x.T + 1) / 2, 0, 1), 6)
    want = sorted((i, r + 1, j) for i in range(150) for r, j in enumerate(sorted((j for j in range(150) if j != i), key=lambda j: (-sim[i, j], j))[:4]))
    df = spark.createDataFrame(v, "track_id long, embedding array<double>")
    assert sorted((r.src, r["rank"], r.dst) for r in knn(df, 4, **kw).collect()) == want


def test_feedback_state_keeps_flag_on_play(spark):
    e = spark.createDataFrame([(1, 7, "like", 1), (2, 7, "play", 2), (3, 8, "play", 3), (4, 7, "dislike", 4)], "event_id long, track_id long, action string, ts long")
    got = {r.track_id: (r.liked, r.play_count) for r in feedback.feedback_state(e).collect()}
    assert got == {7: (-1, 3), 8: (0, 1)}


def test_upsert_last_write_wins(spark):
    s = "k long, updated_at long, tie long, v string"
    out = catalog.upsert(spark.createDataFrame([(1, 1, 0, "a"), (2, 9, 0, "b")], s), spark.createDataFrame([(1, 2, 0, "c"), (2, 3, 0, "d")], s), "k", ["updated_at", "tie"])
    assert {r.k: r.v for r in out.collect()} == {1: "c", 2: "b"}


def test_scan_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.mp3", "b.txt", "sub/c.FLAC", "sub/skip me.wav"):
        (tmp_path / n).write_bytes(b"x" * 10)
    got = sorted(r.path.rsplit("/", 1)[1] for r in scan_directory(spark, str(tmp_path), exclude=["skip"]).collect())
    assert got == ["a.mp3", "c.FLAC"]


def test_vector_edge_cases(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine01(arr(0, 0), arr(1, 0))) == 0.5
    assert one(spark, V.cosine01(arr(1, 0), arr(-1, 0))) == 0.0
    assert one(spark, V.entropy(arr(1))) == 1.0
    assert one(spark, V.normalise(arr(0, -1))) == [0.5, 0.5]
    assert one(spark, V.label_match(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == pytest.approx(0.85)


def test_role_flow_and_structure(spark):
    L = F.lit
    assert one(spark, sets.role_flow(L("intro"), L("verse"))) == 1.0
    assert one(spark, sets.role_flow(L("unknown"), L("verse"))) == 0.5
    assert one(spark, sets.structure_fit(L("intro"), L("chorus"))) == 0.35


def test_keep_media_is_case_insensitive(spark):
    df = spark.createDataFrame([("x/A.MP3",), ("x/a",), ("x/a.mp3.txt",)], "path string")
    assert [r.path for r in keep_media(df).collect()] == ["x/A.MP3"]


def test_running_max_is_independent_of_bins(spark):
    from segue.operators.audit import timeline_gaps

    rng = random.Random(2)
    rows = [(m, rng.randint(0, 3), o := rng.randint(0, 200), o + rng.randint(1, 40), 0, 1, i) for i, m in enumerate(itertools.islice(itertools.cycle([1, 1, 2]), 80))]
    df = spark.createDataFrame(rows, "mix_id long, track_id long, out_start long, out_end long, src_start long, src_end long, tie long")
    res = [sorted(tuple(r) for r in timeline_gaps(df, w).collect()) for w in (7, 1000)]
    assert res[0] == res[1] and res[0]


def test_sequence_builders_keep_every_request(spark):
    """Requests with pools of six, two and one tracks, and one without an option for a role."""
    from segue.operators import sequences as seq

    rows = [(r, r * 10 + i, 120.0 + i, "8A", 0.5, 1500.0, 200.0) for r, n in ((1, 6), (2, 2), (3, 1)) for i in range(n)]
    pool = spark.createDataFrame(rows, "request_id long, track_id long, bpm double, camelot string, mean_energy double, spectral_centroid double, duration_sec double")
    openers = pool.select("request_id", "track_id", F.lit(1.0).alias("start"), F.lit(900.0).alias("goal"))
    got = {r.request_id: len(r.path) for r in seq.beam_sequences(openers, pool, 7, 4).collect()}
    assert got == {1: 6, 2: 2, 3: 1}
    parts = pool.select("request_id", "track_id", F.col("track_id").cast("string").alias("segment_id"), F.lit(0.0).alias("s"), F.lit(30.0).alias("e"), F.lit("intro").alias("role"), F.lit(0.7).alias("quality"), F.col("mean_energy").alias("energy"))
    got = {r.request_id: len(r.used) for r in seq.greedy_segments(parts.select("request_id").distinct(), parts, 3).collect()}
    assert got == {1: 3, 2: 2, 3: 1}
    options = parts.select("request_id", F.explode(F.array(F.lit("INTRO"), F.lit("PEAK"))).alias("role"), "track_id", "segment_id", F.lit(0.5).alias("score")).where("not (request_id = 3 and role = 'PEAK')")
    got = {r.request_id: len(r.path) for r in seq.role_beam(parts.select("request_id").distinct(), options, ["INTRO", "PEAK"], 4).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_curve_keys_follow_the_data(spark, tmp_path):
    from segue.sources.tables import Tables

    for n in (3, 5):
        spark.createDataFrame([(i,) for i in range(n)], "user_id long").write.parquet(str(tmp_path / str(n) / "events.parquet"))
        t = Tables(spark, str(tmp_path / str(n)))
        assert [r.k for r in spark.range(10).select((F.col("id") % t.n_curves()).alias("k")).collect()] == [i % n for i in range(10)]


def test_technique_choice_folds_history_and_budget(spark):
    from segue.operators import sequences as seq

    base = dict(gap=0.02, rhythm=0.9, harmonic=0.9, downbeat=0.9, phrase=0.9, local=0.9, a_bass=0.1, b_bass=0.1, lift=True, a_dense=False, b_dense=False, same_track=False,
                stems=False, kind="crossfade", style="club", role="REVEAL", decision="SWITCH", payoff=True, groove=False, clearance=False, allow_strong=True)
    rows = [dict(base, set_id=1, pos=p, budget=1) for p in range(1, 6)] + [dict(base, set_id=2, pos=p, budget=3) for p in range(1, 6)]
    rows += [dict(base, set_id=3, pos=1, budget=3, decision="VARIATE", role="CONTINUE", payoff=False), dict(base, set_id=3, pos=2, budget=3, stems=True, role="RESET", payoff=False, lift=False)]
    got = {}
    for r in sorted(seq.technique_rank(spark.createDataFrame(rows)).collect(), key=lambda r: (r.set_id, r.pos)):
        got.setdefault(r.set_id, []).append(r.technique)
    strong = {"loop-roll drop", "drop switch"}
    # worked by hand: a strong effect scores 1.13, less 0.60 without budget and 0.34 within two handoffs of another;
    # the clean continuation scores 0.607, less 0.045 for each use in the last three
    assert [x in strong for x in got[1]] == [True, False, False, True, False]
    assert [x in strong for x in got[2]][:4] == [True, True, True, False]
    assert got[3] == ["section edit", "vocal bridge"]


TAGGED = [
    ("give me a chill mix", {"preset": "chill", "energy_profile": "steady", "raw": None}),
    ("smooth 30 min set, 120-130 bpm, no vocal clash", {"preset": "vocal_safe", "transition_style": "smooth", "target_duration_sec": 1800.0, "bpm_min": 120.0, "bpm_max": 130.0, "vocal_preference": "vocal_safe"}),
    ("120 bpm", {"bpm_min": 115.0, "bpm_max": 130.0, "preset": None}),
    ("2 hour set", {"target_duration_sec": 7200.0}),
    ("late_night", {"preset": "late_night", "energy_profile": "wave", "target_duration_sec": 5400.0, "desired_activity": []}),
    ("", {"preset": None, "energy_profile": None, "target_duration_sec": 1800.0, "reprise": "balanced", "layering": "off"}),
    ("stem separation preferred", {"prefer_stems": True, "vocal_preference": "stem_friendly"}),
    ("harmonic mixing", {"prefer_harmonic": True}),
    ("Make a romantic party mix but avoid breakup songs", {"desired_themes": ["romance", "party"], "avoid_themes": ["breakup"], "desired_lyrical_moods": ["romantic"]}),
    ("Start sad and emotional and slowly become hopeful", {"meaning_trajectory": ["sad", "hopeful"], "mood_trajectory": ["melancholic", "hopeful"], "energy_profile": "slow_build"}),
    ("chill, then get energetic", {"mood_trajectory": ["calm", "energetic"], "meaning_trajectory": []}),
    ("no sad songs, never any very dark lyrics", {"avoid_moods": ["sad", "dark"], "avoid_lyrical_moods": ["sad", "dark"], "desired_moods": []}),
    ("a mashup with big effects and fewer repeats", {"layering": "prefer", "performance_style": "experimental", "performance_mode": "segment", "technique_intensity": "strong", "reprise": "avoid"}),
    ("club night, don't use any mashups, no flashy effects", {"layering": "off", "technique_intensity": "subtle", "allow_creative_fx": False}),
    ("a story-like remix-style set", {"performance_style": "experimental", "performance_mode": "segment", "desired_variety": 0.15}),
    ("a story with a callback, lots of different songs", {"performance_style": "story", "performance_mode": "classic", "reprise": "callback", "desired_variety": 0.85}),
]


def test_request_tag_by_hand(spark):
    from segue.operators.tagging import tag

    got = {r.request_id: r.asDict() for r in tag(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TAGGED)] + [(99, None)], "request_id long, raw_text string")).collect()}
    for i, (text, want) in enumerate(TAGGED):
        assert {k: got[i][k] for k in want if k != "raw"} == {k: v for k, v in want.items() if k != "raw"}, text
    assert {k: v for k, v in got[99].items() if k != "request_id"} == {k: v for k, v in got[5].items() if k != "request_id"}


def test_streams_over_several_batches(spark, tmp_path):
    """One file a batch: update mode leaves the same tables as one batch over everything."""
    from segue.streaming import feedback as live
    from segue.streaming.violations import gap_stream

    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5), rng.choice(["like", "dislike", "play"]), i) for i in range(200)]
    schema = "event_id long, track_id long, action string, ts long"
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.parquet(str(tmp_path / "e" / f"{k}.parquet"))
    at_rest = spark.createDataFrame(rows, schema)
    stream = live.read_stream(spark, str(tmp_path / "e" / "*.parquet"), "*.parquet", 1)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(live.drain(live.feedback_state(stream), "t-state", ["track_id"])) == key(live.feedback_state(at_rest))
    mixes = [(m, p, s, s, s + rng.randint(5, 15), 0, 1, 0) for m in range(3) for p, s in enumerate(range(0, 120, 10))]
    schema = "mix_id long, pos long, track_id long, out_start long, out_end long, src_start long, src_end long, tie long"
    for k in range(3):
        spark.createDataFrame([r for r in mixes if r[1] // 4 == k], schema).repartition(2).write.parquet(str(tmp_path / "v" / f"{k}.parquet"))
    got = key(live.drain(gap_stream(spark, live.read_stream(spark, str(tmp_path / "v" / "*.parquet"), "*.parquet", 8)), "t-gaps"))
    want = []
    for m in range(3):
        end = 0
        for r in (r for r in mixes if r[0] == m):
            if r[3] != end:
                want.append((m, r[3], end, "output_gap" if r[3] > end else "output_overlap"))
            end = max(end, r[4])
    assert got == sorted(want)
