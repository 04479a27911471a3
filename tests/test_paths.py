"""The beam of a request in its task against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from segue.functions.basic import clip, snap
from segue.functions.pair import acoustic_score, energy_score, key_score, spectral_score, tempo_score
from segue.operators import sequences as seq
from segue.operators.sets import progression_bonus

POOL = "request_id long, track_id long, bpm double, camelot string, mean_energy double, spectral_centroid double, duration_sec double, taste double"


def plain(first, pool, gain, width):
    """Best path of one request by loops over Python lists; ``gain`` of (place in path, last, next)."""
    text = lambda p: ",".join(map(str, p))
    order = lambda x: (-round(x[1] / len(x[0]), 9), text(x[0]))
    open_, done = sorted(([t], 0.35 * s, pool[t][5]) for t, s in first), []
    open_, goal = sorted(open_, key=order)[:width], 700.0
    while open_:
        ext = [(p + [t], score + gain(len(p), p[-1], t), dur + pool[t][5] - min(3840 / max((pool[p[-1]][1] + pool[t][1]) / 2, 60), pool[t][5] / 2)) for p, score, dur in open_ for t in pool if t not in p]
        kept = sorted(ext, key=order)[: 3 * width]
        done += [x for x in kept if x[2] >= goal] if kept else open_
        open_ = [x for x in kept if x[2] < goal][:width]
    def key(x):
        e = [pool[t][3] for t in x[0]]
        mean = sum(e) / len(e)
        shape = 0.15 - 2 * sum((v - mean) ** 2 for v in e) / len(e) if len(e) >= 3 else 0
        return -round(0.6 * x[1] / len(x[0]) + 0.15 * (1 - abs(x[2] - goal) / goal) + 0.25 * shape, 9), text(x[0])
    return min(done, key=key)


@pytest.mark.parametrize("avoid", [False, True])
def test_paths_as_by_plain_loops_and_without_steps_on_disk(spark, monkeypatch, avoid):
    def no_cut(df):
        raise AssertionError("a step of the beam is written")

    monkeypatch.setattr(seq, "cut_lineage", no_cut)
    rng, rows = random.Random(3), []
    for r, n in ((1, 9), (2, 14), (3, 1)):
        rows += [(r, r * 100 + i, float(rng.choice((0, 90, 120, 122, 180))), rng.choice(("8A", "9A", "3B", "", None, "x")), rng.choice((0.0, 0.4, 0.55, 0.9)), float(rng.choice((0, 900, 1500))), 60.0 + rng.randint(0, 90), rng.choice((0.0, 0.08, -0.12))) for i in range(n)]
    pool = spark.createDataFrame(rows, POOL)
    first = {r: [(r * 100 + i, 0.5 + i / 10) for i in range(5) if any(x[1] == r * 100 + i for x in rows)] for r in (1, 2, 3)}
    openers = spark.createDataFrame([(r, t, s, 700.0) for r, ts in first.items() for t, s in ts], "request_id long, track_id long, start double, goal double")
    a, b = (pool.select("request_id", *[F.col(c).alias(f"{x}_{c}") for c in pool.columns[1:]]) for x in "ab")
    parts = [f(F.col(f"a_{c}"), F.col(f"b_{c}")) for f, c in ((tempo_score, "bpm"), (key_score, "camelot"), (energy_score, "mean_energy"), (spectral_score, "spectral_centroid"))]
    edge = {(x.i, x.j): (x.e, x.t, x.p) for x in a.join(b, "request_id").select(
        F.col("a_track_id").alias("i"), F.col("b_track_id").alias("j"), snap(acoustic_score(*parts)).alias("e"), F.col("b_taste").alias("t"),
        progression_bonus(F.lit("steady"), F.lit(0.0), F.col("a_mean_energy"), F.col("b_mean_energy")).alias("p")).collect()}
    bad = {101, 103, 205} if avoid else set()
    edges = {(102, 104), (203, 206), (206, 203)} if avoid else set()

    def gain(n, i, j):
        e, t, p = edge[i, j]
        return max(0.0, min(1.0, e - (0.18 if (i, j) in edges else 0.0) + t)) + p - (0.10 if j in bad else 0.0)

    more = {}
    if avoid:
        more = {"avoid_tracks": spark.createDataFrame([(t // 100, t) for t in bad], "request_id long, track_id long"),
                "avoid_edges": spark.createDataFrame([(i // 100, i, j) for i, j in edges], "request_id long, src long, dst long")}
    got = {r.request_id: r for r in seq.beam_sequences(openers, pool, width=3, **more).collect()}
    assert set(got) == {1, 2, 3}
    for r in got:
        path, score, dur = plain(first[r], {x[1]: x[1:7] for x in rows if x[0] == r}, gain, 3)
        assert got[r].path == path and got[r].score == pytest.approx(score) and got[r].dur == pytest.approx(dur)
