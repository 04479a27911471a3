"""Best partners on a dense table: few pairs are scored, and the result is that of the full matrix."""

import random

from segue.operators import pairs

from .test_rules import _py_score


def test_dense_tables_score_few_pairs_a_track(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, 60.0 + 2 * rng.randint(1, 12), f"{rng.randint(8, 9)}{rng.choice('AB')}", rng.randint(300, 699) / 1000, 500.0 + 100 * rng.randint(8, 16)) for i in range(6000)]
    df = spark.createDataFrame(rows, "track_id long, bpm double, camelot string, mean_energy double, spectral_centroid double").repartition(4)
    scored, score = [], pairs._score
    monkeypatch.setattr(pairs, "_score", lambda p: (scored.append(p.count()), score(p))[1])
    got = {}
    for r in pairs.pair_topk(df, 5).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, round(r.overall, 3)))
    assert sum(scored) < 150 * len(rows)
    assert all(len(x) == 5 for x in got.values()) and len(got) == len(rows)
    for a in rows[::150]:
        want = sorted((-_py_score(a, b), b[0]) for b in rows if b[0] != a[0])[:5]
        assert [(d, s) for _, d, s in sorted(got[a[0]])] == [(d, round(-s, 3)) for s, d in want]
