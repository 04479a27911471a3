"""The trough of many blends at once against the formula window by window."""

import math

import pytest
from pyspark.sql import functions as F

from segue.operators import transitions as ops
from segue.plans import transitions as plan
from segue.sources.tables import Tables


def by_hand(kind, exit_t, overlap, entry_t, consumed, la, lb, sides):
    n, worst = max(4, math.ceil(overlap / 2)), 0.0
    for k in range(n):
        p, off = (k + 0.5) / n, []
        for (points, duration, own), at, length in zip(sides, (exit_t, entry_t), (overlap, consumed)):
            x, m = at + p * length, len(points)
            first = max(0, min(m - 1, math.floor((x - 1) / duration * m)))
            last = max(first + 1, min(m, math.ceil((x + 1) / duration * m)))
            off.append(sum(points[first:last]) / (last - first) - own if m else 0.0)
        a, b = (0.0, 1.0) if kind == "phrase_cut" else (math.cos(p * math.pi / 2), math.sin(p * math.pi / 2))
        power = a * a * 10 ** (off[0] / 10) + b * b * 10 ** (off[1] / 10)
        worst = max(worst, la * (1 - p) + lb * p - 10 * math.log10(max(power, 1e-12)))
    return worst


def test_trough_of_a_batch(spark):
    curve = lambda m, s: [-20.0 + (i * s) % 13 for i in range(m)]
    cases = [("crossfade", 80.0, 21.0, 3.0, 21.0, -1.0, 2.0, [(curve(40, 3), 120.0, -9.0), (curve(25, 5), 150.0, -12.0)]),
             ("phrase_cut", 118.0, 3.0, 0.0, 3.0, 0.5, -2.0, [(curve(7, 2), 121.0, -9.0), (curve(300, 7), 150.0, -7.0)]),
             ("beatmatched_blend", 60.0, 16.0, 10.0, 19.5, 0.0, 0.0, [([], 121.0, -9.0), (curve(30, 4), 150.0, -12.0)])]
    rows, want = [], []
    for kind, x, ov, y, used, la, lb, sides in cases:
        sums = [[sum(points[:i], 0.0) for i in range(len(points) + 1)] if points else None for points, _, _ in sides]
        rows.append((kind, x, ov, y, used, la, lb, *[v for (points, d, own) in sides for v in (len(points) or None, d, own)], 0, sums[0], 0, sums[1]))
        want.append(by_hand(kind, x, ov, y, used, la, lb, sides))
    names = ["kind", "exit_t", "overlap", "entry_t", "consumed", "la", "lb", "an", "ad", "al", "bn", "bd", "bl", "wa", "p_a", "wb", "p_b"]
    types = ["string", *["double"] * 6, *["int", "double", "double"] * 2, *["int", "array<double>"] * 2]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types))).coalesce(1)
    got = [r.t for r in df.select(ops._worst_trough()(*names).alias("t")).collect()]
    assert got == pytest.approx(want, abs=1e-9)


def test_no_candidate_carries_a_curve(spark, capsys):
    """Windows are worked out outside interpreted lambdas, and what the source's join shuffles has one array of the target."""
    plan._search_frame(Tables(spark, "/root/testdata/sf0.001")).select(F.max("overall")).explain()
    text = capsys.readouterr().out
    assert "ArrowEvalPython" in text
    spread = [x for x in text.splitlines() if "explode(types" in x]
    assert spread and not any(x.count("b_p_energy") or x.count("b_p_bass") for x in spread)
