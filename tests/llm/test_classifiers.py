"""Toxicity and quality: held-out accuracy, and the defined results of odd rows."""

import os
import zlib

import numpy as np
import pytest

from segue.llm import quality, toxicity
from segue.llm.text import text_bytes

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("op,label,rest,precision,recall", [(toxicity, "toxic", (4, 2), 0.9, 0.7), (quality, "quality", (5, 0), 0.97, 0.97)])
def test_held_out_accuracy(spark, op, label, rest, precision, recall):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = op.judge(docs, labels).join(labels.select("doc_id", label), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1] for r in rows)
    hit = sum(r.predicted and r[label] for r in rows)
    assert hit / sum(r.predicted for r in rows) > precision and hit / sum(r[label] for r in rows) > recall
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, op, label):
    texts = ["", None, " \n", "word", "bad " * 40_000, "fine words here"] * 3
    docs = spark.createDataFrame([(i if i else None, t, 1.0, "t") for i, t in enumerate(texts)], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(i, int("bad" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1), (2, None), (5, 0), (5, 0)], f"doc_id long, {label} int")
    rows = op.judge(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 6, 7, 8)}) == 1
    assert op.judge(docs.limit(0), labels).collect() == []
    none = op.judge(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_ftrl_step_is_the_formula():
    m = toxicity.Ftrl(8)
    rng = np.random.default_rng(0)
    z, n = np.zeros(8), np.zeros(8)
    for _ in range(200):
        at, y = np.unique(rng.integers(0, 8, 3)), int(rng.random() < 0.3)
        w = np.array([0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2) for i in range(8)])
        g = 1 / (1 + np.exp(-w[at].sum())) - y
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += g * g
        m.step(at, y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_slots_see_neighbours_of_their_own_text_only():
    import pyarrow as pa

    data, off = text_bytes(pa.array(["A b c", "d", None, "a B"]))
    text, _ = toxicity.slots(data, off)
    assert np.bincount(text, minlength=4).tolist() == [6, 1, 0, 3]
    one, two = (toxicity.slots(*text_bytes(pa.array([t]))) for t in ("x a b", "A b"))
    assert set(two[1]) <= set(one[1])


def test_dual_descent_reaches_the_hinge_optimum():
    """The dual's gap to the primal closes on a small problem."""
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.5), np.unique(rng.integers(0, 40, 6))) for _ in range(120)]
    ratio = quality.ratios(rows)
    w, b = quality.descend(rows, ratio, 400)
    y = np.array([1 if v else -1 for v, _ in rows])
    margin = np.array([w[at] @ quality.scaled(ratio, at) + b for _, at in rows])
    primal = 0.5 * (w @ w + b * b) + quality.COST * np.maximum(0, 1 - y * margin).sum()
    for _ in range(30):
        d = np.zeros_like(w)
        d[:40] = rng.normal(0, 0.02, 40)
        m2 = np.array([(w + d)[at] @ quality.scaled(ratio, at) + b for _, at in rows])
        assert 0.5 * ((w + d) @ (w + d) + b * b) + quality.COST * np.maximum(0, 1 - y * m2).sum() >= primal - 1e-4
