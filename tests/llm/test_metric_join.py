"""Range join of embeddings against all pairs."""

import numpy as np
import pytest

from segue.llm import metric_join

from .test_simhash import classes


def rows():
    rng = np.random.default_rng(6)
    out = []
    centres = rng.normal(size=(12, 16))
    for i in range(500):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(12)]
        out.append((i, int(rng.integers(3)) if i % 3 else 1, (c + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.5])).tolist()))
    path = rng.normal(size=16)
    turn = rng.normal(size=16)
    out += [(1000 - k, 2, (path + turn * 0.05 * k).tolist()) for k in range(60)]
    out += [(2000 + k, 1, out[3][2]) for k in range(150)] + [(2500, 1, (np.array(out[3][2]) * 1e200).tolist()), (2501, 1, (np.array(out[3][2]) * 1e-200).tolist())]
    out += [(3000, 1, None), (3001, 1, []), (3002, 1, [0.0] * 16), (3003, None, out[0][2]), (3004, 1, [None] + out[0][2][1:]), (3005, 1, [float("nan")] * 16), (3006, 1, [float("inf")] + out[0][2][1:]), (3007, 1, [1.0, 2.0]), (3008, 1, [1.0, 2.0])]
    return out


def brute(table):
    good = [(i, lab, np.array(v) / np.abs(v).max()) for i, lab, v in table if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for a, (i, la, v) in enumerate(good):
        for j, lb, w in good[a + 1 :]:
            if la == lb and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links.append((i, j))
    ids = [i for i, _, _ in table]
    low = classes(links, ids)
    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], low[i], low[i] == i) for i in ids)


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 20}, {"cell_rows": 60, "block": 16}, {"cell_rows": 10**9, "block": 40}])
def test_as_by_all_pairs(spark, kw):
    table = rows()
    df = spark.createDataFrame([(*r, 1) for r in table], "vec_id long, label int, embedding array<double>, n int")
    got = sorted(tuple(r) for r in metric_join.near_vectors(df, **kw).collect())
    assert got == brute(table)


def test_nulls_repeats_and_empty(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert metric_join.near_vectors(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (5, 1, [1.0, 0.0]), (6, 1, [1.0, 0.1])], schema)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("6", 2, 5, False), ("None", 0, None, None)]


def test_links_of_every_chunk_stay(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=(1100, 64))
    both = np.stack((one, one + 0.01 * rng.normal(size=one.shape)), axis=1).reshape(2200, 64)
    order = rng.permutation(2200)
    df = spark.createDataFrame([(int(i), 1, both[i].tolist()) for i in order], "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in metric_join.near_vectors(df, cell_rows=10**9).collect())
    assert got == [(i, 1, i - i % 2, i % 2 == 0) for i in range(2200)]


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [-1.0, 0.0]), (3, 1, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_many_labels(spark):
    """Labels without a pivot, far more than pivots: each a pair of equal vectors and a stranger."""
    rows = [(3 * k + i, k, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for k in range(20_000) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = metric_join.near_vectors(df, pivots=8)
    assert out.where("n_links = 1 and component_id = vec_id - vec_id % 3").count() == 40_000 and out.where("n_links = 0 and kept").count() == 20_000
