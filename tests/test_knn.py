"""Nearest vectors in bounded memory."""

import tracemalloc

import numpy as np
import pandas as pd

from segue.operators import evidence


def test_a_block_holds_few_similarities_at_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(3000)
    q, c = pd.DataFrame({"track_id": ids, "unit": list(x), "cell": 0}), pd.DataFrame({"t": ids, "y": list(x)})
    tracemalloc.start()
    got = evidence.nearest(q, c, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all similarities of the block are 72 MB, and each copy as much again
    sim = np.round(np.clip((x @ x.T + 1) / 2, 0, 1), 6)
    np.fill_diagonal(sim, -1.0)
    for i in (0, 255, 256, 2999):
        want = sorted((-sim[i, j], ids[j]) for j in range(3000))[:3]
        assert got[got["src"] == ids[i]]["dst"].tolist() == [j for _, j in want]


def test_targets_are_copied_by_the_queries_of_their_cell(spark, monkeypatch):
    """Cells of about 20 rows and blocks of 64: a row meets a few blocks of queries, not the 13 that all rows make."""
    seen = spark.sparkContext.accumulator(0)
    plain = evidence.nearest

    def counted(q, c, k):
        seen.add(len(c))
        return plain(q, c, k)

    monkeypatch.setattr(evidence, "nearest", counted)
    rng = np.random.default_rng(3)
    rows = [(i, (np.eye(16)[i % 8] + 0.001 * rng.normal(size=16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "track_id long, embedding array<double>")
    assert evidence.knn(df, 2, cell_rows=20, block=64).count() == 1600
    assert 0 < seen.value <= 6 * 800
