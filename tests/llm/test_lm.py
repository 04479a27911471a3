"""Cross-entropy difference against a plain model over words as strings."""

import math
import random
import re
from collections import Counter

import pytest

from segue.llm import lm


def brute(rows, good):
    split = [(d, re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for d, t in rows]
    out = []
    model = []
    for k in range(2):
        own = [w for d, w in split if k == 0 or d in good]
        one = Counter(x for w in own for x in w)
        two = Counter(p for w in own for p in zip(w, w[1:]))
        model.append((one, two, sum(one.values()) + lm.SMOOTH * lm.WORDS))
    for d, w in split:
        loss = []
        for one, two, total in model:
            bits = 0.0
            for i, x in enumerate(w):
                p = single = (one[x] + lm.SMOOTH) / total
                if i:
                    p = lm.MIX * min(two[w[i - 1], x] / max(one[w[i - 1]], 1), 1) + (1 - lm.MIX) * single
                bits -= math.log2(p)
            loss.append(bits / len(w) if w else None)
        out.append((d, len(w), loss[1], loss[0], loss[1] - loss[0] if w else 0.0))
    return out


def test_as_by_plain_model(spark):
    rng = random.Random(12)
    words = ["the", "The", "of", "ciónñ", "x9", "a-b", "über", "!!", "日本"] + [f"w{i}" for i in range(12)]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.choice([0, 1, 7, 90])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "?!"), (303, "w1 w2 " * 40_000), (304, rows[5][1]), (None, "the of w3"), (305, "the of w3")] + [(306, "w5 w6")] * 2
    good = [i for i in range(0, 300, 3)] + [303, 306]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(g, 1) for g in good] + [(1, 0), (2, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = sorted((tuple(r) for r in lm.judge(docs, labels).collect()), key=str)
    want = sorted(brute(rows, set(good)), key=str)
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    for g, w in zip(got, want):
        for a, b in zip(g[2:], w[2:]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=2e-5)), (g, w)


def test_empty_and_without_target(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert lm.judge(docs.limit(0), labels).collect() == []
    row = lm.judge(docs, labels).first()
    assert row.n_tokens == 3 and row.loss_target > row.loss_background > 0
