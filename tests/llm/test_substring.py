"""Repeated windows against a plain count."""

import hashlib
import random

import pytest

from segue.llm import substring


def brute(rows, k=13):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if least[tuple(w[i : i + k])] < d:
                    gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "é", "B", "b", "y z"]
    say = lambda n, among=words: [rng.choice(among) for _ in range(n)]
    line, hot = say(60), say(20)
    texts = []
    for i in range(400):
        t = say(rng.choice([0, 5, 12, 13, 14, 80, 300]))
        if i % 3 == 0:
            at = rng.randint(0, len(t))
            t[at:at] = hot
        if i % 20 == 0:
            t += line[rng.randint(0, 20) :]
        if i % 50 == 0:
            t += ["a"] * 50
        texts.append(rng.choice([" ", "\n", "  \t"]).join(t))
    texts += texts[:60] + [None, "", " \n "] + [" ".join(say(30_000, ["x", "y"]))] * 2
    return texts


@pytest.mark.parametrize("kw", [{}, {"bucket_bytes": 4096, "heavy_share": 0.0, "heavy_least": 40}])
def test_as_by_plain_count(spark, kw):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, base string").repartition(5)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.without_repeats(df, **kw).collect())
    assert got == brute(rows)


def test_repeated_ids_nulls_and_empty(spark):
    base = corpus()[:60]
    rows = [(i // 2, t) for i, t in enumerate(base)] + [(None, t) for t in base[:20]] + [(500, base[7]), (500, base[7]), (-3, base[9])]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert substring.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
