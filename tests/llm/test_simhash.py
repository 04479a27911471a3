"""SimHash classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segue.llm import simhash
from segue.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(links, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_documents_as_by_all_pairs(spark):
    rng = random.Random(1)
    words = ["Alpha", "beta", "ÉTÉ", "été", "delta", "eps", "x", "y\u00a0z"]
    base = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40, 400]))) for _ in range(60)]
    texts = base + [t.replace("eps", "EPS", 1) for t in base] + [t + " tail" for t in base[:30]] + [None, "", " \n", "w " * 30_000] + [base[5]] * 100
    df = spark.createDataFrame([(i + 10, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i + 10: brute_print(t) for i, t in enumerate(texts)}
    ids = list(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = classes(links, ids)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("node_rows", [10**6, 40, 3])
def test_links_in_dense_space_with_divided_nodes(spark, node_rows):
    """A third of all fingerprints share their first 48 bits."""
    rng = random.Random(2)
    values = {rng.getrandbits(16) | 0xABCD_EF01_2345_0000 for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:200]:
        values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    v = np.array(sorted(values), np.uint64)
    rows = [(int(x), i) for i, x in enumerate(v.view(np.int64))]
    got = sorted(tuple(sorted(r)) for r in simhash.trie_links(spark.createDataFrame(rows, "fp long, rep long"), node_rows).collect())
    far = np.bitwise_count(v[:, None] ^ v[None, :])
    i, j = np.nonzero((far <= 2) & (np.arange(len(v))[:, None] < np.arange(len(v))))
    assert got == sorted(zip(i.tolist(), j.tolist()))


def test_nulls_and_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows if r.component_id) == [("4", 4), ("4", 4), ("None", 4)]
    assert len(rows) == 4


def test_components_of_long_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1500)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1500)}}
    assert components(spark.createDataFrame([], "x long, y long").select("x", F.col("y")), "x", "y").collect() == []
