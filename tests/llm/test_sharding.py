"""Shards against all ways to cut, and rules that hold for every table."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from segue.llm import sharding


def least_capacity(sizes, shards):
    """Smallest largest run, by the table of all cuts."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    best = total[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], total[j] - total[i]) for i in range(j + 1)) for j in range(len(total))]
    return best[-1]


def key_of(text):
    return int(hashlib.md5((text or "").encode()).hexdigest()[:15], 16)


def groups_of(docs):
    out = defaultdict(int)
    for _, text in docs:
        out[key_of(text)] += len((text or "").encode()) + 16
    return out


def check(docs, rows, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in rows) == sorted(((i is None, i or 0), size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    slots, where, loads = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
        loads[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values()) and all(0 <= s < shards for s in slots)
    return loads


@pytest.mark.parametrize("shards, n, bins", [(40, 500, 1 << 16), (7, 300, 8), (3, 60, 2), (40, 30, 64), (1, 20, 4)])
def test_cuts_are_the_best(spark, shards, n, bins):
    rng = random.Random(n)
    sizes = {rng.randrange(1 << 60): rng.choice((17, 20, rng.randint(16, 4000))) for _ in range(n)}
    groups = spark.createDataFrame(list(sizes.items()), "key long, bytes long")
    cuts = sharding.minimax_cuts(groups, shards, bins)
    assert cuts == sorted(set(cuts)) and set(cuts) <= set(sizes) and len(cuts) < shards
    loads = defaultdict(int)
    for key, size in sizes.items():
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads.values()) == least_capacity([sizes[k] for k in sorted(sizes)], shards)


def test_bounds_of_a_range_hold(spark):
    """Keys that share all but their last bits: ranges are looked into down to single groups."""
    sizes = {(5 << 20) + i: 100 + i % 7 for i in range(200)} | {1: 16, (1 << 60) - 1: 90}
    groups = spark.createDataFrame(list(sizes.items()), "key long, bytes long")
    cuts = sharding.minimax_cuts(groups, 9, 4)
    loads = defaultdict(int)
    for key, size in sizes.items():
        loads[sum(key >= c for c in cuts)] += size
    assert max(loads.values()) == least_capacity([sizes[k] for k in sorted(sizes)], 9)


def test_whole_tables(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["a", "été", "word"], k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(i, "one large group of copies " * 4) for i in range(1000, 1300)] + [(None, "x" * 200_000), (7, "x" * 200_000)]
    docs += [(None, None), (None, ""), (3, None), (9, "again"), (9, "again")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, key string, shard int, row int")
    rows = sharding.sharded(df).collect()
    loads = check(docs, rows, 40)
    groups = groups_of(docs)
    heavy = sorted(groups.values(), reverse=True)[:2]  # the long text and the copies
    assert sorted(loads.values(), reverse=True)[:2] == heavy
    rest = [groups[k] for k in sorted(groups) if groups[k] not in heavy]
    assert sorted(loads.values(), reverse=True)[2] == least_capacity(rest, 38)
    order = defaultdict(list)
    for r in rows:
        order[r.shard].append((r.slot, r.text_crc32))
    keys = {zlib.crc32((t or "").encode()): key_of(t) for _, t in docs}
    for x in order.values():
        assert [keys[c] for _, c in sorted(x)] == sorted(keys[c] for _, c in x)
    assert {r.shard: r.bytes for r in sharding.manifest(sharding.sharded(df)).collect()} == dict(loads)


def test_small_and_empty(spark):
    kind = "doc_id long, text string"
    assert sharding.sharded(spark.createDataFrame([], kind)).collect() == []
    for docs in ([(1, "a")], [(None, None)] * 3, [(1, "a"), (2, "b")]):
        check(docs, sharding.sharded(spark.createDataFrame(docs, kind)).collect(), 40)


def test_plan_is_native(spark):
    df = sharding.sharded(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
