"""Trie of rebuilt conversations against one made of dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from segue.llm import prefix_trie


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, md5(md5(role) + md5(text))), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, who in nodes.items():
        gain = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += gain
            leaves[path[:d]] += kids[path] == 0
    out = []
    for path, who in nodes.items():
        ends = ",".join(str(c) for c in who if len(built[c]) == len(path))
        out.append((who[0], len(path), nodes[path[:-1]][0] if path else -1, len(who), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    say = ["", "yes", "no way", "tell  me\tmore", "été\nthen", "one two three"]
    rows = []
    for c in list(range(0, 130)) + [400, 401, 415, 1001]:
        for turn in range(rng.choice((0, 1, 2, 3, 5, 8))):
            rows.append((c, turn, ("user", "assistant")[turn % 2], rng.choice(say[: rng.randint(1, 6)])))
    long = [(i, "user", rng.choice(say)) for i in range(60)]
    for c in range(2000, 2040):  # copies of a long conversation, some cut short, some going on
        rows += [(c, *t) for t in long[: rng.choice((60, 60, 31))]] + [(c, 60 + k, "user", rng.choice(say)) for k in range(rng.choice((0, 0, 9)))]
    rows += [(3, 1, None, "tie"), (3, 1, None, None), (3, 1, "user", "tie"), (3, None, "system", "first"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    return rows + [(None, 0, "user", "nobody's"), (None, None, None, None), (500, None, None, None)]


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("block, shard", [(prefix_trie.BLOCK, prefix_trie.SHARD), (4, 7), (1, 3), (16, 1)])
def test_as_by_dictionaries(spark, block, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, rank int, words string").repartition(5)
    got, want = rows_of(prefix_trie.trie(df)), brute(rows)
    assert len(got) == len(want) > 300 and got == want


def test_small_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], kind)).collect() == []
    for rows in ([(20, 0, "user", "a")], [(c, 0, "user", "same words") for c in range(50)], [(-3, 1, None, "x"), (0, 1, None, "x"), (-20, 0, "a", "b")]):
        if min(r[0] for r in rows) >= 0:
            assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, kind))) == brute(rows)
        else:  # the remainder has the sign of the id: -3 and 0 are of one family
            assert {r.n_convs for r in prefix_trie.trie(spark.createDataFrame(rows, kind)).collect() if r.depth == 0} == {3}
