"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from segue.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 3}


def brute(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus():
    rng = random.Random(1)
    stems = ["".join(rng.choices("abcdeéÉÿ", k=rng.randint(4, 9))) for _ in range(40)]
    words = list(stems)
    for s in stems:
        for _ in range(8):
            k = rng.randrange(len(s))
            words.append(rng.choice((s[:k] + s[k + 1 :], s[:k] + rng.choice("abzé") + s[k:], s[:k] + rng.choice("abzß") + s[k + 1 :], s[:k] + s[k + 1 : k + 2] + s[k : k + 1] + s[k + 2 :])))
    docs = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words[: rng.randint(1, len(words))]) for _ in range(60))) for i in range(150)]
    long = "x" * 3000 + "y"
    docs += [(i, f"{long} {long[1:]} {long}z cafés1cafés_CAFÉS") for i in (900, 901, 902)]
    return docs + [(None, "nulls nulls nulls nulls nulla nulla nulla"), (5, None), (6, ""), (7, "1234 ... \n"), (8, "again " * 9), (8, "again " * 9)]


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("block", [7, spelling.BLOCK])
def test_as_by_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    want = brute(docs)
    out = spelling.variants(df)
    assert out.count() == len(want) > 100 and rows(out) == want
    assert any(f and r != f for _, f, r, *_ in want)


def test_misprints_and_groups(spark):
    """Enough runs that some lose a letter; the number of letter groups doesn't change the result."""
    docs = [(i, " ".join(f"{a}{b}lette" for a in "abcdefghij" for b in "klmnopqrst")) for i in range(12)]
    want = brute(docs)
    assert any(n < 12 for w, _, _, n, *_ in want)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.variants(df)) == want


def test_many_groups(spark, monkeypatch):
    n = {f"{a}{b}{c}{d}e": 3 + ord(a) % 5 for a in "abcd" for b in "aeio" for c in "xyz" for d in "pq"}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {w: sum(one_edit(w, v) for v in n) for w in n}
    for groups in (1, 5, 90):
        monkeypatch.setattr(spelling, "round", lambda x, groups=groups: groups, raising=False)
        assert {r.word: r.n_near for r in spelling.near_words(vocabulary).collect()} == want


def test_empty(spark):
    for docs in ([], [(1, None), (2, "a few rare words occurring")]):
        assert spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect() == []
