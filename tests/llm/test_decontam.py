"""Contaminated regions against a full alignment of every part with every text."""

import random

import pytest

from segue.llm import decontam


def least_edits(part, text):
    """Edit distance of ``part`` to any stretch of ``text``."""
    row = list(range(len(part) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for i, p in enumerate(part):
            new.append(min(row[i] + (p != ch), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = rng.choice("abcxyz ")
        elif kind == 1:
            t.insert(at, rng.choice("abcxyz "))
        else:
            del t[at]
    return "".join(t)


def corpus():
    rng = random.Random(8)
    bits = ["th", "er", "ing", "on", " the ", "an", " ", "ea", "é", "ñ", ". ", "St", "sh"]
    prose = lambda n: "".join(rng.choices(bits, k=n))
    items = [(i, prose(rng.choice([8, 18, 40, 60, 130]))) for i in range(25)] + [(50, None), (51, ""), (52, "short one")]
    items.append((60, items[3][1]))
    texts = []
    for i in range(120):
        t = items[i % 25][1]
        kind = i % 5
        inner = [t, edited(rng, t, len(t) // 25), edited(rng, t, len(t) // 10), t.upper().replace(" ", "\n"), t[: len(t) // 2]][kind]
        texts.append(prose(rng.randint(0, 60)) + inner + prose(rng.randint(0, 60)))
    return items, texts + [None, "", " ", prose(100)] + texts[:3]


@pytest.mark.parametrize("block", [decontam.BLOCK, 700])
def test_as_by_full_alignment(spark, block):
    items, texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(docs, bench, block=block).collect()
    index = decontam.Index([x for x in items if x[1]])
    folded = ["".join(map(chr, decontam.fold(t or ""))) for t in texts]
    want = set()
    for item, part, code, budget in zip(index.item, index.part, index.code, index.budget):
        p = "".join(map(chr, code))
        for d, t in enumerate(folded):
            if least_edits(p, t) <= budget:
                want.add((d, item, part))
    assert {(r.doc_id, r.item_id, r.part) for r in rows} == want and len(want) > 60
    codes = {(i, p): ("".join(map(chr, c)), b) for i, p, c, b in zip(index.item, index.part, index.code, index.budget)}
    for r in rows:
        p, budget = codes[r.item_id, r.part]
        stretch = folded[r.doc_id][r.start : r.stop]
        full = list(range(len(p) + 1))
        for k, ch in enumerate(stretch):
            new = [k + 1]
            for i, x in enumerate(p):
                new.append(min(full[i] + (x != ch), full[i + 1] + 1, new[i] + 1))
            full = new
        assert full[-1] == r.edits <= budget
    kept = [tuple(r) for r in decontam.clean(docs, bench, block=block).collect()]
    assert sorted(kept) == [(i, t, 1) for i, t in enumerate(texts) if i not in {d for d, _, _ in want}]


def test_empty_tables_null_ids_and_long_text(spark):
    bench = spark.createDataFrame([(1, "a passage of a benchmark that is long enough to be found"), (None, "another passage without an id, long enough as well")], "item_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contaminated(none, bench).collect() == []
    docs = spark.createDataFrame([(None, "x " * 1_600_000 + "A Passage of a benchmark that is  long enough to be found"), (2, "another passage without an id, long enough as well")], "doc_id long, text string")
    assert decontam.contaminated(docs, bench.limit(0)).collect() == []
    rows = decontam.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.start, r.edits) for r in rows) == [("2", "None", 0, 0), ("None", "1", 3_200_000, 1)]


def test_excerpts_at_every_offset_and_short_items(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choices("abcdefghij klmno", k=n))
    items = [(1, prose(400)), (2, prose(140)), (3, prose(25)), (4, "Kiel 7"), (5, " ")]
    size = decontam.WINDOW + decontam.STRIDE - 1
    texts = [prose(30) + items[i][1][a : a + size] + prose(30) for i in (0, 1) for a in range(len(items[i][1]) - size + 1)]
    n = len(texts)
    texts += [prose(40) + items[2][1].upper() + prose(40), "so kiel 7, then", "so kiel 77 then", prose(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    first = len(items[0][1]) - size + 1
    assert found == {(i, 1 if i < first else 2) for i in range(n)} | {(n, 3), (n + 1, 4)}
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [n + 2, n + 3]
