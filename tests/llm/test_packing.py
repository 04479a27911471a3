"""Packing: exact round trip, limits, padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from segue.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "\n\n  x", "it's we'll 'd", "naïve ¼ ² x³", "日本語 テキスト", "a<|endoftext|>b", "\x1c\x1d x\u00a0y\u2003z", "e\u0301 🎉🎉", "１２ Ⅷ", "word " * 9000]
    words = ["the", "Ciónñ", "über", "x9", "  ", "\n", "--", "###", "'s", "don't", "ſtraße", "\t\t"]
    return odd + [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(300)] + ["same text"] * 50


@pytest.mark.parametrize("limits", [(1024, 256, 1024), (64, 3, 40)])
def test_round_trip_and_limits(spark, limits):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE)
    all_texts = texts()
    prompts = [i % 30 if i % 3 else None for i in range(len(all_texts))]
    df = spark.createDataFrame([(i, t, p, "x") for i, (t, p) in enumerate(zip(all_texts, prompts))], "doc_id long, text string, p int, offset string").repartition(3)
    rows = packing.pack(df, FILE, limits, prompt_col="p", with_ids=True).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(all_texts):
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want
        at = 0
        for r in pieces:
            assert (r.start, r.doc_tokens, r.length) == (at, len(want), len(r.ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
    short = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = loss = 0
        for r in own:
            assert r.offset == at
            at += r.length
            loss += max(0, r.length - max(0, (prompts[r.doc_id] or 0) - r.start))
        assert at <= limits[0] and len(own) <= limits[1] and loss <= limits[2]
        short += at < limits[0] and len(own) < limits[1] and loss < limits[2]
    assert short <= 3


def test_empty_and_null_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []
    rows = packing.pack(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string").coalesce(1), FILE).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 1), ("None", 2), ("None", 2)]
