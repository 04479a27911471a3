"""Each stage of the pipeline against its own input."""

import os

import pytest

import corpus_pipeline
from segue.llm import secrets

from .test_near import low_of

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    insults = ["idiot", "pathetic", "moron", "disgusting", "worthless"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            pieces = docs.collect()
            assert {p.doc_id for p in pieces} == set(rows)
            assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
            break
        assert docs.columns == columns
        left = {r.doc_id: r for r in docs.collect()}
        assert len(left) == docs.count()
        gone = {i: rows[i] for i in set(rows) - set(left)}
        if name == "toxicity":
            assert sum(sum(w in r.text.lower() for w in insults) >= 2 for r in gone.values()) > 0.5 * len(gone) > 5
            assert not any(all(w in r.text.lower() for w in insults) for r in left.values())
        elif name == "simhash_dedup":
            ids = sorted(rows)
            low = low_of([rows[i].text for i in ids])
            assert set(left) == {i for k, i in enumerate(ids) if low[k] == k}
        elif name == "decontamination":
            assert all(any(b.lower() in r.text.lower() for b in bench) for r in gone.values()) and gone
            assert not any(b in r.text for r in left.values() for b in bench if len(b) >= 32)
        elif name == "secret_scan":
            assert not gone and any(left[i].text != rows[i].text for i in left)
            assert all(left[i].text == (secrets.redact(r.text, secrets.scan(r.text)[1]) if r.text else r.text) for i, r in rows.items())
            assert not any(secrets.base_spans(r.text) for r in left.values())
        rows = left


def test_run_is_the_stages(spark):
    docs = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert docs.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_repeated_and_null_ids_in_dedup(spark):
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (1, text, "c"), (2, text, "d"), (3, "quite another text here", "e")], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in stage(spark, docs, "").collect()) == ["1", "3"]
    assert stage(spark, docs.limit(0), "").collect() == []
