"""The stages one by one, each on what the one before kept, against plain versions; and odd tables through all of them."""
from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import ODD, SCHEMA

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    assert list(STAGES) == ["toxicity", "near_duplicates", "secrets", "mix", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = STAGES["toxicity"](spark, docs, SF).cache()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and kept < {r["doc_id"] for r in docs.collect()}
    assert sum(d in kept for d, toxic in labels.items() if not toxic) > 0.97 * sum(not toxic for toxic in labels.values())
    one = STAGES["near_duplicates"](spark, clean, SF).cache()
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    safe = STAGES["secrets"](spark, one, SF).cache()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    assert safe.columns == docs.columns and safe.count() == one.count()
    for r in safe.collect():
        assert r["n_chars"] == len(r["text"]) and not brute.base_secrets(r["text"])
        assert (r["text"] == before[r["doc_id"]]) or "[" in r["text"]
    mixed = STAGES["mix"](spark, safe, SF).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    ids = STAGES["encode"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in ids) == Counter(r["doc_id"] for r in mixed.collect())
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in ids)


def test_stages_take_anything(spark):
    rows = [(i, t, None, None if i % 2 else "s", None, "k", i, "z") for i, t in enumerate(ODD)] + [(None,) * 8, (9, ODD[9], None, None, None, None, None, None)]
    for frame in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            columns = frame.columns
            frame = stage(spark, frame, SF).cache()
            assert name == "encode" or frame.columns == columns
            frame.count()
