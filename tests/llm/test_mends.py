"""Ties, extreme values, special tokens, repeated ids, and columns whose names the operators use inside."""
from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from bookdq.llm import curves, neardup
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_equal_cosines_go_to_the_smaller_id(spark):
    """A query and scaled copies of its vector, and entries of several ids that tie."""
    v = np.array([0.5, 0.25, -1.0, 2.0])
    rows = [(0, v.tolist())] + [(i, (v * 2.0 ** (i % 7 - 3)).tolist()) for i in range(1, 30)] + [(50 + i, (-v).tolist()) for i in range(1, 5)]
    got = curves.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5] and all(r["score"] == got[0]["score"] for r in got)


def test_cosines_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.choice([200, 0, -200])).tolist()) for i in range(60)]
    got = curves.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    for r in got:
        cos = {i: float(x @ unit[r["query_id"]] / np.sqrt(x @ x) / np.sqrt(unit[r["query_id"]] @ unit[r["query_id"]])) for i, x in unit.items() if i != r["query_id"]}
        assert abs(r["score"] - cos[r["vec_id"]]) < 1e-12 and sorted(cos, key=lambda i: (-cos[i], i))[r["rank"] - 1] == r["vec_id"]


def test_one_id_with_two_texts(spark):
    """The link of an id's second text is found, and does not link the first."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    other = [f"v{i}" for i in range(80)]
    near = [*base[:-1], "changed"]
    docs = [(5, " ".join(other)), (5, " ".join(base)), (7, " ".join(near)), (9, " ".join(other)), (9, " ".join(rng.sample(other, 80)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.classified(frame, "doc_id", "text", 2, 80).collect()
    assert sorted((r["id"], r["component"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 9, True)]
    assert sorted(r["doc_id"] for r in neardup.kept(frame, width=2).collect()) == [5, 5, 9]


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    a = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(a))] * 40 + [(2, " ".join([*a[:-1], "x"]))] * 40
    made = []
    compared = neardup.compared
    monkeypatch.setattr(neardup, "compared", lambda pairs, sets, percent: (made.append((pairs.count(), sets.count())), compared(pairs, sets, percent))[1])
    got = neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and sum(n for n, _ in made) == 1 and made[0][1] == 2


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside are columns like others, with their values unchanged."""
    names = ["_c", "_row", "_copy", "_found", "_y", "_toxicity", "_gone", "all", "k", "h", "id", "row", "v", "kept", "a b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = spark.createDataFrame([(*r, *[f"{n}{r['doc_id']}" for n in names]) for r in docs.limit(60).collect()], docs.schema.simpleString()[7:-1] + ", " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = frame.columns
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), frame.schema)
        assert frame.columns == columns, name
        rows = frame.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name


def test_near_duplicates_of_larger_groups(spark):
    """Several hot groups that share a passage: components equal those of all pairs."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(20):
            words = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(passage + words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()}
    assert got == brute.near_duplicates(docs, 2, 80)
