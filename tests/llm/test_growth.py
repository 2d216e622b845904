"""Steps whose cost must not grow faster than their input."""
from __future__ import annotations

import random

from bookdq.llm import neardup, sharding
from bookdq.llm.common import Shelf, likely_among
from bookdq.plans import sizing
from tests.llm import brute


def test_finished_buckets_are_left_out(spark, monkeypatch):
    """Texts with common passages that are never linked: each bucket goes through the rounds that its own members need."""
    rng = random.Random(4)
    passages = [[f"p{i}-{j}" for j in range(40)] for i in range(6)]
    docs = [(i, " ".join([*passages[i % 6], *(f"x{rng.randrange(10**6)}" for _ in range(4 + i // 12))])) for i in range(60)]
    docs += [(100 + i, " ".join([*passages[0], *passages[1], f"y{i}"])) for i in range(8)]
    rows = {}
    save = Shelf.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name.startswith("open") and name[4:].isdigit():
            rows[name] = out.count()
        return out

    monkeypatch.setattr(Shelf, "save", counted)
    monkeypatch.setattr(neardup, "FIRST_PIVOTS", 1)
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup.bands, "__defaults__", (1,))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()}
    assert got == brute.near_duplicates(docs, 2, 80)
    sizes = [rows[k] for k in sorted(rows)]
    assert len(sizes) > 1 and sizes[-1] < sizes[0], rows


def test_few_rows_pass_the_filter(spark):
    """All rows whose key is wanted, one of a few hundred others at most."""
    rows = spark.range(100_000).selectExpr("id - 50000 AS k", "cast(id AS string) AS wide")
    keys = spark.range(0, 100_000, 50).selectExpr("id - 50000 AS key").unionByName(spark.range(1).selectExpr("cast(null AS long) AS key"))
    found = {r["k"] for r in likely_among(rows, "k", keys, "key").collect()}
    assert found >= set(range(-50_000, 50_000, 50)) and len(found) < 2_300


def test_rounds_sort_nothing(spark):
    """The tables sorted as a whole are those of the first cut, the ballast and the slots, however many rounds move documents."""
    docs = [(i, f"pair {i % 90} " * 6) for i in range(180)] + [(1000 + i, "hot " * 40) for i in range(90)] + [(2000 + i, f"single {i} " * (1 + 40 * (i % 3))) for i in range(120)]
    before = len(sizing.stored)
    rows = sharding.assign(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    assert len(rows) == len(docs) and len(sizing.stored) - before == 3
