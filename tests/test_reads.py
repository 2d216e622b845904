"""Operators that look at the book several times make its rows once."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bookdq import Book, BookSpec, Measures
from bookdq.operators import deep_dive as dd
from bookdq.operators import distribution as ds
from bookdq.operators import keys, values
from bookdq.operators.binning import Binning, resolve
from bookdq.operators.distribution import Profile, PsiRule

N = 500
NUMBERS = Profile("x", group_by=("src", "yr"), allow_negative=False, outlier_ratio=2.0, psi=PsiRule("yr", bins=4))
CODES = Profile("cd", type="categorical", group_by=("src", "yr"), psi=PsiRule("yr"))


@pytest.fixture
def counted(spark):
    """A book whose source is made by a function that counts its calls, one for each row read."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def source(i):
        calls.add(1)
        return "ABC"[i % 3]

    raw = spark.range(N).select(source("id").alias("src"), (F.col("id") % 97 - 3).cast("double").alias("x"), (F.col("id") % 4).alias("yr"),
                                F.concat(F.lit("c"), F.col("id") % 7).alias("cd"), F.col("id").alias("k"))
    spec = BookSpec("counted", "src", ("A", "B", "C"), Measures("x", "x", "k", "x", "cd"), ("k",), derived={"yr2": "yr * 2"})
    return Book(spec, raw), calls


READERS = {
    "findings of distributions": lambda b: ds.run(b, ds.DistributionConfig(variables=(NUMBERS, CODES))).findings,
    "statistics": lambda b: ds.numeric_stats(b, NUMBERS),
    "percentiles": lambda b: ds.percentile_table(b, NUMBERS),
    "histogram": lambda b: ds.histogram(b, NUMBERS),
    "psi": lambda b: ds.psi_numeric(b, NUMBERS),
    "findings of values": lambda b: values.run(b, values.ValuesConfig(categorical={"cd": values.CategoricalRule()}, numeric={"x": values.NumericRule()})).findings,
    "medians": lambda b: values.medians_by_source(b, "x"),
    "findings of keys": lambda b: keys.run(b, keys.KeyConfig(candidate_keys={"A": ("k",), "_all": ("src", "cd")})).findings,
    "key suggestion": lambda b: keys.suggest_key(b, "_all", ("src", "cd", "yr", "x")),
}


@pytest.mark.parametrize("name", READERS)
def test_rows_are_made_once(counted, name):
    book, calls = counted
    assert READERS[name](book).collect()
    assert calls.value == N


def test_edges_read_the_rows_once(spark, counted):
    book, calls = counted
    found = resolve(book, Binning("x", "fifths", "quantile", bins=5), "src <> 'none'")
    assert len(found.cuts) == 4 and calls.value == N


def test_a_copy_holds_the_population_and_its_derived_columns(counted):
    book, _ = counted
    copy = book.stored(["src", "yr2"])
    assert copy.columns() == ["src", "yr2"] and copy.stored(["src"]) is copy
    assert sorted(copy.population().collect()) == sorted(book.population().select("src", "yr2").collect())


@pytest.mark.parametrize("method", ["none", "log10"])
def test_ends_of_a_histogram_are_those_of_the_statistics(spark, method):
    rows = [("this segment" if i % 3 else "rest of book", *[None if (i + j) % 11 == 0 else float((i * (j + 3)) % 89 - 5) for j in range(len(dd.METRICS))]) for i in range(400)]
    grain = spark.createDataFrame(rows, "scope string, " + ", ".join(f"{m} double" for m in dd.METRICS))
    metrics = ("premium", "loss")
    assert dd.histogram_bounds(dd.histogram_ends(grain, metrics, method), metrics, method) == dd.histogram_bounds(dd.policy_stats(grain), metrics, method)
    own, given = (dd.policy_histogram(grain, s, metrics, method, 10) for s in (None, dd.policy_stats(grain)))
    assert sorted(own.collect()) == sorted(given.collect())


def test_keys_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(keys, "TASK_ROWS", 50)
    raw = spark.range(1000).select(F.lit("A").alias("src"), F.when(F.col("id") >= 400, F.col("id")).alias("k"), F.lit(1.0).alias("x"))
    book = Book(BookSpec("wide", "src", ("A",), Measures("x", "x", "k", "x", "src"), ("k",)), raw).stored(["src", "k"])
    groups = keys.key_groups(book, "_all", ["k"])
    assert max(r["count"] for r in groups.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 100
    got = keys.key_summary(book, "_all", ["k"]).first()
    assert (got["n_rows"], got["n_distinct_keys"], got["n_dup_rows"], got["n_dup_groups"], got["max_rows_per_key"]) == (1000, 601, 400, 1, 400)
    assert got["key_cols_with_nulls"] == "k (400)"
