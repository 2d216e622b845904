"""Column-level functions against known values and against numpy."""
from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bookdq.functions import percentiles as pc
from bookdq.functions.grading import grade, worst
from bookdq.functions.labels import label_of, segment_label, sort_labels, split_segments
from bookdq.functions.percentiles import percentile_grid, percentiles
from bookdq.functions.ratios import claims_needed, credibility, ratio, weighted_rms_log
from bookdq.functions.running import previous_value, running_total
from bookdq.functions.scales import bucket, from_scale, scale_bounds, to_scale
from bookdq.functions.stability import psi_between_peers


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_labels_of_levels(spark):
    df = column(spark, [1.0, 10_000_000.0, 0.5, None, -3.0])
    assert [r[0] for r in df.select(label_of(df, "x")).collect()] == ["1", "10000000", "0.5", "<null>", "-3"]


def test_segment_labels_keep_nulls_apart(spark):
    df = spark.createDataFrame([("BMQ", 2019), (None, None)], "src string, pol_yr int")
    assert [r[0] for r in df.select(segment_label(df, ["src", "pol_yr"])).collect()] == ["src=BMQ|pol_yr=2019", "src=<null>|pol_yr=<null>"]
    assert df.select(segment_label(df, [])).first()[0] == "ALL"


def test_natural_order_of_labels(spark):
    labels = ["pol_yr=2019", "pol_yr=10", "pol_yr=9", "ALL", "pol_yr=<null>", "pol_yr=x"]
    got = [r[0] for r in sort_labels(spark.createDataFrame([(x,) for x in labels], "segment string")).collect()]
    assert got == ["ALL", "pol_yr=9", "pol_yr=10", "pol_yr=2019", "pol_yr=x", "pol_yr=<null>"]
    got = [r[0] for r in sort_labels(column(spark, ["b|2", "BOP", "10", "9", "<null>"], "string"), "x").collect()]
    assert got == ["9", "10", "BOP", "b|2", "<null>"]


def test_split_segments(spark):
    df = spark.createDataFrame([("src=A|yr=1", 1), ("src=B", 2), ("ALL", 3)], "segment string, n int")
    assert split_segments(df).columns == ["src", "yr", "n"]
    assert {tuple(r) for r in split_segments(df).collect()} == {("A", "1", 1), ("B", "", 2), ("(all)", "(all)", 3)}
    assert split_segments(df, max_dims=1).columns == ["segment", "n"]
    assert split_segments(df.where("segment = 'ALL'")).columns == ["segment", "n"]
    assert split_segments(df.withColumn("yr", F.lit("kept")), keep_label=True).columns == ["src", "segment", "n", "yr"]


@pytest.mark.parametrize("value,warn,fail,higher,expected", [
    (None, 0.1, 0.2, True, "info"), (0.3, 0.1, 0.2, True, "fail"), (0.2, 0.1, 0.2, True, "warn"), (0.1, 0.1, 0.2, True, "pass"),
    (0.15, 0.1, None, True, "warn"), (5.0, None, None, True, "pass"), (0.05, 0.2, 0.1, False, "fail"), (0.15, 0.2, 0.1, False, "warn"),
    (float("nan"), 0.1, 0.2, True, "info")])
def test_grade(spark, value, warn, fail, higher, expected):
    assert column(spark, [value]).select(grade(F.col("x"), warn, fail, higher)).first()[0] == expected


def test_worst(spark):
    assert column(spark, ["pass", "warn", "info"], "string").agg(worst(F.col("x"))).first()[0] == "warn"
    assert column(spark, ["odd", None], "string").agg(worst(F.col("x"))).first()[0] is None


def test_credibility(spark):
    got = [r[0] for r in column(spark, [1082.0, 270.5, 108.2, 0.0, 5000.0, -1.0]).select(credibility(F.col("x"))).collect()]
    assert got == pytest.approx([1, 0.5, math.sqrt(0.1), 0, 1, 0])
    assert column(spark, [0.5]).select(claims_needed(F.col("x"))).first()[0] == pytest.approx(270.5)


def test_ratio_needs_a_positive_denominator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None]


@pytest.mark.parametrize("lifts,expected", [([1.0, 1.0], 0.0), ([1.5, 1 / 1.5], math.log(1.5)), ([None, None], None)])
def test_interaction_strength(spark, lifts, expected):
    df = spark.createDataFrame([(x, 2.0) for x in lifts], "lift double, w double")
    got = df.agg(weighted_rms_log(F.col("lift"), F.col("w"))).first()[0]
    assert got == (pytest.approx(expected) if expected is not None else None)


@pytest.mark.parametrize("method", ["log1p", "log10", "signed_log", "none"])
def test_scales_invert(spark, method):
    df = column(spark, [0.5, 3.0, 1e6])
    v, _ = to_scale(F.col("x"), method)
    assert [r[0] for r in df.select(from_scale(v, method)).collect()] == pytest.approx([0.5, 3.0, 1e6])


def test_scale_domains(spark):
    df = column(spark, [-5.0, 0.0])
    assert [r[0] for r in df.select(to_scale(F.col("x"), "log1p")[0]).collect()] == [None, 0.0]
    assert [r[0] for r in df.select(to_scale(F.col("x"), "log10")[0]).collect()] == [None, None]
    assert [r[0] for r in df.select(to_scale(F.col("x"), "signed_log")[0]).collect()] == pytest.approx([-math.log(6), 0])
    assert scale_bounds(0.0, 5.0, "log10") is None and scale_bounds(2.0, 2.0, "none") is None


def test_bucket_folds_the_tails(spark):
    df = column(spark, [-9.0, 0.0, 2.4, 2.5, 9.9, 10.0, 99.0])
    assert [r[0] for r in df.select(bucket(F.col("x"), 0.0, 10.0, 4)).collect()] == [0, 0, 0, 1, 3, 3, 3]


def test_percentile_grid():
    assert len(percentile_grid(20)) == 22 and percentile_grid([0.9, 0.5, 0.5]) == [0, 0.5, 0.9, 0.99, 1]
    for bad in (1, 1001, [], [1.2]):
        with pytest.raises(ValueError):
            percentile_grid(bad)


# ---- exact percentiles ---------------------------------------------------------------
def as_dict(df, by):
    return {(*[r[b] for b in by], r["variable"], r["prob"]): r["value"] for r in df.collect()}


def skewed(spark, n=20_000, seed=3):
    """A group with most of the rows, a heavily repeated value, a null group, an empty group and one single row."""
    rng = np.random.default_rng(seed)
    g = rng.choice(["hot", "b", None], n, p=[0.8, 0.15, 0.05])
    x = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.lognormal(3, 2, n), 2)) * rng.choice([1, -1], n, p=[0.9, 0.1])
    rows = list(zip(g.tolist(), x.tolist())) + [("empty", None), ("one", 5.0)]
    return spark.createDataFrame(rows, "g string, x double"), rows


@pytest.mark.parametrize("broadcast,block_rows", [(True, 10**9), (False, 10**9), (True, 50), (False, 50), (True, 0)])
def test_exact_percentiles_under_skew(spark, monkeypatch, broadcast, block_rows):
    if not broadcast:  # more located blocks than may be broadcast: the join shuffles
        monkeypatch.setattr(pc, "collect_if_small", lambda df: None)
    df, rows = skewed(spark)
    probs = [0.0, 0.01, 0.333, 0.5, 0.9, 0.99, 1.0]
    got = as_dict(percentiles(df, ["g"], {"x": F.col("x"), "twice": F.col("x") * 2}, probs, blocks=16, positives=True, block_rows=block_rows), ["g"])
    for g in ("hot", "b", None, "one"):
        values = np.array([x for k, x in rows if k == g])
        for p in probs:
            assert got[(g, "x", p)] == pytest.approx(np.quantile(values, p), abs=1e-9)
            assert got[(g, "twice", p)] == pytest.approx(2 * np.quantile(values, p), abs=1e-9)
            assert got[(g, "+x", p)] == pytest.approx(np.quantile(values[values > 0], p), abs=1e-9)
    assert not [k for k in got if k[0] == "empty"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=0, max_size=40), p=st.floats(0, 1))
def test_exact_percentile_of_any_values(spark, values, p):
    got = percentiles(spark.createDataFrame([(v,) for v in values], "x double"), [], {"x": F.col("x")}, [p], blocks=4).collect()
    known = [v for v in values if v is not None]
    if not known:
        assert got == []
    else:
        assert got[0]["value"] == pytest.approx(np.quantile(known, p), rel=1e-9, abs=1e-6)


def test_approximate_percentiles(spark):
    df, rows = skewed(spark)
    exact, approx = (as_dict(percentiles(df, ["g"], {"x": F.col("x")}, [0.5, 0.9], exact=e, positives=True), ["g"]) for e in (True, False))
    assert set(exact) == set(approx)
    hot = np.sort([x for k, x in rows if k == "hot"])
    for key in [k for k in exact if k[0] == "hot" and k[1] == "x"]:
        assert abs(np.searchsorted(hot, approx[key]) / len(hot) - np.searchsorted(hot, exact[key]) / len(hot)) < 0.01


# ---- running totals ------------------------------------------------------------------
def test_running_total_over_many_partitions_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v)) for k, v in enumerate(np.where(rng.random(5000) < 0.4, 7.0, rng.integers(0, 1000, 5000)))]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["total"] for r in running_total(df, [F.col("v").desc(), F.col("k").asc()], "v", "total").collect()}
    total = 0.0
    for k, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += v
        assert got[k] == pytest.approx(total)


def test_running_total_within_a_hot_key(spark):
    rng = np.random.default_rng(8)
    rows = [("hot" if rng.random() < 0.6 else f"v{rng.integers(0, 9)}", k, float(rng.integers(0, 50))) for k in range(4000)]
    got = {r["k"]: r["total"] for r in running_total(spark.createDataFrame(rows, "g string, k int, v double"), [F.col("k").asc()], "v", "total", keys=["g"]).collect()}
    sums: dict[str, float] = {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0.0) + v
        assert got[k] == pytest.approx(sums[g])


def test_running_total_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert running_total(df, [F.col("k").asc()], "v", "total").count() == 0


def test_previous_value_across_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if rng.random() < 0.7 else f"v{rng.integers(0, 20)}", i, int(rng.integers(0, 9))) for i in range(4000)]
    got = {r["at"]: r["prev"] for r in previous_value(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], ["at"], "v", "prev").collect()}
    last: dict[str, int] = {}
    for k, at, v in rows:
        assert got[at] == last.get(k)
        last[k] = v


# ---- PSI -----------------------------------------------------------------------------
def reference_psi(a, b):
    a, b = (np.maximum(np.array(v, float), 1e-4) for v in (a, b))
    a, b = a / a.sum(), b / b.sum()
    return float(((a - b) * np.log(a / b)).sum())


def test_psi_between_peers(spark):
    counts = {("p", 1): [10, 10, 0], ("p", 2): [10, 10, 0], ("p", 3): [90, 10, 5], ("q", 1): [3, 4, 5], (None, 1): [1, 1, 1]}
    rows = [(p, a, k, n) for (p, a), ns in counts.items() for k, n in enumerate(ns) if n]
    got = {(r["p"], r["a"]): r for r in psi_between_peers(spark.createDataFrame(rows, "p string, a int, k int, n long"), ["p", "a"], "a", "k").collect()}
    assert set(got) == {("p", 1), ("p", 2), ("p", 3)}  # a lone segment has no peers, a null dimension takes no part
    far = reference_psi(counts[("p", 1)], counts[("p", 3)])
    assert got[("p", 1)]["psi"] == pytest.approx(far / 2) and got[("p", 1)]["max_pairwise_psi"] == pytest.approx(far)
    assert got[("p", 3)]["psi"] == pytest.approx(far) and got[("p", 3)]["n_peers"] == 2 and got[("p", 3)]["n"] == 105
    assert reference_psi([10, 10], [10, 10]) == 0 and reference_psi([90, 10], [10, 90]) > 1


def test_labels_of_many_parts(spark):
    """Ten parts and more sort part by part, and split into as many columns."""
    labels = ["|".join(f"d{i}={v}" for i, v in enumerate(p)) for p in ([1] * 9 + [10], [1] * 9 + [9], [1] * 9 + ["x"], [1] * 9 + ["<null>"], [1] * 9, [1] * 11)]
    df = spark.createDataFrame([(x,) for x in labels], "segment string")
    got = [r[0] for r in sort_labels(df).collect()]
    assert got == [labels[4], labels[5], labels[1], labels[0], labels[2], labels[3]]
    out = split_segments(df)
    assert out.columns == [f"d{i}" for i in range(11)] and {r["d10"] for r in out.collect()} == {"", "1"}
