"""The command line jobs, end to end on a small book."""
from __future__ import annotations

import json

import pytest

from bookdq.plans.jobs import book_of, checks_of, main
from bookdq.sources import FindingsStore


@pytest.fixture
def config(spark, tmp_path):
    rows = [("A", 1, 10.0, 1.0, 1, 2.0, "x"), ("A", 1, -5.0, 0.0, 0, 1.0, "x"), ("B", None, 7.0, 3.0, 1, 1.0, "y")]
    spark.createDataFrame(rows, "src string, k int, premium double, loss double, claims int, expo double, base string").write.parquet(str(tmp_path / "book"))
    (tmp_path / "ids.csv").write_text("k\n1\n")
    data = {
        "book": {"name": "small", "source": "src", "sources": ["A", "B"], "policy_key": ["k"], "segment_candidates": ["src", "base"],
                 "measures": {"premium": "premium", "loss": "loss", "claims": "claims", "exposure": "expo", "exposure_base": "base"}},
        "location": str(tmp_path / "book"), "sources": {"ids": str(tmp_path / "ids.csv")}, "sql_vars": {"id_list": "ids"},
        "rules": [{"key": "listed", "enabled": True, "exclude_when": "src = 'A' AND is_listed AND premium < 0",
                   "lists": {"is_listed": {"column": "k", "source": "{{ id_list }}", "source_column": "k"}}}],
        "checks": {"business_rules": {"rules": [{"id": "negative", "violation": "premium < 0", "variables": ["premium"]}]}, "missing_rate": {}},
        "check_overrides": {"missing_rate": {"include": ["k"]}}, "results": {"path": str(tmp_path / "history")}}
    path = tmp_path / "book.json"
    path.write_text(json.dumps(data))
    return data, str(path)


def test_jobs(spark, config, tmp_path, capsys):
    data, path = config
    assert main(["preflight", "--config", path]) == 0
    assert main(["refresh", "--config", path]) == 0
    assert main(["refresh", "--config", path, "--no-rules", "--checks", "business_rules"]) == 0
    runs = FindingsStore(spark, **data["results"]).runs().collect()
    assert sorted(r["filters"].split("#")[0] for r in runs) == ["", "listed"]
    assert {(r["n_findings"], r["n_fail"]) for r in runs} == {(4, 1), (2, 1)}  # filtered: no negative premium left, k missing in B
    assert main(["extract", "--config", path, "--out", str(tmp_path / "x"), "--filtered"]) == 0
    assert spark.read.parquet(str(tmp_path / "x")).count() == 2
    assert main(["summary", "--config", path, "--by", "src"]) == 0
    assert "premium_share" in capsys.readouterr().out


def test_preflight_fails_on_a_wrong_column(config, tmp_path):
    data, _ = config
    data["checks"]["segment_mix"] = {"dimensions": ["gone"]}
    path = tmp_path / "wrong.json"
    path.write_text(json.dumps(data))
    assert main(["preflight", "--config", str(path)]) == 1


def test_unknown_settings(spark, config):
    data, _ = config
    with pytest.raises(ValueError):
        book_of(spark, {**data, "colour": "red"})
    with pytest.raises(ValueError):
        checks_of({**data, "checks": {"no_such_check": {}}})
