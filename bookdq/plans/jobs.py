"""Command line jobs for spark-submit: preflight, refresh, summary and extract, driven by one configuration file.

    spark-submit bookdq/plans/jobs.py refresh --config book.yaml [--no-rules] [--checks missing_rate business_rules]

The file (YAML or JSON) holds `book` (BookSpec), `location`, and optionally `schema`, `sources` (named views),
`optional_sources`, `sql_vars`, `rules`, `transforms`, `apply_transforms`, `checks`, `check_overrides`, `plugins` and
`results` ({path: …} or {table: …}). Unknown settings are errors.
"""
from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from bookdq.book import Book, BookSpec
from bookdq.operators.filters import Rule, RuleSet
from bookdq.operators.preflight import preflight
from bookdq.operators.summary import summarize
from bookdq.operators.transforms import ColumnTransform, TransformSet
from bookdq.plans.refresh import refresh
from bookdq.plans.registry import check_config, checks, from_dict
from bookdq.plans.sizing import drop_materialized
from bookdq.sources import FindingsStore, Sources, read_source, write_extract

_SETTINGS = {"book", "location", "schema", "sources", "optional_sources", "sql_vars", "rules", "transforms", "apply_transforms",
             "checks", "check_overrides", "plugins", "results"}


def read_config(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def book_of(spark: SparkSession, config: Mapping[str, Any]) -> Book:
    """The book a configuration describes; reading it starts no job (but for inferring CSV types)."""
    extra = set(config) - _SETTINGS
    if extra:
        raise ValueError(f"unknown setting(s) {', '.join(sorted(extra))}")
    Sources(spark, config.get("sources", {}), config.get("optional_sources", ()))
    rules = RuleSet(tuple(from_dict(Rule, r) for r in config.get("rules", ())))
    transforms = TransformSet(tuple(from_dict(ColumnTransform, t) for t in config.get("transforms", ())), config.get("apply_transforms", False))
    return Book(from_dict(BookSpec, config["book"]), read_source(spark, config["location"], config.get("schema")), rules, transforms,
                config.get("sql_vars"))


def checks_of(config: Mapping[str, Any]) -> dict[str, Any]:
    """Check settings with the overrides merged over them."""
    entries, wanted, over = checks(config.get("plugins", ())), config.get("checks", {}), config.get("check_overrides", {})
    unknown = (set(wanted) | set(over)) - set(entries)
    if unknown:
        raise ValueError(f"unknown check(s) {', '.join(sorted(unknown))}")
    return {n: check_config(entries[n], wanted.get(n), over.get(n)) for n in entries if n in wanted or n in over}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bookdq")
    parser.add_argument("job", choices=("preflight", "refresh", "summary", "extract"))
    parser.add_argument("--config", required=True)
    parser.add_argument("--checks", nargs="*", help="refresh: only these checks")
    parser.add_argument("--no-rules", action="store_true", help="refresh: switch every rule off")
    parser.add_argument("--by", nargs="*", default=[], help="summary: dimensions")
    parser.add_argument("--out", help="extract, summary: target folder (summary without one prints every group)")
    parser.add_argument("--rows", type=int, help="extract: only the first rows")
    parser.add_argument("--filtered", action="store_true", help="extract: the population instead of the raw table")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    config = read_config(args.config)
    spark = SparkSession.builder.appName(f"bookdq {args.job}").getOrCreate()
    book = book_of(spark, config)
    if args.job == "preflight":
        report = preflight(book, checks_of(config)).collect()  # one row per question
        for r in report:
            print(f"{'ok  ' if r['ok'] else 'MISS'} {r['check']}: {r['detail']}")
        return 0 if all(r["ok"] for r in report) else 1
    if args.job == "summary":
        if args.out:
            summarize(book, args.by).write.mode("overwrite").parquet(args.out)
        else:
            for row in summarize(book, args.by).toLocalIterator():  # every group, a partition at a time
                print(json.dumps(row.asDict(), default=str))
        return 0
    if args.job == "extract":
        write_extract(book, args.out, args.rows, args.filtered)
        return 0
    store = FindingsStore(spark, **config["results"])
    run_id, found, errors = refresh(book, checks_of(config), store, args.checks, config.get("plugins", ()), use_rules=not args.no_rules)
    counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    print(f"{run_id}: {sum(counts.values())} findings {counts}" + (f", failed: {', '.join(errors)}" if errors else ""))
    drop_materialized(spark)
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
