"""Preflight: does the configuration fit the table? A report, one row per question."""
from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.book import Book

# fixed values: settings that hold column names
_COLUMN_LISTS = ("group_by", "include", "exclude", "dimensions", "exclude_variables")
_COLUMN_MAPS = ("categorical", "numeric")


def configured_columns(config: Any) -> list[str]:
    """Every column one check configuration names, nested parts included."""
    found: set[str] = set()
    for f in fields(config):
        value = getattr(config, f.name)
        if f.name in _COLUMN_LISTS:
            found.update(value or ())
        elif f.name in _COLUMN_MAPS:
            found.update(value)
        elif f.name in ("default_dimension", "across") and value:
            found.add(value)
        elif f.name == "candidate_keys":
            found.update(c for key in value.values() for c in key)
        elif f.name == "variables":
            found.update(value if isinstance(value, Mapping) else [v for v in value if isinstance(v, str)])
        if f.name == "name" and hasattr(config, "group_by"):
            found.add(value)
        for part in _parts(value):
            found.update(configured_columns(part))
    return sorted(found)


def _parts(value: Any) -> Iterable[Any]:
    items = value.values() if isinstance(value, Mapping) else value if isinstance(value, (tuple, list)) else [value]
    return [v for v in items if is_dataclass(v)]


def preflight(book: Book, configs: Mapping[str, Any]) -> DataFrame:
    """(check, ok, detail). Rules and derived columns are only analysed; rows and sources take one pass each."""
    spark, spec, rows = book.raw.sparkSession, book.spec, []
    active = book.rules.active(spec.profile)
    usable = book
    for rule in active:
        try:
            book.rules.validate(book, rule)
            rows.append((f"rule {rule.key}", True, "compiles"))
        except (AnalysisException, ValueError) as problem:
            rows.append((f"rule {rule.key}", False, str(problem)[:160]))
            usable = book.with_rules(book.rules.all_disabled())
    total = book.raw.count()
    rows.append(("table readable", True, f"{total:,} rows, {len(book.raw.columns)} columns"))
    if active and usable is book:
        kept = book.population().count()
        removed = (total - kept) / total if total else 0.0
        rows.append(("global rules", True, f"{total:,} rows -> {kept:,} ({removed:.1%} removed)"))
    else:
        rows.append(("global rules", True, "none active"))
    groups = {"measures": [*spec.measures.numeric(), spec.measures.exposure_base], "policy_key": list(spec.policy_key),
              "segment_candidates": list(spec.segment_candidates), "derived_columns": list(spec.derived),
              **{name: configured_columns(c) for name, c in configs.items()}}
    for label, names in groups.items():
        missing = [n for n in names if not book.has(n)]
        rows.append((label, not missing, f"{len(names)} referenced" + (f" | missing {', '.join(missing)}" if missing else "")))
    try:
        usable.transformed().select(*spec.derived).schema  # noqa: B018
        rows.append(("derived columns evaluate", True, ", ".join(spec.derived) or "none"))
    except AnalysisException as problem:
        rows.append(("derived columns evaluate", False, str(problem)[:160]))
    # one source more than configured is enough to know they differ
    seen = (usable.population().where(F.col(spec.source).isNotNull()).select(F.col(spec.source).cast("string")).distinct()
            .limit(10 * len(spec.sources) + 100).collect())
    found, expected = {r[0] for r in seen}, set(spec.sources)
    rows.append(("sources", found == expected, f"only configured {sorted(expected - found)}, only in the data {sorted(found - expected)}"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
