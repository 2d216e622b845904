"""Key uniqueness, duplicate samples and key suggestion."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.grading import grade
from bookdq.operators import findings as fd
from bookdq.plans.registry import CheckResult, check
from bookdq.plans.sizing import materialize

WHOLE = "_all"
TASK_ROWS = 250_000  # rows of the table to a task that counts keys
SALTS = 16  # tasks among which the rows of one key value are spread


@dataclass(frozen=True)
class KeyConfig:
    enabled: bool = True
    order: int = 10
    candidate_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # source (or `_all`) -> columns
    warn_dup_rate: float = 0.0
    fail_dup_rate: float = 0.001
    sample_limit: int = 50
    suggest_max_cols: int = 8
    suggest_exclude_amounts: bool = True


def _rows_of(book: Book, source: str) -> DataFrame:
    return book.population() if source == WHOLE else book.population(F.col(book.spec.source) == source)


def key_groups(book: Book, source: str, key: Sequence[str]) -> DataFrame:
    """(*key, _n) of a stored book. A hash aggregate keeps the keys of its task in memory, nearly a row each, and a task grows with
    the files it is given; so rows are dealt to as many tasks as they need, a frequent value to several of them, and counts by key."""
    tasks = 1 + book.population().count() // TASK_ROWS  # a stored book knows its rows
    rows = _rows_of(book, source).select(*key, (F.spark_partition_id() % SALTS).alias("_salt"))
    part = rows.repartition(tasks, *key, "_salt").groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    return part.drop("_salt").repartition(tasks, *key).groupBy(*key).agg(F.sum("_n").alias("_n"))


def key_summary(book: Book, source: str, key: Sequence[str], cfg: KeyConfig = KeyConfig()) -> DataFrame:
    """One row: rows, distinct keys, rows and groups that repeat a key, and null counts per key column."""
    groups = key_groups(book.stored([book.spec.source, *key]), source, key)
    n, repeated = F.col("_n"), F.col("_n") > 1
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = groups.agg(
        zero(F.sum(n)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct_keys"),
        zero(F.sum(F.when(repeated, n))).alias("n_dup_rows"), F.count_if(repeated).alias("n_dup_groups"),
        zero(F.max(n)).alias("max_rows_per_key"),
        *[zero(F.sum(F.when(F.col(k).isNull(), n))).alias(f"null__{k}") for k in key])
    rate = F.when(F.col("n_rows") > 0, F.col("n_dup_rows") / F.col("n_rows")).otherwise(F.lit(0.0))
    nulls = F.filter(F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"null__{k}").alias("n")) for k in key]),
                     lambda c: c["n"] > 0)
    named = F.transform("key_nulls", lambda c: F.concat(c["column"], F.lit(" ("), fd.count_text(c["n"]), F.lit(")")))
    return (out.withColumns({"dup_rate": rate, "key_nulls": nulls})
            .select(F.lit(source).alias("source"), grade(F.col("dup_rate"), cfg.warn_dup_rate, cfg.fail_dup_rate).alias("status"),
                    F.lit(", ".join(key)).alias("key"), "n_rows", "n_distinct_keys", "n_dup_rows", "n_dup_groups",
                    "dup_rate", "max_rows_per_key",
                    F.when(F.size("key_nulls") > 0, F.array_join(named, ", ")).otherwise(F.lit("none")).alias("key_cols_with_nulls"),
                    "key_nulls"))


def duplicate_sample(book: Book, source: str, key: Sequence[str], limit: int = 50) -> DataFrame:
    """The key values with most rows; ties in key order, so the sample is stable."""
    book.require(key)
    groups = _rows_of(book, source).groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    return groups.orderBy(F.col("n_rows").desc(), *key).limit(limit)


def suggest_key(book: Book, source: str, candidates: Sequence[str] | None = None, start: Sequence[str] = (),
                max_cols: int = 8, exclude_amounts: bool = True, batch: int = 4) -> DataFrame:
    """Greedy forward search: each step adds the column that raises the distinct key count most, until unique.

    A distinct count of many column sets in one aggregate multiplies the rows, so sets are counted in small batches,
    most promising first. Columns are skipped once they provably cannot win: distinct(key + c) is at most
    distinct(key) x distinct(c), and at most the row count. The result is exact; ties go to the first column. `is_unique` says
    whether a step's columns are a key; a walk that ends at `max_cols` without one has it false on its last row.
    """
    names = list(candidates) if candidates else [
        c for c in book.columns(derived=False) if not (exclude_amounts and book.is_amount(c))]
    book.require([*names, *start])
    df = materialize(_rows_of(book, source).select(*dict.fromkeys([*names, *start])), "candidates")  # every step reads it

    def distinct(sets: list[list[str]]) -> list[int]:
        counted = df.agg(*[F.count_distinct(_key(s)).alias(f"d{i}") for i, s in enumerate(sets)]).first()
        return [counted[f"d{i}"] for i in range(len(sets))]

    total = df.count()
    single: dict[str, int] = {}
    chosen, steps = list(start), []
    current = distinct([chosen])[0] if chosen else 1
    while len(steps) < max_cols:
        options = [c for c in names if c not in chosen]
        if not options:
            break
        if not chosen or not single:
            for at in range(0, len(options), batch):
                part = options[at:at + batch]
                single.update(zip(part, distinct([[c] for c in part])))
        bound = {c: min(total, current * single[c]) for c in options}
        counts: dict[str, int] = {}
        waiting = sorted(options, key=lambda c: (-bound[c], options.index(c)))
        if not chosen:
            counts, waiting = {c: single[c] for c in options}, []
        while waiting:
            best = max(counts.values(), default=-1)
            part = [c for c in waiting[:batch] if bound[c] >= best]
            if not part:
                break
            counts.update(zip(part, distinct([[*chosen, c] for c in part])))
            waiting = waiting[batch:]
        current = max(counts.values())
        added = next(c for c in options if counts.get(c) == current)
        chosen = [*chosen, added]
        steps.append((len(chosen), added, ", ".join(chosen), current, total, current / total if total else 1.0, current == total))
        if current == total:
            break
    schema = "step int, added string, key string, distinct_keys bigint, n_rows bigint, coverage double, is_unique boolean"
    return df.sparkSession.createDataFrame(steps, schema)


def _key(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def key_findings(summary: DataFrame, source_column: str, cfg: KeyConfig) -> DataFrame:
    """Duplicate rate per key, and the key columns that hold nulls."""
    frames = []
    for whole in (True, False):
        part = summary.where((F.col("source") == WHOLE) == whole)
        dims = [] if whole else [source_column]
        part = part if whole else part.withColumn(source_column, F.col("source"))
        frames.append(fd.emit(part, "key_uniqueness", dims, dict(
            variable="_key", item=F.col("key"), metric="dup_rate", value=F.col("dup_rate"), warn=cfg.warn_dup_rate,
            fail=cfg.fail_dup_rate,
            detail=F.concat(fd.count_text(F.col("n_dup_rows")), F.lit(" duplicate rows in "),
                            fd.count_text(F.col("n_dup_groups")), F.lit(" keys")))))
        nulls = part.select(*dims, F.inline("key_nulls"))
        frames.append(fd.emit(nulls, "key_uniqueness", dims, dict(
            variable=F.col("column"), item="key column", metric="key_null_rows", value=F.col("n"), status="info",
            detail=F.concat(F.lit("null in key column for "), fd.count_text(F.col("n")), F.lit(" rows")))))
    return fd.concat(frames, summary.sparkSession)


@check("key_uniqueness", KeyConfig, "Key uniqueness", order=10)
def run(book: Book, cfg: KeyConfig) -> CheckResult:
    spark = book.raw.sparkSession
    if not cfg.candidate_keys:
        return CheckResult(fd.no_findings(spark), notes=["No candidate keys configured; use suggest_key."])
    book = book.stored([book.spec.source, *[c for key in cfg.candidate_keys.values() for c in key]])  # every key reads it
    parts = [key_summary(book, source, key, cfg) for source, key in cfg.candidate_keys.items()]
    summary = materialize(reduce(DataFrame.unionByName, parts), "keys")  # one row per key: findings and table read it
    tables = {"summary": summary.drop("key_nulls")}
    for source, key in cfg.candidate_keys.items():
        tables[f"duplicates::{source}"] = duplicate_sample(book, source, key, cfg.sample_limit)
    return CheckResult(key_findings(summary, book.spec.source, cfg), tables)
