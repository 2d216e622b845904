"""Sinks: extracts, findings history, typed table loads, result exports."""
from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookdq.operators.findings import FINDING_SCHEMA

RUN_COLUMNS = ("run_id", "run_ts", "profile", "filters")
RUN_SCHEMA = T.StructType([*FINDING_SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in RUN_COLUMNS]])


def write_extract(book, path: str, rows: int | None = None, filtered: bool = False) -> None:
    """The raw table (or the population) as parquet, optionally only the first `rows` rows."""
    df = book.population() if filtered else book.raw
    (df.limit(rows) if rows else df).write.mode("overwrite").parquet(path)


def load_to_table(spark: SparkSession, path: str, table: str, date_suffix: str = "_dt") -> None:
    """Parquet into a catalog table, columns named `*_dt` as dates."""
    df = spark.read.parquet(path)
    df = df.select(*[F.col(c).cast("date").alias(c) if c.endswith(date_suffix) else F.col(c) for c in df.columns])
    df.write.mode("overwrite").saveAsTable(table)


def export_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV (with header) or JSON lines; one file per partition."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


class FindingsStore:
    """Run history of findings: parquet partitioned by run, or a catalog table with commits.

    A table is only ever appended to. Each attempt at a run writes its rows under a number of its own, and is committed by one row in
    `<table>_commits` after all rows are there. Readers see, of each run, the rows of its last commit: a job that failed half way left rows
    that nobody sees, and a retried run replaces its earlier attempt. Rows from before there were commits count until their run has one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, table: str | None = None, location: str | None = None):
        """`location`: folder of the table's data, where it is not the warehouse's."""
        if (path is None) == (table is None):
            raise ValueError("give either a path or a table")
        self.spark, self.path, self.name, self.location = spark, path, table, location

    def append(self, findings: DataFrame, run_id: str, run_ts: str, profile: str, filters: str = "") -> None:
        """Store one run. Storing a run again replaces only that run, so a retried job leaves no copies."""
        out = findings.withColumns({"run_id": F.lit(run_id), "run_ts": F.lit(run_ts), "profile": F.lit(profile),
                                    "filters": F.lit(filters)})
        if self.path:
            (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run_id").parquet(self.path))
        else:
            self.commit(run_id, self.stage(out))

    def stage(self, rows: DataFrame) -> str:
        """Writes rows of an attempt, seen by nobody yet. Returns its number."""
        attempt = uuid.uuid4().hex
        self._add(rows.withColumn("_attempt", F.lit(attempt)), self.name, "rows")
        return attempt

    def commit(self, run_id: str, attempt: str) -> None:
        row = [(run_id, attempt, time.time_ns())]
        self._add(self.spark.createDataFrame(row, "run_id string, _attempt string, at long").coalesce(1), f"{self.name}_commits", "commits")

    def _add(self, rows: DataFrame, table: str, folder: str) -> None:
        writer = rows.write.mode("append").option("mergeSchema", True)
        (writer.option("path", f"{self.location}/{folder}") if self.location else writer).saveAsTable(table)

    def _committed(self, stored: DataFrame) -> DataFrame:
        if "_attempt" not in stored.columns:
            return stored
        try:
            commits = self.spark.table(f"{self.name}_commits")
        except AnalysisException as problem:
            if problem.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
                raise
            return stored.where(F.col("_attempt").isNull()).drop("_attempt")
        last = commits.groupBy(F.col("run_id").alias("_run")).agg(F.max_by("_attempt", F.struct("at", "_attempt")).alias("_last"))  # a row a run
        seen = stored.join(last, F.col("run_id").cast("string") == F.col("_run"), "left")
        return seen.where(F.col("_attempt").eqNullSafe(F.col("_last"))).drop("_attempt", "_run", "_last")

    def load(self) -> DataFrame:
        """All runs; an empty frame of the right shape before the first one. Runs without `filters` read ''."""
        try:
            stored = (self.spark.read.option("mergeSchema", True).parquet(self.path) if self.path
                      else self._committed(self.spark.table(self.name)))
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
                raise  # an unreadable history is not an empty one
            return self.spark.createDataFrame([], RUN_SCHEMA)
        if "filters" not in stored.columns:
            stored = stored.withColumn("filters", F.lit(""))
        stored = stored.withColumns({"filters": F.coalesce("filters", F.lit("")), "run_id": F.col("run_id").cast("string")})
        return stored.select(*[c for c in RUN_SCHEMA.names if c in stored.columns],
                             *[c for c in stored.columns if c not in RUN_SCHEMA.names])

    def runs(self) -> DataFrame:
        return run_history(self.load())

    def latest(self, offset: int = 0) -> DataFrame:
        return latest_run(self.load(), offset)


def run_history(stored: DataFrame) -> DataFrame:
    """One row per run: findings, warnings, failures and the rules it was computed under."""
    return (stored.groupBy("run_id", "run_ts")
            .agg(F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("status") == "warn").alias("n_warn"),
                 F.count_if(F.col("status") == "fail").alias("n_fail"),
                 F.coalesce(F.max(F.when(F.col("filters") != "", F.col("filters"))), F.lit("")).alias("filters"))
            .orderBy("run_ts", "run_id"))


def run_trend(runs: DataFrame) -> DataFrame:
    """Flag counts per run in long form."""
    return runs.unpivot(["run_ts"], ["n_fail", "n_warn"], "variable", "value")


def latest_run(stored: DataFrame, offset: int = 0) -> DataFrame:
    """Findings of the n-th latest run (0 = the latest), empty when there are not that many."""
    newest = Window.orderBy(F.col("run_ts").desc(), F.col("run_id").desc())  # over runs, not findings
    runs = (stored.select("run_id", "run_ts").distinct().withColumn("_at", F.row_number().over(newest))
            .where(F.col("_at") == offset + 1).select("run_id"))
    return stored.join(F.broadcast(runs), "run_id", "left_semi")


def is_stale(stored: DataFrame, fingerprint: str) -> DataFrame:
    """One row: was the latest run computed under other rules than the given fingerprint?"""
    last = stored.agg(F.max_by(F.coalesce("filters", F.lit("")), F.struct("run_ts", "run_id")).alias("run_filters"))
    return last.select("run_filters", F.lit(fingerprint).alias("current_filters"),
                       (F.col("run_filters") != fingerprint).alias("stale"))
