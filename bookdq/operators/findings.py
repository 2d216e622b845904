"""Findings: the graded long-format output every check shares."""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookdq.functions.grading import grade
from bookdq.functions.labels import segment_label, segment_map

_TEXT = ("check", "variable", "item", "segment", "metric")
FINDING_SCHEMA = T.StructType([
    *[T.StructField(c, T.StringType()) for c in _TEXT],
    T.StructField("value", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("detail", T.StringType()),
    T.StructField("dims", T.MapType(T.StringType(), T.StringType())),  # the segment as real values
])
FINDING_KEY = _TEXT


def _col(value, kind: str) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(kind)


def emit(df: DataFrame, check: str, dims: Iterable[str], *specs: dict) -> DataFrame:
    """Several findings per row of `df` in one pass over it; the segment is the given dimension columns.

    A spec has variable, item, metric, value, and any of warn, fail, status, threshold, detail, higher_is_worse and
    `when`, the condition under which a row has this finding; `segment` and `dims` name another segment than the row's.
    """
    dims = list(dims)
    cells = []
    for spec in specs:
        value = _col(spec["value"], "double")
        status = spec.get("status")
        graded = (_col(status, "string") if status is not None
                  else grade(value, spec.get("warn"), spec.get("fail"), spec.get("higher_is_worse", True)))
        limit = spec["threshold"] if "threshold" in spec else spec.get("fail")
        cell = F.struct(
            F.lit(check).alias("check"), _col(spec["variable"], "string").alias("variable"),
            _col(spec.get("item"), "string").alias("item"), spec.get("segment", F.col("_segment")).alias("segment"),
            F.lit(spec["metric"]).alias("metric"), value.alias("value"), _col(limit, "double").alias("threshold"),
            graded.alias("status"), _col(spec.get("detail"), "string").alias("detail"), spec.get("dims", F.col("_dims")).alias("dims"))
        cells.append(F.when(spec["when"], cell) if "when" in spec else cell)
    named = df.withColumns({"_segment": segment_label(df, dims), "_dims": segment_map(df, dims)})
    return named.select(F.inline(F.array(*cells))).where(F.col("check").isNotNull())


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def concat(frames: Iterable[DataFrame], spark: SparkSession) -> DataFrame:
    frames = list(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else no_findings(spark)


def error_finding(spark: SparkSession, check: str, message: str) -> DataFrame:
    """What a check that could not run leaves behind."""
    row = (check, "_check", "error", "ALL", "error", None, None, "fail", message[:500], {})
    return spark.createDataFrame([row], FINDING_SCHEMA)


def count_text(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def of_text(part: Column, whole: Column, what: str = "rows") -> Column:
    """'1,234 of 5,678 rows'"""
    return F.concat(count_text(part), F.lit(" of "), count_text(whole), F.lit(f" {what}" if what else ""))
