"""Readers: catalog table, parquet (file, folder or glob), CSV."""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"^[A-Za-z_]\w*$")


def read_source(spark: SparkSession, location: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A `.csv` path is read with header; anything else with a slash, a glob or `.parquet` is parquet; a plain
    (dotted) name is a catalog table. Give a schema for CSV at scale: inferring types reads the file twice."""
    if location.rstrip("/").lower().endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(location) if schema else reader.option("inferSchema", True).csv(location)
    if "/" in location or "*" in location or location.lower().endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(location)
    return spark.table(location)


class Sources:
    """Named sources as temp views. A missing optional source is remembered and only fails when it is used."""

    def __init__(self, spark: SparkSession, locations: Mapping[str, str], optional: Iterable[str] = ()):
        self.spark, self.missing = spark, {}
        optional = set(optional)
        for name, location in locations.items():
            if not _NAME.match(name):
                raise ValueError(f"source name {name!r} must be a plain identifier")
            try:
                read_source(spark, location).createOrReplaceTempView(name)
            except AnalysisException as problem:
                if name not in optional:
                    raise
                self.missing[name] = f"{location}: {problem.getCondition() or problem}"

    def table(self, name: str) -> DataFrame:
        if name in self.missing:
            raise FileNotFoundError(f"source {name!r} could not be read ({self.missing[name]})")
        return self.spark.table(name)
