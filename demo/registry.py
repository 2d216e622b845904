"""Query registry: a name, the Spark query, and the SQL it must agree with (none where SQL cannot say it)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demo.book import BOOK_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Double columns rounded, as the SQL rounds them: engines add in different orders."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, book: bool = True, with_: str = ""):
    """Register a query. `sql` reads the CTE `book` unless book=False; `with_` adds CTEs before the final select."""
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ctes = [c for c in (BOOK_SQL if book else "", with_.strip()) if c]
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql.strip()
        return fn

    return add
