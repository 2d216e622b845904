"""Portfolio summary at any grouping level."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.labels import NULL_LABEL, label_of, level_text
from bookdq.functions.ratios import ratio, share


MARGIN = "(total)"


def sums_by(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Sum of named measures by 0..n dimensions."""
    return df.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in measures.items()])


def summarize(book: Book, dims: Sequence[str] = (), where: str | Column | None = None) -> DataFrame:
    """Records, distinct policy terms, premium, loss and claims with their ratios, largest premium first.

    The policy count is a distinct count of the key as one struct, so a null inside a key still counts.
    """
    m, dims = book.spec.measures, book.require(dims)
    key = F.struct(*[F.col(c) for c in book.require(book.spec.policy_key)])
    df = book.population(where)
    out = df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(key).alias("policies"),
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(n)
          for n, c in (("premium", m.premium), ("loss", m.loss))],
        F.coalesce(F.round(F.sum(m.claims)).cast("bigint"), F.lit(0)).alias("claims"))
    out = out.withColumns({
        "premium_per_policy": ratio(F.col("premium"), F.col("policies")),
        "records_per_policy": ratio(F.col("records"), F.col("policies")),
        "loss_ratio": ratio(F.col("loss"), F.col("premium")),
        "severity": ratio(F.col("loss"), F.col("claims"))})
    if not dims:
        return out
    total = df.agg(F.coalesce(F.sum(m.premium).cast("double"), F.lit(0.0)).alias("t"))
    return out.withColumn("premium_share", share(F.col("premium"), total.scalar())).orderBy(F.col("premium").desc(), *dims)


def crosstab(book: Book, rows: str, columns: str, levels: Sequence[str] | None = None,
             where: str | Column | None = None) -> DataFrame:
    """Premium by two dimensions with totals. `levels` names the columns and saves the pass that finds them; levels it does
    not name are summed in `(other)`. The row of totals is told by is_total = 1, whatever a level is called."""
    book.require([rows, columns])
    df = book.population(where)
    cells = (df.select(label_of(df, rows).alias(rows), label_of(df, columns).alias("_c"),
                       F.col(book.spec.measures.premium).alias("_p")).groupBy(rows, "_c").agg(F.sum("_p").cast("double").alias("_p")))
    if levels is None:
        levels = [r["_c"] for r in cells.select("_c").distinct().orderBy("_c").collect()]  # they become columns
    other = ~F.col("_c").isin(*levels) if levels else F.lit(True)
    sums = [F.coalesce(F.sum(F.when(F.col("_c") == name, F.col("_p"))), F.lit(0.0)).alias(name) for name in levels]
    rest = [F.coalesce(F.sum(F.when(other, F.col("_p"))), F.lit(0.0)).alias("(other)")]
    wide = cells.rollup(rows).agg(*sums, *rest, F.coalesce(F.sum("_p"), F.lit(0.0)).alias(MARGIN), F.grouping(rows).alias("_all"))
    return wide.withColumn(rows, F.when(F.col("_all") == 1, F.lit("Total")).otherwise(F.col(rows))).withColumnRenamed("_all", "is_total")


def distinct_values(book: Book, column: str, limit: int | None = None) -> DataFrame:
    """Levels of a column as text, in text order, `<null>` last; the first `limit` of them if one is given."""
    df = book.population()
    text = level_text(F.col(column), df.schema[book.require([column])[0]].dataType)
    first = df.select(text.alias("v")).distinct().orderBy(F.col("v").asc_nulls_last())
    first = first if limit is None else first.limit(limit)
    return first.select(F.coalesce("v", F.lit(NULL_LABEL)).alias("value"))


def largest_series(df: DataFrame, column: str, weight: str, keep: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows of the `keep` heaviest values of a column, names of the others)."""
    size = df.groupBy(column).agg(F.sum(weight).alias("_w"))
    top = F.broadcast(size.orderBy(F.col("_w").desc(), column).limit(keep).select(column))  # `keep` rows
    on = F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
    kept = df.alias("l").join(top.alias("r"), on, "left_semi")
    dropped = size.select(column).alias("l").join(top.alias("r"), on, "left_anti")
    return kept, dropped
