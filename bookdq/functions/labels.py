"""Text labels of levels and segments, and their natural order."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_LABEL = "<null>"
OTHER_LABEL = "<other>"
UNGROUPED = "ALL"

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def level_text(column: Column, data_type: T.DataType) -> Column:
    """A level as text, null staying null; a double holding a whole number prints without decimals."""
    text = column.cast("string")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        whole = F.when(F.rint(column) == column, column.try_cast("decimal(38,0)").cast("string"))
        return F.coalesce(whole, text)
    return text


def level_label(column: Column, data_type: T.DataType) -> Column:
    """`level_text` with the null level spelled out."""
    return F.coalesce(level_text(column, data_type), F.lit(NULL_LABEL))


def label_of(df: DataFrame, name: str) -> Column:
    return level_label(F.col(name), df.schema[name].dataType)


def segment_label(df: DataFrame, dims: Sequence[str]) -> Column:
    """`src=A|pol_yr=1998`, or `ALL` for an ungrouped row. Kept next to the real columns, never parsed back."""
    if not dims:
        return F.lit(UNGROUPED)
    return F.concat_ws("|", *[F.concat(F.lit(f"{d}="), label_of(df, d)) for d in dims])


def segment_map(df: DataFrame, dims: Sequence[str]) -> Column:
    """The segment as map<string,string>: what later steps read instead of the label."""
    if not dims:
        return F.from_json(F.lit("{}"), T.MapType(T.StringType(), T.StringType()))
    return F.create_map(*[c for d in dims for c in (F.lit(d), label_of(df, d))])


def _order_parts(label: Column) -> tuple[Column, Column, Column]:
    missing = label.isNull() | (label == NULL_LABEL)
    numeric = label.rlike(_NUMBER)
    rank = (F.when(missing, F.lit(2)).when(label == UNGROUPED, F.lit(-1))
            .when(numeric, F.lit(0)).otherwise(F.lit(1)))
    return rank, F.when(numeric, label.try_cast("double")).otherwise(F.lit(0.0)), F.when(rank == 1, label).otherwise(F.lit(""))


def natural_order(label: Column) -> list[Column]:
    """Sort keys of a text level: `ALL`, then numbers by value, then text, then nulls."""
    return [part.asc() for part in _order_parts(label)]


def natural_segment_order(df: DataFrame, dims: Sequence[str]) -> list[Column]:
    """Sort keys of a grouped frame, part by part over its dimension columns."""
    return [key for d in dims for key in natural_order(label_of(df, d))]


def natural_key(label: Column) -> Column:
    """`natural_order` as one struct, for keys of several levels."""
    return F.struct(*[part.alias(n) for n, part in zip(("rank", "number", "text"), _order_parts(label))])


def sort_labels(df: DataFrame, column: str = "segment") -> DataFrame:
    """Distinct labels of a frame in natural order. A full label sorts part by part, however many it has; of two that begin
    alike the shorter comes first."""
    labels = df.select(F.col(column).cast("string").alias(column)).distinct()
    values = F.transform(F.split(F.col(column), r"\|"),
                         lambda part: natural_key(F.when(part.contains("="), F.regexp_replace(part, r"^[^=]*=", "")).otherwise(part)))
    return labels.orderBy(values, column)


def split_segments(df: DataFrame, column: str = "segment", dims: Sequence[str] | None = None,
                   max_dims: int | None = None, keep_label: bool = False) -> DataFrame:
    """One column per dimension in place of the combined label.

    `ALL` rows read "(all)", a dimension the row does not have reads "". Unchanged when there is nothing to
    split, or more than `max_dims` dimensions where that is given. `dims` saves the pass that finds the dimension names.
    """
    if column not in df.columns:
        return df
    parsed = F.str_to_map(F.col(column), F.lit(r"\|"), F.lit("="))
    grouped = F.col(column) != UNGROUPED
    if dims is None:
        # dimension names, not rows: as many as the result gets columns
        names = (df.where(grouped).select(F.posexplode(F.map_keys(parsed)).alias("at", "dim"))
                 .groupBy("dim").agg(F.min("at").alias("at")).orderBy("at", "dim"))
        dims = [r["dim"] for r in (names if max_dims is None else names.limit(max_dims + 1)).collect()]
    if not dims or max_dims is not None and len(dims) > max_dims:
        return df
    out = []
    for name in df.columns:
        if name != column:
            out.append(F.col(name))
            continue
        out += [F.when(~grouped, F.lit("(all)")).otherwise(F.coalesce(F.element_at(parsed, F.lit(d)), F.lit(""))).alias(d)
                for d in dims if d not in df.columns]
        if keep_label:
            out.append(F.col(column))
    return df.select(*out)


def distinct_list(column: Column) -> Column:
    """Aggregate: the distinct values as one sorted text. For columns of few values (sources, statuses)."""
    return F.array_join(F.array_sort(F.collect_set(column.cast("string"))), ", ")
