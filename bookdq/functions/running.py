"""Running totals over a whole frame without a one-task window."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.plans.sizing import materialize


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds `out` = sum of `value` over the rows up to this one in `order` (which must be a total order), within the
    rows of the same keys if there are any; null is a key like others.

    A window over a whole frame, or over a key that holds a third of it, would run in one task. Instead the frame is
    range-sorted and stored, each sorted partition is totalled, and a row adds the totals of the partitions before
    its own to its position inside its partition.
    """
    keys = list(keys)
    ordered = materialize(df.orderBy(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = ordered.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = totals.select(*keys, "_part", F.sum("_sum").over(earlier).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # without keys: one row per sorted partition, which bounds the broadcast; with keys Spark decides at run time
    before = before.withColumnsRenamed({k: f"_before_{k}" for k in [*keys, "_part"]})
    ordered = ordered.withColumn("_inside", inside)
    same = [ordered[k].eqNullSafe(before[f"_before_{k}"]) for k in keys] + [ordered["_part"] == before["_before__part"]]
    joined = ordered.join(before if keys else F.broadcast(before), same).drop(*[f"_before_{k}" for k in [*keys, "_part"]])
    zero = F.lit(0).cast(totals.schema["_sum"].dataType)
    total = F.coalesce(F.col("_before"), zero) + F.coalesce(F.col("_inside"), zero)
    return joined.withColumn(out, total).drop("_part", "_before", "_inside")


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds `out` = `value` of the row before this one among the rows with the same keys (null on the first).

    As above: range-sorted and stored, looked up inside each sorted partition, and across the partition border from a
    table of last values. A key holding much of the frame spans many partitions instead of one task.
    """
    ordered = materialize(df.orderBy(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    last = ordered.groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    border = last.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_border"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = ordered.withColumns({"_prev": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    return (rows.join(border, [*keys, "_part"], "left")
            .withColumn(out, F.when(F.col("_first"), F.col("_border")).otherwise(F.col("_prev")))
            .drop("_part", "_prev", "_first", "_border"))
