"""Statuses: pass < info < warn < fail."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: severity order of the statuses
STATUS_ORDER = ("pass", "info", "warn", "fail")
FLAGGED = ("warn", "fail")


def _number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def grade(value: Column, warn=None, fail=None, higher_is_worse: bool = True) -> Column:
    """Status of a metric; strictly beyond a threshold is flagged, a null metric is only information."""
    def beyond(limit):
        return value > _number(limit) if higher_is_worse else value < _number(limit)

    status = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("info"))
    if fail is not None:
        status = status.when(beyond(fail), F.lit("fail"))
    if warn is not None:
        status = status.when(beyond(warn), F.lit("warn"))
    return status.otherwise(F.lit("pass"))


def severity(status: Column) -> Column:
    """Rank of a status, null for anything that is not one."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return F.when(rank > 0, (rank - 1).cast("int"))


def worst(status: Column) -> Column:
    """Aggregate: the most severe status of a group, null if it has none."""
    return F.max_by(status, severity(status))


def is_flagged(status: Column) -> Column:
    return F.coalesce(status.isin(*FLAGGED), F.lit(False))
