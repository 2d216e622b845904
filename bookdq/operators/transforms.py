"""Column standardization and value mapping, in one fixed order: trim, case, pad, map, cast."""
from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookdq.functions.labels import OTHER_LABEL

INLINE_MAPPING = 100  # a longer mapping is joined as a table

_CASES = {"upper": F.upper, "lower": F.lower, "title": F.initcap}
_CASTS = ("string", "int", "float")
_UNMAPPED = ("keep", "null", "other")


@dataclass(frozen=True)
class ColumnTransform:
    column: str
    trim: bool = False
    case: str | None = None
    zero_pad: int = 0
    mapping: Mapping[str, str | None] = field(default_factory=dict)  # standardized value -> value to use
    unmapped: str = "keep"
    cast: str | None = None
    description: str = ""

    def __post_init__(self):
        if self.zero_pad < 0:
            raise ValueError(f"{self.column}: zero_pad cannot be negative")
        if self.case not in (None, *_CASES) or self.cast not in (None, *_CASTS) or self.unmapped not in _UNMAPPED:
            raise ValueError(f"{self.column}: unknown case, cast or unmapped policy")

    @property
    def maps(self) -> bool:
        return bool(self.mapping) or self.unmapped != "keep"

    @property
    def active(self) -> bool:
        return bool(self.trim or self.case or self.zero_pad or self.cast or self.maps)

    def standardized(self, x: Column) -> Column:
        """Trim (spaces), case and pad. A value longer than the pad width is left whole."""
        x = F.trim(x) if self.trim else x
        x = _CASES[self.case](x) if self.case else x
        if self.zero_pad:
            text = x.cast("string")
            x = F.when(F.length(text) >= self.zero_pad, text).otherwise(F.lpad(text, self.zero_pad, "0"))
        return x

    def fallback(self, x: Column) -> Column:
        return {"keep": x, "null": F.lit(None).cast("string"), "other": F.lit(OTHER_LABEL)}[self.unmapped]

    def casted(self, x: Column) -> Column:
        """Text that is not a number becomes null; a fraction cast to int rounds half to even."""
        if self.cast == "string":
            return x.cast("string")
        if self.cast == "float":
            return x.cast("string").try_cast("double")
        if self.cast == "int":
            text = x.cast("string")
            return F.coalesce(text.try_cast("bigint"), F.rint(text.try_cast("double")).try_cast("bigint"))
        return x

    def expression(self, x: Column) -> Column:
        x = self.standardized(x)
        if self.maps:
            x = x.cast("string")
            mapped = None
            for seen, use in self.mapping.items():
                value = F.lit(use).cast("string")
                mapped = F.when(x == seen, value) if mapped is None else mapped.when(x == seen, value)
            x = self.fallback(x) if mapped is None else mapped.otherwise(self.fallback(x))
        return self.casted(x)

    def steps(self) -> list[dict]:
        """The transform as ordered steps of the preprocessing handover."""
        found = [({"op": "trim"}, self.trim), ({"op": "case", "to": self.case}, self.case),
                 ({"op": "zero_pad", "width": self.zero_pad}, self.zero_pad),
                 ({"op": "map_values", "mapping": dict(self.mapping), "unmapped": self.unmapped}, self.maps),
                 ({"op": "cast", "to": self.cast}, self.cast)]
        return [step for step, on in found if on]


@dataclass(frozen=True)
class TransformSet:
    transforms: tuple[ColumnTransform, ...] = ()
    applied: bool = False  # the checks see the raw values unless this is on

    def __post_init__(self):
        names = [t.column for t in self.transforms]
        if len(names) != len(set(names)):
            raise ValueError("one transform per column")

    def in_force(self) -> list[ColumnTransform]:
        return [t for t in self.transforms if t.active]

    def fingerprint(self) -> str:
        """Which transforms the population was built with."""
        on = sorted(self.in_force(), key=lambda t: t.column) if self.applied else []
        if not on:
            return ""
        digest = hashlib.sha1("|".join(f"{t.column}={t.steps()}" for t in on).encode()).hexdigest()[:6]
        return "+".join(t.column for t in on) + "#" + digest


def apply_transforms(df: DataFrame, transforms: Sequence[ColumnTransform]) -> DataFrame:
    """Every transformed column replaced in place in one projection; long mappings become broadcast joins.

    A mapping is written by hand, so its table is bounded by the configuration, not by the data.
    """
    by_column = {t.column: t for t in transforms if t.active}
    unknown = set(by_column) - set(df.columns)
    if unknown:
        raise ValueError(f"transform of unknown column(s) {', '.join(sorted(unknown))}")
    columns = df.columns
    joined: dict[str, Column] = {}
    for t in by_column.values():
        if len(t.mapping) <= INLINE_MAPPING:
            continue
        table = F.broadcast(df.sparkSession.createDataFrame(
            [(k, v) for k, v in t.mapping.items()], "_seen string, _use string")).withColumn("_hit", F.lit(True))
        std, use, hit = f"_std_{t.column}", f"_use_{t.column}", f"_hit_{t.column}"
        df = (df.withColumn(std, t.standardized(F.col(t.column)).cast("string"))
              .join(table, F.col(std) == F.col("_seen"), "left")
              .withColumnsRenamed({"_use": use, "_hit": hit}).drop("_seen"))
        joined[t.column] = t.casted(F.when(F.col(hit), F.col(use)).otherwise(t.fallback(F.col(std))))
    return df.select(*[joined[c].alias(c) if c in joined
                       else by_column[c].expression(F.col(c)).alias(c) if c in by_column else F.col(c) for c in columns])


def transform_effect(df: DataFrame, transform: ColumnTransform) -> DataFrame:
    """One row: distinct values before and after, rows and rows whose text changes.

    Works on value counts, so the distinct counts never touch the row grain.
    """
    name = transform.column
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    after = apply_transforms(counts.withColumn("_before", F.col(name)), [transform])
    before_text, after_text = F.col("_before").cast("string"), F.col(name).cast("string")
    changed = ~before_text.eqNullSafe(after_text)
    by_result = (after.groupBy(after_text.alias("_after"))
                 .agg(F.count(F.lit(1)).alias("_values"), F.sum("_n").alias("_rows"),
                      F.coalesce(F.sum(F.when(changed, F.col("_n"))), F.lit(0)).alias("_moved")))
    return by_result.agg(F.coalesce(F.sum("_values"), F.lit(0)).alias("values_before"),
                         F.count("_after").alias("values_after"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
                         F.coalesce(F.sum("_moved"), F.lit(0)).alias("rows_changed"))
