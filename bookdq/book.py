"""The book: one wide fact table, its column roles, and the population every check sees."""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookdq.operators.filters import RuleSet
from bookdq.operators.transforms import TransformSet, apply_transforms
from bookdq.plans.sizing import materialize

_AMOUNT = (T.DoubleType, T.FloatType, T.DecimalType)
_CODE_SUFFIXES = ("_cd", "_id", "_yr")  # fixed values: numeric columns named like this hold codes


class UnknownColumnError(ValueError):
    """A name that is neither a column of the book nor a derived one."""


@dataclass(frozen=True)
class Measures:
    premium: str
    loss: str
    claims: str
    exposure: str
    exposure_base: str

    def numeric(self) -> list[str]:
        return [self.premium, self.loss, self.claims, self.exposure]


@dataclass(frozen=True)
class BookSpec:
    name: str
    source: str
    sources: tuple[str, ...]
    measures: Measures
    policy_key: tuple[str, ...]
    segment_candidates: tuple[str, ...] = ()
    derived: Mapping[str, str] = field(default_factory=dict)  # name -> SQL expression
    profile: str = "default"


class Book:
    """Raw table + transforms + derived columns + global rules. Nothing runs until a result is asked for."""

    def __init__(self, spec: BookSpec, raw: DataFrame, rules: RuleSet | None = None,
                 transforms: TransformSet | None = None, sql_vars: Mapping[str, str] | None = None):
        self.spec, self.raw = spec, raw
        self.rules, self.transforms = rules or RuleSet(), transforms or TransformSet()
        self.sql_vars = dict(sql_vars or {})
        self._raw_view: str | None = None
        self.is_stored = False

    def with_rules(self, rules: RuleSet) -> Book:
        return Book(self.spec, self.raw, rules, self.transforms, self.sql_vars)

    def with_transforms(self, transforms: TransformSet) -> Book:
        return Book(self.spec, self.raw, self.rules, transforms, self.sql_vars)

    def with_profile(self, profile: str) -> Book:
        return Book(replace(self.spec, profile=profile), self.raw, self.rules, self.transforms, self.sql_vars)

    # ---- populations -----------------------------------------------------------------
    def _derive(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.expr(e) for n, e in self.spec.derived.items()}) if self.spec.derived else df

    def unfiltered(self) -> DataFrame:
        """Every raw row with the derived columns, no transform and no rule."""
        return self._derive(self.raw)

    def transformed(self) -> DataFrame:
        """Every row, with the transforms in place (if the set is applied) and the derived columns."""
        df = apply_transforms(self.raw, self.transforms.in_force()) if self.transforms.applied else self.raw
        return self._derive(df)

    def population(self, where: str | Column | None = None) -> DataFrame:
        """The rows every check sees: transforms first, then the active rules, then an optional scope."""
        df = self.rules.keep(self.transformed(), self)
        return df.where(F.expr(where) if isinstance(where, str) else where) if where is not None else df

    def stored(self, names: Iterable[str]) -> Book:
        """A book of the same population, written once with only these columns: what the rows come from (joins, transforms, rules)
        runs once for an operator that reads them several times. A book that is such a copy is returned as it is."""
        names = self.require(dict.fromkeys(names))
        if self.is_stored:
            return self
        spec = replace(self.spec, derived={})
        copy = Book(spec, materialize(self.population().select(*names), "population"), sql_vars=self.sql_vars)
        copy.is_stored = True
        return copy

    # ---- columns ---------------------------------------------------------------------
    @property
    def schema(self) -> T.StructType:
        return self.transformed().schema

    def columns(self, derived: bool = True) -> list[str]:
        return [*self.raw.columns, *(self.spec.derived if derived else ())]

    def has(self, name: str) -> bool:
        return name in self.columns()

    def require(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        unknown = [n for n in names if not self.has(n)]
        if unknown:
            raise UnknownColumnError(f"{self.spec.name}: unknown column(s) {', '.join(map(repr, unknown))}")
        return names

    def type_of(self, name: str) -> T.DataType:
        self.require([name])
        return self.schema[name].dataType

    def is_numeric(self, name: str) -> bool:
        return isinstance(self.type_of(name), T.NumericType)

    def is_amount(self, name: str) -> bool:
        return isinstance(self.type_of(name), _AMOUNT)

    def is_text(self, name: str) -> bool:
        return isinstance(self.type_of(name), T.StringType)

    def kind(self, name: str) -> str:
        """How a column is profiled when nothing is said: amounts and uncoded numbers are numeric."""
        coded = name.endswith(_CODE_SUFFIXES)
        return "numeric" if self.is_amount(name) or (self.is_numeric(name) and not coded) else "categorical"

    def segment_options(self) -> list[str]:
        return [c for c in (self.spec.segment_candidates or (self.spec.source,)) if self.has(c)]

    # ---- SQL written by the user -------------------------------------------------------
    def raw_view(self) -> str:
        """Temp view of the raw table, for rules that look at the whole table."""
        if self._raw_view is None:
            self._raw_view = f"raw_{self.spec.name}_{uuid.uuid4().hex[:8]}"
            self.raw.createOrReplaceTempView(self._raw_view)
        return self._raw_view

    def sql(self, text: str) -> str:
        """Fill `{{ raw_table }}`, `{{ table }}` and the book's own variables into a rule."""
        def value(match: re.Match) -> str:
            name = match.group(1)
            if name in ("raw_table", "table"):
                return self.raw_view()
            if name not in self.sql_vars:
                raise ValueError(f"undefined variable {name!r} in rule: {text.strip()}")
            return self.sql_vars[name]

        return re.sub(r"\{\{\s*(\w+)\s*\}\}", value, text)
