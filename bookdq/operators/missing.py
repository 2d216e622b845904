"""Missing rates: nulls, blanks and sentinels, per variable and level."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.grading import grade
from bookdq.functions.labels import segment_label
from bookdq.operators import findings as fd
from bookdq.operators.counted import count_conditions
from bookdq.plans.registry import CheckResult, check


@dataclass(frozen=True)
class MissingRule:
    """A setting left at None falls back to the default rule, field by field."""

    warn: float | None = None
    fail: float | None = None
    group_by: tuple[str, ...] | None = None
    treat_as_missing: tuple[str, ...] | None = None
    applies_when: str | None = None


@dataclass(frozen=True)
class MissingConfig:
    enabled: bool = True
    order: int = 20
    default: MissingRule = MissingRule(warn=0.05, fail=0.20, group_by=("src",))
    variables: Mapping[str, MissingRule] = field(default_factory=dict)
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    blank_strings_are_missing: bool = True

    def rule(self, name: str) -> MissingRule:
        own, base = self.variables.get(name, MissingRule()), self.default
        def pick(field_name):
            value = getattr(own, field_name)
            return value if value is not None else getattr(base, field_name)
        return MissingRule(pick("warn"), pick("fail"), tuple(pick("group_by") or ()),
                           tuple(pick("treat_as_missing") or ()), own.applies_when or base.applies_when)


def missing_condition(book: Book, name: str, rule: MissingRule, blanks: bool = True) -> Column:
    """TRUE where a value is missing: null; blank or sentinel text (trimmed); sentinel number."""
    x = F.col(name)
    if book.is_text(name):
        sentinels = list(dict.fromkeys([*([""] if blanks else []), *map(str, rule.treat_as_missing or ())]))
        return x.isNull() | F.trim(x).isin(*sentinels) if sentinels else x.isNull()
    if book.is_numeric(name) and rule.treat_as_missing:
        return x.isNull() | x.isin(*[float(s) for s in rule.treat_as_missing])
    return x.isNull()


def missing_rates(book: Book, cfg: MissingConfig = MissingConfig()) -> list[tuple[tuple[str, ...], DataFrame]]:
    """(level, frame) pairs. All variables of one level are conditional counts of one pass."""
    names = [n for n in book.require(cfg.include or book.columns(derived=False)) if n not in cfg.exclude]
    levels: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        levels.setdefault(tuple(book.require(cfg.rule(name).group_by)), []).append(name)
    population, out = book.population(), []
    for level, members in levels.items():
        rules = [cfg.rule(n) for n in members]
        applies = [F.coalesce(F.expr(r.applies_when), F.lit(False)) if r.applies_when else F.lit(True) for r in rules]
        missing = [a & F.coalesce(missing_condition(book, n, r, cfg.blank_strings_are_missing), F.lit(False))
                   for a, n, r in zip(applies, members, rules)]
        counted = count_conditions(population, level, members, applies, missing).where(F.col("n_applicable") > 0)
        limits = F.create_map(*[c for n, r in zip(members, rules) for c in (
            F.lit(n), F.struct(F.lit(r.warn).cast("double").alias("warn"), F.lit(r.fail).cast("double").alias("fail"),
                               F.lit(r.applies_when).cast("string").alias("applies_when")))])
        rated = (counted.withColumn("_r", limits[F.col("name")])
                 .withColumn("missing_rate", F.col("n_hit") / F.col("n_applicable")))
        out.append((level, rated.select(
            *level, F.col("name").alias("variable"), F.lit(", ".join(level) or "ALL").alias("level"),
            segment_label(rated, level).alias("segment"),
            grade(F.col("missing_rate"), F.col("_r.warn"), F.col("_r.fail")).alias("status"), "missing_rate",
            F.col("n_hit").alias("n_missing"), "n_applicable", "n_rows", F.col("_r.warn").alias("warn"),
            F.col("_r.fail").alias("fail"), F.col("_r.applies_when").alias("applies_when"))))
    return out


def missing_matrix(detail: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """Segment x variable: the worst rate."""
    return detail.groupBy("segment").pivot("variable", list(variables) if variables else None).agg(F.max("missing_rate"))


@check("missing_rate", MissingConfig, "Missing rate", order=20)
def run(book: Book, cfg: MissingConfig) -> CheckResult:
    spark, by_level = book.raw.sparkSession, missing_rates(book, cfg)
    frames = [fd.emit(df, "missing_rate", level, dict(
        variable=F.col("variable"), item=F.col("applies_when"), metric="missing_rate", value=F.col("missing_rate"),
        threshold=F.col("fail"), status=F.col("status"), detail=fd.of_text(F.col("n_missing"), F.col("n_applicable"))))
        for level, df in by_level]
    return CheckResult(fd.concat(frames, spark), {f"detail::{', '.join(l) or 'ALL'}": df for l, df in by_level})
