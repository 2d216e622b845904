"""Business rules: predicates that are true for a bad row, measured per segment."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.grading import grade
from bookdq.functions.labels import segment_label
from bookdq.operators import findings as fd
from bookdq.operators.counted import count_conditions
from bookdq.plans.registry import CheckResult, check


@dataclass(frozen=True)
class BusinessRule:
    id: str
    violation: str
    applies_when: str | None = None
    variables: tuple[str, ...] = ()
    description: str = ""
    warn: float = 0.0
    fail: float = 0.001

    @property
    def primary(self) -> str:
        return self.variables[0] if self.variables else self.id


@dataclass(frozen=True)
class RulesConfig:
    enabled: bool = True
    order: int = 25
    group_by: tuple[str, ...] = ("src",)
    rules: tuple[BusinessRule, ...] = ()


def rule_violations(book: Book, cfg: RulesConfig) -> DataFrame:
    """Violation rate per segment and rule over the rows the rule applies to; segments it never applies to are left
    out. All rules of a pass are conditional counts of one aggregate."""
    dims = book.require(cfg.group_by)
    book.require([v for r in cfg.rules for v in r.variables])
    applies = [F.coalesce(F.expr(r.applies_when), F.lit(False)) if r.applies_when else F.lit(True) for r in cfg.rules]
    bad = [a & F.coalesce(F.expr(r.violation), F.lit(False)) for a, r in zip(applies, cfg.rules)]
    counted = count_conditions(book.population(), dims, [r.id for r in cfg.rules], applies, bad)
    limits = F.create_map(*[c for r in cfg.rules for c in (
        F.lit(r.id), F.struct(F.lit(r.primary).alias("variable"), F.lit(float(r.warn)).alias("warn"),
                              F.lit(float(r.fail)).alias("fail"), F.lit(r.description).alias("description")))])
    out = (counted.where(F.col("n_applicable") > 0).withColumn("_r", limits[F.col("name")])
           .withColumn("violation_rate", F.col("n_hit") / F.col("n_applicable")))
    return out.select(*dims, F.col("name").alias("rule"), F.col("_r.variable").alias("variable"),
                      segment_label(out, dims).alias("segment"), "n_rows", "n_applicable",
                      F.col("n_hit").alias("n_violations"), "violation_rate", F.col("_r.warn").alias("warn"),
                      F.col("_r.fail").alias("fail"),
                      grade(F.col("violation_rate"), F.col("_r.warn"), F.col("_r.fail")).alias("status"),
                      F.col("_r.description").alias("description"))


@check("business_rules", RulesConfig, "Business rules", order=25)
def run(book: Book, cfg: RulesConfig) -> CheckResult:
    if not cfg.rules:
        return CheckResult(fd.no_findings(book.raw.sparkSession))
    detail = rule_violations(book, cfg)
    described = F.when(F.col("description") != "", F.concat(F.lit(" · "), F.col("description"))).otherwise(F.lit(""))
    found = fd.emit(detail, "business_rules", cfg.group_by, dict(
        variable=F.col("variable"), item=F.col("rule"), metric="violation_rate", value=F.col("violation_rate"),
        threshold=F.col("fail"), status=F.col("status"),
        detail=F.concat(fd.of_text(F.col("n_violations"), F.col("n_applicable")), described)))
    return CheckResult(found, {"detail": detail})


def violation_matrix(detail: DataFrame, segments: list[str] | None = None) -> DataFrame:
    """Rule x segment rates."""
    return detail.groupBy("rule").pivot("segment", segments).agg(F.max("violation_rate"))
