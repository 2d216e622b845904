"""Deep dive into one segment: policy-level statistics against the rest of the book."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.percentiles import percentiles
from bookdq.functions.ratios import FULL_CREDIBILITY, claims_needed, credibility, ratio
from bookdq.functions.scales import bucket, from_scale, scale_bounds, to_scale
from bookdq.operators.mix import MixConfig, segment_mix
from bookdq.plans.sizing import materialize

SEGMENT, REST = "this segment", "rest of book"
GRID = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)  # fixed values
METRICS = ("premium", "exposure", "severity", "frequency", "loss", "claims", "loss_ratio")


@dataclass(frozen=True)
class Scope:
    """The segment looked at, the exposure base its exposure is summed in, and the exposure unit of frequency."""

    segment: str | Column
    base: str | None = None
    per: float = 1.0

    def condition(self) -> Column:
        return F.expr(self.segment) if isinstance(self.segment, str) else self.segment

    def label(self) -> Column:
        return F.when(self.condition(), F.lit(SEGMENT)).otherwise(F.lit(REST))

    def exposure(self, book: Book) -> Column:
        x = F.col(book.spec.measures.exposure)
        return F.when(F.col(book.spec.measures.exposure_base) == self.base, x) if self.base else x


def _with_ratios(df: DataFrame, per: float) -> DataFrame:
    return df.withColumns({"loss_ratio": ratio(F.col("loss"), F.col("premium")),
                           "severity": ratio(F.col("loss"), F.col("claims")),
                           "frequency": ratio(F.col("claims"), F.col("exposure")) * F.lit(float(per))})


def policy_grain(book: Book, scope: Scope) -> DataFrame:
    """One row per policy term and scope. A policy with rows inside and outside the segment has two."""
    m, key = book.spec.measures, book.require(book.spec.policy_key)
    sums = book.population().groupBy(*key, scope.label().alias("scope")).agg(
        F.sum(m.premium).cast("double").alias("premium"), F.sum(m.loss).cast("double").alias("loss"),
        F.sum(m.claims).cast("double").alias("claims"), F.sum(scope.exposure(book)).cast("double").alias("exposure"))
    return _with_ratios(sums.select("scope", "premium", "loss", "claims", "exposure"), scope.per)


def stored_grain(book: Book, scope: Scope) -> DataFrame:
    """The policy grain written once: statistics, percentiles and histogram all read it."""
    return materialize(policy_grain(book, scope), "policies")


def policy_stats(grain: DataFrame, exact: bool = True) -> DataFrame:
    """One row per metric and scope: counts, min, max, mean, sum and percentile arrays (all and positive values)."""
    made = {"n_nonnull": F.count, "n_positive": lambda c: F.count_if(c > 0), "vmin": F.min, "vmax": F.max, "vmean": F.avg, "vsum": F.sum}
    wide = grain.groupBy("scope").agg(F.count(F.lit(1)).alias("n_policies"), *[f(F.col(m)).alias(f"{m}__{n}") for m in METRICS for n, f in made.items()])
    cells = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}__{n}").alias(n) for n in made]) for m in METRICS]  # one row per policy, not per metric
    basic = wide.select("scope", "n_policies", F.inline(F.array(*cells))).select("metric", "scope", "n_policies", *made)
    long = percentiles(grain, ["scope"], {m: F.col(m) for m in METRICS}, GRID, exact, positives=True)
    positive = F.col("variable").startswith("+")
    pick = lambda p, flag: F.max(F.when((F.col("prob") == p) & (positive if flag else ~positive), F.col("value")))
    grids = (long.groupBy(F.regexp_replace("variable", r"^\+", "").alias("metric"), "scope")
             .agg(F.array(*[pick(p, False) for p in GRID]).alias("pcts"), F.array(*[pick(p, True) for p in GRID]).alias("pcts_pos")))
    return basic.join(grids, ["metric", "scope"], "left")


def histogram_bounds(stats: DataFrame, metrics: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """p1 to p99 pooled over both scopes, on the scale; both scopes share bins. Metrics without a usable range are
    left out. Two numbers per metric reach the driver."""
    grid = F.col("pcts_pos" if method == "log10" else "pcts")
    rows = (stats.where(F.col("metric").isin(*metrics)).groupBy("metric")
            .agg(F.min(grid[0]).alias("lo"), F.max(grid[len(GRID) - 1]).alias("hi")).collect())
    found = {r["metric"]: scale_bounds(r["lo"], r["hi"], method) for r in rows if r["lo"] is not None}
    return {m: found[m] for m in metrics if found.get(m)}


def histogram_ends(grain: DataFrame, metrics: Sequence[str], method: str) -> DataFrame:
    """What `histogram_bounds` reads of the statistics, for these metrics alone: the two outer percentiles, of the values above zero
    where the scale takes no others."""
    name, ends = ("pcts_pos" if method == "log10" else "pcts"), (GRID[0], GRID[-1])
    long = percentiles(grain, ["scope"], {m: F.when(F.col(m) > 0, F.col(m)) if method == "log10" else F.col(m) for m in metrics}, ends)
    pick = [F.max(F.when(F.col("prob") == p, F.col("value"))) if p in ends else F.lit(None).cast("double") for p in GRID]
    return long.groupBy(F.col("variable").alias("metric"), "scope").agg(F.array(*pick).alias(name))


def policy_histogram(grain: DataFrame, stats: DataFrame | None, metrics: Sequence[str], method: str = "none", bins: int = 40) -> DataFrame:
    """Counts per metric, scope and bucket on a common scale; tails fold into the end buckets. Without `stats` (those of the same
    grain) only the percentiles that end the scale are taken."""
    bounds = histogram_bounds(histogram_ends(grain, metrics, method) if stats is None else stats, metrics, method)
    cells = []
    for metric, (lo, hi) in bounds.items():
        v, valid = to_scale(F.col(metric), method)
        inside = F.when(F.col(metric).isNotNull() & valid, bucket(v, lo, hi, bins))
        cells.append(F.struct(F.lit(metric).alias("metric"), inside.alias("bucket"), F.lit(lo).alias("lo"),
                              F.lit((hi - lo) / bins).alias("width")))
    if not cells:
        empty = "metric string, scope string, bucket int, n bigint, left double, right double, center double, `from` double, to double, share double"
        return grain.sparkSession.createDataFrame([], empty)
    counts = (grain.select("scope", F.inline(F.array(*cells))).where(F.col("bucket").isNotNull())
              .groupBy("metric", "scope", "bucket", "lo", "width").agg(F.count(F.lit(1)).alias("n")))
    left = F.col("lo") + F.col("bucket") * F.col("width")
    return counts.select("metric", "scope", "bucket", "n", left.alias("left"), (left + F.col("width")).alias("right"),
                         (left + F.col("width") / 2).alias("center"), from_scale(left, method).alias("from"),
                         from_scale(left + F.col("width"), method).alias("to"),
                         (F.col("n") / F.sum("n").over(Window.partitionBy("metric", "scope"))).alias("share"))


def policy_trend(book: Book, scope: Scope, time: str) -> DataFrame:
    """Premium, loss, claims, exposure and their ratios by period for both scopes; segment + rest = book."""
    m = book.spec.measures
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sums = book.population().groupBy(*book.require([time]), scope.label().alias("scope")).agg(
        zero(F.sum(m.premium)).alias("premium"), zero(F.sum(m.loss)).alias("loss"), zero(F.sum(m.claims)).alias("claims"),
        zero(F.sum(scope.exposure(book))).alias("exposure"))
    return _with_ratios(sums, scope.per)


def largest_policy_share(grain: DataFrame) -> DataFrame:
    """One row: share of the segment's loss carried by its largest policy, flagged above a quarter."""
    out = grain.where(F.col("scope") == SEGMENT).agg(F.max("loss").alias("largest_loss"), F.sum("loss").alias("segment_loss"))
    out = out.withColumn("largest_share", ratio(F.col("largest_loss"), F.col("segment_loss")))
    return out.withColumn("concentrated", F.coalesce(F.col("largest_share") > 0.25, F.lit(False)))


def composition(book: Book, scope: Scope, by: str, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix of one segment by another dimension; `dominant` marks a level above 80% of its premium."""
    return (segment_mix(book, [by], cfg, where=scope.segment)
            .withColumn("dominant", F.coalesce(F.col("premium_share") > 0.8, F.lit(False))))


def credibility_gap(book: Book, scope: Scope, z_target: float = 0.5, full: float = FULL_CREDIBILITY) -> DataFrame:
    """One row: claims of the segment, its Z, the claims the target asks for and how many are missing."""
    out = book.population(scope.segment).agg(F.coalesce(F.sum(book.spec.measures.claims).cast("bigint"), F.lit(0)).alias("claims"))
    out = out.withColumns({"z": credibility(F.col("claims"), full), "claims_needed": claims_needed(F.lit(float(z_target)), full)})
    return out.withColumn("claims_missing", F.greatest(F.col("claims_needed") - F.col("claims"), F.lit(0.0)))
