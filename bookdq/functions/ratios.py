"""Ratios and credibility."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_CREDIBILITY = 1082.0  # fixed value: claims that carry full credibility


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, null unless the denominator is positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as double, null when the whole is zero or null."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def credibility(n: Column, full: float = FULL_CREDIBILITY) -> Column:
    """Square-root rule: Z = min(1, sqrt(n / full))."""
    return F.least(F.lit(1.0), F.sqrt(F.greatest(n.cast("double"), F.lit(0.0)) / F.lit(float(full))))


def claims_needed(z: Column, full: float = FULL_CREDIBILITY) -> Column:
    """Claims a credibility of z asks for: the inverse of `credibility`."""
    return F.pow(F.least(F.greatest(z.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(2.0)) * F.lit(float(full))


def weighted_rms_log(x: Column, weight: Column, keep: Column | None = None) -> Column:
    """Aggregate: sqrt(sum(w ln(x)^2) / sum(w)) over rows with x > 0 and w > 0; null if there are none."""
    ok = (x > 0) & (weight > 0)
    ok = ok & keep if keep is not None else ok
    w = weight.cast("double")
    return F.sqrt(F.sum(F.when(ok, w * F.pow(F.ln(F.when(x > 0, x)), F.lit(2.0)))) / F.sum(F.when(ok, w)))
