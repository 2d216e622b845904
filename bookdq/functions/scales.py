"""Log scales, their inverse and equal-width buckets."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("none", "log1p", "log10", "signed_log")  # fixed values


def to_scale(x: Column, method: str) -> tuple[Column, Column]:
    """(value on the scale, whether x is in the scale's domain). Out of the domain the value is null."""
    if method == "none":
        return x.cast("double"), F.lit(True)
    if method == "log1p":
        return F.when(x > -1, F.log1p(x.cast("double"))), x > -1
    if method == "log10":
        return F.when(x > 0, F.log10(x.cast("double"))), x > 0
    if method == "signed_log":
        return F.signum(x.cast("double")) * F.log1p(F.abs(x.cast("double"))), F.lit(True)
    raise ValueError(f"unknown scale {method!r}; one of {METHODS}")


def from_scale(v: Column, method: str) -> Column:
    """Back to the original units."""
    if method == "log1p":
        return F.expm1(v)
    if method == "log10":
        return F.pow(F.lit(10.0), v)
    if method == "signed_log":
        return F.signum(v) * F.expm1(F.abs(v))
    return v


def scale_bounds(lo: float, hi: float, method: str) -> tuple[float, float] | None:
    """A range in original units mapped onto a scale; None when the scale cannot hold it or it is flat."""
    floor = -0.999999  # fixed value: lowest argument kept for log1p
    if method == "log10":
        if lo <= 0:
            return None
        a, b = math.log10(lo), math.log10(hi)
    elif method == "log1p":
        a, b = math.log1p(max(lo, floor)), math.log1p(max(hi, floor))
    elif method == "signed_log":
        a, b = (math.copysign(math.log1p(abs(t)), t) for t in (lo, hi))
    else:
        a, b = lo, hi
    return (a, b) if math.isfinite(a) and math.isfinite(b) and b > a else None


def bucket(v: Column, lo, hi, bins: int) -> Column:
    """Index of the equal-width bucket of v in [lo, hi]; values outside fall into the end buckets."""
    lo, hi = (t if isinstance(t, Column) else F.lit(float(t)) for t in (lo, hi))
    width = (hi - lo) / F.lit(bins)
    clipped = F.greatest(F.least(v, hi), lo)
    return F.least(F.greatest(F.floor((clipped - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
