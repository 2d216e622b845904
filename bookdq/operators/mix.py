"""Segment mix: where the premium sits and which segments are too thin to price."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.labels import segment_label, segment_map
from bookdq.functions.ratios import FULL_CREDIBILITY, credibility, share
from bookdq.functions.running import running_total
from bookdq.operators import findings as fd
from bookdq.plans.registry import CheckResult, check

CHECK = "segment_mix"


@dataclass(frozen=True)
class Thresholds:
    large_share: float = 0.05
    material_share: float = 0.005
    z_target: float = 0.5
    thin_premium_warn: float = 0.20
    thin_premium_fail: float = 0.40


@dataclass(frozen=True)
class MixConfig:
    enabled: bool = True
    order: int = 80
    category: str = "Portfolio analysis"
    dimensions: tuple[str, ...] = ()
    default_dimension: str | None = None
    split_by_source: bool = False
    full_credibility: float = FULL_CREDIBILITY
    top_n: int = 25
    thresholds: Thresholds = Thresholds()


def segment_mix(book: Book, dims: Sequence[str], cfg: MixConfig = MixConfig(),
                where: str | Column | None = None) -> DataFrame:
    """One row per segment: shares of the total, running premium share (largest first), credibility and flag."""
    dims, m, t = book.require([d for d in dims if d]), book.spec.measures, cfg.thresholds
    segments = book.population(where).groupBy(*dims).agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(m.premium).cast("double"), F.lit(0.0)).alias("premium"),
        F.coalesce(F.sum(m.claims).cast("bigint"), F.lit(0)).alias("claims"))
    order = [F.col("premium").desc(), *[F.col(d).asc_nulls_last() for d in dims]]
    ranked = running_total(segments, order, "premium", "_running")  # its base is stored, so totals are one small pass
    totals = ranked.agg(F.struct(*[F.sum(c).alias(c) for c in ("premium", "records", "claims")]).alias("t"))
    df = ranked.withColumn("_t", totals.scalar())
    df = df.withColumns({f"{c}_share": share(F.col(c), F.col(f"_t.{c}")) for c in ("premium", "records", "claims")})
    df = df.withColumns({"cum_premium_share": share(F.col("_running"), F.col("_t.premium")),
                         "z_claims": credibility(F.col("claims"), cfg.full_credibility),
                         "z_records": credibility(F.col("records"), cfg.full_credibility)})
    thin = (F.col("premium_share") >= t.material_share) & (F.col("z_claims") < t.z_target)
    flag = F.when(F.col("premium_share") > t.large_share, F.lit("large")).when(thin, F.lit("thin")).otherwise(F.lit(""))
    return df.withColumn("flag", flag).withColumn("segment", segment_label(df, dims)).drop("_t", "_running")


def mix_measures(mix: DataFrame, dims: Sequence[str], t: Thresholds) -> DataFrame:
    """One row: segment count, HHI, segments to half the premium, the largest segment, premium below credibility."""
    top = F.max_by(F.struct(segment_label(mix, dims).alias("segment"), segment_map(mix, dims).alias("dims"), "premium_share",
                            "premium", "claims", "z_claims"), F.struct("premium", -F.col("cum_premium_share")))
    return mix.agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.pow("premium_share", F.lit(2.0))).alias("hhi"),
        (F.count_if(F.col("cum_premium_share") < 0.5) + 1).alias("n_for_half"), top.alias("top"),
        F.coalesce(F.sum(F.when(F.col("z_claims") < t.z_target, F.col("premium_share"))), F.lit(0.0)).alias("below"),
        F.count_if(F.col("flag") == "thin").alias("n_thin")).where(F.col("n_segments") > 0)


def mix_findings(mix: DataFrame, dims: Sequence[str], t: Thresholds = Thresholds()) -> DataFrame:
    dims = list(dims)
    # the eight largest thin segments, named in the finding
    first = F.row_number().over(Window.orderBy(F.col("premium").desc(), "segment"))
    named = (mix.where(F.col("flag") == "thin").orderBy(F.col("premium").desc(), "segment").limit(8)
             .withColumn("_at", first).groupBy()
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "segment"))), lambda s: s["segment"]), ", ").alias("x")))
    one = mix_measures(mix, dims, t).withColumn("_thin", named.scalar())
    thin_text = F.concat("_thin", F.when(F.col("n_thin") > 8, F.lit("…")).otherwise(F.lit("")))
    common = dict(variable=dims[0], item=" x ".join(dims))
    found = fd.emit(
        one, CHECK, [],
        dict(metric="n_segments", value=F.col("n_segments"), status="info",
             detail=F.format_string("%d segment(s) make up half the premium · HHI %.3f", "n_for_half", "hhi"), **common),
        dict(metric="top_segment_share", value=F.col("top.premium_share"), warn=t.large_share, threshold=t.large_share,
             segment=F.col("top.segment"), dims=F.col("top.dims"),
             detail=F.format_string("largest segment: %s premium, %s claims, Z=%.2f", F.format_number("top.premium", 0),
                                    fd.count_text(F.col("top.claims")), F.col("top.z_claims")), **common),
        dict(metric="pct_premium_below_credibility", value=F.col("below"), warn=t.thin_premium_warn, fail=t.thin_premium_fail,
             detail=F.format_string(f"%.1f%% of premium sits in segments with Z < {t.z_target:.2f}", F.col("below") * 100), **common),
        dict(metric="n_thin_material_segments", value=F.col("n_thin"), warn=0.0, threshold=0.0,
             detail=F.when(F.col("n_thin") > 0, thin_text).otherwise(F.lit("every material segment reaches the credibility target")),
             **common))
    return found


@check(CHECK, MixConfig, "Segment mix & credibility", order=80, category="Portfolio analysis")
def run(book: Book, cfg: MixConfig) -> CheckResult:
    if not cfg.dimensions:
        return CheckResult(fd.no_findings(book.raw.sparkSession), notes=["No rating dimensions configured."])
    frames, tables = [], {}
    for dimension in cfg.dimensions:
        dims = [*([book.spec.source] if cfg.split_by_source else []), dimension]
        mix = segment_mix(book, dims, cfg)
        frames.append(mix_findings(mix, dims, cfg.thresholds))
        tables[f"segments::{dimension}"] = mix
    return CheckResult(fd.concat(frames, book.raw.sparkSession), tables)

