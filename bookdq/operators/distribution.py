"""Distribution profiles: statistics, percentiles, histograms, PSI, top and new categories."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.labels import NULL_LABEL, OTHER_LABEL, level_text, natural_order, label_of, segment_label
from bookdq.functions.percentiles import percentile_grid, percentile_row, percentiles
from bookdq.functions.running import running_total
from bookdq.functions.scales import METHODS, bucket, from_scale, to_scale
from bookdq.functions.stability import psi_between_peers
from bookdq.operators import findings as fd
from bookdq.plans.registry import CheckResult, check
from bookdq.plans.sizing import materialize

CHECK = "distribution"


@dataclass(frozen=True)
class LogScale:
    method: str = "none"
    y: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown scale {self.method!r}")


@dataclass(frozen=True)
class PsiRule:
    across: str
    bins: int = 10
    warn: float = 0.10
    fail: float = 0.25


@dataclass(frozen=True)
class Profile:
    name: str
    type: str = "auto"
    group_by: tuple[str, ...] = ("src",)
    percentile_bins: int | tuple[float, ...] = 20
    log_scale: LogScale = LogScale()
    hist_bins: int = 40
    clip: tuple[float, float] = (0.001, 0.999)
    allow_negative: bool = True
    negative_fail: float = 0.001
    outlier_ratio: float | None = None
    psi: PsiRule | None = None
    top_n: int = 25
    max_categories: int = 500
    new_category_min_share: float = 0.005

    def __post_init__(self):
        percentile_grid(self.percentile_bins)

    @property
    def compares(self) -> bool:
        return self.psi is not None and self.psi.across in self.group_by


@dataclass(frozen=True)
class DistributionConfig:
    enabled: bool = True
    order: int = 30
    variables: tuple[Profile, ...] = ()


def _columns(profiles: Sequence[Profile]) -> list[str]:
    return list(dict.fromkeys(c for p in profiles for c in (*p.group_by, p.name)))


# ---- numeric -------------------------------------------------------------------------
# Profiles with the same dimensions share their passes over the book; frames of several carry a column `variable`.
def grids(book: Book, profiles: Sequence[Profile], exact: bool = True) -> DataFrame:
    """(*dims, variable, percentile, value) over the grids of profiles with the same dimensions."""
    dims = book.require(profiles[0].group_by)
    wanted = {p.name: percentile_grid(p.percentile_bins) for p in profiles}
    every = sorted({q for grid in wanted.values() for q in grid})
    book = book.stored(_columns(profiles)) if exact else book  # a sketch takes one pass
    long = percentiles(book.population(), dims, {n: F.col(n) for n in book.require(wanted)}, every, exact)
    mine = F.create_map(*[c for n, grid in wanted.items() for c in (F.lit(n), F.array(*[F.lit(q) for q in grid]))])
    return (long.where(F.array_contains(mine[F.col("variable")], F.col("prob")))
            .select(*dims, "variable", F.col("prob").alias("percentile"), "value"))


def percentile_table(book: Book, p: Profile, exact: bool = True) -> DataFrame:
    return grids(book, [p], exact).drop("variable")


def stats(book: Book, profiles: Sequence[Profile], table: DataFrame) -> DataFrame:
    """One row per variable and segment; a segment without values keeps its counts and has no statistics.

    `table` is the percentile frame of the same profiles (p50 and p99 are read from it).
    """
    dims, aggs = book.require(profiles[0].group_by), []
    for i, p in enumerate(profiles):
        x = F.col(book.require([p.name])[0])
        aggs += [F.count(x).alias(f"_v{i}"), F.count_if(x == 0).alias(f"_z{i}"), F.count_if(x < 0).alias(f"_n{i}"),
                 F.min(x).cast("double").alias(f"_l{i}"), F.avg(x.cast("double")).alias(f"_m{i}"), F.max(x).cast("double").alias(f"_h{i}"),
                 F.stddev_samp(x.cast("double")).alias(f"_s{i}")]
    fields = {"n_nonnull": "_v", "n_zero": "_z", "n_negative": "_n", "min": "_l", "mean": "_m", "max": "_h", "std": "_s"}
    cells = [F.struct(F.lit(p.name).alias("variable"), *[F.col(f"{c}{i}").alias(f) for f, c in fields.items()]) for i, p in enumerate(profiles)]
    basic = (book.population().groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
             .select(*dims, "n_rows", F.inline(F.array(*cells))))
    pick = {n: F.max(F.when(F.col("percentile") == q, F.col("value"))).alias(n) for n, q in (("p50", 0.5), ("p99", 0.99))}
    points = table.groupBy(*dims, "variable").agg(*pick.values())
    # both sides are one row per variable and segment: stack and regroup, which also matches null dimensions
    both = basic.unionByName(points, allowMissingColumns=True)
    out = both.groupBy("variable", *dims).agg(*[F.max(c).alias(c) for c in ("n_rows", *fields, *pick)])
    some = F.col("n_nonnull") > 0
    return out.withColumns({
        "pct_zero": F.when(some, F.col("n_zero") / F.col("n_nonnull")),
        "pct_negative": F.when(some, F.col("n_negative") / F.col("n_nonnull")),
        "max_to_p99": F.when(F.col("p99") > 0, F.col("max") / F.col("p99"))})


def numeric_stats(book: Book, p: Profile, exact: bool = True) -> DataFrame:
    book = book.stored(_columns([p]))
    return stats(book, [p], grids(book, [p], exact)).drop("variable")


def psi_buckets(book: Book, profiles: Sequence[Profile]) -> DataFrame:
    """(variable, *dims, bucket, n): buckets cut at the quantiles of the whole population (right-closed)."""
    dims, df = book.require(profiles[0].group_by), book.stored(_columns(profiles)).population()
    probs = {p.name: [i / p.psi.bins for i in range(1, p.psi.bins)] for p in profiles}
    found = percentile_row(df, {n: F.col(n) for n in book.require(probs)}, sorted({q for qs in probs.values() for q in qs}))
    cells = []
    for name, wanted in probs.items():
        edges = sorted({found[(name, q)] for q in wanted if (name, q) in found})
        if not edges:
            continue  # nothing but nulls
        x = F.col(name)
        index = F.when(x <= edges[0], F.lit(0))
        for i, edge in enumerate(edges[1:], 1):
            index = index.when(x <= edge, F.lit(i))
        index = F.when(x.isNotNull(), index.otherwise(F.lit(len(edges))))
        cells.append(F.struct(F.lit(name).alias("variable"), index.alias("bucket")))
    cells = cells or [F.struct(F.lit("").alias("variable"), F.lit(None).cast("int").alias("bucket"))]
    return (df.select(*dims, F.inline(F.array(*cells))).where(F.col("bucket").isNotNull())
            .groupBy("variable", *dims, "bucket").agg(F.count(F.lit(1)).alias("n")))


def psi_numeric(book: Book, p: Profile) -> DataFrame:
    """PSI per segment of one numeric variable."""
    return psi_between_peers(psi_buckets(book, [p]), p.group_by, p.psi.across, "bucket")


def histogram(book: Book, p: Profile) -> DataFrame:
    """Counts per segment and equal-width bucket on the profile's scale, clipped to its outer percentiles."""
    dims = book.require(p.group_by)
    df = book.stored(_columns([p])).population()
    v, valid = to_scale(F.col(book.require([p.name])[0]), p.log_scale.method)
    scaled = df.where(F.col(p.name).isNotNull() & valid).select(*dims, v.alias("_v"))
    ends = percentile_row(scaled, {"v": F.col("_v")}, p.clip)
    if not ends:
        lo, hi = 0.0, 1.0  # no value at all: the counts below are empty
    else:
        lo, hi = ends[("v", p.clip[0])], ends[("v", p.clip[1])]
    if hi <= lo:
        lo, hi = scaled.agg(F.min("_v"), F.max("_v")).first()
        hi += 1e-9
    width = (hi - lo) / p.hist_bins
    counts = (scaled.groupBy(*dims, bucket(F.col("_v"), lo, hi, p.hist_bins).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n")))
    left = F.lit(lo) + F.col("bucket") * F.lit(width)
    out = counts.withColumns({"left": left, "right": left + F.lit(width), "center": left + F.lit(width / 2),
                              "from": from_scale(left, p.log_scale.method),
                              "to": from_scale(left + F.lit(width), p.log_scale.method),
                              "share": F.col("n") / F.sum("n").over(Window.partitionBy(*dims))})  # <= bins rows a segment
    return out.withColumn("segment", segment_label(out, dims))


def outside_scale(book: Book, p: Profile) -> DataFrame:
    """One row: values the scale has no place for."""
    _, valid = to_scale(F.col(p.name), p.log_scale.method)
    return book.population().agg(F.count_if(F.col(p.name).isNotNull() & ~valid).alias("excluded"))


# ---- categorical ---------------------------------------------------------------------
def every_category(book: Book, profiles: Sequence[Profile]) -> DataFrame:
    """(variable, *dims, category, n, share) of all categories and `<null>`, in one pass over the fact table."""
    dims = book.require(profiles[0].group_by)
    counts = _category_rows(book, profiles).select("variable", *dims, F.coalesce("_cat", F.lit(NULL_LABEL)).alias("category"), F.col("_n").alias("n"))
    keys = ["variable", *dims]
    totals = counts.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("n").alias("_total"))  # a join: a segment has any number of categories
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return counts.join(totals, same).select(*keys, "category", "n", (F.col("n") / F.col("_total")).alias("share"))


def _category_rows(book: Book, profiles: Sequence[Profile]) -> DataFrame:
    dims, df = book.require(profiles[0].group_by), book.population()
    texts = [F.struct(F.lit(p.name).alias("variable"), level_text(F.col(p.name), df.schema[p.name].dataType).alias("_cat"))
             for p in profiles if book.require([p.name])]
    return df.select(*dims, F.inline(F.array(*texts))).groupBy("variable", *dims, "_cat").agg(F.count(F.lit(1)).alias("_n"))


def categories(book: Book, profiles: Sequence[Profile]) -> DataFrame:
    """(variable, *dims, category, n, share): the globally most frequent categories, `<null>` and `<other>`.

    The fact table is read once, into counts per variable, segment and category; ranking and folding work on the
    counts. The list of kept categories has `max_categories` rows a variable, which makes its broadcast safe.
    """
    dims = book.require(profiles[0].group_by)
    counts = _category_rows(book, profiles)
    most = F.create_map(*[F.lit(x) for p in profiles for x in (p.name, p.max_categories)])
    by_size = Window.partitionBy("variable").orderBy(F.col("_all").desc(), "_cat")
    widest = max(p.max_categories for p in profiles)
    top = (counts.where(F.col("_cat").isNotNull()).groupBy("variable", "_cat").agg(F.sum("_n").alias("_all"))
           .withColumn("_at", F.row_number().over(by_size)).where(F.col("_at") <= widest)
           .where(F.col("_at") <= most[F.col("variable")]).select(F.col("variable").alias("_variable"), F.col("_cat").alias("_kept")))
    on = (F.col("variable") == F.col("_variable")) & (F.col("_cat") == F.col("_kept"))
    category = F.when(F.col("_cat").isNull(), F.lit(NULL_LABEL)).otherwise(F.coalesce("_kept", F.lit(OTHER_LABEL)))
    folded = (counts.join(F.broadcast(top), on, "left")
              .groupBy("variable", *dims, category.alias("category")).agg(F.sum("_n").alias("n")))
    # at most max_categories + 2 rows a segment
    return folded.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable", *dims)))


def category_counts(book: Book, p: Profile) -> DataFrame:
    return categories(book, [p]).drop("variable")


def category_summary(counts: DataFrame, dims: Sequence[str]) -> DataFrame:
    real = ~F.col("category").isin(NULL_LABEL, OTHER_LABEL)
    return counts.groupBy(*dims).agg(F.sum("n").alias("n_rows"), F.count_if(real).alias("n_categories"))


def top_categories(counts: DataFrame, dims: Sequence[str], top_n: int) -> DataFrame:
    order = Window.partitionBy(*dims).orderBy(F.col("n").desc(), "category")
    return counts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top_n).drop("_at")


def new_categories(counts: DataFrame, dims: Sequence[str], across: str, min_share: float) -> tuple[DataFrame, DataFrame]:
    """(new categories, levels compared). A category is new at the first level that has it, unless that is the first
    level of its partition; levels follow natural order. Ranks are taken over levels, not over rows, by a running total: one
    partition may hold any number of levels."""
    others = [d for d in dims if d != across]
    levels = counts.select(*dims).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(levels, [*natural_order(label_of(levels, across)), F.col(across).asc()], "_one", "_rank", keys=others).drop("_one")
    same = [F.col(f"c.{d}").eqNullSafe(F.col(f"r.{d}")) for d in dims]
    placed = counts.alias("c").join(ranked.alias("r"), same).select("c.*", "_rank")
    first = (placed.where(~F.col("category").isin(NULL_LABEL, OTHER_LABEL) & (F.col("n") > 0))
             .groupBy(*others, "category").agg(F.min("_rank").alias("_first"),
                                               F.min_by(F.col(across), "_rank").alias(across),
                                               F.min_by("n", "_rank").alias("n"), F.min_by("share", "_rank").alias("share")))
    fresh = first.where((F.col("_first") > 1) & (F.col("share") >= min_share)).select(*dims, "category", "n", "share")
    return fresh, ranked.where(F.col("_rank") > 1).drop("_rank")


def psi_categorical(book: Book, p: Profile, counts: DataFrame | None = None) -> DataFrame:
    counts = category_counts(book, p) if counts is None else counts
    return psi_between_peers(counts, p.group_by, p.psi.across, "category")


# ---- findings ------------------------------------------------------------------------
def _psi_findings(psi: DataFrame, p: Profile) -> DataFrame:
    others = [d for d in p.group_by if d != p.psi.across]
    within = f" within {', '.join(others)}" if others else ""
    return fd.emit(psi, CHECK, p.group_by, dict(
        variable=p.name, item=f"across {p.psi.across}", metric="psi", value=F.col("psi"), warn=p.psi.warn, fail=p.psi.fail,
        detail=F.concat(F.lit("median PSI vs "), F.col("n_peers").cast("string"), F.lit(f" other {p.psi.across} values{within}"))))


def _numeric(book: Book, profiles: list[Profile]) -> tuple[list[DataFrame], dict[str, DataFrame]]:
    table = materialize(grids(book, profiles), "percentiles")
    rows = materialize(stats(book, profiles, table), "stats")
    frames: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    compared = [p for p in profiles if p.compares]
    buckets = materialize(psi_buckets(book, compared), "buckets") if compared else None
    some = F.col("n_nonnull") > 0
    for p in profiles:
        mine = rows.where(F.col("variable") == p.name).drop("variable")
        specs = [dict(variable=p.name, item="no data", metric="n_nonnull", value=F.lit(0.0), status="info", when=~some,
                      detail=F.concat(F.lit(f"no non-null {p.name} in "), fd.count_text(F.col("n_rows")), F.lit(" rows")))]
        if not p.allow_negative:
            specs.append(dict(variable=p.name, item="negative values", metric="pct_negative", value=F.col("pct_negative"), warn=0.0,
                              fail=p.negative_fail, when=some, detail=fd.of_text(F.col("n_negative"), F.col("n_nonnull"), "")))
        if p.outlier_ratio:
            specs.append(dict(variable=p.name, item="outliers", metric="max_to_p99", value=F.col("max_to_p99"), warn=p.outlier_ratio,
                              fail=p.outlier_ratio * 10, threshold=p.outlier_ratio, when=F.col("max_to_p99").isNotNull(),
                              detail=F.format_string("max %.2f vs p99 %.2f", "max", "p99")))
        frames.append(fd.emit(mine, CHECK, p.group_by, *specs))
        tables[f"stats::{p.name}"] = mine
        tables[f"percentiles::{p.name}"] = table.where(F.col("variable") == p.name).drop("variable")
        if p.compares:
            psi = psi_between_peers(buckets.where(F.col("variable") == p.name).drop("variable"), p.group_by, p.psi.across, "bucket")
            tables[f"psi::{p.name}"] = psi
            frames.append(_psi_findings(psi, p))
    return frames, tables


def _categorical(book: Book, profiles: list[Profile]) -> tuple[list[DataFrame], dict[str, DataFrame]]:
    every = materialize(categories(book, profiles), "categories")
    unfolded = materialize(every_category(book, [p for p in profiles if p.compares]), "every_category") if any(p.compares for p in profiles) else None
    frames: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    for p in profiles:
        dims = list(p.group_by)
        counts = every.where(F.col("variable") == p.name).drop("variable")
        tables[f"summary::{p.name}"] = category_summary(counts, dims)
        tables[f"top::{p.name}"] = top_categories(counts, dims, p.top_n)
        if not p.compares:
            continue
        across = p.psi.across
        psi = psi_between_peers(counts, dims, across, "category")
        fresh, compared = new_categories(unfolded.where(F.col("variable") == p.name).drop("variable"), dims, across, p.new_category_min_share)
        tables[f"psi::{p.name}"], tables[f"new_categories::{p.name}"] = psi, fresh
        zero = compared.withColumns({"_new": F.lit(0), "_text": F.lit(None).cast("string")})
        named = fresh.select(*dims, F.lit(1).alias("_new"),
                             F.format_string("%s (%.1f%%)", F.col("category"), F.col("share") * 100).alias("_text"))
        # a new category holds at least min_share of its segment, so a segment has at most 1 / min_share of them
        per_level = (zero.unionByName(named).groupBy(*dims)
                     .agg(F.sum("_new").alias("n_new"), F.array_join(F.array_sort(F.collect_list("_text")), ", ").alias("_text")))
        frames += [_psi_findings(psi, p),
                   fd.emit(per_level, CHECK, dims, dict(
                       variable=p.name, item=f"new vs earlier {across}", metric="new_categories", value=F.col("n_new"), warn=0.0,
                       threshold=0.0, detail=F.substring("_text", 1, 500)))]
    return frames, tables


@check(CHECK, DistributionConfig, "Distributions", order=30)
def run(book: Book, cfg: DistributionConfig) -> CheckResult:
    """Profiles are run together by kind and dimensions, so the passes over the book do not grow with the number of
    variables; what several results read is stored once, at level grain."""
    book = book.stored(_columns(cfg.variables)) if cfg.variables else book
    together: dict[tuple[str, tuple[str, ...]], list[Profile]] = {}
    for p in cfg.variables:
        kind = p.type if p.type != "auto" else book.kind(p.name)
        together.setdefault((kind, tuple(p.group_by)), []).append(p)
    frames: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    for (kind, _), profiles in together.items():
        more, found = (_numeric if kind == "numeric" else _categorical)(book, profiles)
        frames += more
        tables |= found
    return CheckResult(fd.concat(frames, book.raw.sparkSession), tables)
