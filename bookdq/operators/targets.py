"""Target analysis: how a ratio moves with each variable, and where two variables interact."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.labels import OTHER_LABEL, label_of
from bookdq.functions.ratios import FULL_CREDIBILITY, credibility, ratio, share, weighted_rms_log
from bookdq.operators import findings as fd
from bookdq.operators.binning import Binning
from bookdq.plans.registry import CheckResult, check
from bookdq.plans.sizing import materialize

CHECK = "target_analysis"
SUMS = ("records", "premium", "loss", "claims", "exposure")
CROSSING_ROWS = 1_000_000  # level combinations up to which sums are taken at full crossing first


@dataclass(frozen=True)
class Target:
    label: str
    numerator: str
    denominator: str

    @property
    def needs_base(self) -> bool:
        return "exposure" in (self.numerator, self.denominator)


# fixed values: the four targets, each weighted by its own denominator
TARGETS = {
    "frequency": Target("Frequency (claims per exposure)", "claims", "exposure"),
    "severity": Target("Severity (loss per claim)", "loss", "claims"),
    "loss_cost": Target("Loss cost (loss per exposure)", "loss", "exposure"),
    "loss_ratio": Target("Loss ratio (loss per premium)", "loss", "premium"),
}


@dataclass(frozen=True)
class TargetConfig:
    enabled: bool = True
    order: int = 85
    category: str = "Portfolio analysis"
    variables: tuple[str, ...] = ()
    offer_all_columns: bool = True
    exclude_variables: tuple[str, ...] = ()
    max_pair_levels: int = 200
    default_target: str = "loss_ratio"
    max_levels: int = 12
    min_claims: int = 10
    full_credibility: float = FULL_CREDIBILITY
    spread_warn: float = 3.0
    interaction_warn: float = 0.15
    where: str | None = None


@dataclass
class TargetTables:
    total: DataFrame
    oneway: DataFrame
    pairs: DataFrame
    strength: DataFrame


def candidate_variables(book: Book, cfg: TargetConfig = TargetConfig()) -> list[str]:
    """Curated segment columns first, then every other column; measures and policy key only if named in `variables`."""
    automatic = ({*book.spec.measures.numeric(), *book.spec.policy_key} - set(cfg.variables)) | set(cfg.exclude_variables)
    curated = [c for c in book.segment_options() if c not in automatic]
    others = [c for c in book.columns() if c not in automatic and c not in curated]
    return curated + (others if cfg.offer_all_columns else [])


def level_counts(book: Book, variables: Sequence[str]) -> DataFrame:
    """One row: approximate number of levels of each variable, by bounded sketches in one pass."""
    return book.population().agg(*[F.approx_count_distinct(v).alias(v) for v in book.require(variables)])


def exact_levels(df: DataFrame, variables: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count_distinct(v).alias(v) for v in variables]).first().asDict()


def not_crossed(book: Book, variables: Sequence[str], cfg: TargetConfig, base: str | None = None) -> list[str]:
    """The variables that `profile` leaves out of its two-ways, with their number of levels, as notes."""
    found = exact_levels(_scope(book, cfg, base), book.require(dict.fromkeys(variables)))
    return [f"{v} has {n:,} levels, more than {cfg.max_pair_levels:,}: it is shown alone and not crossed; bin it, or name it in pair_variables."
            for v, n in found.items() if n > cfg.max_pair_levels]


def default_base(book: Book, where: str | None = None) -> str | None:
    """The exposure base with most premium."""
    m = book.spec.measures
    by_base = book.population(where).where(F.col(m.exposure_base).isNotNull()).groupBy(m.exposure_base).agg(F.sum(m.premium).alias("p"))
    row = by_base.agg(F.max_by(m.exposure_base, F.struct("p", m.exposure_base)).alias("b")).first()
    return row["b"]


def _scope(book: Book, cfg: TargetConfig, base: str | None) -> DataFrame:
    df = book.population(cfg.where)
    return df.where(F.col(book.spec.measures.exposure_base) == base) if base else df


def level_sums(df: DataFrame, book: Book, levels: Mapping[str, Column], pairs: Sequence[tuple[str, str]],
               crossing_first: bool) -> DataFrame:
    """Long sums (depth, var_a, level_a, var_b, level_b, measures): total, every one-way and the given two-ways.

    One GROUPING SETS aggregate. It expands every input row once per set, so when the full crossing of all levels is
    small the sums are first taken at that grain (they are additive) and only the result is expanded.
    """
    m = book.spec.measures
    names = list(levels)
    cols = [f"_l{i}" for i in range(len(names))]
    at = dict(zip(names, cols))
    rows = df.select(*[levels[n].cast("string").alias(at[n]) for n in names], F.lit(1).cast("bigint").alias("records"),
                     F.col(m.premium).alias("premium"), F.col(m.loss).alias("loss"), F.col(m.claims).alias("claims"),
                     F.col(m.exposure).alias("exposure"))
    if crossing_first:
        rows = rows.groupBy(*cols).agg(*[F.sum(c).alias(c) for c in SUMS])
    sets = [[], *[[c] for c in cols], *[[at[a], at[b]] for a, b in pairs]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        *[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(c) for c in SUMS],
        *[F.grouping(c).alias(f"_g{c}") for c in cols])
    used = F.filter(F.array(*[F.when(F.col(f"_g{at[n]}") == 0, F.struct(F.lit(n).alias("var"), F.col(at[n]).alias("level")))
                              for n in names]), lambda s: s.isNotNull())
    slot = lambda i, f: F.get(used, F.lit(i))[f]
    return grouped.select(F.size(used).alias("depth"), slot(0, "var").alias("var_a"), slot(0, "level").alias("level_a"),
                          slot(1, "var").alias("var_b"), slot(1, "level").alias("level_b"), *SUMS)


def _ratios(df: DataFrame, target: Target, overall: Column, full: float) -> DataFrame:
    df = df.withColumns({"weight": F.col(target.denominator), "value": ratio(F.col(target.numerator), F.col(target.denominator))})
    return df.withColumns({"relativity": share(F.col("value"), overall), "z": credibility(F.col("claims"), full)})


def shape(sums: DataFrame, target: Target, cfg: TargetConfig, max_levels: int) -> TargetTables:
    """Fold small levels into `<other>` (exact: every measure is a sum), then ratios, expectation and strength."""
    keys2 = ["var_a", "level_a", "var_b", "level_b"]
    add = [F.sum(c).alias(c) for c in SUMS]
    total = sums.where(F.col("depth") == 0).select(*SUMS, ratio(F.col(target.numerator), F.col(target.denominator)).alias("value"))
    overall = total.select("value").scalar()
    total = total.withColumn("target", F.lit(target.label))

    one = sums.where(F.col("depth") == 1).select("var_a", "level_a", *SUMS)
    biggest = Window.partitionBy("var_a").orderBy(F.col(target.denominator).desc(), "level_a")
    keep = (one.withColumn("_at", F.row_number().over(biggest)).where(F.col("_at") <= max_levels)
            .select(F.col("var_a").alias("_var"), F.col("level_a").alias("_level")))
    keep = F.broadcast(keep)  # variables x max_levels rows

    def fold(df: DataFrame, side: str) -> DataFrame:
        var, level = f"var_{side}", f"level_{side}"
        return (df.join(keep, (F.col(var) == F.col("_var")) & (F.col(level) == F.col("_level")), "left")
                .withColumn(level, F.coalesce("_level", F.lit(OTHER_LABEL))).drop("_var", "_level"))

    oneway = _ratios(fold(one, "a").groupBy("var_a", "level_a").agg(*add), target, overall, cfg.full_credibility)
    oneway = oneway.withColumn("weight_share", share(F.col("weight"), F.sum("weight").over(Window.partitionBy("var_a"))))

    cells = fold(fold(sums.where(F.col("depth") == 2).select(*keys2, *SUMS), "a"), "b").groupBy(*keys2).agg(*add)
    pairs = _ratios(cells, target, overall, cfg.full_credibility)
    rel = oneway.select("var_a", "level_a", "relativity")
    for side in ("a", "b"):
        lookup = F.broadcast(rel.toDF("_v", "_l", f"_rel_{side}"))  # variables x (max_levels + 1) rows
        pairs = pairs.join(lookup, (F.col(f"var_{side}") == F.col("_v")) & (F.col(f"level_{side}") == F.col("_l")), "left").drop("_v", "_l")
    pairs = pairs.withColumn("expected", overall * F.col("_rel_a") * F.col("_rel_b")).drop("_rel_a", "_rel_b")
    pairs = pairs.withColumn("lift", ratio(F.col("value"), F.col("expected")))

    credible = F.col("claims") >= cfg.min_claims
    strength = pairs.groupBy("var_a", "var_b").agg(
        weighted_rms_log(F.col("lift"), F.col("weight"), credible).alias("strength"), F.count(F.lit(1)).alias("n_cells"),
        F.count_if(credible).alias("n_credible"),
        share(F.coalesce(F.sum(F.when(credible, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias("weight_credible"))
    strength = strength.select("var_a", "var_b", F.concat_ws(" × ", "var_a", "var_b").alias("pair"), "strength", "n_cells",
                               "n_credible", "weight_credible", F.expm1("strength").alias("typical_error"))
    return TargetTables(total, oneway, pairs, strength.orderBy(F.col("strength").desc_nulls_last(), "pair"))


def profile(book: Book, variables: Sequence[str], target: str, cfg: TargetConfig = TargetConfig(), base: str | None = None,
            binnings: Sequence[Binning] = (), max_levels: int | None = None,
            pair_variables: Sequence[str] | None = None) -> TargetTables:
    """Total, one-ways and two-ways of one target.

    The number of levels is counted first: variables above `max_pair_levels` are not crossed unless binned (see
    `not_crossed`), and the count decides at which grain the sums start. `pair_variables` replaces that guard: whatever is
    named there is crossed at all its levels and then folded, which is exact.
    """
    variables = book.require(dict.fromkeys(v for v in variables if v))
    df = _scope(book, cfg, base)
    bins = {b.variable: b for b in binnings if b.cuts_values}
    levels = {v: bins[v].label(F.col(v)) if v in bins else label_of(df, v) for v in variables}
    raw = [v for v in variables if v not in bins]
    sizes = {v: b.n_bins + 1 for v, b in bins.items()}
    if raw:
        sizes |= exact_levels(df, raw)
    crossed = [v for v in variables if (v in pair_variables if pair_variables is not None else v in bins or sizes[v] <= cfg.max_pair_levels)]
    combos = 1
    for v in variables:
        combos *= max(sizes[v], 1)
    sums = level_sums(df, book, levels, list(combinations(crossed, 2)), combos <= CROSSING_ROWS)
    return shape(materialize(sums, "levels"), TARGETS[target], cfg, max_levels or cfg.max_levels)


def score_binnings(book: Book, variable: str, schemes: Sequence[Binning], target: str, cfg: TargetConfig = TargetConfig(),
                   base: str | None = None) -> DataFrame:
    """Every scheme of a variable and its raw levels, scored in one pass; best separation first."""
    df = _scope(book, cfg, base)
    named = {b.name: b for b in schemes if b.cuts_values}
    levels = {"(raw levels)": label_of(df, *book.require([variable])), **{n: b.label(F.col(variable)) for n, b in named.items()}}
    sums = level_sums(df, book, levels, [], crossing_first=False)
    sums, measure = materialize(sums, "schemes"), TARGETS[target]
    overall = sums.where(F.col("depth") == 0).select(ratio(F.col(measure.numerator), F.col(measure.denominator)).alias("value")).scalar()
    part = _ratios(sums.where(F.col("depth") == 1).select("var_a", "level_a", *SUMS), measure, overall, cfg.full_credibility)  # every level, unfolded
    credible = F.col("claims") >= cfg.min_claims
    used = credible & (F.col("relativity") > 0) & (F.col("weight") > 0)
    lo, hi = (f(F.when(used, F.col("relativity"))) for f in (F.min, F.max))
    out = part.groupBy(F.col("var_a").alias("scheme")).agg(
        F.count(F.lit(1)).alias("n_bins"), F.count_if(credible).alias("n_credible"),
        weighted_rms_log(F.col("relativity"), F.col("weight"), credible).alias("signal"),
        F.when(F.count_if(used) > 1, hi / lo).alias("spread"),
        share(F.coalesce(F.sum(F.when(credible, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias("credible_weight"))
    text = F.create_map(*[F.lit(x) for n in levels for x in (n, named[n].summary() if n in named else "raw levels")])
    return out.withColumn("cuts", text[F.col("scheme")]).orderBy(F.col("signal").desc_nulls_last(), "scheme")


def target_findings(target: str, t: TargetTables, cfg: TargetConfig = TargetConfig()) -> DataFrame:
    credible = F.col("claims") >= cfg.min_claims
    used = credible & (F.col("relativity") > 0)
    lo, hi = (f(F.when(used, F.col("relativity"))) for f in (F.min, F.max))
    by_var = t.oneway.groupBy("var_a").agg(
        F.when(F.count_if(used) > 1, hi / lo).alias("spread"), F.count_if(used).alias("n_used"),
        share(F.coalesce(F.sum(F.when(F.col("claims") < cfg.min_claims, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias("thin"))
    variable = F.col("var_a")
    one = fd.emit(
        by_var, CHECK, [],
        dict(variable=variable, item=target, metric="target_spread", value=F.col("spread"), warn=cfg.spread_warn, threshold=cfg.spread_warn,
             detail=F.when(F.col("spread").isNull(), F.lit("not enough credible levels to compare"))
             .otherwise(F.format_string(f"{target} varies %.1fx across %d credible levels", "spread", "n_used"))),
        dict(variable=variable, item=target, metric="pct_weight_low_credibility", value=F.col("thin"), warn=0.1, fail=0.25,
             detail=F.format_string(f"%.1f%% of weight sits in levels with fewer than {cfg.min_claims} claims", F.col("thin") * 100)))
    two = fd.emit(
        t.strength, CHECK, [],
        dict(variable=variable, item=F.concat(F.lit(f"{target}: "), F.col("pair")), metric="interaction_strength", when=F.col("strength").isNotNull(),
             value=F.col("strength"), warn=cfg.interaction_warn, threshold=cfg.interaction_warn,
             detail=F.format_string("a main-effects model is typically %.0f%% out across %d credible cells", F.col("typical_error") * 100, F.col("n_credible"))))
    return one.unionByName(two)


def interaction_lines(t: TargetTables, var_a: str, var_b: str, cfg: TargetConfig = TargetConfig(), swap: bool = False,
                      max_lines: int = 8) -> DataFrame:
    """Credible cells of one pair as lines over the first variable's levels; the heaviest lines only."""
    x, line = ("level_b", "level_a") if swap else ("level_a", "level_b")
    cells = t.pairs.where((F.col("var_a") == var_a) & (F.col("var_b") == var_b) & (F.col("claims") >= cfg.min_claims))
    top = (cells.groupBy(F.col(line).alias("_line")).agg(F.sum("weight").alias("_w"))
           .orderBy(F.col("_w").desc(), "_line").limit(max_lines).select("_line"))
    shown = cells.join(F.broadcast(top), F.col(line) == F.col("_line"), "left_semi")
    return shown.select(F.col(x).alias("x"), F.col(line).alias("line"), "value", "claims", "weight", "expected", "lift")


def lift_matrix(lines: DataFrame, levels: Sequence[str] | None = None) -> DataFrame:
    """Line x level lifts."""
    return lines.groupBy("line").pivot("x", list(levels) if levels else None).agg(F.avg("lift"))


@check(CHECK, TargetConfig, "Target analysis", order=85, category="Portfolio analysis")
def run(book: Book, cfg: TargetConfig) -> CheckResult:
    if not cfg.variables:
        return CheckResult(fd.no_findings(book.raw.sparkSession), notes=["No rating variables configured."])
    target = cfg.default_target
    base = default_base(book, cfg.where) if TARGETS[target].needs_base else None
    t = profile(book, cfg.variables, target, cfg, base)
    notes = [f"{TARGETS[target].label} is measured for exposure base {base}."] if base else []
    notes += not_crossed(book, cfg.variables, cfg, base)
    tables = {f"{n}::{target}": getattr(t, n) for n in ("total", "oneway", "pairs", "strength")}
    return CheckResult(target_findings(target, t, cfg), tables, notes)

