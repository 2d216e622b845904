"""Value consistency across sources and plausibility of amounts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.book import Book
from bookdq.functions.labels import level_text
from bookdq.functions.percentiles import percentiles
from bookdq.operators import findings as fd
from bookdq.plans.registry import CheckResult, check
from bookdq.plans.sizing import materialize

CHECK = "value_checks"


@dataclass(frozen=True)
class CategoricalRule:
    max_values: int = 500  # still accepted in configurations, but cuts nothing: the comparison is a group-by
    warn_unique: float = 0.0
    warn_rows: float = 0.005
    fail_rows: float = 0.05


@dataclass(frozen=True)
class MedianRatio:
    warn: float = 10.0
    fail: float = 50.0


@dataclass(frozen=True)
class NumericRule:
    min: float | None = None
    max: float | None = None
    allow_negative: bool = True
    allow_zero: bool = True
    discrete: bool = False
    top_value_warn: float | None = None
    compare_medians: bool = True
    median_ratio: MedianRatio | None = None
    out_of_bounds_warn: float = 0.0
    out_of_bounds_fail: float = 0.001
    sign_warn: float = 0.0
    sign_fail: float = 0.01


@dataclass(frozen=True)
class ValuesConfig:
    enabled: bool = True
    order: int = 27
    categorical: Mapping[str, CategoricalRule] = field(default_factory=dict)
    numeric: Mapping[str, NumericRule] = field(default_factory=dict)
    median_ratio: MedianRatio = MedianRatio()


# ---- categorical ---------------------------------------------------------------------
OTHER_SOURCES = "(other sources)"


def value_counts(book: Book, columns: Sequence[str]) -> DataFrame:
    """(variable, value, source, n) of the non-null values of several columns, in one pass over the book.

    Counting is map-side first, so a value or a source that holds a third of the rows costs no more than another.
    Rows without a source are left out.
    """
    df, src = book.population(), book.spec.source
    cells = [F.struct(F.lit(c).alias("variable"), level_text(F.col(c), df.schema[c].dataType).alias("value"))
             for c in book.require(columns)]
    return (df.where(F.col(src).isNotNull()).select(src, F.inline(F.array(*cells))).where(F.col("value").isNotNull())
            .groupBy("variable", "value", src).agg(F.count(F.lit(1)).alias("n")))


def value_matrix(book: Book, column: str, sources: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Value x source counts. The configured sources name the first columns; sources that only the data has are summed in
    `(other sources)`, so no row is lost and nothing is scanned to find them."""
    counts = value_counts(book, [column]) if counts is None else counts.where(F.col("variable") == column)
    names, at = list(sources or book.spec.sources), F.col(book.spec.source)

    def total(wanted: Column) -> Column:
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0))

    return counts.groupBy("value").agg(*[total(at == s).alias(s) for s in names], total(~at.isin(*names)).alias(OTHER_SOURCES))


def value_shares(book: Book, column: str) -> DataFrame:
    """Share of each value in its source, and how many sources use it."""
    src = book.spec.source
    counts = value_counts(book, [column])
    totals = counts.groupBy(src).agg(F.sum("n").alias("n_source"))
    used = counts.withColumn("used_by", F.count(F.lit(1)).over(Window.partitionBy("value")))  # rows: one per source
    return used.join(totals, src).select("value", src, "n", (F.col("n") / F.col("n_source")).alias("share"), "used_by")


def used_by_one(book: Book, column: str) -> DataFrame:
    """Values only one source uses, with that source and its rows."""
    src = book.spec.source
    per_value = value_counts(book, [column]).groupBy("value").agg(F.count(F.lit(1)).alias("_k"), F.min(src).alias(src),
                                                                  F.sum("n").alias("n_rows"))
    return per_value.where(F.col("_k") == 1).select("value", src, "n_rows").orderBy(F.col("n_rows").desc(), "value")


def inventory(counts: DataFrame, source: str) -> DataFrame:
    """Per variable: distinct values and sources."""
    return counts.groupBy("variable").agg(F.count_distinct("value").alias("n_values"), F.count_distinct(source).alias("n_sources"))


def unique_by_source(counts: DataFrame, source: str) -> DataFrame:
    """Per variable and source: values nobody else uses, their share of the source's rows, and the first ten of them.

    The window that counts the sources of a value holds one row per source.
    """
    used = counts.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("variable", "value")))
    own = F.col("_k") == 1
    per_source = used.groupBy("variable", source).agg(
        F.count_if(own).alias("source_unique_values"),
        F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n_rows_unique"), F.sum("n").alias("n_rows"))
    at = F.row_number().over(Window.partitionBy("variable", source).orderBy("value"))
    first = (used.where(own).withColumn("_at", at).where(F.col("_at") <= 10).groupBy("variable", source)
             .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("first_values")))  # ten a source
    more = F.when(F.col("source_unique_values") > 10, F.lit("…")).otherwise(F.lit(""))
    return per_source.join(first, ["variable", source], "left").select(
        "variable", source, "source_unique_values", "n_rows_unique", "n_rows",
        (F.col("n_rows_unique") / F.col("n_rows")).alias("pct_rows_source_unique"),
        F.concat(F.coalesce("first_values", F.lit("")), more).alias("first_values"))


def source_unique(book: Book, column: str, rule: CategoricalRule = CategoricalRule()) -> DataFrame:
    """`unique_by_source` of one column, however many values it has."""
    return unique_by_source(value_counts(book, [column]), book.spec.source).drop("variable")


def _per_variable(rules: Mapping[str, object], names: Sequence[str]) -> Column:
    """The numeric settings of every variable's rule, looked up by `variable`."""
    return F.create_map(*[c for v, r in rules.items() for c in (
        F.lit(v), F.struct(*[F.lit(getattr(r, n)).cast("double").alias(n) for n in names]))])[F.col("variable")]


def _categorical_findings(counts: DataFrame, rules: Mapping[str, CategoricalRule], src: str) -> list[DataFrame]:
    found = inventory(counts, src)
    per_source = unique_by_source(counts, src).withColumn("_r", _per_variable(rules, ("warn_unique", "warn_rows", "fail_rows")))
    variable, item = F.col("variable"), "used by one source only"
    return [
        fd.emit(found, CHECK, [], dict(
            variable=variable, item="inventory", metric="n_values", value=F.col("n_values"), status="info",
            detail=F.concat(fd.count_text(F.col("n_values")), F.lit(" distinct values across "), F.col("n_sources").cast("string"),
                            F.lit(" sources")))),
        fd.emit(per_source, CHECK, [src],
                dict(variable=variable, item=item, metric="source_unique_values", value=F.col("source_unique_values"),
                     warn=F.col("_r.warn_unique"), threshold=F.col("_r.warn_unique"), detail=F.col("first_values")),
                dict(variable=variable, item=item, metric="pct_rows_source_unique", value=F.col("pct_rows_source_unique"),
                     warn=F.col("_r.warn_rows"), fail=F.col("_r.fail_rows"), detail=fd.of_text(F.col("n_rows_unique"), F.col("n_rows"))))]


# ---- numeric -------------------------------------------------------------------------
def plausibility(book: Book, rules: Mapping[str, NumericRule]) -> DataFrame:
    """Per variable and source: rows, values, negative, zero and out-of-bounds counts with their share of the values,
    min and max. All columns are conditional aggregates of one pass."""
    src = book.spec.source
    names = book.require(rules)
    aggs = []
    for i, (name, rule) in enumerate(rules.items()):
        x = F.col(name)
        below = F.count_if(x < rule.min) if rule.min is not None else F.lit(0).cast("bigint")
        above = F.count_if(x > rule.max) if rule.max is not None else F.lit(0).cast("bigint")
        aggs += [F.count(x).alias(f"_v{i}"), F.count_if(x < 0).alias(f"_n{i}"), F.count_if(x == 0).alias(f"_z{i}"), below.alias(f"_b{i}"),
                 above.alias(f"_a{i}"), F.min(x).cast("double").alias(f"_l{i}"), F.max(x).cast("double").alias(f"_h{i}")]
    wide = book.population().groupBy(src).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    fields = {"n_nonnull": "_v", "n_negative": "_n", "n_zero": "_z", "n_below": "_b", "n_above": "_a", "min": "_l", "max": "_h"}
    cells = [F.struct(F.lit(n).alias("variable"), *[F.col(f"{c}{i}").alias(f) for f, c in fields.items()]) for i, n in enumerate(names)]
    part = lambda n: F.when(F.col("n_nonnull") > 0, n / F.col("n_nonnull"))
    return wide.select(src, "n_rows", F.inline(F.array(*cells))).withColumns({
        "pct_out_of_bounds": part(F.col("n_below") + F.col("n_above")), "pct_negative": part(F.col("n_negative")),
        "pct_zero": part(F.col("n_zero"))})


def numeric_plausibility(book: Book, column: str, rule: NumericRule = NumericRule()) -> DataFrame:
    return plausibility(book, {column: rule}).drop("variable")


def top_values(counts: DataFrame, source: str) -> DataFrame:
    """Per variable and source: the most common value (the smallest on a tie), its rows and its share."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value")))
    out = counts.groupBy("variable", source).agg(best.alias("_b"), F.max("n").alias("n_top"), F.sum("n").alias("n_values"))
    return out.select("variable", source, F.col("_b.value").alias("top_value"), "n_top", "n_values",
                      (F.col("n_top") / F.col("n_values")).alias("top_value_share"))


def top_value_share(book: Book, column: str) -> DataFrame:
    return top_values(value_counts(book, [column]), book.spec.source).drop("variable")


def medians(book: Book, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """(variable, source, median) of several columns at once."""
    src = book.spec.source
    book = book.stored([src, *columns]) if exact else book  # a sketch takes one pass
    return (percentiles(book.population(), [src], {c: F.col(c) for c in book.require(columns)}, [0.5], exact)
            .select("variable", src, F.col("value").alias("median")))


def medians_by_source(book: Book, column: str, exact: bool = True) -> DataFrame:
    return medians(book, [column], exact).drop("variable")


def median_ratios(found: DataFrame) -> DataFrame:
    """Per variable: largest over smallest non-zero median of the sources, if there are two or more; null when a
    median is negative, where a ratio says nothing."""
    out = found.where(F.col("median") != 0).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_sources"), F.min("median").alias("min_median"), F.max("median").alias("max_median"))
    return out.where(F.col("n_sources") > 1).withColumn(
        "median_ratio", F.when(F.col("min_median") > 0, F.col("max_median") / F.col("min_median")))


def median_ratio(book: Book, column: str, exact: bool = True) -> DataFrame:
    return median_ratios(medians(book, [column], exact)).drop("variable")


def _bounds_text(rule: NumericRule) -> str:
    lo, hi = ("-inf" if rule.min is None else f"{rule.min:g}"), ("inf" if rule.max is None else f"{rule.max:g}")
    return f"outside [{lo}, {hi}]"


def _numeric_findings(book: Book, cfg: ValuesConfig, rows: DataFrame, counts: DataFrame | None) -> list[DataFrame]:
    src, rules = book.spec.source, cfg.numeric
    variable, n = F.col("variable"), F.col("n_nonnull")
    bounded = [v for v, r in rules.items() if r.min is not None or r.max is not None]
    signed = [v for v, r in rules.items() if not r.allow_negative]
    nonzero = [v for v, r in rules.items() if not r.allow_zero]
    text = F.create_map(*[F.lit(t) for v, r in rules.items() for t in (v, _bounds_text(r))])[variable]
    rated = rows.where(n > 0).withColumns({"_r": _per_variable(rules, ("out_of_bounds_warn", "out_of_bounds_fail", "sign_warn", "sign_fail")), "_text": text})
    sign = dict(variable=variable, warn=F.col("_r.sign_warn"), fail=F.col("_r.sign_fail"))
    out = [fd.emit(
        rated, CHECK, [src],
        dict(variable=variable, item=F.col("_text"), metric="pct_out_of_bounds", when=variable.isin(bounded), value=F.col("pct_out_of_bounds"),
             warn=F.col("_r.out_of_bounds_warn"), fail=F.col("_r.out_of_bounds_fail"),
             detail=F.concat(fd.count_text(F.col("n_below")), F.lit(" below, "), fd.count_text(F.col("n_above")), F.lit(" above of "), fd.count_text(n),
                             F.lit(" · observed "), F.format_number("min", 0), F.lit(" to "), F.format_number("max", 0))),
        dict(item="negative values", metric="pct_negative", when=variable.isin(signed), value=F.col("pct_negative"),
             detail=fd.of_text(F.col("n_negative"), n, ""), **sign),
        dict(item="zero values", metric="pct_zero", when=variable.isin(nonzero), value=F.col("pct_zero"),
             detail=fd.of_text(F.col("n_zero"), n, ""), **sign))]
    ladders = {v: r for v, r in rules.items() if r.discrete and r.top_value_warn is not None and v in cfg.categorical}
    if ladders and counts is not None:
        top = top_values(counts.where(variable.isin(list(ladders))), src).withColumn("_r", _per_variable(ladders, ("top_value_warn",)))
        out.append(fd.emit(top, CHECK, [src], dict(
            variable=variable, item=F.concat(F.lit("most common value: "), F.col("top_value")), metric="top_value_share",
            value=F.col("top_value_share"), warn=F.col("_r.top_value_warn"), threshold=F.col("_r.top_value_warn"),
            detail=fd.of_text(F.col("n_top"), F.col("n_values")))))
    compared = {v: r.median_ratio or cfg.median_ratio for v, r in rules.items() if r.compare_medians}
    if compared:
        ratios = median_ratios(medians(book, list(compared))).withColumn("_r", _per_variable(compared, ("warn", "fail")))
        out.append(fd.emit(ratios, CHECK, [], dict(
            variable=variable, item="median by source", metric="median_ratio_across_src", value=F.col("median_ratio"), warn=F.col("_r.warn"),
            fail=F.col("_r.fail"), detail=F.format_string("%.2f to %.2f", "min_median", "max_median"))))
    return out


@check(CHECK, ValuesConfig, "Values check", order=27)
def run(book: Book, cfg: ValuesConfig) -> CheckResult:
    """Two passes over the book (value counts of all categorical columns, aggregates of all numeric ones) and the
    medians; the counts are stored, since inventory, unique values, top shares and tables all read them."""
    frames: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    counts = None
    book = book.stored([book.spec.source, *cfg.categorical, *cfg.numeric])
    if cfg.categorical:
        counts = materialize(value_counts(book, list(cfg.categorical)), "values")
        frames += _categorical_findings(counts, cfg.categorical, book.spec.source)
        tables |= {f"values::{c}": value_matrix(book, c, counts=counts) for c in cfg.categorical}
    if cfg.numeric:
        rows = materialize(plausibility(book, cfg.numeric), "plausibility")
        frames += _numeric_findings(book, cfg, rows, counts)
        tables |= {f"numeric::{c}": rows.where(F.col("variable") == c).drop("variable") for c in cfg.numeric}
    return CheckResult(fd.concat(frames, book.raw.sparkSession), tables)
