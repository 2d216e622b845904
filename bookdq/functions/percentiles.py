"""Exact interpolated percentiles that never put a whole group into one task.

`F.percentile` keeps every distinct value of a group in the memory of one task, which a group holding a third of
a large book does not survive. Here the value range is cut into blocks of near-equal row counts, rows are counted
per (group, block), and only the few blocks that hold a wanted rank are looked at value by value:

1. cut points: one `percentile_approx` per column (a bounded sketch with map-side merge), one row to the driver;
2. rows per (group, block): map-side aggregation, a bounded number of rows per group; ranks are located here. A
   located block that still holds too many rows is cut again, from the rows of that block only;
3. values of the located blocks only: counted per value, ranked inside their block, and interpolated.

The cut points shape the work, never the result: a block is a set of values, so ties stay together and the ranks
found are those of the full data.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.plans.sizing import broadcast_rows, collect_if_small, materialize

BLOCKS = 128
BLOCK_ROWS = 2_000_000  # rows of one group a located block may hold before it is cut again
MAX_LISTED = 2_000  # located blocks of a column up to which rows are picked by a list
MAX_CUTS = 3  # times the range is cut; each divides a block by about BLOCKS


def percentile_grid(bins: int | Sequence[float]) -> list[float]:
    """20 -> 0, .05, .. 1; a list is sorted, de-duplicated and given 0 and 1. 0.99 is always part of it."""
    if isinstance(bins, int):
        if not 2 <= bins <= 1000:
            raise ValueError("percentile bins must be between 2 and 1000")
        probs = {round(i / bins, 6) for i in range(bins + 1)}
    else:
        if not bins or any(not 0 <= p <= 1 for p in bins):
            raise ValueError("percentiles must be a non-empty list within [0, 1]")
        probs = {round(float(p), 6) for p in bins} | {0.0, 1.0}
    return sorted(probs | {0.99})


def percentiles(df: DataFrame, by: Sequence[str], columns: Mapping[str, Column], probs: Sequence[float],
                exact: bool = True, positives: bool = False, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Long frame (*by, variable, prob, value), nulls ignored; a group without values has no rows.

    `positives` adds the percentiles of the values above zero, as variable `+name`. `exact=False` takes the sketch
    value (`percentile_approx`, accuracy 10000): one pass, no second look.
    """
    probs = [float(p) for p in dict.fromkeys(probs)]
    names = list(columns)
    wide = df.select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values())])
    if not exact:
        return _sketched(wide, by, names, probs, positives)

    group = [*by, "variable"]
    inf = float("inf")
    first = wide.agg(*[_cut_points(f"_x{i}", blocks).alias(f"_x{i}") for i in range(len(names))]).first()
    cuts = [{c for c in (first[f"_x{i}"] or []) if c == c and abs(c) != inf} for i in range(len(names))]
    for _ in range(MAX_CUTS):
        long = _blocked(wide, by, names, cuts, positives)
        located = _locate(long, group, probs)
        rows = collect_if_small(located)
        if rows is None:
            located = materialize(located, "located")  # three steps read it
        full = ([(r["_t_variable"], r["_t_block"]) for r in rows if r["_t_rows"] > block_rows] if rows is not None
                else located.where(F.col("_t_rows") > block_rows).select("_t_variable", "_t_block").distinct().collect())  # as many as there are cut points, at most
        crowded = {(v if v in names else v[1:], b) for v, b in full}  # a plus marks the positives of a column
        if not crowded or not _cut_again(long, names, cuts, crowded, blocks):
            break
    else:
        long = _blocked(wide, by, names, cuts, positives)
        located = _locate(long, group, probs)
        rows = collect_if_small(located)
        if rows is None:
            located = materialize(located, "located")
    if rows is not None:  # otherwise the joins below shuffle
        wanted: dict[str, set[int]] = {}
        for r in rows:
            wanted.setdefault(r["_t_variable"], set()).add(r["_t_block"])
        if max(map(len, wanted.values()), default=0) <= MAX_LISTED:
            long = _blocked(wide, by, names, cuts, positives, wanted)  # other blocks are dropped before anything is joined
        located = broadcast_rows(df.sparkSession, rows, located.schema)

    same = (F.col("variable") == F.col("_t_variable")) & (F.col("_block") == F.col("_t_block"))
    for g in by:
        same = same & F.col(g).eqNullSafe(F.col(f"_t_{g}"))
    # values are counted before the join fans in the wanted ranks, so a frequent value is one row
    values = (long.join(located.select(*[f"_t_{g}" for g in group], "_t_block"), same, "left_semi")
              .groupBy(*group, "_block", "_x").agg(F.count(F.lit(1)).alias("_n")))
    in_block = Window.partitionBy(*group, "_block").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.sum("_n").over(in_block))
    hits = (ranked.join(located, same)
            .withColumn("_last", F.col("_before") + F.col("_upto") - 1)
            .withColumn("_first", F.col("_before") + F.col("_upto") - F.col("_n"))
            .select(*group, "_x", "_first", "_last", F.explode("_want").alias("_w")))

    def at(rank: str) -> Column:
        holds = (F.col(f"_w.{rank}") >= F.col("_first")) & (F.col(f"_w.{rank}") <= F.col("_last"))
        return F.max(F.when(holds, F.col("_x")))

    ends = (hits.groupBy(*group, F.col("_w.prob").alias("prob"), F.col("_w._weight").alias("_weight"))
            .agg(at("_low").alias("_lo"), at("_high").alias("_hi")))
    return ends.select(*group, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_weight")).alias("value"))


def _sketched(wide: DataFrame, by: Sequence[str], names: Sequence[str], probs: Sequence[float], positives: bool) -> DataFrame:
    wanted = {n: F.col(f"_x{i}") for i, n in enumerate(names)}
    if positives:
        wanted |= {f"+{n}": F.when(F.col(f"_x{i}") > 0, F.col(f"_x{i}")) for i, n in enumerate(names)}
    rows = wide.groupBy(*by).agg(*[F.percentile_approx(c, list(probs), 10000).alias(f"_p{i}") for i, c in enumerate(wanted.values())])
    cells = [F.struct(F.lit(n).alias("variable"), F.lit(p).alias("prob"), F.get(f"_p{i}", F.lit(k)).alias("value"))
             for i, n in enumerate(wanted) for k, p in enumerate(probs)]
    return rows.select(*by, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def _cut_points(x: str, blocks: int) -> Column:
    return F.percentile_approx(x, [k / blocks for k in range(1, blocks)], 2 * blocks)


def _blocked(wide: DataFrame, by: Sequence[str], names: Sequence[str], cuts: Sequence[set[float]], positives: bool,
             wanted: Mapping[str, set[int]] | None = None) -> DataFrame:
    """(*by, variable, _x, _block): every value with the block it falls into, or only those in the wanted blocks."""
    inf = float("inf")
    places = range(len(names))
    split = Bucketizer(splitsArray=[[-inf, *(sorted(c) or [0.0]), inf] for c in cuts], inputCols=[f"_x{i}" for i in places],
                       outputCols=[f"_b{i}" for i in places], handleInvalid="keep").transform(wide)
    cells = []
    for i, n in enumerate(names):
        x, block = F.col(f"_x{i}"), F.col(f"_b{i}").cast("int")
        for name, keep in ((n, x.isNotNull()), (f"+{n}", x > 0)):  # positives: the same values in the same blocks
            if name == n or positives:
                listed = keep if wanted is None else keep & block.isin(*wanted[name]) if name in wanted else F.lit(False)
                cells.append(F.when(listed, F.struct(F.lit(name).alias("variable"), x.alias("_x"), block.alias("_block"))))
    return split.select(*by, F.inline(F.array(*cells))).where(F.col("_x").isNotNull())


def _locate(long: DataFrame, group: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The blocks that hold a wanted rank, the rows before them, and the ranks."""
    by_block = Window.partitionBy(*group).orderBy("_block")  # a row per block
    every = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = (long.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
               .withColumn("_total", F.sum("_n").over(every))
               .withColumn("_want", F.transform(F.array(*[F.lit(p) for p in probs]), _rank_of)))
    touched = F.filter("_want", lambda w: (w["_low"] < F.col("_before") + F.col("_n")) & (w["_high"] >= F.col("_before")))
    return (counted.withColumn("_want", touched).where(F.size("_want") > 0)
            .select(*[F.col(g).alias(f"_t_{g}") for g in group], F.col("_block").alias("_t_block"), F.col("_n").alias("_t_rows"),
                    "_before", "_want"))


def _cut_again(long: DataFrame, names: Sequence[str], cuts: Sequence[set[float]], crowded: set[tuple[str, int]], blocks: int) -> bool:
    """Add cut points inside crowded blocks; False when their values allow none (one value repeated)."""
    inside = F.lit(False)
    for name in names:
        hit = [b for n, b in crowded if n == name]
        if hit:
            inside = inside | ((F.col("variable") == name) & F.col("_block").isin(hit))
    found = long.where(inside).groupBy("variable", "_block").agg(_cut_points("_x", blocks).alias("c")).collect()  # a row per block
    more = False
    for r in found:
        mine = cuts[names.index(r["variable"])]
        new = {c for c in r["c"] if c == c and abs(c) != float("inf")} - mine
        more = more or bool(new)
        mine |= new
    return more


def _rank_of(p: Column) -> Column:
    """Ranks around probability p among `_total` values and the weight of the upper one."""
    position = p * (F.col("_total") - 1).cast("double")
    low = F.floor(position)
    return F.struct(p.alias("prob"), low.alias("_low"), F.ceil(position).alias("_high"),
                    (position - low.cast("double")).alias("_weight"))


def percentile_row(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float],
                   exact: bool = True) -> dict[tuple[str, float], float]:
    """Ungrouped percentiles as driver scalars (bin cuts, bucket edges): len(columns) * len(probs) numbers."""
    rows = percentiles(df, [], columns, probs, exact).collect()
    return {(r["variable"], r["prob"]): r["value"] for r in rows}

