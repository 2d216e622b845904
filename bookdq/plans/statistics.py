"""Statistics of preparation steps, many in shared passes, and how they come back to the rows.

A statistic is wanted of one input column (null where a row is out of scope), in groups of some columns. Those of one kind
and grouping share their passes: one aggregate for all means of a grouping, one run of the exact percentiles for all its
columns, and one count of levels for all modes and frequent levels of any grouping.

What comes back is small, a row a group. Up to BROADCAST_ROWS rows it is a broadcast table (or plain numbers without groups), so the
book is not exchanged for it; a larger one is stored and joined.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.functions.percentiles import percentiles
from bookdq.plans.sizing import broadcast_rows, collect_if_small, materialize


@dataclass(frozen=True)
class Wanted:
    """`kind`: percentiles (of probs), mean, mode (smallest of equally frequent values), or frequent (levels with a share of probs[0] or more).
    `by`: group columns of the rows; `keys`: their values when the step comes, columns of the measured frame."""

    place: int
    kind: str
    by: tuple[str, ...]
    keys: tuple[str, ...]
    column: str
    probs: tuple[float, ...] = ()


@dataclass(frozen=True)
class Attached:
    """`numbers`: values without groups. Else `table` has columns to join with `by`, in that order, and then `values`."""

    by: tuple[str, ...] = ()
    numbers: tuple | None = None
    table: DataFrame | None = None
    values: tuple[str, ...] = ()
    looked_up: bool = False  # frequent levels: the table lists them

    @property
    def columns(self) -> list[str]:
        return [] if self.table is None else self.table.columns


def measure(df: DataFrame, wanted: Sequence[Wanted]) -> dict[int, Attached]:
    found: dict[int, Attached] = {}
    for keys in dict.fromkeys(w.keys for w in wanted if w.kind in ("percentiles", "mean")):
        ranked = [w for w in wanted if w.keys == keys and w.kind == "percentiles"]
        means = [w for w in wanted if w.keys == keys and w.kind == "mean"]
        if ranked:
            probs = sorted({q for w in ranked for q in w.probs})
            long = percentiles(df.select(*keys, *[w.column for w in ranked]), keys, {w.column: F.col(w.column) for w in ranked}, probs)
            cells = [F.max(F.when((F.col("variable") == w.column) & (F.col("prob") == q), F.col("value"))).alias(f"{w.column}_{i}") for w in ranked for i, q in enumerate(w.probs)]
            _hand_out(found, long.groupBy(*keys).agg(*cells), ranked)
        if means:
            _hand_out(found, df.groupBy(*keys).agg(*[F.avg(w.column).alias(f"{w.column}_0") for w in means]), means)
    levels = [w for w in wanted if w.kind in ("mode", "frequent")]
    if levels:
        _measure_levels(found, df, levels)
    return found


def _measure_levels(found: dict[int, Attached], df: DataFrame, wanted: Sequence[Wanted]) -> None:
    """Counts of all levels of all wanted columns in one aggregate: (which, group as text, level as text, n)."""
    spark = df.sparkSession
    cells = [F.when(F.col(w.column).isNotNull(), F.struct(F.lit(w.place).alias("which"), F.to_json(F.struct(F.lit(0).alias("_"), *w.keys)).alias("group"), F.col(w.column).cast("string").alias("level"))) for w in wanted]
    counts = df.select(F.inline(F.array(*cells))).where(F.col("which").isNotNull()).groupBy("which", "group", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "levels")
    totals = {r["which"]: r["n"] for r in counts.groupBy("which").agg(F.sum("n").alias("n")).collect()}
    for w in wanted:
        mine = counts.where(F.col("which") == w.place)
        if w.kind == "frequent":
            kept = mine.where(F.col("n") / F.lit(float(totals.get(w.place, 1))) >= w.probs[0]).select(F.col("level").alias(f"{w.column}_0"))
            found[w.place] = Attached(table=_sized(kept), values=(f"{w.column}_0",), looked_up=True)
            continue
        kind = df.schema[w.column].dataType
        pick = mine.groupBy("group").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("level").cast(kind).alias("level"))).alias("best"))
        if not w.by:
            row = pick.select("best.level").first()
            found[w.place] = Attached(numbers=(row[0] if row else None,))
            continue
        seen = df.groupBy(*w.keys).agg(F.first(F.to_json(F.struct(F.lit(0).alias("_"), *w.keys))).alias("group"))
        _hand_out(found, seen.join(pick, "group").select(*w.keys, F.col("best.level").alias(f"{w.column}_0")), [w])


def _hand_out(found: dict[int, Attached], table: DataFrame, wanted: Sequence[Wanted]) -> None:
    """One small table for all wanted statistics of a grouping; each gets its columns of it."""
    keys = wanted[0].keys
    values = {w.place: tuple(f"{w.column}_{i}" for i in range(max(1, len(w.probs)))) for w in wanted}
    if not keys:
        row = table.first()
        found |= {w.place: Attached(numbers=tuple(row[v] if row else None for v in values[w.place])) for w in wanted}
        return
    table = _sized(table)
    for w in wanted:
        mine = table.select(*[F.col(key).alias(f"_g{w.place}_{i}") for i, key in enumerate(keys)], *values[w.place])
        found[w.place] = Attached(w.by, table=mine, values=values[w.place])


def _sized(table: DataFrame) -> DataFrame:
    small = collect_if_small(table)
    return materialize(table, "statistics") if small is None else broadcast_rows(table.sparkSession, small, table.schema)


def attach(df: DataFrame, known: Attached, column: str) -> tuple[DataFrame, list]:
    """The frame with the statistic's columns (`known.columns`, to be dropped), and its values: columns, or numbers without groups.
    For frequent levels the value is the level of `column` where it is one."""
    if known.table is None:
        return df, list(known.numbers)
    if known.looked_up:
        same = F.col(column).cast("string") == F.col(known.values[0])
    else:
        same = F.lit(True)
        for mine, theirs in zip(known.by, known.columns):
            same = same & F.col(mine).eqNullSafe(F.col(theirs))
    return df.join(known.table, same, "left"), [F.col(v) for v in known.values]
