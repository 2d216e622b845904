"""Population stability index between the segments of a level table, in tiles of segments.

The index of two segments, the sum of (p - q)(ln p - ln q) over keys, is a sum of four inner products, p ln p + q ln q - p ln q - q ln p.
So all pairs of two blocks of segments are a few matrix products, and no row is ever made for a pair:

* The segments to compare with each other are dealt over tiles of about TILE segments by a hash. A task takes one pair of tiles.
* Where one tile holds all of them, its task gives median and maximum at once.
* Otherwise each task counts, for each of its segments, the values in ranges of a logarithmic scale. The counts of all tiles tell which
  ranges hold the middle ranks; a second pass gives only the values in these, and their ranks are known from the counts.

A key that a segment lacks has EMPTY_CELL; keys that a pair of tiles lacks altogether are priced by their number.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.plans.sizing import materialize

EMPTY_CELL = 1e-4  # fixed value: floor of a cell count
TILE = 512
_SEGMENT = ("_id", "_keys", "_values", "_all", "_k")


def psi_between_peers(counts: DataFrame, dims: Sequence[str], across: str, key: str, n: str = "n", tile: int = TILE) -> DataFrame:
    """Median and maximum PSI of each segment against its peers (same other dims, another value of `across`).

    `counts` is already aggregated (dims, key, n). Every segment becomes one row holding its counts, so the comparison
    runs on level rows, never on data rows. Rows with a null dimension are left out; a segment without peers has no row.
    """
    others = [d for d in dims if d != across]
    known = counts
    for d in dims:
        known = known.where(F.col(d).isNotNull())
    known = materialize(known.groupBy(*dims, F.col(key).cast("string").alias("_key")).agg(F.sum(n).alias("_n")), "cells")
    keys = known.agg(F.count_distinct("_key").alias("_k")).scalar()  # keys without a count in any segment are keys as well
    cell = F.struct("_key", F.col("_n").cast("double").alias("_v"))
    rows = known.groupBy(*dims).agg(F.collect_list(F.when(F.col("_n") > 0, cell)).alias("_cells"), F.sum("_n").alias("n"))  # buckets, or categories after folding
    rows = rows.where(F.size("_cells") > 0).withColumn("_k", keys)
    values = F.transform("_cells", lambda c: F.greatest(c["_v"], F.lit(EMPTY_CELL)))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) + (F.col("_k") - F.size("_cells")) * F.lit(EMPTY_CELL)
    segments = materialize(rows.select(*dims, "n", F.monotonically_increasing_id().alias("_id"), F.to_json(F.struct(F.lit(0).alias("_"), *others)).alias("_part"),
                                       F.transform("_cells", lambda c: c["_key"]).alias("_keys"), values.alias("_values"), total.alias("_all"), "_k"), "segments")
    sizes = segments.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    dealt = segments.join(sizes, "_part").withColumn("_tile", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int"))
    alone = dealt.where("_tiles = 1").select("_part", *_SEGMENT)
    found = alone.groupBy("_part").applyInPandas(_whole(_matrix(EMPTY_CELL)), "_id long, psi double, max_pairwise_psi double, n_peers long")
    if not sizes.where("_tiles > 1").isEmpty():
        found = found.union(_selected(dealt.where("_tiles > 1")))
    return found.join(segments.select(*dims, "n", "_id"), "_id").select(*dims, "psi", "max_pairwise_psi", "n_peers", "n")


def _selected(dealt: DataFrame) -> DataFrame:
    """Exact medians over many tiles: counts per range, then the values of the ranges that hold the middle."""
    matrix, other = _matrix(EMPTY_CELL), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    cell, wanted = ["_part", "_i", "_j"], ["_low", "_high"]
    right = dealt.select("_part", "_tile", *_SEGMENT, other.alias("_o")).select(F.col("_part").alias("_p"), F.col("_o").alias("_ri"), F.col("_tile").alias("_rj"), *[F.col(c).alias(f"{c}_r") for c in _SEGMENT])

    def pairs(left: DataFrame, fn: Callable, schema: str, more: Sequence[str] = ()) -> DataFrame:
        mine = left.select("_part", F.col("_tile").alias("_i"), other.alias("_j"), *_SEGMENT, *more)
        return mine.groupBy(*cell).cogroup(right.groupBy("_p", "_ri", "_rj")).applyInPandas(fn, schema)

    ranges = pairs(dealt, _counts(matrix), "_id long, bucket int, n long, top double").groupBy("_id", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    ranges = materialize(ranges, "ranges")  # a row a segment and range in use
    one = Window.partitionBy("_id")
    placed = ranges.withColumn("before", F.sum("n").over(one.orderBy("bucket")) - F.col("n")).withColumns({"peers": F.sum("n").over(one), "most": F.max("top").over(one)})
    low, high = F.expr("(peers - 1) div 2"), F.expr("peers div 2")

    def holds(rank):
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    middle = placed.groupBy("_id").agg(F.max("peers").alias("n_peers"), F.max("most").alias("max_pairwise_psi"), F.max(F.when(holds(low), F.col("bucket"))).alias("_low"), F.max(F.when(holds(high), F.col("bucket"))).alias("_high"),
                                       F.max(F.when(holds(low), F.col("before"))).alias("low_before"), F.max(F.when(holds(high), F.col("before"))).alias("high_before"))
    middle = materialize(middle, "middle")
    values = pairs(dealt.join(middle.select("_id", *wanted), "_id"), _values(matrix), "_id long, bucket int, psi double", wanted)
    ranked = values.withColumn("at", F.row_number().over(Window.partitionBy("_id", "bucket").orderBy("psi")) - 1).join(middle, "_id")
    before = F.when(F.col("bucket") == F.col("_low"), F.col("low_before")).otherwise(F.col("high_before"))
    rank = before + F.col("at")
    hit = ranked.where((rank == F.expr("(n_peers - 1) div 2")) | (rank == F.expr("n_peers div 2")))
    return hit.groupBy("_id").agg(F.avg("psi").alias("psi"), F.first("max_pairwise_psi").alias("max_pairwise_psi"), F.first("n_peers").alias("n_peers"))


# What tasks run. Functions made by functions travel with all they need, so executors do not need this package.
def _matrix(empty: float) -> Callable:
    def psi(left: pd.DataFrame, right: pd.DataFrame, suffix: str) -> np.ndarray:
        """(left, right): the index of each pair; NaN of a segment with itself."""
        names: dict[str, int] = {}
        sides = []
        for frame, s in ((left, ""), (right, suffix)):
            places = [np.fromiter((names.setdefault(k, len(names)) for k in keys), np.int64, len(keys)) for keys in frame[f"_keys{s}"]]
            sides.append((frame[f"_id{s}"].to_numpy(), places, frame[f"_values{s}"], frame[f"_all{s}"].to_numpy()))
        total, shares = int(left["_k"].iloc[0]), []
        for _, places, values, whole in sides:
            w = np.full((len(places), len(names)), empty)
            for row, at, v in zip(w, places, values):
                row[at] = v
            shares.append(w / whole[:, None])
        (p, q), (lp, lq), (none_p, none_q) = shares, map(np.log, shares), (empty / whole for *_, whole in sides)
        out = (p * lp).sum(axis=1)[:, None] + (q * lq).sum(axis=1)[None, :] - p @ lq.T - lp @ q.T
        out += (total - len(names)) * (none_p[:, None] - none_q) * (np.log(none_p)[:, None] - np.log(none_q))
        out = np.maximum(out, 0.0)
        out[sides[0][0][:, None] == sides[1][0]] = np.nan
        return out

    return psi


def _whole(matrix: Callable) -> Callable:
    def run(segments: pd.DataFrame) -> pd.DataFrame:
        some = segments if len(segments) > 1 else segments[:0]
        out = matrix(some, some, "") if len(some) else np.empty((0, 0))
        return pd.DataFrame({"_id": some["_id"], "psi": np.nanmedian(out, axis=1), "max_pairwise_psi": np.nanmax(out, axis=1) if len(some) else [], "n_peers": len(some) - 1})

    return run


def _counts(matrix: Callable) -> Callable:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            for name, row in zip(left["_id"], matrix(left, right, "_r")):
                row = np.sort(row[~np.isnan(row)])
                bucket, first, n = np.unique(np.floor(8 * np.log2(row + 1e-12)).astype(np.int32), return_index=True, return_counts=True)
                parts.append((np.full(len(bucket), name), bucket, n, row[first + n - 1]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("_id", "bucket", "n", "top"), zip(*parts))})

    return run


def _values(matrix: Callable) -> Callable:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_id": np.empty(0, np.int64), "bucket": np.empty(0, np.int32), "psi": np.empty(0)})
        out = matrix(left, right, "_r")
        bucket = np.where(np.isnan(out), -(1 << 20), np.floor(8 * np.log2(np.nan_to_num(out) + 1e-12))).astype(np.int32)
        row, column = np.nonzero((bucket == left["_low"].to_numpy()[:, None]) | (bucket == left["_high"].to_numpy()[:, None]))
        return pd.DataFrame({"_id": left["_id"].to_numpy()[row], "bucket": bucket[row, column], "psi": out[row, column]})

    return run
