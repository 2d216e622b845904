"""Approximate nearest neighbours by shifted Hilbert curves.

Each of CURVES orderings projects the unit vectors on DIMS random directions of its own, shifts them by a random offset,
and takes the place of the cell of 2**BITS steps a direction on a Hilbert curve as key. Near vectors often have near keys on
one of the curves. Every curve is range-partitioned into WINDOWS windows of equal counts (boundaries from one pass of
quantile sketches over all keys). A query goes to its own window and the REACH windows on both sides; in each it is
compared with all rows by matrix products. The best of all curves and windows merge and are ranked again, exactly.

All rows are indexed. Equal vectors are one entry that keeps its smallest ids, K + 1 of them: no query can use more. A
window with more rows than a task should hold is dealt over several tasks, and its queries go to each of them.

Recall depends on the share of rows that a query meets and on how much structure the vectors have, not on the count. The
parameters are those that reach 0.97 on vectors without any structure (directions spread evenly in 64 dimensions), where a query
must meet most rows whatever the index; structured vectors do with fewer curves and more windows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, map_arrow

CURVES, DIMS, BITS, WINDOWS, REACH = 14, 8, 3, 16, 1
WINDOW_ROWS = 64  # a window has so many rows at least: a small table has fewer windows, down to one, where the search is exact
TASK_ROWS, TASK_QUERIES = 20_000, 4_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows of coordinates below 2**bits), after Skilling (2004)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ q - 1, turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] ^ turn) >> b & 1
    return key


@lru_cache(maxsize=4)
def directions(width: int, curves: int, dims: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each curve: orthonormal directions (as many as the vectors have, at most) and offsets."""
    rng = np.random.default_rng(seed)
    dims = min(dims, width)
    made = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
    return np.stack(made), rng.random((curves, dims))


def keys(unit: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """(rows, curves): each row's key on each curve. Cells are steps of the normal distribution that projections of
    unit vectors come near, so that they are evenly filled."""
    turned, offset = directions(unit.shape[1], curves, dims)
    out = np.empty((len(unit), curves), dtype=np.int64)
    for c in range(curves):
        z = unit @ turned[c] * np.sqrt(unit.shape[1])
        even = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution's
        out[:, c] = hilbert(np.floor((even + offset[c]) % 1.0 * (1 << bits) * (1 - 1e-12)).astype(np.int64), bits)
    return out


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec binary of doubles): rows with a key whose vector has no null, infinite or NaN component, is not zero, and
    has the most frequent width (the larger of equally frequent ones). Rows with one key are one vector, the least."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows.withColumn("width", F.size("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, windows: int = WINDOWS, reach: int = REACH,
           task_rows: int = TASK_ROWS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): for each row whose key is divisible by `every`, the `k` nearest other rows found, by
    cosine in double precision, ties to the smaller key; all others if there are fewer. Rows that are not usable (see
    there) are neither queries nor candidates. Other columns are not read."""
    spark = vectors.sparkSession
    shelf = Shelf(spark, "curves")
    rows = shelf.save(usable(vectors, key, vector), "rows")
    common = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.where(F.col("width") == (common["width"] if common else 0))
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.stack([np.array(x) for x in batch.column("v").to_pylist()])
                scaled = v / np.abs(v).max(axis=1, keepdims=True)
                got = keys(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), curves)
                lists = pa.ListArray.from_arrays(np.arange(0, got.size + 1, curves, dtype=np.int32), got.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("ids"), pa.array([x.tobytes() for x in v], pa.binary()), lists], names=["ids", "vec", "keys"])

    schema = "ids array<long>, vec binary, keys array<long>"
    entries = shelf.save(map_arrow(entries.select("ids", "v"), with_keys, schema), "entries")
    asked = rows.where(F.col("id") % every == 0).select(F.array("id").alias("ids"), "v")
    queries = shelf.save(map_arrow(asked, with_keys, schema), "queries")
    windows = max(1, min(windows, entries.count() // WINDOW_ROWS))
    parts = [i / windows for i in range(1, windows)]
    bounds = entries.agg(*[F.percentile_approx(F.col("keys")[c], parts, 2000) for c in range(curves)]).first() if parts else [[]] * curves
    cuts = F.array(*[F.array(*[F.lit(int(x)) for x in sorted(b or [])]).cast("array<long>") for b in bounds])  # curves x windows numbers
    place = F.posexplode(F.transform("keys", lambda x, i: F.size(F.filter(cuts[i], lambda b: b <= x)))).alias("curve", "window")
    placed = entries.select("ids", "vec", place)
    near = queries.select(F.col("ids")[0].alias("query"), "vec", place).withColumn("window", F.explode(F.sequence(F.greatest(F.col("window") - reach, F.lit(0)), F.least(F.col("window") + reach, F.lit(windows - 1)))))
    many = {}
    for frame, most, at in ((placed, task_rows, 0), (near, task_queries, 1)):
        for r in frame.groupBy("curve", "window").count().collect():  # curves x windows rows
            many.setdefault((r["curve"], r["window"]), [1, 1])[at] = -(-r["count"] // most)
    kinds = F.create_map(*[x for (c, w), n in many.items() for x in (F.lit(c * windows + w), F.array(*map(F.lit, n)))]) if many else F.create_map().cast("map<int,array<int>>")
    sizes = F.element_at(kinds, F.col("curve") * windows + F.col("window"))
    cell = ["curve", "window", "part_r", "part_q"]

    def dealt(frame: DataFrame, own: str, other: str, own_at: int, other_at: int, id_: str) -> DataFrame:
        frame = frame.withColumn("_n", sizes).withColumn(own, F.pmod(F.xxhash64(id_), F.col("_n")[own_at]).cast("int"))
        return frame.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_n")[other_at] - 1))).drop("_n")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        def scaled(f: pd.DataFrame) -> np.ndarray:
            """Divided by a power of two each, which changes no cosine: squares neither overflow nor vanish."""
            v = np.frombuffer(b"".join(f["vec"]), np.float64).reshape(len(f), -1)
            return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])

        r, q = scaled(left), scaled(right)
        length, ids = np.sqrt((r * r).sum(axis=1)), [x.tolist() for x in left["ids"]]
        least, unit, most, out = np.array([x[0] for x in ids]), r / length[:, None], min(len(r), k + 1), []
        for a in range(0, len(q), 512):
            some = q[a:a + 512]
            norm = np.sqrt((some * some).sum(axis=1))
            near = some @ unit.T
            border = np.partition(near, len(r) - most, axis=1)[:, len(r) - most] - 1e-9 * norm  # all that may be among the best, ties included
            row, column = np.nonzero(near >= border[:, None])
            exact = (some[row] * r[column]).sum(axis=1) / (norm[row] * length[column])
            order = np.lexsort((least[column], -exact, row))
            row, column, exact = row[order], column[order], exact[order]
            used = np.arange(len(row)) - np.searchsorted(row, row) < most  # entries better than one are not more than the ids better than its least
            out.append(pd.DataFrame({"query": right["query"].to_numpy()[a:a + 512][row[used]], "ids": [ids[i] for i in column[used]], "score": exact[used]}))
        return pd.concat(out)

    found = (dealt(placed, "part_r", "part_q", 0, 1, "ids").groupBy(*cell).cogroup(dealt(near, "part_q", "part_r", 1, 0, "query").groupBy(*cell))
             .applyInPandas(best, "query long, ids array<long>, score double"))
    pairs = found.select("query", "score", F.explode("ids").alias("id")).where("id <> query").groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # some hundreds of candidates a query
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")
