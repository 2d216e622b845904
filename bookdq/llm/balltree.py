"""Exact inner-product search by ball trees, one a shard, with branch and bound.

A vector takes part as whole numbers, floor(256 * component), so scores are exact. Vectors are dealt over shards by a hash
of their id. Each shard holds its different vectors (with the smallest K + 1 ids of each: no query can use more) in a
balanced ball tree: a node covers a run of rows, and for a query q no row in it scores above q * centre + |q| * radius.

A query first searches the shard it lies in; the score of its kth best goes with it to the other shards, a few first, then
all, so that each starts with the bound found so far. Inside a shard it descends to the most promising leaf, drops the
nodes whose bound is below its kth score, and visits the leaves that are left from the highest bound on, a few at a
time, with the kth score of that moment. Queries that visit the same leaf share a matrix product.

Queries meet shards in blocks: a task holds one shard (SHARD_CELLS numbers) and TASK_QUERIES queries, whatever the table.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, ship

SCALE = 256
SHARD_CELLS, TASK_QUERIES, LEAF_ROWS = 1 << 20, 8_000, 64
WAVES = 8  # the second wave takes one in so many shards, the third the rest
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<long>, width): rows with a key and a vector without null or non-finite components, as whole numbers.
    Rows with one key are one vector, the least. A vector so long that a score with one like it may not fit a long (its
    sum of squares reaches 2**62) takes no part."""
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad)
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.abs(SCALE * x) + 1, F.lit(2.0))) < 2.0 ** 62)
    rows = rows.select("id", F.transform("x", lambda x: F.floor(SCALE * x)).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))


def starts(n: int, level: int) -> np.ndarray:
    """First rows of the nodes of a level; each node's halves are two nodes of the next level."""
    return n * np.arange(1 << level) // (1 << level)


def depth(n: int, leaf: int = LEAF_ROWS) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))


def build(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(order of the rows, centres of each level's nodes, their radii). A node is cut in the middle of its rows along the
    line between two rows that lie far apart."""
    n, levels = len(points), depth(len(points), leaf)
    order, centres, radii = np.arange(n), [], []
    for level in range(levels + 1):
        first = starts(n, level)
        count = np.diff(first, append=n)
        node = np.repeat(np.arange(len(first)), count)
        x = points[order].astype(np.float64)
        centre = np.add.reduceat(x, first) / count[:, None]

        def farthest(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = np.sqrt(((x - of[node]) ** 2).sum(axis=1))
            most = np.maximum.reduceat(apart, first)
            at = np.flatnonzero(apart == most[node])
            return at[np.unique(node[at], return_index=True)[1]], most

        one, radius = farthest(centre)
        centres.append(centre)
        radii.append(radius)
        if level < levels:
            other, _ = farthest(x[one])
            along = (x * (x[other] - x[one])[node]).sum(axis=1)
            order = order[np.lexsort((along, node))]
    return order, centres, radii


class BallTree:
    """Rows of `ids` and equal vectors are one entry with the least `keep` ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, leaf: int = LEAF_ROWS):
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        if vectors.shape[1]:
            different, entry = np.unique(vectors, axis=0, return_inverse=True)
        else:
            different, entry = vectors[:1], np.zeros(len(ids), dtype=np.int64)
        entry = entry.ravel()
        order, self.centres, self.radii = build(different, leaf)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        row = place[entry]  # of each id, its entry's row
        sort = np.argsort(row, kind="stable")  # ids of one row stay ascending
        row, ids = row[sort], ids[sort]
        first = np.searchsorted(row, row)
        used = np.arange(len(row)) - first < keep
        self.row, self.ids = row[used], ids[used]
        self.vectors = different[order]
        self.exact = np.abs(self.vectors).max(initial=0)
        bounds = starts(len(self.vectors), len(self.centres) - 1)
        self.leaves = np.append(np.searchsorted(self.row, bounds), len(self.row))  # ids of leaf i: leaves[i] to leaves[i + 1]

    def limit(self, level: int, queries: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row of the node scores higher."""
        centre, radius = self.centres[level], self.radii[level]
        far = np.sqrt((centre * centre).sum(axis=1)) + radius
        return queries @ centre.T + length[:, None] * (radius + 1e-9 * far) + 1

    def search(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score): the k best rows of each query, but for the row `own`, with a score of `least` or more."""
        m, leaves = len(queries), len(self.leaves) - 1
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        whole = float(self.exact) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2 ** 53  # then doubles are exact
        left, right = (q, self.vectors.astype(np.float64)) if whole else (queries, self.vectors)
        score, found = np.full((m, k), NONE), np.full((m, k), NONE)
        kth = least.copy()

        def visit(leaf: int, who: np.ndarray) -> None:
            a, b = self.leaves[leaf], self.leaves[leaf + 1]
            ids, row = self.ids[a:b], self.row[a:b]
            low = row[0]
            got = (left[who] @ right[low:row[-1] + 1].T).astype(np.int64)[:, row - low]
            got[ids[None, :] == own[who][:, None]] = NONE
            hit = np.flatnonzero((got >= kth[who][:, None]).any(axis=1))
            if not len(hit):
                return
            who, got = who[hit], got[hit]
            every = np.concatenate([score[who], got], axis=1)
            names = np.concatenate([found[who], np.broadcast_to(ids, got.shape)], axis=1)
            pick = np.lexsort(np.stack([names, ~every]), axis=1)[:, :k]  # ~x falls as x grows, for every long
            score[who], found[who] = np.take_along_axis(every, pick, axis=1), np.take_along_axis(names, pick, axis=1)
            kth[who] = np.maximum(kth[who], score[who][:, -1])

        def visit_all(who: np.ndarray, leaf: np.ndarray) -> None:
            sort = np.argsort(leaf, kind="stable")
            who, leaf = who[sort], leaf[sort]
            cut = np.flatnonzero(np.diff(leaf, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(leaf))):
                visit(int(leaf[a]), who[a:b])

        node = np.zeros(m, dtype=np.int64)
        limits = [self.limit(level, q, length) for level in range(len(self.centres))]
        for level in range(1, len(self.centres)):  # to the most promising leaf
            node = 2 * node + (limits[level][np.arange(m), 2 * node + 1] > limits[level][np.arange(m), 2 * node])
        seen = np.zeros((m, leaves), dtype=bool)
        seen[np.arange(m), node] = True
        visit_all(np.arange(m), node)
        alive = np.ones((m, 1), dtype=bool)
        for level in range(len(self.centres)):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            alive = alive & (limits[level] >= kth[:, None])
        bound = np.where(alive & ~seen, limits[-1], -np.inf)
        turn, best = 0, np.argsort(-bound, axis=1)
        some = 1
        while turn < leaves:
            who, leaf = np.arange(m).repeat(min(some, leaves - turn)), best[:, turn:turn + some].ravel()
            open_ = (bound[who, leaf] > -np.inf) & (bound[who, leaf] >= kth[who])
            if not open_.any():
                break
            visit_all(who[open_], leaf[open_])
            turn, some = turn + some, 2 * some
        given = (found != NONE) & (score >= least[:, None]) & (score != NONE)
        return np.nonzero(given)[0], found[given], score[given]


def search(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_cells: int = SHARD_CELLS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """(query_id, rank, key, score): for each row whose key is divisible by `every`, the `k` other rows with the highest
    inner products of whole-number components, ties to the smaller key; all others if there are fewer.

    Vectors of different widths have no product and do not meet; empty vectors score 0 with each other. Rows that are not
    usable (see there; null vectors are among them) are neither queries nor candidates. Equal vectors under different keys are
    rows of their own; rows with one key are one row, the one with the least vector. An empty table gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    shelf = Shelf(spark, "balltree")
    rows = shelf.save(usable(vectors, key, vector), "rows")
    sizes = (rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("asked"))
             .select(F.col("width").alias("_w"), F.ceil(F.col("n") * F.greatest("width", F.lit(1)) / shard_cells).cast("int").alias("shards"),
                     F.greatest(F.ceil(F.col("asked") / task_queries), F.lit(1)).cast("int").alias("blocks")))
    dealt = rows.join(sizes, F.col("width") == F.col("_w")).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    most = sizes.agg(F.max("shards")).first()[0] or 0

    def search_shard(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "id", "score")})
        width = len(rows["v"].iloc[0])
        matrix = [np.array(f[c].tolist(), dtype=np.int64).reshape(len(f), width) for f, c in ((rows, "v"), (queries, "q_v"))]
        tree, out = BallTree(rows["id"].to_numpy(), matrix[0], k + 1), []
        own, least = queries["query"].to_numpy(), queries["least"].to_numpy()
        for a in range(0, len(queries), 1000):
            who, ids, score = tree.search(matrix[1][a:a + 1000], own[a:a + 1000], least[a:a + 1000], k)
            out.append(pd.DataFrame({"query": own[a:a + 1000][who], "id": ids, "score": score}))
        return pd.concat(out)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")  # at most k rows a shard and query
    asked = dealt.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "v", "width", "shards", "blocks", "shard")
    found = None
    ends = sorted({min(e, most) for e in (1, 1 + most // WAVES, most)})
    for wave, (a, b) in enumerate(zip([0, *ends], ends)):
        offset = F.explode(F.sequence(F.lit(a), F.least(F.lit(b), F.col("shards")) - 1)).alias("offset")
        near = asked.where(F.col("shards") > a).select("*", offset).withColumn("shard", (F.col("shard") + F.col("offset")) % F.col("shards"))
        near = near.withColumn("block", F.pmod(F.xxhash64("query", F.lit(1)), F.col("blocks")).cast("int"))
        if found is None:
            near = near.withColumn("least", F.lit(int(NONE) + 1))
        else:
            kth = found.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
            near = near.join(kth, "query", "left").withColumn("least", F.coalesce("least", F.lit(int(NONE) + 1)))
        kept = dealt.select("id", "v", "width", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        cell = ["width", "shard", "block"]
        own = near.select(*[F.col(c).alias(f"q_{c}") for c in cell], "query", F.col("v").alias("q_v"), "least")
        got = kept.groupBy(*cell).cogroup(own.groupBy(*[f"q_{c}" for c in cell])).applyInPandas(search_shard, "query long, id long, score long")
        got = got if found is None else found.select("query", "id", "score").union(got)
        found = shelf.save(got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), f"wave{wave}")
    if found is None:
        found = rows.select(F.col("id").alias("query"), "id", F.col("id").alias("score"), F.lit(1).alias("rank")).where(F.lit(False))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
