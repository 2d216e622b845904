"""The trie of conversation prefixes: one row a distinct prefix, with members, children, leaves and what sharing it saves.

* Turns are numbered in each conversation, and conversations rebuilt, by running totals and joins: none is held in one task.
* A prefix's digest is the sum of its turns' hashes times BASE**place modulo the prime 2**89 - 1. Sums may be taken in parts, so the digests of a
  conversation of any length are a running total as well, and a node's parent has the digest less its last term.
* Nodes are one aggregation by (depth, digest), partly on the map side. A prefix of one conversation alone has one leaf and
  saves nothing, so only shared nodes enter what follows.
* A node with more than HUB_ROWS turns below it is a hub. The shared nodes below the last hub of a path are one subtree,
  which goes whole to a shard. There a minimal perfect hash gives each node a slot: keys that are alone in a place of a
  level's bit table have it, the others try the next level, and a key's slot is the rank of its bit. Digests are written to
  their slots and read again, so a wrong slot cannot pass. Counts are scattered into flat arrays by slot, and each
  depth, the deepest first, is added to its parents' slots.
* Hubs are few (a path has no more hubs than turns, and each stands for HUB_ROWS rows). A chain of hubs with one smallest
  member is summed by a running total from its end, chains that hang on it first.
* The ids that end at a node are packed in order by all tasks; one stream a node hashes the packs, without holding them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookdq.functions.running import running_total
from bookdq.llm.common import Shelf, map_arrow

PRIME, BASE = (1 << 89) - 1, 0x9E3779B97F4A7C15F39CC1
HALF = 1 << 45
DIGEST = "decimal(27,0)"
SHARD_NODES, HUB_ROWS = 200_000, 200_000
PACK = 20_000
FAMILY, HEADS = 100, 6  # a conversation starts with up to HEADS - 1 turns of the first of its FAMILY


class SlotTable:
    """A minimal perfect hash over different keys, the columns of a matrix of longs: `find` gives slots 0 to n - 1, -1 for others."""

    def __init__(self, keys: np.ndarray, space: float = 2.0):
        n = keys.shape[1]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, base = np.arange(n), 0
        while len(rest):
            if len(self.levels) > 100:
                raise ValueError("two keys are equal")
            size = max(64, int(space * len(rest)))
            at = self._place(keys[:, rest], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + base))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.keys = np.zeros_like(keys)
        slot = self._slots(keys)
        self.keys[:, slot] = keys
        if base != n or not np.array_equal(self.keys[:, slot], keys):
            raise ValueError("slots collide")

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = np.full(keys.shape[1], (level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, dtype=np.uint64)
        for row in keys:
            h = (h ^ row.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return (h % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot, open_ = np.full(keys.shape[1], -1, dtype=np.int64), np.arange(keys.shape[1])
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[:, open_], level, len(alone))
            hit = alone[at]
            slot[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        known = slot >= 0
        known[known] = (self.keys[:, slot[known]] == keys[:, known]).all(axis=0)
        return np.where(known, slot, -1)


def accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Sums over subtrees of `leaves` and `saved`; nodes (depth, hi, lo) whose parent (depth - 1, p_hi, p_lo) is not among them are roots."""
    own = np.stack([nodes[c].to_numpy(np.int64) for c in ("depth", "hi", "lo")])
    table = SlotTable(own)
    slot, up = table.find(own), table.find(np.stack([own[0] - 1, nodes["p_hi"].to_numpy(np.int64), nodes["p_lo"].to_numpy(np.int64)]))
    n = len(nodes)
    parent, depth, leaves, saved = (np.empty(n, dtype=np.int64) for _ in range(4))
    for array, values in ((parent, up), (depth, own[0]), (leaves, nodes["leaves"]), (saved, nodes["saved"])):
        array[slot] = values
    order = np.argsort(-depth, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        some = some[parent[some] >= 0]
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    return pd.DataFrame({"depth": table.keys[0], "hi": table.keys[1], "lo": table.keys[2], "leaves": leaves, "saved": saved})


@lru_cache(maxsize=100_000)
def power(place: int) -> int:
    return pow(BASE, place, PRIME)


def terms(turns: DataFrame) -> DataFrame:
    """Adds `term` = the turn's hash times BASE**depth to rows (c, depth, hash, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Decimal(int(h, 16) * power(d) % PRIME) for h, d in zip(batch.column("hash").to_pylist(), batch.column("depth").to_pylist())]
            rest = batch.select(["c", "depth", "chars", "total"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(got, pa.decimal128(27, 0))], names=[*rest.schema.names, "term"])

    return map_arrow(turns.select("c", "depth", "chars", "total", "hash"), run, f"c long, depth long, chars long, total long, term {DIGEST}")


def rebuild(conversations: DataFrame, shelf: Shelf, key: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: c, depth, hash, chars, total; the conversations: c, total)"""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256), 1, 22)
    plain = conversations.select(F.col(key).cast("long").alias("c"), F.col(turn).alias("t"), digest.alias("hash"), F.length(what).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    turns = running_total(plain.where("c IS NOT NULL"), [F.col("t").asc_nulls_first(), F.col("hash").asc()], "one", "pos", keys=["c"]).drop("t", "one")
    turns = shelf.save(turns, "turns")
    first = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("c").agg(F.max("pos").alias("n")).select("c", "n", (F.col("c") - F.col("c") % FAMILY).alias("base"), first.alias("h"))
    convs = shelf.save(convs, "convs")
    of_base = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    shift = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").select("c", "base", "h", shift.alias("shift"), (shift + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    heads = turns.where(F.col("pos") < HEADS).withColumnRenamed("c", "base")
    lent = convs.join(heads, "base").where("pos <= h").select("c", F.col("pos").alias("depth"), "hash", "chars", "total")
    kept = turns.join(convs, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("shift")).alias("depth"), "hash", "chars", "total")
    return lent.union(kept), convs.select("c", "total")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, digest): SHA-256 of the ids `c` of each node in ascending order, comma-joined."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node in a sorted partition, cut at batches and at PACK ids."""
        for batch in batches:
            if not batch.num_rows:
                continue
            depth, node, ids = (batch.column(c) for c in ("depth", "node", "c"))
            hi, lo, d = halves(node), ids.to_pylist(), depth.to_numpy()
            new = np.any([np.diff(x, prepend=x[:1] - 1) != 0 for x in (d, *hi)], axis=0)
            begin = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(d), PACK)]))
            texts = [",".join(map(str, lo[a:b])) for a, b in zip(begin, [*begin[1:], len(d)])]
            at = pa.array(begin)
            yield pa.RecordBatch.from_arrays([depth.take(at), node.take(at), ids.take(at), pa.array(texts, pa.string())], names=["depth", "node", "least", "text"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.decimal128(27, 0)), pa.array([r[2] for r in rows], pa.string())], names=["depth", "node", "digest"])

        for batch in batches:
            for depth, node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "text"))):
                if (depth, node) == at:
                    state.update(b"," + text.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(text.encode())
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if at is not None:
            done.append((*at, state.hexdigest()))
        yield batch_of(done)

    ordered = ends.select("depth", "node", "c").orderBy("depth", "node", "c")
    packs = map_arrow(ordered, pack, f"depth long, node {DIGEST}, least long, text string")
    return map_arrow(packs.repartition("depth", "node").sortWithinPartitions("depth", "node", "least").select("depth", "node", "text"), stream, f"depth long, node {DIGEST}, digest string")


def halves(node: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two longs of each digest, as stored."""
    raw = np.frombuffer(node.buffers()[1], np.int64)[2 * node.offset:2 * (node.offset + len(node))]
    return raw[::2], raw[1::2]


def high(digest: str) -> Column:
    return F.expr(f"{digest} div {HALF}").cast("long")


def low(digest: str) -> Column:
    return F.expr(f"{digest} % {HALF}").cast("long")


def of_hubs(shelf: Shelf, hubs: DataFrame) -> DataFrame:
    """(depth, node, leaves, saved) over subtrees of hubs (depth, node, up, owner, leaves, saved), whose own values hold those of
    all that hangs on them but hubs. Chains of one owner are summed as soon as no other chain hangs on them."""
    above = hubs.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), F.col("owner").alias("on"))
    left, number, done = shelf.save(hubs.join(above, ["depth", "up"], "left"), "hubs0"), 0, None
    while not left.isEmpty():
        busy = left.where(F.col("on") != F.col("owner")).select(F.col("on").alias("owner")).distinct()
        ready = left.join(busy, "owner", "left_anti")
        summed = running_total(running_total(ready, [F.col("depth").desc()], "leaves", "all_leaves", keys=["owner"]), [F.col("depth").desc()], "saved", "all_saved", keys=["owner"])
        summed = shelf.save(summed.select("depth", "node", "up", "owner", "on", F.col("all_leaves").alias("leaves"), F.col("all_saved").alias("saved")), f"summed{number}")
        done = summed if done is None else done.union(summed)
        more = (summed.where(F.col("on") != F.col("owner")).groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("node"))
                .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        rest = left.join(ready.select("owner").distinct(), "owner", "left_anti").join(more, ["depth", "node"], "left")
        number += 1
        left = shelf.save(rest.select("depth", "node", "up", "owner", "on", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), f"hubs{number}")
    return hubs.select("depth", "node", "leaves", "saved") if done is None else done.select("depth", "node", "leaves", "saved")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_nodes: int = SHARD_NODES, hub_rows: int = HUB_ROWS) -> DataFrame:
    """(key, depth, parent_<key>, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every distinct prefix of the rebuilt
    conversations; see rebuild for those. Prefixes compare by role and text; null role or text is empty.

    Turns of one number (null numbers come first) are ordered by the SHA-256 of role and text, so repeated rows are turns
    of their own in a defined order. Rows without a key take no part. An empty table gives no node. Other columns are not read.
    """
    spark = conversations.sparkSession
    shelf = Shelf(spark, "prefixtrie")
    turns, convs = rebuild(conversations, shelf, key, turn, role, text)
    convs = shelf.save(convs, "totals")
    all_ = convs.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).first()
    summed = running_total(terms(turns), [F.col("depth").asc()], "term", "upto", keys=["c"])
    mod = f"cast({PRIME} as {DIGEST})"
    paths = summed.select("c", "depth", "chars", "total", F.expr(f"cast(upto % {mod} as {DIGEST})").alias("node"), F.expr(f"cast((upto - term) % {mod} as {DIGEST})").alias("up"))
    paths = shelf.save(paths, "paths")
    shelf.drop("turns")
    nodes = paths.groupBy("depth", "node").agg(F.first("up").alias("up"), F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"),
                                               F.sum(F.col("total") - F.col("depth") + 1).alias("below"))
    nodes = shelf.save(nodes, "nodes")
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    nodes = shelf.save(nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    shelf.drop("nodes")

    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.coalesce("n_single", F.lit(0))).cast("long")
    shared = nodes.where("n_convs > 1").withColumns({"leaves": leaves, "saved": (F.col("n_convs") - 1) * F.col("chars")})
    hubs = shared.where(F.col("below") > hub_rows)
    names = hubs.select("depth", "node")
    hub_parents = hubs.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"))
    under = paths.where("depth = 1").select("c", "depth", "node").union(paths.join(hub_parents, ["depth", "up"], "left_semi").select("c", "depth", "node"))
    tops = under.join(names, ["depth", "node"], "left_anti").select(F.col("c").alias("owner"), F.col("depth").alias("top_depth"), F.col("node").alias("top"))
    low_nodes = shared.where(F.col("below") <= hub_rows)
    shards = -(-low_nodes.count() // shard_nodes)
    dealt = low_nodes.join(tops, "owner").withColumn("shard", F.pmod(F.xxhash64("top_depth", "top"), F.lit(max(shards, 1))).cast("int"))
    arrays = dealt.select("shard", "depth", high("node").alias("hi"), low("node").alias("lo"), high("up").alias("p_hi"), low("up").alias("p_lo"), "leaves", "saved")
    got = arrays.groupBy("shard").applyInPandas(accumulate, "depth long, hi long, lo long, leaves long, saved long")
    node = F.expr(f"cast(cast(hi as decimal(20,0)) * {HALF} + lo as {DIGEST})")
    sums = shelf.save(got.select("depth", node.alias("node"), "leaves", "saved"), "sums")
    if not hubs.isEmpty():
        hung = (dealt.where("depth = top_depth").select("depth", "node", F.col("up").alias("_up")).join(sums, ["depth", "node"])
                .groupBy((F.col("depth") - 1).alias("depth"), F.col("_up").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
        filled = hubs.join(hung, ["depth", "node"], "left").select("depth", "node", "up", "owner", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        sums = sums.union(of_hubs(shelf, filled))

    zero = F.lit(0).cast(DIGEST)
    ended = paths.where("depth = total").select("depth", "node", "c").union(convs.where("total = 0").select(F.lit(0).cast("long"), zero, "c"))
    digests = shelf.save(end_digests(ended), "ends")
    every = nodes.join(sums, ["depth", "node"], "left").withColumns({"leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("up"), F.col("owner").alias("parent"))
    deep = every.where("depth > 1").join(parents, ["depth", "up"]).select("depth", "node", "owner", "parent", "n_convs", "n_children", "leaves", "saved")
    upper = every.where("depth = 1").select("depth", "node", "owner", F.lit(all_["least"]).cast("long").alias("parent"), "n_convs", "n_children", "leaves", "saved")
    root = every.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where(F.lit(all_["n"] > 0))
    root = root.select(F.lit(0).cast("long").alias("depth"), zero.alias("node"), F.lit(all_["least"]).cast("long").alias("owner"), F.lit(None).cast("long").alias("parent"), F.lit(all_["n"]).cast("long").alias("n_convs"), "n_children",
                       F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    out = deep.union(upper).union(root).join(digests, ["depth", "node"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("owner").alias(key), "depth", F.col("parent").alias(f"parent_{key}"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                      F.coalesce("digest", F.lit(nothing)).alias("ends_sha256"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
lent AS (SELECT convs.c, t.pos AS depth, role, text FROM convs JOIN t ON t.c = convs.base AND t.pos <= h),
kept AS (SELECT convs.c, t.pos - h + (SELECT count(*) FROM lent WHERE lent.c = convs.c) AS depth, role, text FROM convs JOIN t ON t.c = convs.c AND t.pos > h),
turns AS (SELECT * FROM lent UNION ALL SELECT * FROM kept),
totals AS (SELECT convs.c, (SELECT count(*) FROM turns WHERE turns.c = convs.c) AS total FROM convs),
paths AS (SELECT c, depth, length(text) AS chars, to_json(list([role, text]) OVER (PARTITION BY c ORDER BY depth))::VARCHAR AS path,
    to_json(list([role, text]) OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::VARCHAR AS up FROM turns
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
nodes AS (SELECT path, depth, min(CASE WHEN depth = 1 THEN 'root' ELSE up END) AS up, min(c) AS owner, count(*) AS n, max(chars) AS chars,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = total), '') AS ends FROM paths JOIN totals USING (c) GROUP BY path, depth),
kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
marked AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.path),
below AS (SELECT path AS top, path, n, chars, n_children FROM marked),
pairs AS (SELECT DISTINCT a.path AS top, b.path FROM paths a JOIN paths b USING (c) WHERE a.depth <= b.depth),
sums AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS leaves, sum((n - 1) * chars) AS saved FROM pairs JOIN marked ON marked.path = pairs.path GROUP BY top)
SELECT m.owner AS conv_id, m.depth, p.owner AS parent_conv_id, m.n AS n_convs, m.n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN sums ON sums.top = m.path LEFT JOIN nodes p ON p.path = m.up"""
