"""Source divergence, the prefix trie and exact top-k search against SQL and plain versions, on small and odd tables."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from bookdq.llm import balltree, divergence, prefixtrie

SF = "/root/testdata/sf0.001"


def by_sql(sql: str, name: str, rows: list[tuple], columns: dict[str, str]) -> Counter:
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in columns.items())})")
    if rows:
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", rows)
    return Counter(con.sql(sql).fetchall())


def counted(frame, columns: list[str]) -> Counter:
    return Counter(map(tuple, frame.select(*columns).collect()))


# ---- source divergence ---------------------------------------------------------------
DOCUMENTS = {"doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR", "source": "VARCHAR"}
OUT = ["lang", "source", "part", "item", "value", "rank"]


def odd_documents() -> list[tuple]:
    rng = random.Random(7)
    words = ["Red", "red", "blau", "où", "été", "日本", "x", "y2z", "a-b", "🎉k", "É"]
    rows = [(i, " ".join(rng.choice(words[:3 + i % 9]) for _ in range(rng.randrange(0, 25))), rng.choice(["en", "de"]), f"s{rng.randrange(7)}") for i in range(120)]
    rows += [(200, None, "en", "s1"), (201, "", None, None), (202, "Red red red", None, ""), (203, "red", "", None), (204, "red", "", "b"), (204, "red", "", "b")]
    rows += [(None, "12 34", "xx", "lonely"), (300, "rare words", "xx", "other"), (301, "w" * 30_000 + " red" * 5000, "en", "only")]
    return rows


@pytest.mark.parametrize(("side", "tile_terms"), [(divergence.SIDE, divergence.TILE_TERMS), (2, 4)])
def test_divergence_of_odd_documents(spark, side, tile_terms):
    """Nulls, languages without kept terms, repeated rows, long texts; with many small tiles as well. The clashing column names are ignored."""
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, at int")
    assert counted(divergence.audit(docs, side=side, tile_terms=tile_terms), OUT) == by_sql(divergence.ORACLE, "documents", rows, DOCUMENTS)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_terms_listed_by_rank(spark):
    """More terms above their language than are listed, with ties at the border."""
    names = [f"{a}{b}" for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"]
    rows = [(i, " ".join(names), "en", "full") for i in range(3)] + [(9, "zz " * 3000, "en", "other")] * 3
    got = divergence.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("source = 'full' AND part = 'term'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(names)[:200] and [r["rank"] for r in got] == list(range(1, 201))


def test_quadtree_is_the_full_sum():
    rng = np.random.default_rng(3)
    for side, columns in ((1, 5), (8, 3), (8, 61), (16, 200)):
        counts = rng.integers(0, 4, (side, columns)) * (rng.random((side, columns)) < 0.15)
        shares = np.where(counts > 0, 10 * counts + rng.integers(1, 5, counts.shape), np.arange(5, 5 + side)[:, None])
        sums, empty = divergence.Quadtree(shares, counts > 0).pairs([(0, 0)])
        for a in range(side):
            for b in range(side):
                both = (counts[a] == 0) & (counts[b] == 0)
                if a != b:
                    assert empty[a, b] == both.sum()
                    assert sums[a, b] == ((shares[a] - shares[b]) ** 2 // shares[b])[~both].sum()


# ---- prefix trie ---------------------------------------------------------------------
CONVERSATIONS = {"conv_id": "BIGINT", "turn": "BIGINT", "role": "VARCHAR", "text": "VARCHAR"}
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    out = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.append((ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()))
    return Counter(out)


def odd_conversations() -> list[tuple]:
    """Chains that extend one another, copies, early ends, missing bases, null and repeated turns, negative ids."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(205, 220), -3, -130, -107, 5_000_000_000]:
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b", "🎉", ""])) for t in range(rng.randrange(1, 9))]
    for c in range(300, 330):
        rows += [(c, t, "user", f"t{t}") for t in range(c - 298)]
    for c in range(400, 406):
        rows += [(c, t, "user", "same " * 40) for t in range(12)]
    rows += [(7, None, None, None), (7, None, None, None), (7, 2, "user", "a"), (None, 1, "user", "x"), (100, 0, None, "only"), (110, 0, "u", None)]
    return rows


@pytest.mark.parametrize(("shard_nodes", "hub_rows"), [(prefixtrie.SHARD_NODES, prefixtrie.HUB_ROWS), (4, 9)])
def test_trie_of_odd_conversations(spark, shard_nodes, hub_rows):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, 1, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, node string, c int")
    want = plain_trie(rows)
    assert counted(prefixtrie.trie(frame, shard_nodes=shard_nodes, hub_rows=hub_rows), NODE) == want
    assert by_sql(prefixtrie.ORACLE, "conversations", rows, CONVERSATIONS) == want


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.trie(spark.createDataFrame([], schema)).count() == 0
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lonely, 1, "user", "x" * 50_000)]
    got = counted(prefixtrie.trie(spark.createDataFrame(rows, schema)), NODE)
    assert got == plain_trie(rows) and [r[:5] for r in got] == [(lonely, 0, None, 1, 0)]


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 44, (3, 5000)), axis=1)
    table = prefixtrie.SlotTable(keys)
    assert sorted(table.find(keys)) == list(range(keys.shape[1]))
    assert (table.find(keys + np.array([[0], [1], [0]])) == -1).all()
    with pytest.raises(ValueError):
        prefixtrie.SlotTable(np.array([[1, 1], [2, 2]]))


def test_subtrees_of_a_deep_chain():
    n = 3000
    nodes = pd.DataFrame({"depth": np.arange(1, n + 1), "hi": 0, "lo": np.arange(1, n + 1), "p_hi": 0, "p_lo": np.arange(n), "leaves": [0] * (n - 1) + [1], "saved": 1})
    got = prefixtrie.accumulate(nodes).sort_values("depth")
    assert (got["leaves"] == 1).all() and got["saved"].tolist() == list(range(n, 0, -1))


# ---- exact top-k ---------------------------------------------------------------------
def plain_search(rows: list[tuple], every: int, k: int) -> Counter:
    vectors: dict = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(256 * x)) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(map(int.__mul__, v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return Counter(out)


def test_search_with_ties_and_odd_vectors(spark):
    """Equal vectors in great numbers, ties between different ones, nulls, other widths, empty vectors, repeated keys, large values."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(600)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(600, 900)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(900, 1300)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2050, [float("inf")] * 4), (None, [1.0] * 4), (2100, [0.0] * 4)]
    rows += [(2150, [2.0, 2.0]), (2151, [3.0, 1.0]), (2200, []), (2201, []), (0, [9.0] * 4), (0, [9.0] * 4), (2250, [1e6, -1e6, 1e6, 3.3]), (2251, [1e6, 1e6, -1e6, 0.1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, width int, shard int")
    got = balltree.search(frame, shard_cells=800, task_queries=4)
    assert counted(got, ["query_id", "rank", "vec_id", "score"]) == plain_search(rows, 50, 5)


def test_search_of_nothing_and_of_too_long(spark):
    schema = "vec_id long, embedding array<float>"
    assert balltree.search(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1e30, 1.0]), (1, [1.0, 1.0]), (50, [2.0, 2.0])]
    got = balltree.search(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 2 * 512 * 256)]


def test_branches_are_cut():
    """Clustered rows: most leaves are never visited, and the result is that of all products."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 8))
    rows = (centres[:, None] + rng.integers(-20, 20, (64, 64, 8))).reshape(-1, 8)
    ids = rng.permutation(len(rows))
    tree = balltree.BallTree(ids, rows, 6)
    visited = []
    leaves = tree.leaves
    tree.leaves = type("Watched", (), {"__getitem__": lambda s, i: (visited.append(i), leaves[i])[1], "__len__": lambda s: len(leaves)})()
    who, found, score = tree.search(rows[:1], ids[:1], np.array([balltree.NONE + 1]), 5)
    want = sorted((-int(s), int(i)) for s, i in zip(rows @ rows[0], ids) if i != ids[0])[:5]
    assert [(-int(s), int(i)) for s, i in zip(score, found)] == want and len(visited) // 2 < (len(leaves) - 1) / 4
