"""Source divergence audit: how far each source's term shares lie from those of every other source of its language.

The counts of a language are a matrix of sources by terms that is mostly zero. It is dealt into tiles of SIDE x SIDE
sources (a block of sources with itself or with another block) by TILE_TERMS terms. In a tile a K-squared quadtree (K = 2)
lies over each square of terms: the bits of a level tell which quadrants hold a count. The trees of two sources are
walked jointly, level by level for all pairs of row blocks at once. Where both quadrants are all zero, every pair of their
rows pays the same price for each term, so only the number of terms is noted; what is left at the last level is priced
cell by cell. Terms that no source of a tile has are one more all-zero quadrant, priced from the vocabulary's size.

All numbers are whole: shares p = 1 + floor(10**9 * (count + 1) / (N + V)), prices floor((p - q)**2 / q). Squares stay below 2**63
as p is at most 1 + 10**9, and so do sums over any vocabulary of under 5 * 10**8 terms.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.functions.running import running_total
from bookdq.llm.common import Shelf, map_arrow, ship, slices

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lowered UTF-8: a run of letters and of anything beyond ASCII
UNIT = 1_000_000_000
LEAST_DOCS, MOST_TERMS = 3, 200
SIDE, TILE_TERMS = 64, 1 << 15
FRONTIER = 1 << 22
HELD = 400_000  # terms a task counts before it hands them on


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), partly counted: several rows of one term may come. A row without a term marks each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (l, s), (times, docs) in held.items():
                n = len(times)
                terms = pa.array([None, *map(bytes.decode, times)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([l] * (n + 1), pa.string()), pa.array([s] * (n + 1), pa.string()), terms,
                                                  pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, times)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in slices(batches, "_t"):
            for t, l, s in zip(*(batch.column(c).to_pylist() for c in ("_t", "_l", "_s"))):
                times, docs = held.setdefault((l, s), (Counter(), Counter()))
                terms = TERM.findall(t.encode(errors="replace").translate(LOWER))
                times.update(terms)
                docs.update(set(terms))
            if sum(len(t) for t, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "_t"), (lang, "_l"), (source, "_s"))])
    return map_arrow(rows, run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), in decimals so that no count overflows."""
    whole = ((count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(31,0)")
    return 1 + F.call_function("div", whole, F.nullif(total + terms, F.lit(0)).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Quadtree:
    """A square K-squared tree over each run of `side` columns of a matrix of whole numbers above 0; `occupied` tells its cells with
    a count. Rows are a power of two. Levels go from one quadrant a square to single cells."""

    def __init__(self, shares: np.ndarray, occupied: np.ndarray):
        side, columns = occupied.shape
        self.side, self.columns = side, columns
        packed = np.packbits(occupied, axis=0)
        order = np.lexsort(packed[::-1])  # columns with like patterns side by side: larger empty quadrants
        pad = -columns % side
        self.pad = pad
        self.shares = np.pad(shares[:, order], ((0, 0), (0, pad)), constant_values=1)
        self.levels = [np.pad(occupied[:, order], ((0, 0), (0, pad)))]
        while self.levels[0].shape[0] > 1:
            x = self.levels[0]
            self.levels.insert(0, x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).any(axis=(1, 3)))

    def pairs(self, begin: list[tuple[int, int]], level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(sums of prices over cells where a row of the pair has a count, numbers of columns where neither has one), as
        matrices over rows, for the pairs of row blocks `begin` of a level."""
        side, height = self.side, len(self.levels) - 1
        sums = np.zeros(side * side, dtype=np.int64)
        zeros = [np.zeros((1 << d, 1 << d), dtype=np.int64) for d in range(height + 1)]
        squares, some = (self.columns + self.pad) // side, max(1, FRONTIER // side ** 3)
        for first in range(0, squares, some):
            square = np.arange(first, min(first + some, squares))
            c = (square[:, None] << level) + np.arange(1 << level)
            a, b, c = (np.concatenate(x) for x in zip(*[(np.full(c.size, u), np.full(c.size, v), c.ravel()) for u, v in begin]))
            for d in range(level, height + 1):
                empty = ~(self.levels[d][a, c] | self.levels[d][b, c])
                np.add.at(zeros[d], (a[empty], b[empty]), side >> d)
                full = ~empty if d < height else ~empty & (a != b)
                a, b, c = a[full], b[full], c[full]
                if d < height:
                    a, b, c = ((2 * x[:, None] + np.array(s)).ravel() for x, s in ((a, [0, 0, 0, 0, 1, 1, 1, 1]), (b, [0, 0, 1, 1, 0, 0, 1, 1]), (c, [0, 1] * 4)))
            p, q = self.shares[a, c], self.shares[b, c]
            np.add.at(sums, a * side + b, (p - q) ** 2 // q)
        count = sum(np.repeat(np.repeat(z, side >> d, axis=0), side >> d, axis=1) for d, z in enumerate(zeros))
        return sums.reshape(side, side), count - self.pad


def price_tile(tile: pa.Table, block: int) -> pa.Table:
    """Rows (lang, i, j, at, term, p) of one tile of blocks of `block` sources, with a row without a term for each source, holding its share of terms it lacks.
    Gives (lang, a, b, value, seen) for its pairs of sources: the price of the tile's terms, and how many these are."""
    lang, i, j = (tile.column(c)[0].as_py() for c in ("lang", "i", "j"))
    at, p, term = tile.column("at").to_numpy(), tile.column("p").to_numpy(), tile.column("term").combine_chunks()
    header = term.is_null().to_numpy(zero_copy_only=False)
    side = block if i == j else 2 * block
    if i == j:
        side = 1 << max(0, int(at[header].max() - i * block)).bit_length()  # fewer sources, a smaller square
    row = at - i * block if i == j else np.where(at // block == i, at - i * block, at - j * block + block)
    words = term.filter(pa.array(~header)).dictionary_encode()
    columns = len(words.dictionary)
    own = np.ones(side, dtype=np.int64)
    own[row[header]] = p[header]
    occupied, shares = np.zeros((side, columns), dtype=bool), np.repeat(own[:, None], columns, axis=1)
    place = (row[~header], words.indices.to_numpy())
    occupied[place], shares[place] = True, p[~header]
    tree = Quadtree(shares, occupied)
    sums, empty = tree.pairs([(0, 0)]) if i == j else tree.pairs([(0, 1), (1, 0)], level=1)
    real = np.zeros(side, dtype=bool)
    real[row[header]] = True
    wanted = real[:, None] & real & ~np.eye(side, dtype=bool)
    if i != j:
        wanted &= (np.arange(side) < block)[:, None] != (np.arange(side) < block)
    a, b = np.nonzero(wanted)
    value = sums[a, b] + empty[a, b] * ((own[a] - own[b]) ** 2 // own[b])
    names = np.zeros(side, dtype=np.int64)
    names[row[header]] = at[header]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names[a], "b": names[b], "value": value, "seen": np.full(len(a), columns, dtype=np.int64)})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", side: int = SIDE, tile_terms: int = TILE_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: a source's divergence from each other source of its language over the
    language's kept terms (those in LEAST_DOCS of its documents or more). Part `term`: the MOST_TERMS terms a source has more
    often than its language, by their price.

    A null text, language or source is empty; a language or source '' is one like others. Repeated rows are documents of their own. A language without
    kept terms has pairs with value 0; an empty table gives no row. Ties go to the smaller item in UTF-8. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shelf = Shelf(spark, "divergence")
    cells = occurrences(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = shelf.save(cells, "cells")
    kept = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("lang", "term", "total")
    kept = shelf.save(kept, "kept")
    mine = shelf.save(cells.where("n > 0").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "mine")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_n"))
    sizes = mine.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = cells.where("term IS NULL").select("lang", "source", F.lit(1).cast("long").alias("one")).join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["terms", "lang_n", "group_n"])
    groups = running_total(groups, [F.col("source").asc()], "one", "at", keys=["lang"]).withColumn("at", F.col("at") - 1)
    groups = shelf.save(groups.withColumn("none", share(F.lit(0), F.col("group_n"), F.col("terms"))), "groups")
    shelf.drop("cells")

    placed = mine.join(groups, ["lang", "source"]).select("*", share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"))
    placed = shelf.save(placed.select("lang", "source", "at", "term", "p", "q", "terms"), "placed")
    shelf.drop("mine")
    above = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= MOST_TERMS)

    blocks = groups.groupBy("lang").agg(F.floor(F.max("at") / side).cast("int").alias("last")).withColumnRenamed("lang", "_l")  # a row a language
    columns = F.ceil(F.col("terms") / tile_terms).cast("int")
    column = F.pmod(F.xxhash64("term"), columns).cast("int")
    cells = placed.select("lang", "at", "term", "p", column.alias("column"))
    heads = groups.where("terms > 0").select("lang", "at", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("column"))
    block = F.floor(F.col("at") / side).cast("int")
    tiles = cells.union(heads).join(blocks, F.col("lang") == F.col("_l")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tiles = tiles.select("lang", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "column", "at", "term", "p")
    priced = tiles.groupBy("lang", "i", "j", "column").applyInArrow(lambda tile: price_tile(tile, side), "lang string, a long, b long, value long, seen long")
    priced = shelf.save(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")), "priced")
    left = groups.select("lang", "source", F.col("at").alias("a"), "terms", F.col("none").alias("none_a"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("none").alias("none_b"))
    every = left.join(right, "lang").where("a <> b").join(priced, ["lang", "a", "b"], "left")  # the result has all these pairs
    rest = F.col("terms") - F.coalesce("seen", F.lit(0))
    value = F.coalesce("value", F.lit(0)) + F.coalesce(rest * price(F.col("none_a"), F.col("none_b")), F.lit(0))
    pairs = every.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.union(terms)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
cells AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source),
grp AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l ON l.lang = g.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, term, 1 + ({UNIT}::HUGEINT * (total + 1)) // (n + v) AS q FROM kept k JOIN langs USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {MOST_TERMS}"""
