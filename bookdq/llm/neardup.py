"""Near duplicates by circulant MinHash, banding and exact Jaccard.

Two permutations make the whole signature: the first sends a shingle to one of 2**20 places (a 64-bit mix of its hash),
the second is a fixed permutation of the places, and coordinate k uses it shifted by k places. So the 512 values of a
shingle lie side by side in one table, and a signature is the minimum of as many slices of it.

32 bands of 4 coordinates: two sets with a Jaccard of 0.8 share no band with a probability of 5e-8. One bit of each of
the 512 coordinates is a sketch: the share of differing bits estimates (1 - Jaccard) / 2. Candidates are confirmed on the full sets.
What makes it hold at scale:

* Texts with equal sets are one class; everything below runs on one representative a class. Bands, attributes and sets are tables apart.
* A bucket never emits all its pairs. First each member is compared with one pivot only, that of its largest bucket (the pivot of a bucket is the
  member that shares buckets with most others): a group of copies falls into one component by as many comparisons as it has members.
  Then, in buckets over several components, the members outside their pivot's component are compared with it. What is left are texts that
  share a bucket over several components, mostly texts with a common passage.
  They are bucketed anew, by prefix: of two sets with a Jaccard of 0.8, the n - 0.8 n + 1 rarest elements of each (in
  one order for all sets) have one in common for sure, and a passage that many texts share is not rare.
* Two sets that have been compared with the same pivot have a bound for what they share. Pairs below it are left out.
* In these buckets only members outside the largest component become pivots (8 a bucket, then four times as many each
  round) and are compared with the members of other components. A bucket that is one component or whose minor members were all
  pivots is left out from then on: no link between two components can be left in it. It ends when no bucket is left.
* A pair of texts meets in many prefix buckets. It is taken in the first only, as far as that is seen from the few tokens that each row has before
  its own: a token in both means that the pair meets there as well.
* Before the exact step, pairs are dropped on what rules out a link for sure: set sizes, and a bitmap of each set (its elements in 1,024 places: a place that
  only one of two sets holds is an element that only this set has; mostly enough below 0.75). And on the sketch, which a pair with a Jaccard of 0.8 fails with
  a probability below 1e-9 (a pair at 0.6 mostly does; it still tells apart sets that fill their bitmaps).
* Components are contracted by joins: every component hooks to its smallest neighbour, paths are halved, repeat.
* Texts and sets are wide: before a join moves them, a bit filter of fixed size drops most of those that the join would.
* Tables are dropped as soon as no later step reads them.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.common import Shelf, likely_among, map_arrow, packed, slices, unpacked

COORDINATES, BANDED, ROWS = 512, 128, 4
PLACES = 1 << 20
RARITY = 1 << 18
SKETCH = [f"s{i}" for i in range(COORDINATES // 64)]
PLACED = 1024
BITS = [f"p{i}" for i in range(PLACED // 64)]
BEFORE = 3  # tokens before its own that a row of a prefix bucket has
SKETCH_APART = 97  # differing bits of the 512 beyond which a pair is no candidate
FIRST_PIVOTS, MORE_PIVOTS = 8, 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@lru_cache(maxsize=1)
def circulant(seed: int = 11) -> np.ndarray:
    """Row p: the second permutation's values of place p under all shifts (a view of one table)."""
    table = np.random.default_rng(seed).permutation(PLACES).astype(np.int32)
    return sliding_window_view(np.concatenate([table, table[:COORDINATES]]), COORDINATES)


class Shingles:
    """The set of a text: sorted different 64-bit hashes of its `width`-word shingles; of the whole sequence if it has
    fewer words; nothing without words. Remembers word hashes (a bounded memory)."""

    def __init__(self, width: int, limit: int = 500_000):
        self.width, self.limit, self.known = width, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode(errors="surrogatepass").translate(LOWER).split()  # bytes: ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        s = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            s = (s ^ h[i:i + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(s ^ s >> np.uint64(32))


def signature(s: np.ndarray) -> np.ndarray:
    best, rows = np.full(COORDINATES, PLACES, dtype=np.int32), circulant()
    for k in range(0, len(s), 1024):
        best = np.minimum(best, rows[(s[k:k + 1024] >> np.uint64(44)).astype(np.int64)].min(axis=0))
    return best


def bands(sig: np.ndarray, rows: int = ROWS) -> list[int]:
    raw = sig[:BANDED].astype("<i4").tobytes()
    return [xxhash.xxh3_64_intdigest(raw[i:i + 4 * rows], seed=i) - (1 << 63) for i in range(0, len(raw), 4 * rows)]


def sketch(sig: np.ndarray) -> list[int]:
    bits = np.packbits((sig * np.int32(-1640531527) >> 31 & 1).astype(np.uint8))
    return np.frombuffer(bits.tobytes(), "<i8").tolist()


def bitmap(s: np.ndarray) -> np.ndarray:
    held = np.zeros(PLACED, dtype=bool)
    held[s & (PLACED - 1)] = True
    return np.packbits(held).view("<i8")


def describe(docs: DataFrame, width: int) -> DataFrame:
    """(id, v, n, h1, h2, the sketch, bands) of rows (_k, _v, _t): size and 128-bit hash of the set; v is handed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in slices(batches, "_t"):
            rows = []
            for text in batch.column("_t").to_pylist():
                s = shingles(text)
                d = xxhash.xxh3_128_digest(s.tobytes())
                sig = signature(s) if len(s) else None
                rows.append((len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                             *(sketch(sig) if len(s) else [0] * len(SKETCH)), bands(sig) if len(s) else []))
            *numbers, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_v"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(b, pa.list_(pa.int64()))],
                                             names=["id", "v", "n", "h1", "h2", *SKETCH, "bands"])

    return map_arrow(docs, run, "id long, v long, n long, h1 long, h2 long, " + ", ".join(f"{c} long" for c in SKETCH) + ", bands array<long>")


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().to_pylist()]).tolist()
    return [flat[a:b].view(np.uint64) for a, b in zip(ends, ends[1:])]


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(rep, shingles, the bitmap) of rows (rep, _t, h1, h2) whose text has the set with that hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in slices(batches, "_t"):
            keep, found = [], []
            for t, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("_t", "h1", "h2"))):
                s = shingles(t)
                d = xxhash.xxh3_128_digest(s.tobytes())
                keep.append((h1, h2) == (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                if keep[-1]:
                    found.append(s.view(np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate([*found, np.empty(0, np.int64)]))
            placed = np.stack([np.empty(len(BITS), np.int64), *map(bitmap, found)])[1:]
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(pa.array(keep, pa.bool_())), lists, *(pa.array(np.ascontiguousarray(c)) for c in placed.T)], names=["rep", "shingles", *BITS])

    return map_arrow(texts, run, "rep long, shingles array<long>, " + ", ".join(f"{c} long" for c in BITS))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(band, rep, before): the rarest elements of each set, as many as a linked set must meet, and of each the BEFORE that
    precede it. Rarity is counted over these sets in RARITY hashed cells, a table of fixed size; ties and cells in common are ordered by hash."""
    spark = sets.sparkSession
    seen = np.zeros(RARITY, dtype=np.int64)
    for r in sets.select(F.explode("shingles").alias("x")).groupBy(F.pmod("x", F.lit(RARITY)).alias("cell")).count().toLocalIterator():
        seen[r["cell"]] = r["count"]
    sent = spark.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tokens, before, ends = [], [], [], []
            for i, s in enumerate(arrays(batch.column("shingles"))):
                x = s.view(np.int64)
                some = x[np.lexsort((x, sent.value[np.mod(x, RARITY)]))][:len(x) - -(-percent * len(x) // 100) + 1]
                tokens.append(some)
                rows.append(np.full(len(some), i))
                place = np.arange(len(some))[:, None] - np.arange(1, BEFORE + 1)
                before.append(some[place[place >= 0]])
                ends.append((place >= 0).sum(axis=1))
            last = np.cumsum(np.concatenate([[0], *ends])).astype(np.int32)
            preceding = pa.ListArray.from_arrays(last, np.concatenate([*before, np.empty(0, np.int64)]))
            at = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*tokens, np.empty(0, np.int64)])), batch.column("rep").take(at), preceding], names=["band", "rep", "before"])

    return map_arrow(sets, run, "band long, rep long, before array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, linked) of pairs: size of the intersection of their full sets, and whether 100 times it reaches
    percent times the union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, linked = [], []
            for x, y in zip(arrays(batch.column("x")), arrays(batch.column("y"))):
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common.append(int((both[1:] == both[:-1]).sum()))
                linked.append(100 * common[-1] >= percent * (len(x) + len(y) - common[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "common", "linked"])

    def met(end: str, named: str) -> DataFrame:
        return likely_among(sets, "rep", pairs, end).select(F.col("rep").alias(end), F.col("shingles").alias(named))

    filled = pairs.join(met("b", "y"), "b").join(met("a", "x"), "a")
    return map_arrow(filled.select("a", "b", "x", "y"), run, "a long, b long, common long, linked boolean")


def contract(shelf: Shelf, labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(rep, comp) after the edges: components that an edge joins get their smallest label. Only the table of the result stays."""
    step, passing = 0, [f"{name}-links0"]
    left = labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    links = edges.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v")).distinct()
    links = shelf.save(links, f"{name}-links0")
    while not links.isEmpty():
        both = links.select(F.col("v").alias("c"), F.col("u").alias("to")).union(links.select(F.col("u").alias("c"), F.col("u").alias("to")))
        up = shelf.save(both.groupBy("c").agg(F.min("to").alias("to")), f"{name}-up{step}")
        for _ in range(2):
            jump = up.select(F.col("c").alias("to"), F.col("to").alias("further"))
            up = up.join(jump, "to", "left").select("c", F.coalesce("further", "to").alias("to"))
        up = shelf.save(up, f"{name}-root{step}")
        labels = shelf.save(labels.join(up.withColumnRenamed("c", "comp"), "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), f"{name}-labels{step}")
        for end in ("u", "v"):
            links = links.join(up.select(F.col("c").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        passing += [f"{name}-up{step}", f"{name}-root{step}", f"{name}-links{step + 1}", *([f"{name}-labels{step - 1}"] if step else [])]
        step += 1
        links = shelf.save(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-links{step}")
    for table in passing:
        shelf.drop(table)
    return labels


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key long, n_shingles, component_id, kept) of every row.

    component_id: the smallest key reachable over links; kept: the row's key is that. Null and empty texts have no
    shingle, link with nothing and are kept. A null key takes no part: component_id is null and the row is kept.
    Rows with one key and one text are the same document, so both are kept or neither. Rows with one key and different texts are documents of
    their own: each has its text's component, and what links one of them does not link the other. An empty table gives no row. Other columns are not read.
    """
    return classified(docs, key, text, width, percent).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    gone = classified(docs, key, text, width, percent).where(~F.col("kept")).select("id", "v").distinct()
    rows = packed(docs, k=F.col(key).cast("long"), h=F.xxhash64(text))
    return unpacked(rows.join(gone, (F.col("k") == F.col("id")) & (F.col("h") == F.col("v")), "left_anti"), docs)


def classified(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(id, v = hash of the text, n, component, kept) of every row; see components."""
    shelf = Shelf(docs.sparkSession, "neardup")
    plain = docs.select(F.col(key).cast("long").alias("_k"), F.xxhash64(text).alias("_v"), F.col(text).alias("_t"))
    described = shelf.save(describe(plain, width), "described")
    rows = shelf.save(described.select("id", "v", "n", "h1", "h2"), "rows")
    same = described.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("least"), *[F.first(c).alias(c) for c in ("n", *SKETCH, "bands")])  # of equal sets all these are equal
    same = same.withColumn("of", F.col("least.v")).withColumn("least", F.col("least.id"))
    whole = shelf.save(same.withColumn("rep", F.monotonically_increasing_id()), "whole")
    classes = shelf.save(whole.drop("bands"), "classes")
    shelf.drop("described")
    banded = whole.select(F.explode("bands").alias("band"), "rep")
    shared = shelf.save(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band", "size"), "shared")
    members = shelf.save(banded.join(shared, "band"), "buckets")
    shelf.drop("whole")
    shelf.drop("shared")
    met = members.groupBy("rep").agg(F.sum("size").alias("met"))
    wanted = shelf.save(classes.join(met, "rep"), "wanted")
    # texts move only once, and hardly others than those wanted; repeated rows are made one where the join has brought them together
    texts = likely_among(plain, "_k", wanted, "least").join(wanted.select("rep", "least", "of", "h1", "h2"), (F.col("_k") == F.col("least")) & (F.col("_v") == F.col("of")))
    texts = texts.groupBy("_k", "_v").agg(*[F.first(c).alias(c) for c in ("rep", "_t", "h1", "h2")])
    sets = shelf.save(full_sets(texts.drop("_k", "_v"), width), "sets")
    facts = shelf.save(wanted.select("rep", "n", *SKETCH).join(sets.select("rep", *BITS), "rep"), "facts")
    # the pivot of a bucket is its member that shares buckets with most others: the least edited of a group of copies
    top = members.join(wanted.select("rep", "met"), "rep").groupBy("band").agg(F.max(F.struct("met", (-F.col("rep")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("pivot"))
    members = shelf.save(members.join(top, "band"), "members1")
    shelf.drop("buckets")
    labels = sets.select("rep", F.col("rep").alias("comp"))

    def likely(a: str, b: str):
        size = (100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n"))
        apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{a}.{SKETCH[0]}").bitwiseXOR(F.col(f"{b}.{SKETCH[0]}"))))
        shared = F.least(*[F.col(f"{x}.n") - sum((F.bit_count(F.col(f"{x}.{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{c}")))) for c in BITS), F.lit(0)) for x, y in ((a, b), (b, a))])
        return size & (apart <= SKETCH_APART) & ((100 + percent) * shared >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n")))

    def possible(a: str, b: str):
        """False where two sets that were compared with one pivot cannot be linked: they share at most the smaller of what
        they have in common with it, and the smaller of what they have besides."""
        most = F.least(f"{a}.i", f"{b}.i") + F.least(F.expr(f"{a}.n - {a}.i"), F.expr(f"{b}.n - {b}.i"))
        reach = 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)
        return ~F.col(f"{a}.ref").eqNullSafe(F.col(f"{b}.ref")) | F.col(f"{a}.ref").isNull() | reach

    def with_facts(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are likely."""
        side = {x: facts.select(F.col("rep").alias(x), F.struct("n", *SKETCH, *BITS).alias(f"f{x}")) for x in ("a", "b")}
        return pairs.join(side["a"], "a").join(side["b"], "b").where(likely("fa", "fb")).select("a", "b")

    def ordered(a: str, b: str):
        return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")

    def spread(name: str):
        """Members of buckets over several components, with their component and the bucket's largest."""
        placed = shelf.save(members.join(labels, "rep"), f"{name}-placed")
        sizes = placed.select("band", "comp").repartition("band").groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size"))  # moved once for both counts
        split = sizes.groupBy("band").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        found = shelf.save(placed.join(split.select("band", F.col("top.comp").alias("main")), "band"), name)
        shelf.drop(f"{name}-placed")
        return found

    # each member with the pivot of its largest bucket; then the members that are still outside their pivot's component
    first = members.where("rep <> pivot").groupBy("rep").agg(F.max(F.struct("size", "pivot")).alias("best")).select(*ordered("best.pivot", "rep")).distinct()
    tested = shelf.save(with_facts(first), "pairs0")
    met = shelf.save(compared(tested, sets, percent), "compared0")
    labels = contract(shelf, labels, met.where("linked").select("a", "b"), "round0")
    of_pivot = labels.select(F.col("rep").alias("pivot"), F.col("comp").alias("pivot_comp"))
    outside = members.join(labels, "rep").join(of_pivot, "pivot").where("comp <> pivot_comp").select(*ordered("pivot", "rep")).distinct()
    pairs = shelf.save(with_facts(outside.join(tested, ["a", "b"], "left_anti")), "pairs1")
    tested = tested.union(pairs)
    met = met.union(shelf.save(compared(pairs, sets, percent), "compared1"))
    labels = contract(shelf, labels, met.where("linked").select("a", "b"), "round1")
    # what is known of each representative: of the sets it was compared with, the one with most comparisons, and what they share
    ends = met.select("a", "b", "common").union(met.select("b", "a", "common"))
    weight = ends.groupBy("a").agg(F.count(F.lit(1)).alias("w"))
    itself = facts.join(weight, F.col("rep") == F.col("a"), "left_semi").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("n").alias("common"))
    known = ends.union(itself).join(weight, "a").groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("w", "a", "common")).alias("k")).select("rep", F.col("k.a").alias("ref"), F.col("k.common").alias("i"))
    known = shelf.save(facts.join(known, "rep", "left"), "known")
    unsure = likely_among(sets.select("rep", "shingles"), "rep", spread("unsure"), "rep")  # a set too many only meets others once more
    tokens = shelf.save(prefixes(unsure, percent), "tokens")
    for name in ("unsure", "members1", "compared0", "compared1"):
        shelf.drop(name)
    again = tokens.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band")
    members = shelf.save(tokens.join(again, "band"), "left1")
    shelf.drop("tokens")
    done, most, number = None, FIRST_PIVOTS, 2
    while True:
        open_ = spread(f"open{number}")
        minor = open_.where("comp <> main")
        if done is not None:
            minor = minor.join(done, ["band", "rep"], "left_anti")
        ranked = minor.withColumn("_n", F.row_number().over(Window.partitionBy("band").orderBy("rep"))).where(F.col("_n") <= most + 1)
        ranked = shelf.save(ranked, f"pivots{number}")
        pivots, unfinished = ranked.where(F.col("_n") <= most).drop("_n"), ranked.where(F.col("_n") > most).select("band")
        if pivots.isEmpty():
            break
        done = pivots.select("band", "rep") if done is None else done.union(pivots.select("band", "rep"))
        # sketches and bitmaps are joined late, and only in buckets that have a pivot in this round
        active = open_.join(pivots.select("band").distinct(), "band", "left_semi")
        fresh = (pivots.join(known, "rep").alias("p").join(active.join(known, "rep").alias("m"), "band").where((F.col("p.comp") != F.col("m.comp")) & ~F.arrays_overlap("p.before", "m.before") & likely("p", "m") & possible("p", "m"))
                 .select(*ordered("p.rep", "m.rep")).distinct())
        pairs = shelf.save(fresh.join(tested, ["a", "b"], "left_anti"), f"pairs{number}")
        tested = tested.union(pairs)
        met = shelf.save(compared(pairs, sets, percent), f"compared{number}")
        labels = contract(shelf, labels, met.where("linked").select("a", "b"), f"round{number}")
        # the other buckets are done for good: components only grow, so of two members that are apart later one was minor now, hence a pivot
        if unfinished.isEmpty():
            break
        members = shelf.save(active.select("band", "rep", "before").join(unfinished, "band"), f"left{number}")
        for name in (f"open{number}", f"compared{number}", f"left{number - 1}"):
            shelf.drop(name)
        most, number = most * MORE_PIVOTS, number + 1

    labels = shelf.save(labels, "labels")  # the only tables the result reads: rows, classes and this one
    for name in ("sets", "wanted", "facts", "known", f"open{number}", f"compared{number}", f"left{number - 1}", *[f"{kind}{i}" for kind in ("pairs", "pivots") for i in range(number + 1)], *[f"round{i}-labels{j}" for i in range(number) for j in range(40)]):
        shelf.drop(name)
    placed = classes.select("rep", "h1", "h2", "least").join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component"))
    of_class = placed.join(smallest, "comp").select("h1", "h2", "component")
    out = rows.join(of_class, ["h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select("id", "v", "n", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
