"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

DataFrame functions and joins only. Links are given by a group column: documents of one group are linked with each other.
No pair is ever made: what a document needs to know of its neighbours is how many bytes of its group lie in each shard,
an aggregate with at most `shards` rows a group.

1. Linked documents are cut into shards by running bytes in hash order, so every shard begins with an even load.
2. A round: a group ranks its shards by the bytes it has there (equal parts: by a hash) and plans to fill the first of them,
   as many as its bytes need; the documents of its other shards are dealt over what is missing there by running bytes. In
   odd rounds a shard counts as holding its whole ceiling, in even rounds the group's part and what is free below the ceiling. The wanted bytes
   between shards, a shards x shards matrix, are turned into quotas that keep every load between a floor and a ceiling;
   documents move in hash order while the middle of their running bytes is within the quota of their pair of shards.
   Rounds end when one of each kind moves nothing.
3. Unlinked documents are ballast: by size classes, large ones first, they are cut at what each shard still lacks.

Running bytes of a round are windows over the documents of one group in one shard, or of one pair of shards: light rows, never more than a shard
holds, and no sort of all documents in each round. Those that may hold more (the first cut, ballast, slots) are running totals over sorted partitions.

So sizes end within half a percent and one small document of each other, as far as single documents allow, and a group that is
larger than a shard lies in as few shards as have room for it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookdq.functions.running import running_total
from bookdq.llm.common import Shelf
from bookdq.plans.sizing import broadcast_rows

SLACK = 0.005
CLASSES = (16_384, 2_048, 512)  # bytes at which a size class of ballast ends, largest first
Flow = dict[tuple[int, int], float]


def quotas(wanted: Flow, load: list[float], floor: float, ceiling: float) -> Flow:
    """The wanted flows, scaled down until every load stays within its limits (or where it was, if it was outside)."""
    flow = dict(wanted)
    n = range(len(load))
    high, low = [max(ceiling, x) for x in load], [min(floor, x) for x in load]
    for _ in range(500):
        inward = [sum(v for (_, b), v in flow.items() if b == s) for s in n]
        outward = [sum(v for (a, _), v in flow.items() if a == s) for s in n]
        worst = 0.0
        take, give = [1.0] * len(load), [1.0] * len(load)
        for s in n:
            after = load[s] + inward[s] - outward[s]
            if after > high[s] and inward[s] > 0:
                take[s] = max(0.0, 1 - (after - high[s]) / inward[s])
                worst = max(worst, (after - high[s]) / (high[s] or 1))
            elif after < low[s] and outward[s] > 0:
                give[s] = max(0.0, 1 - (low[s] - after) / outward[s])
                worst = max(worst, (low[s] - after) / (low[s] or 1))
        if worst < 1e-4:
            return flow
        flow = {(a, b): v * take[b] * give[a] for (a, b), v in flow.items()}
    return {(a, b): min(v, wanted.get((b, a), 0.0)) for (a, b), v in wanted.items()}  # swaps leave every load as it is


def cut_at(running: Column, ends: list[tuple[int, float]]) -> Column:
    """The first shard whose end is at or beyond the middle of a document; ends ascending."""
    out = F.lit(ends[-1][0])
    for shard, end in reversed(ends[:-1]):
        out = F.when(running <= end, F.lit(shard)).otherwise(out)
    return out


def loads(rows: DataFrame, shards: int) -> list[float]:
    got = {r["shard"]: r["b"] for r in rows.groupBy("shard").agg(F.sum("size").alias("b")).collect()}  # one row a shard
    return [float(got.get(s, 0)) for s in range(shards)]


def within(keys: list[str], *order: Column) -> Column:
    """The sum of sizes up to and with a document, in this order, among the rows with the same keys; a shard is one of the keys."""
    return F.sum("size").over(Window.partitionBy(*keys).orderBy(*order, "order", "row").rowsBetween(Window.unboundedPreceding, 0))


def plan(cells: DataFrame, load: list[float], ceiling: float, document: float, anywhere: bool) -> DataFrame:
    """cells: (grp, shard, b). (grp, shard, start, ends) of those that give documents away: where their running bytes begin on
    their group's line, and up to where on it which shard takes them (those that their bytes meet, in order).

    Shards are filled in the order of the group's bytes, so a document only goes where its group has no less than at its
    own place: every move adds to the sum of squares of the cells. Windows hold a group's cells, `shards` rows at most.
    """
    free = ceiling - F.element_at(F.array(*map(F.lit, load)), F.col("shard") + 1)
    room = F.greatest(F.lit(ceiling), "b") if anywhere else F.col("b") + F.when(free >= document, free).otherwise(F.lit(0.0))
    group = Window.partitionBy("grp")
    ranked = group.orderBy(F.col("b").desc(), F.xxhash64("grp", "shard").desc(), "shard")
    earlier, later = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(1, Window.unboundedFollowing)
    rows = cells.withColumn("room", room).withColumn("rest", F.sum("b").over(group) - F.coalesce(F.sum("room").over(earlier), F.lit(0.0)))
    rows = rows.withColumn("more", F.greatest(F.least("room", "rest"), F.lit(0.0)) - F.col("b"))
    need, give = F.greatest("more", F.lit(0.0)), F.greatest(-F.col("more"), F.lit(0.0))
    rows = rows.withColumn("need", need).withColumn("give", give).withColumn("start", F.coalesce(F.sum("give").over(later), F.lit(0.0)))
    rows = rows.withColumn("first", F.coalesce(F.sum("need").over(earlier), F.lit(0.0)))
    taker = F.struct((F.col("first") + F.col("need")).alias("end"), "first", "shard", F.col("b").alias("pull"))
    rows = rows.withColumn("ends", F.array_sort(F.collect_list(F.when(F.col("need") > 0, taker)).over(group))).where("give > 0")
    met = F.filter("ends", lambda e: (e["end"] > F.col("start")) & (e["first"] < F.col("start") + F.col("give")))
    return rows.select("grp", "shard", "start", met.alias("ends"))


def propagate(shelf: Shelf, linked: DataFrame, shards: int, average: float, spare: float) -> DataFrame:
    """linked: (row, id, grp, size, order). Returns it with `shard`. spare: bytes of ballast that can fill shards up."""
    total = linked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    run = running_total(linked, [F.col("order"), F.col("row")], "size", "_run")
    shard = F.least(F.floor((F.col("_run") - F.col("size") / 2) * shards / F.lit(max(1.0, float(total)))), F.lit(shards - 1)).cast("int")
    placed = shelf.save(run.select("row", "id", "grp", "size", "order", shard.alias("shard")), "round0")
    if spare > 0.05 * average * shards:  # whatever the linked loads, ballast fills each shard up to the average
        ceiling, floor = average * (1 - SLACK), 0.0
    else:
        ceiling, floor = average * (1 + SLACK), max(0.0, average * (1 - SLACK) - spare / shards)
    document = total / max(1, placed.count())
    spark = placed.sparkSession
    number, idle, kept = 0, 0, "round0"
    while idle < 2:  # until a round of each kind moves nothing: every move adds to a bounded sum, so that comes
        number += 1
        load = loads(placed, shards)
        givers = plan(placed.groupBy("grp", "shard").agg(F.sum("size").alias("b")), load, ceiling, document, anywhere=number % 2 == 1)
        line = placed.join(givers, ["grp", "shard"]).withColumn("_run", within(["grp", "shard"]))
        middle = F.col("start") + F.col("_run") - F.col("size") / 2
        taker = F.get(F.filter("ends", lambda e: e["end"] >= middle), F.lit(0))
        willing = line.select("row", "size", "order", "shard", taker["shard"].alias("to"), taker["pull"].alias("pull")).where("to is not null")
        willing = shelf.save(willing, f"willing{number}")
        wanted = {(r["shard"], r["to"]): float(r["b"]) for r in willing.groupBy("shard", "to").agg(F.sum("size").alias("b")).collect()}  # shards x shards rows at most
        flow = {k: v for k, v in quotas(wanted, load, floor, ceiling).items() if v > 0}
        idle += 1
        if flow:
            quota = broadcast_rows(spark, [(a, b, v) for (a, b), v in flow.items()], spark.createDataFrame([], "shard int, to int, quota double").schema)
            run = willing.join(quota, ["shard", "to"]).withColumn("_run", within(["shard", "to"], F.col("pull").desc()))
            moved = shelf.save(run.where(F.col("_run") - F.col("size") / 2 <= F.col("quota")).select("row", F.col("to").alias("_to")), f"moved{number}")
            if not moved.isEmpty():
                placed = shelf.save(placed.join(moved, "row", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to"), f"round{number}")
                shelf.drop(kept)
                idle, kept = 0, f"round{number}"
            shelf.drop(f"moved{number}")
        shelf.drop(f"willing{number}")
    return placed


def fill(shelf: Shelf, ballast: DataFrame, load: list[float], average: float) -> DataFrame:
    """ballast (row, id, size, order) with `shard`: each size class is cut by what the shards lack for the average."""
    load = list(load)
    number = F.lit(len(CLASSES) + 1)
    for i, least in reversed(list(enumerate(CLASSES, 1))):
        number = F.when(F.col("size") >= least, F.lit(i)).otherwise(number)
    run = running_total(ballast.withColumn("class", number), [F.col("order"), F.col("row")], "size", "_run", ["class"])
    run = shelf.save(run.select("row", "id", "size", "class", (F.col("_run") - F.col("size") / 2).alias("middle")), "ballast")
    totals = {r["class"]: float(r["b"]) for r in run.groupBy("class").agg(F.sum("size").alias("b")).collect()}  # one row a class
    shard = F.lit(0)
    for i in sorted(totals):
        lack = [max(0.0, average - x) for x in load]
        share = [x * totals[i] / sum(lack) for x in lack] if sum(lack) else [totals[i] / len(load)] * len(load)
        ends, end = [], 0.0
        for s, x in enumerate(share):
            if x > 0:
                end += x
                ends.append((s, end))
        cut = cut_at(F.col("middle"), ends)
        shard = F.when(F.col("class") == i, cut).otherwise(shard)
        if i != max(totals):
            load = [a + b for a, b in zip(load, loads(run.where(F.col("class") == i).withColumn("shard", cut), len(load)))]
    return run.select("row", "id", "size", shard.cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, linked) of every row. law is `bytes`.

    size: UTF-8 bytes of the text and 16. Linked are documents with equal texts (an empty text is a text); a null text
    counts as none: size 16, checksum of nothing, no links. slot numbers a shard's rows from 0 in order of key (nulls
    first), then row. Repeated rows are documents of their own, linked with each other.
    """
    shelf = Shelf(docs.sparkSession, "shards")
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    digest = F.when(F.col(text).isNotNull(), F.sha2(F.col(text).cast("binary"), 256))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 16).alias("size"),
                       F.crc32(raw).alias("crc"), digest.alias("grp"))
    rows = shelf.save(rows.withColumn("order", F.xxhash64("id", "crc")), "rows")
    bytes_, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = rows.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    marked = shelf.save(rows.join(groups.withColumn("linked", F.lit(True)), "grp", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "marked")
    linked, ballast = marked.where("linked"), marked.where("not linked")
    average = float(bytes_) / shards
    spare = float(ballast.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"])
    placed = propagate(shelf, linked.select("row", "id", "grp", "size", "order"), shards, average, spare)
    ballast = fill(shelf, ballast.select("row", "id", "size", "order"), loads(placed, shards), average)
    every = placed.select("row", "id", "shard").union(ballast.select("row", "id", "shard"))
    slots = running_total(every.withColumn("_one", F.lit(1).cast("long")), [F.col("id").asc_nulls_first(), F.col("row")], "_one", "_n", ["shard"])
    out = marked.join(slots.select("row", "shard", (F.col("_n") - 1).alias("slot")), "row")
    return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked", "grp")


def cut(assigned: DataFrame) -> DataFrame:
    """(links, whole): a report of how many linked documents lie in another shard than most of their group's bytes."""
    cells = assigned.where("linked").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("grp").agg(F.max("n").alias("whole"), F.sum("n").alias("links")).agg(F.sum("links").alias("linked"), F.sum("whole").alias("together"))
