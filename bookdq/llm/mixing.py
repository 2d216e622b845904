"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in an order shuffled by a hash, gets a virtual finish time: the words of its source up to and
with it, divided by the source's target. All sources then share one queue, globally range-sorted by finish time and cut
where its words reach the budget: whatever the cut, each source is served in proportion to its target. A source whose
target exceeds its size queues again, newly shuffled, in a second and third epoch.

Only ids and sizes are sorted, never texts. Running totals are range-sorted partitions plus partition offsets
(functions.running), so one source with a third of the rows is spread like any other rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.functions.running import running_total
from bookdq.llm.common import Shelf, n_words, packed, unpacked
from bookdq.plans.sizing import broadcast_rows, collect_if_small

WEIGHTS, CAP = (5, 2, 1), 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size) rows. Sources by code point, null last, take the
    weights in turn; they share the total by weight, a target stops at `cap` times its source's size, and the excess is
    shared again by weight until none is above. One row a source, so the numbering window is over sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    per = Shelf(sizes.sparkSession, "sources").save(per.withColumn("weight", weight), "sources")
    limit, share, capped = F.col("source_size") * cap, None, -1
    while True:  # each turn stops one more source at least
        over = F.lit(False) if share is None else F.col("weight") * F.lit(share) > limit
        row = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(over, limit).otherwise(0)).alias("fixed"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
                      F.count_if(over).alias("capped")).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, share = row["capped"], (row["total"] - row["fixed"]) / row["open"]
    return per.select("source", "source_no", "source_size", F.least(F.col("weight") * F.lit(share or 0.0), limit.cast("double")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(row, key, size, source_size, target, taken, copies) of every row; `row` numbers the rows of docs.

    taken = copies * size: the words the mix takes of the document; no document is taken more than `cap` times. The
    budget is the words of all documents. Null and empty texts have size 0. Repeated rows queue each for itself. The
    same rows give the same mix, whatever the partitions; ties of the hash (rows with one key) go by a hash of the text; rows equal in both are the same document.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(source).alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    return _queue(shelf, shelf.save(plain, "rows"), weights, cap, seed).withColumnRenamed("id", key)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs, with its columns, as often as it is taken."""
    shelf = Shelf(docs.sparkSession, "mix")
    numbered = shelf.save(packed(docs, row=F.monotonically_increasing_id(), id=key, source=source, size=n_words(text), text_hash=F.xxhash64(text)), "numbered")
    rows = numbered.select("row", "id", "source", "size", "text_hash")
    taken = _queue(shelf, rows, weights, cap, seed).where("copies > 0").select("row", "copies")
    return unpacked(numbered.select("row", "all").join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def _queue(shelf: Shelf, rows: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    spark = rows.sparkSession
    targets = source_targets(rows, weights, cap)
    small = collect_if_small(targets)
    side = targets if small is None else broadcast_rows(spark, small, targets.schema)
    placed = shelf.save(rows.join(side, rows["source"].eqNullSafe(side["source"])).select("row", "id", "size", "text_hash", "source_no", "source_size", "target"), "placed")
    epochs = F.least(F.lit(cap), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    queued = placed.where("target > 0 and source_size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    shuffle = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("id").cast("string")).cast("binary"))
    queued = queued.select("row", "size", "text_hash", "source_no", "target", "epoch", shuffle.alias("shuffle"))
    order = [F.col("epoch"), F.col("shuffle"), F.col("text_hash"), F.col("row")]
    timed = running_total(queued, order, "size", "served", ["source_no"]).select("row", "size", "text_hash", "source_no", "epoch", (F.col("served") / F.col("target")).alias("finish"))
    line = running_total(timed, [F.col("finish"), F.col("source_no"), F.col("epoch"), F.col("text_hash"), F.col("row")], "size", "total")
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    taken = line.where(F.col("total") <= F.lit(budget)).groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    out = placed.join(taken, "row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("row", "id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = f"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM rows GROUP BY source),
weighted AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(source_no - 1) % {len(WEIGHTS)} + 1] AS weight FROM per),
stops AS (SELECT *, (sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM weighted),
level AS (SELECT coalesce(min_by(share, source_size::DOUBLE / weight) FILTER (weight * share <= {CAP} * source_size), 0) AS share FROM stops),
targets AS (SELECT source, source_no, source_size, least(weight * level.share, ({CAP} * source_size)::DOUBLE) AS target FROM weighted, level),
queued AS (SELECT r.doc_id, r.size, t.source_no, t.target, epoch, md5('{SEED}:' || epoch || ':' || r.doc_id) AS shuffle
           FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source, LATERAL unnest(generate_series(1, least({CAP}, ceil(t.target / t.source_size)::INT))) AS e(epoch)
           WHERE t.target > 0 AND t.source_size > 0),
timed AS (SELECT *, (sum(size) OVER (PARTITION BY source_no ORDER BY epoch, shuffle, doc_id ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM queued),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, source_no, epoch, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM timed),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM line WHERE total <= (SELECT sum(size) FROM rows) GROUP BY doc_id)
SELECT r.doc_id, r.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON r.doc_id = k.doc_id
"""
