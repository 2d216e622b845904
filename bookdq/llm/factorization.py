"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i = 1 for each different term of a text. The
factors v let two terms that are harmless alone (an insult's homonym, the name of a group) count when they meet, which
added weights cannot express. Terms are hashed to 2**BITS places, so the model has a fixed size and is sent to the
executors whole (w and v: (1 + FACTORS) x 2**BITS numbers at most; places without weight are not sent).

Fitting: the labelled rows in the order of a hash of their id, `max_rows` at most; their hashed terms (not their texts)
come to the driver, where mini-batches of AdaGrad run in numpy from a fixed seed. Everything else covers all rows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bookdq.llm.common import Shelf, map_arrow, packed, slices, unpacked

BITS, FACTORS = 18, 8
MAX_ROWS = 20_000  # labelled rows that the model is fitted on, at most
BEGINNINGS = (4, 5, 6)
TERM = re.compile(r"[^\W\d_]+")
TOXIC = 0.7
LEAST_CHI, MOST_PLACES = 12.0, 1 << 14


class Terms:
    """Places of the different terms of a text: its words in lower case, and their first letters, so that endings and
    compounds of a stem meet. Remembers the places of words it has seen (a bounded memory)."""

    def __init__(self, bits: int = BITS, limit: int = 500_000):
        self.bits, self.limit, self.place = bits, limit, {}

    def __call__(self, text: str) -> np.ndarray:
        place = self.place
        if len(place) > self.limit:
            place.clear()
        words = set(TERM.findall(text.lower()))
        for w in [w for w in words if w not in place]:
            place[w] = [xxhash.xxh32_intdigest(t) >> 32 - self.bits for t in {w, *("^" + w[:n] for n in BEGINNINGS if len(w) > n)}]
        return np.unique(np.fromiter(chain.from_iterable(map(place.__getitem__, words)), np.int32))


@dataclass
class Machine:
    """A fitted model: places (sorted) with their weights and factors; other places have none."""
    bias: float
    places: np.ndarray
    weight: np.ndarray
    factor: np.ndarray
    bits: int = BITS
    _row: np.ndarray | None = field(default=None, repr=False)

    def score(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        if self._row is None:
            self._row = np.full(1 << self.bits, -1, dtype=np.int32)
            self._row[self.places] = np.arange(len(self.places))
        known = [(at := self._row[r])[at >= 0] for r in rows]
        size = np.array([len(k) for k in known], dtype=np.int64)
        at = np.concatenate([*known, np.empty(0, np.int32)])
        doc = np.repeat(np.arange(len(rows)), size)
        linear = np.bincount(doc, self.weight[at], minlength=len(rows))
        pairs = np.zeros(len(rows))
        for f in range(self.factor.shape[1]):
            v = self.factor[at, f]
            pairs += np.bincount(doc, v, minlength=len(rows)) ** 2 - np.bincount(doc, v * v, minlength=len(rows))
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def chi_squared(with_1, seen, ones: float, n: float):
    """Of a term that `seen` of n rows have, `with_1` of them labelled 1, of `ones` such rows in all. Arrays or columns."""
    return n * (with_1 * n - seen * ones) * (with_1 * n - seen * ones) / (seen * (n + 1e-6 - seen) * (ones * (n - ones) + 1e-6))


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 20, rate: float = 0.3,
        shrink: float = 1e-3, least: float = LEAST_CHI, most: int = MOST_PLACES, batch: int = 128, seed: int = 7) -> Machine:
    """Logistic loss, both classes weighted alike. Places take part if their chi-squared statistic against the label is
    `least` or more, the `most` strongest of them, so that chance words of a long text carry no weight. Without rows,
    or with rows of one class, the model is a constant: the share of that class, pulled towards a half."""
    labels = np.asarray(labels, dtype=np.float64)
    n, ones = len(rows), float(labels.sum())
    if not 0 < ones < n:
        share = (ones + 0.5) / (n + 1)
        return Machine(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), bits)
    with_1 = np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y]), minlength=1 << bits).astype(float)
    seen = np.bincount(np.concatenate(rows), minlength=1 << bits).astype(float)
    chi = chi_squared(with_1, np.maximum(seen, 1e-9), ones, float(n))
    chi[seen < 3] = 0
    strongest = np.argsort(-chi, kind="stable")[:most]
    places = np.sort(strongest[chi[strongest] >= least])
    row_of = np.full(1 << bits, -1, dtype=np.int64)
    row_of[places] = np.arange(len(places))
    rows = [(at := row_of[r])[at >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(places)), rng.normal(0, 0.01, (len(places), factors)), -1.0
    gw, gv, gb = np.full(len(places), 1e-2), np.full((len(places), factors), 1e-2), 1e-2
    cost = np.where(labels > 0, n / (2 * ones), n / (2 * (n - ones)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            some = order[k:k + batch]
            at = np.concatenate([rows[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
            mine, place = np.unique(at, return_inverse=True)
            va = v[at]
            total = np.stack([np.bincount(doc, va[:, f], minlength=len(some)) for f in range(factors)], axis=1)
            own = np.stack([np.bincount(doc, va[:, f] ** 2, minlength=len(some)) for f in range(factors)], axis=1)
            z = b + np.bincount(doc, w[at], minlength=len(some)) + ((total ** 2 - own).sum(axis=1)) / 2
            error = cost[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some])
            d = error[doc]
            step = np.bincount(place, d, minlength=len(mine)) / len(some) + shrink * np.sign(w[mine])
            gw[mine] += step ** 2
            w[mine] -= rate * step / np.sqrt(gw[mine])
            rest = total[doc] - va
            pull = np.stack([np.bincount(place, d * rest[:, f], minlength=len(mine)) for f in range(factors)], axis=1) / len(some) + shrink * v[mine]
            gv[mine] += pull ** 2
            v[mine] -= rate / 2 * pull / np.sqrt(gv[mine])
            gb += error.mean() ** 2
            b -= rate * error.mean() / np.sqrt(gb)
    return Machine(float(b), places, w, v, bits)


def held_out(key: str = "doc_id") -> Column:
    """The rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def term_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches, "_t"):
            rows = [terms(t or "") for t in batch.column("_t").to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), pa.ListArray.from_arrays(ends, np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int32))],
                                             names=["_k", "_y", "terms"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("_k"), F.col("_y"), F.col(text).alias("_t")), run, "_k long, _y int, terms array<int>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Machine:
    """The model of labelled rows that are not held out; `max_rows` of them at most, by a hash of the id. Labels that are
    null, or belong to no document, teach nothing. Only text and label are read."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_i")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_i"), "_i").limit(max_rows)  # so the side sent to all tasks has max_rows rows at most
    shelf = Shelf(docs.sparkSession, "toxicity")
    plain = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = shelf.save(term_rows(plain.join(F.broadcast(chosen), F.col("_k") == F.col("_i")), "_k", "_t"), "terms").dropDuplicates(["_k"])
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    seen = rows.select("_y", F.explode("terms").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("seen"), F.sum("_y").alias("with_1"))
    strongest = seen.withColumn("chi", chi_squared(F.col("with_1"), F.col("seen"), float(ones), float(n))).where(f"seen >= 3 and chi >= {LEAST_CHI}").orderBy(F.desc("chi"), "place").limit(MOST_PLACES)
    places = np.array(sorted(r["place"] for r in strongest.collect()), dtype=np.int32)  # so the rows that come to the driver are short
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.array(t or [], dtype=np.int32) for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), pa.array([t[np.isin(t, sent.value)].tobytes() for t in terms], pa.binary())], names=["_k", "_y", "places"])

    found = sorted(map_arrow(rows, short, "_k long, _y int, places binary").collect(), key=lambda r: r["_k"])
    return fit([np.frombuffer(r["places"], np.int32) for r in found], np.array([r["_y"] for r in found]))


def score(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """(key, score) of every row; null and empty texts have no term and so the score of the bias. keep=True returns all
    columns of docs (none of which may be `_toxicity`: see kept) and `_toxicity`, for filters."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.places, model.weight, model.factor, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, terms = Machine(*sent.value), Terms()
        for batch in slices(batches, text if keep else "_t"):
            got = machine.score([terms(t or "") for t in batch.column(text if keep else "_t").to_pylist()])
            columns = list(batch.columns) if keep else [batch.column("_k")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "_toxicity"] if keep else ["_k", "score"])

    if keep:
        return map_arrow(docs, run, StructType([*docs.schema.fields, StructField("_toxicity", DoubleType())]))
    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), run, f"_k {kind}, score double").withColumnRenamed("_k", key)


def kept(docs: DataFrame, model: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with a score below TOXIC, whatever the names of their columns."""
    scored = score(packed(docs, k=key, t=text), model, "k", "t", keep=True)
    return unpacked(scored.where(F.col("_toxicity") < TOXIC), docs)
