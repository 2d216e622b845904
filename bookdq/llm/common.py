"""What the operators share: slices of Arrow batches, tables in the shared folder, words."""
from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bookdq.plans.sizing import delete, shared_folder, stored

SLICE_BYTES = 4 << 20
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
FILTER_WORDS = 1 << 18  # of 64 bits


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column` (string or binary) has about `limit` bytes in each; a larger value is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(int(a), int(b - a))


class Shelf:
    """Parquet tables of one run in the shared folder (`spark.checkpoint.dir`): they cut lineage, so a lost executor
    re-reads instead of recomputing, and row numbers given before the write stay as they are."""

    made: list[str] = []  # folders of this process, in order

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/bookdq-llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
        self.made.append(self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("error").parquet(f"{self.path}/{name}")
        return self.read(df, name)

    def read(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Only for tables that no frame in use reads any more."""
        delete(self.spark, f"{self.path}/{name}")


@contextmanager
def noted(folders: list[str]) -> Iterator[None]:
    """Adds the folders of intermediate tables made meanwhile to a list."""
    shelves, tables = len(Shelf.made), len(stored)
    yield
    folders += [f for f in [*Shelf.made[shelves:], *stored[tables:]] if "/code-" not in f]


def drop_unread(spark: SparkSession, folders: list[str], docs: DataFrame) -> None:
    """Deletes the folders that docs does not read, and takes them from the list."""
    read = docs.inputFiles() if folders else []
    for folder in [f for f in folders if not any(f.rsplit("/", 1)[1] in file for file in read)]:
        delete(spark, folder)
        folders.remove(folder)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder that every executor reaches: file:, hdfs:, s3:, gs: or a plain path."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def put(uri: str, name: str, raw: bytes) -> str:
    """Writes under a name of this attempt, then moves: a file that has its name is whole. Returns its URI."""
    system, folder = open_folder(uri)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{name}") as out:
        out.write(raw)
    system.move(f"{folder}/.{name}", f"{folder}/{name}")
    return f"{uri}/{name}"


def get(uri: str) -> bytes:
    system, path = open_folder(uri)
    with system.open_input_stream(path) as file:
        return file.read()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        raw, top = io.BytesIO(), Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(raw, "w") as pack:
            for file in sorted(top.rglob("*.py")):
                pack.write(file, file.relative_to(top.parent))
        spark.sparkContext.addPyFile(put(Shelf(spark, "code").path, "bookdq.zip", raw.getvalue()))
        _shipped.add(app)


def map_arrow(df: DataFrame, fn: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow whose function may use this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def packed(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """The given columns, and all of docs in one struct `all`: names of docs cannot meet those that an operator adds."""
    named = [F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()]
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("all"), *named)


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs again, those of `new` replaced."""
    return rows.select(*[new.get(c, F.col("all").getField(c)).alias(c) for c in docs.columns])


def likely_among(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys, and few others: a filter of at most 2 MB of bits is sent to all tasks, so that a join with the keys
    need not move the wide rows that it drops. Exact only together with that join."""
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(64 * FILTER_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place(key) % 64).cast("int"))
    words = keys.groupBy(F.floor(place(key) / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    found = rows.join(F.broadcast(words), F.floor(place(column) / 64) == F.col("_word"))
    return found.where(F.getbit("_bits", (place(column) % 64).cast("int")) == 1).drop("_word", "_bits")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Words of a text (runs without ASCII white space); 0 for null. A long."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
