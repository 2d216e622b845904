"""Token files: ids ranked by frequency, in byte-aligned variable-length code with its control bytes apart.

A file holds consecutive documents in ascending key order and decodes alone:

    magic, then seven little-endian unsigned 64-bit numbers: documents, tokens, different ids, documents with a key, bytes of data, and the
        file's place (partition, number in the partition)
    the different ids, most frequent first (equal counts: smaller id first), unsigned 32-bit; a token's rank is its place here
    one byte a document: has it a key; the keys, signed 64-bit; the token counts, unsigned 64-bit
    control bytes: two bits a token, four tokens a byte, lowest bits first: bytes of the rank less one
    data bytes: the ranks, 1 to 4 bytes each, little-endian

Most tokens of a text have one of the 256 most frequent ids of its file, so they take one byte. The reader expands the
control bytes through a table of 256 x 4 lengths and gathers all ranks of a file at once.
"""
from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookdq.llm.chunks import ADJACENT, ChunkMemory
from bookdq.llm.common import Shelf, get, map_arrow, put, slices

BLANK = re.compile(r"\s")
UNBROKEN = re.compile(r"(?: ?\S++(?:\n|\Z))++")
MAGIC = b"RANKIDS1"
FILE_TOKENS = 8_000_000  # a file is closed when it has so many; the writer holds one file in memory
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)  # of a control byte's four tokens


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, dtype="<u4")
    padded[:n] = ranks
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    code = (size - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[:n][np.arange(4) < size[:n, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_bytes(keys: Sequence[int | None], counts: Sequence[int], ids: np.ndarray, place: tuple[int, int]) -> bytes:
    times = np.bincount(ids, minlength=1)  # ids of a vocabulary: a table of their counts is small
    order = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
    rank = np.zeros(len(times), dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    control, data = pack(rank[ids])
    given = np.array([k is not None for k in keys], dtype=np.uint8)
    head = np.array([len(keys), len(ids), len(order), int(given.sum()), len(data), *place], dtype="<u8")
    return b"".join((MAGIC, head.tobytes(), order.astype("<u4").tobytes(), given.tobytes(), np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
                     np.array(counts, dtype="<u8").tobytes(), control, data))


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, tuple[int, int]]:
    """(keys, token counts, ids, place)"""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, different, _, size, part, number = np.frombuffer(raw, "<u8", 7, 8).tolist()
    at = 64
    table = np.frombuffer(raw, "<u4", different, at)
    at += 4 * different
    given = np.frombuffer(raw, np.uint8, docs, at)
    at += docs
    keys = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    control = raw[at:at + -(-tokens // 4)]
    at += len(control)
    if len(raw) != at + size:
        raise ValueError("the token file is cut")
    ids = table[unpack(control, raw[at:], tokens)] if tokens else np.empty(0, np.uint32)
    return [k if g else None for k, g in zip(keys.tolist(), given.tolist())], counts, ids, (part, number)


class Library:
    """Ids of texts as the tokenizers library gives them; texts with a string of an added token (a special one, say) are not cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        added = [t.content for t in self.tool.get_added_tokens_decoder().values() if t.content]
        self.line = np.frombuffer(self._each(["\n"])[0], "<u4")[-1]
        self.memory = ChunkMemory(self._many, lambda text: self._each([text])[0], uncut=lambda text: ADJACENT.search(text) or any(t in text for t in added))

    def _each(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, texts: Sequence[str]) -> list[bytes]:
        """Strings without white space behind their first character go through one call, a line break between them:
        it always stands alone there, so its id parts their ids again."""
        out = [b""] * len(texts)
        lines = "\n".join(texts)
        if lines.count("\n") == len(texts) - 1 and lines[-1:] != "\n" and UNBROKEN.fullmatch(lines):  # all are of that kind, as a rule
            plain = range(len(texts))
        else:
            plain = [i for i, t in enumerate(texts) if t and not BLANK.search(t, 1) and (t[0] == " " and len(t) > 1 or not BLANK.match(t))]
            rest = sorted(set(range(len(texts))) - set(plain))
            for i, v in zip(rest, self._each([texts[i] for i in rest]) if rest else ()):
                out[i] = v
            lines = "\n".join([texts[i] for i in plain])
        if plain:
            ids = np.array(self.tool.encode_batch_fast([lines], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(plain) - 1:
                raise ValueError("the tokenizer does not keep line breaks apart")
            raw, a = ids.tobytes(), 0
            for i, b in zip(plain, [*(4 * cuts).tolist(), len(raw)]):
                out[i] = raw[a:b]
                a = b + 4
        return out

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return self.memory.ids(texts)


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def write(docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encodes every text (null: empty), appends `end_id`, and writes token files in ascending key order (null keys
    first; rows with one key by a hash of the text). Returns the manifest: file, part, number, docs, tokens.

    The texts are range-partitioned by key, so file order is partition order. A repeated or speculative task writes
    files of other names; the manifest, a Spark output, names those of the attempt that counted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task = library(path), TaskContext.get()
        end, part, number = np.array([end_id], dtype="<u4"), task.partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            name = f"{part:08d}-{number:06d}-{task.taskAttemptId()}.tok"
            counts = [len(x) + 1 for x in held[::2]]
            file = put(folder, name, to_bytes(keys, counts, np.concatenate(held), (part, number)))
            return pa.RecordBatch.from_pydict({"file": [file], "part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()), "docs": pa.array([len(keys)], pa.int64()),
                                               "tokens": pa.array([tokens], pa.int64())})

        for batch in slices(batches, "_t"):
            for k, ids in zip(batch.column("_k").to_pylist(), tool.encode([t or "" for t in batch.column("_t").to_pylist()])):
                keys.append(k)
                held += (ids, end)
                tokens += len(ids) + 1
                if tokens >= file_tokens:
                    yield close()
                    keys, held, tokens, number = [], [], 0, number + 1
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
    apart = F.xxhash64("_t")  # rows of one key, null among them, spread over partitions in a defined order
    return map_arrow(rows.repartitionByRange("_k", apart).sortWithinPartitions("_k", apart), run, "file string, part long, number long, docs long, tokens long")


def read(manifest: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids array<int>) of every document of the files in a manifest, from the files alone.
    start: tokens of all documents before it. Without `ids` on demand: then they are decoded and not handed on."""
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                keys, counts, ids, _ = from_bytes(get(file))
                ends = np.cumsum(counts)
                for a in range(0, len(keys), 2000):
                    some = slice(a, a + 2000)
                    cut = list(zip((ends - counts)[some].tolist(), ends[some].tolist()))
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in cut]
                    columns = [pa.array(keys[some], pa.int64()), pa.array((ends - counts)[some] + base), pa.array(counts[some]), pa.array(crc, pa.int64())]
                    if with_ids:
                        offsets = np.array([0, *(j - cut[0][0] for _, j in cut)], dtype=np.int32)
                        columns.append(pa.ListArray.from_arrays(offsets, ids[cut[0][0]:cut[-1][1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(columns, names=["_k", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    files = manifest.withColumn("base", before).select("file", "base").repartition(manifest.sparkSession.sparkContext.defaultParallelism)
    return map_arrow(files, run, "_k long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids).withColumnRenamed("_k", key)


def write_and_read(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Files and manifest in the shared folder, read back. An empty table gives no file and no row."""
    shelf = Shelf(docs.sparkSession, "tokens")
    manifest = shelf.save(write(docs, path, end_id, f"{shelf.path}/files", key, text, file_tokens), "manifest")
    return read(manifest, key, with_ids)
