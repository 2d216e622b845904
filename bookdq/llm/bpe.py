"""Byte-level BPE in padded numpy matrices, and its inverse.

Each match of the split pattern is a row of byte ids. Rows of like length share a padded matrix. In every round each
row merges its leftmost pair of the lowest rank, the row is compacted, and only the two pairs beside the merge are
looked up again, in an open-addressing table over (left id, right id). Rows without a known pair leave the matrix.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookdq.llm.chunks import ChunkMemory
from bookdq.llm.common import map_arrow, slices

NONE = np.int32(2**31 - 1)
ROWS = 8192  # rows of a matrix at most
LONG = 512  # bytes; longer matches go to merge_long
#: White space as the tokenizer libraries have it (the Unicode property); the regex module adds four control characters.
BLANKS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


class PairTable:
    """(left id, right id) -> id of the merged token, which is its rank; NONE where the pair is no token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(left))))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = left << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # each free slot takes one of those that want it; the others go one further
            free = todo[self.keys[slot[todo]] == -1]
            winners = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[winners]], self.ranks[slot[winners]] = key[winners], rank[winners]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Negative ids (padding) have no pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -2
        shape, key = key.shape, key.ravel()
        slot = self._slot(key)
        out, todo = np.full(len(key), NONE, dtype=np.int32), np.flatnonzero(key != -2)
        while len(todo):
            at = self.keys[slot[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (at != -1)]
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1
        return out.reshape(shape)


def merge_rows(ids: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Rows of token ids padded with -1 on the right -> merged rows, padded likewise, and their lengths."""
    n, width = ids.shape
    ids = ids.copy()
    length = (ids >= 0).sum(axis=1)
    rank = np.full((n, width), NONE, dtype=np.int32)
    if width > 1:
        rank[:, :-1] = pairs(ids[:, :-1], ids[:, 1:])
    done, done_length = np.full((n, width), -1, dtype=np.int32), length.copy()
    rows = np.arange(n)  # where the active rows go
    while len(rows):
        at = rank.argmin(axis=1)  # the first of equal ranks
        active = np.arange(len(rows))
        best = rank[active, at]
        ended = best == NONE
        if ended.any():
            done[rows[ended], :ids.shape[1]], done_length[rows[ended]] = ids[ended], length[ended]
            keep = ~ended
            rows, ids, rank, length, at, best = rows[keep], ids[keep], rank[keep], length[keep], at[keep], best[keep]
            if not len(rows):
                break
            active = np.arange(len(rows))
        ids[active, at] = best
        columns = np.arange(ids.shape[1] - 1)
        source = columns + (columns > at[:, None])  # leave out column at + 1
        ids, kept_rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
        length = length - 1
        rank = kept_rank
        last = rank.shape[1] - 1
        right = np.where(at < last, ids[active, np.minimum(at + 1, last)], -1)
        rank[active, np.minimum(at, last)] = pairs(ids[active, np.minimum(at, last)], right)
        before = np.flatnonzero(at > 0)
        rank[before, at[before] - 1] = pairs(ids[before, at[before] - 1], ids[before, at[before]])
    return done, done_length


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges for one very long row, in n log n steps: a heap of (rank, position) over a linked list."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or pairs.get(ids[i] << 32 | ids[j]) != r:
            continue  # an entry that an earlier merge made void
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := pairs.get(r << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := pairs.get(ids[before[i]] << 32 | r)) is not None:
            heapq.heappush(heap, (x, before[i]))
    return [x for x, a in zip(ids, alive) if a]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}


class Codec:
    """Encodes and decodes with the ranks of a file; `pattern` splits a text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"\s", f"[{BLANKS}]").replace(f"[^[{BLANKS}]", f"[^{BLANKS}").replace(r"\S", f"[^{BLANKS}]"))
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.token = {r: t for t, r in ranks.items()}
        self.memory = ChunkMemory(self._chunks, self._whole)

    @property
    def long_pairs(self) -> dict[int, int]:
        if not hasattr(self, "_long_pairs"):
            full = self.pairs.keys >= 0
            self._long_pairs = dict(zip(self.pairs.keys[full].tolist(), self.pairs.ranks[full].tolist()))
        return self._long_pairs

    def pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of matches of the pattern. A match that is itself a token stays whole,
        as in the public libraries."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = np.array(merge_long(self.byte_id[np.frombuffer(p, np.uint8)].tolist(), self.long_pairs), dtype="<u4").tobytes()
            else:  # widths in steps of 4, of 8 above 16, and so on
                step = max(4, 1 << (len(p) - 1).bit_length() >> 2)
                buckets.setdefault(-(-len(p) // step) * step, []).append(i)
        for width, rows in buckets.items():
            step = max(1, min(ROWS, ROWS * 32 // width))
            for k in range(0, len(rows), step):
                some = [pieces[i] for i in rows[k:k + step]]
                padded = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in some]), np.uint8).reshape(len(some), width)
                size = np.fromiter(map(len, some), np.int64, len(some))
                ids, length = merge_rows(np.where(np.arange(width) < size[:, None], self.byte_id[padded], np.int32(-1)), self.pairs)
                flat, ends = ids[np.arange(width) < length[:, None]].astype("<u4").tobytes(), (4 * np.cumsum(length)).tolist()
                a = 0
                for i, b in zip(rows[k:k + step], ends):
                    out[i] = flat[a:b]
                    a = b
        return out

    def _chunks(self, chunks: Sequence[str]) -> list[bytes]:
        # letters, with a blank before them or not, are one match; the others are split
        split = [(c,) if (c[1:] if c[:1] == " " else c).isalpha() else self.pattern.findall(c) for c in chunks]
        different = list(set(chain.from_iterable(split)))
        ids = dict(zip(different, self.pieces([p.encode() for p in different])))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[p] for p in s]) for s in split]

    def _whole(self, text: str) -> bytes:
        return self._chunks([text])[0]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        return self.memory.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker; built from the file, which lies on every machine."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row; a null text counts as empty, an empty text has no ids. Other columns are
    not read. Repeated rows give repeated rows. Narrow: no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, "_t"):
            ids = tool.encode([t or "" for t in batch.column("_t").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.ListArray.from_arrays(ends, flat)], names=["_k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), run, f"_k {kind}, ids array<int>").withColumnRenamed("_k", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); bytes that are no UTF-8, as cut ids can give, become the replacement character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            texts = [tool.decode(np.array(x if x is not None else [], dtype=np.int64)).decode(errors="replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(texts, pa.string())], names=["_k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return map_arrow(encoded.select(F.col(key).alias("_k"), "ids"), run, f"_k {kind}, text string").withColumnRenamed("_k", key)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded again from the ids alone, in one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in slices(batches, "_t"):
            count, of_ids, of_text = [], [], []
            for ids in tool.encode([t or "" for t in batch.column("_t").to_pylist()]):
                count.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                             names=["_k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return map_arrow(rows, run, f"_k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_k", key)
