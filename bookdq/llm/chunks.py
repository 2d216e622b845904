"""Cuts texts where the split pattern of the byte-level tokenizers always cuts, and remembers what each cut piece gave.

Texts repeat their words, so the costly step (merging) runs once for each different chunk of a worker, not for each
occurrence. A chunk starts at a blank or is one line break. In a text without adjacent white space the pattern
(public_tokenizers.PATTERN) has a boundary at each of these places: a blank goes with the word behind it, a line break
stands alone, and no match goes over white space. Other texts are handed over whole.

A chunk has a number, and the ids of all chunks lie in one flat array: a batch of texts is one walk through a
dictionary, then one gather.
"""
from __future__ import annotations

import gc
import re
import string
from collections.abc import Callable, Sequence
from itertools import chain, filterfalse

import numpy as np

ADJACENT = re.compile(r"\s\s")
MAX_CHUNKS = 300_000
MARKS = frozenset(string.punctuation)
START, LINE, SIGNS = " ", "\n", "  "  # leads of keys: first word of a text, of a line, signs; other words have none. No word holds them


class Numbers(dict):
    """Numbers keys in the order they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Flat:
    """Runs of ids by number, in one array that grows."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 12, "<u4"), 0
        self.start, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The runs of the numbers, one behind the other."""
        if not len(numbers):
            return
        self.ids = self._room(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        most = int(numbers.max()) + 1
        self.start, self.length = self._room(self.start, most), self._room(self.length, most)
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbers in a row, how many each has)"""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)], lengths


class ChunkMemory:
    """`ids(texts)` gives the ids (unsigned 32-bit) of each text.

    compute: ids, as little-endian bytes, of many strings at once. whole: those of one text that is not cut (any length): one for which `uncut`
    is true. The ids of a string must be those of its parts put together wherever the pattern cuts it.
    The memory has two generations. When the new one holds more than `limit` chunks it becomes the old one, and the old one is dropped; a
    chunk met again moves to the new one. So it is bounded whatever the data, and words in use stay.
    """

    def __init__(self, compute: Callable[[Sequence[str]], Sequence[bytes]], whole: Callable[[str], bytes], limit: int = MAX_CHUNKS, uncut: Callable[[str], object] = ADJACENT.search):
        self.compute, self.whole, self.limit, self.uncut = compute, whole, limit, uncut
        self.numbers, self.flat = Numbers(), Flat()
        self.old_numbers, self.old_flat = Numbers(), Flat()
        self.line = np.frombuffer(compute([LINE])[0], "<u4")

    def _learn(self) -> None:
        """Ids of the new chunks. Letters and the signs behind them are two matches, so `word,` needs no more than `word` and `,`."""
        numbers, old, alone, ended = self.numbers, self.old_numbers, [], []
        fresh, numbers.fresh = numbers.fresh, []
        while fresh:  # once more for letters and signs that are asked for here
            again = list(filter(old.__contains__, fresh))
            if again:
                self.flat.add(self._of(again), *self.old_flat.gather(np.fromiter(map(old.__getitem__, again), np.int64, len(again))))
            for w in filterfalse(old.__contains__, fresh):
                if w[-1:] in MARKS:
                    core = w.rstrip(string.punctuation)
                    if core.isalpha():
                        ended.append((numbers[w], numbers[core], numbers[SIGNS + w[len(core):]]))
                        continue
                alone.append(w)
            fresh, numbers.fresh = numbers.fresh, []
        lines = [w for w in alone if w[:1] == LINE]
        others = [w for w in alone if w[:1] != LINE]
        values = self.compute([w[1:] for w in lines] + [w[2:] if w[:2] == SIGNS else w[1:] if w[:1] == START else " " + w for w in others]) if alone else []
        values = [self.line.tobytes() + v for v in values[:len(lines)]] + values[len(lines):]
        self.flat.add(self._of(lines + others), np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)
        if ended:
            table = np.array(ended, dtype=np.int64)
            ids, lengths = self.flat.gather(table[:, 1:].ravel())
            self.flat.add(table[:, 0], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _of(self, keys: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the collector would walk the memory again and again
        try:
            return self._ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.limit:
            self.old_numbers, self.old_flat = self.numbers, self.flat
            self.numbers, self.flat = Numbers(), Flat()
        uncut = [bool(self.uncut(t)) for t in texts]
        chunks = [self._chunks(t) for t, u in zip(texts, uncut) if not u]
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        found = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        self._learn()
        ids, lengths = self.flat.gather(found)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)].tolist()
        cut = iter(zip([0, *ends], ends))
        return [np.frombuffer(self.whole(t), "<u4") if u else ids[slice(*next(cut))] for t, u in zip(texts, uncut)]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        lead, out = START, []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = lead + words[0]
            out += words
            lead = LINE
        return out
