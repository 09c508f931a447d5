"""Words and their hashes for whole Arrow columns at a time, on UTF-8 bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20            # bytes of text handled at once; one longer text is a chunk of its own
P = np.uint64(0x9E3779B97F4A7C15)
P_INV = np.uint64(pow(int(P), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters A-Z, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = {"p": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = P if which == "p" else P_INV
        have = np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK) - 1, base)]).astype(np.uint64)
        np.multiply.accumulate(have, out=have)
        _powers[which] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of consecutive rows; null is empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        yield first, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, a few at a time: what is made of them is small beside a batch of whole texts.
    Memory of a batch goes back to the system before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a chunk: ``start, end`` in bytes, ``hash`` of the lower-cased bytes, and ``of[i]:of[i+1]``
    the words of its i-th text."""

    def __init__(self, data: np.ndarray, at: np.ndarray, letter: np.ndarray = ALNUM, lower: bool = True):
        self.data = LOWER[data] if lower else data
        inside = letter[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.of = np.searchsorted(self.start, at)
        self.hash = span_hash(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every k consecutive words of one text, and the first word of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h = h * P + self.hash[j:n + j]
        whole = np.ones(n, bool)
        for j in range(1, k):                              # a gram that begins j words before a text's end is none
            short = self.of[1:] - j
            whole[short[(short >= 0) & (short < n) & (short >= self.of[:-1])]] = False
        first = np.flatnonzero(whole)
        return mixed(h[first]), first


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial by prefix sums, wrapped at 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("p", n), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _power("inv", n + 1)[start] + (end - start).astype(np.uint64))
