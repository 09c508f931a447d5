"""Token ids of whole Arrow columns with a byte-level BPE vocabulary file of the ``tokenizers`` library."""
from __future__ import annotations

import os
import sys
import types
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from lociflow.llm.bytesplit import span_hash

LATIN = 0x250             # code points below are split here; a text with others goes to the library whole
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
SPECIAL = "<|endoftext|>"
CHUNK = 1 << 18           # code points at once; what is made of them takes many times their bytes
LEARNED = 4096            # pieces that go through the library at once
LONGEST = 256             # code points of a remembered piece
MAX_KNOWN = 400_000       # pieces remembered by a worker; beyond, the third met most often stays


def _kinds() -> np.ndarray:
    out = np.zeros(LATIN, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = SPACE
    return out


def piece_starts(points: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the vocabulary's pattern makes of Latin texts:
    contractions, runs of letters, digits or marks with one blank before, and white space."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[points]
    first = np.zeros(n + 1, bool)
    first[at] = True
    first = first[:n]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)                              # runs of one kind
    end = np.append(run[1:], n)
    starts = new.copy()
    of = kind[run]
    follows = np.append(~first[run[1:]], False) if len(run) else np.zeros(0, bool)      # the next run is of the same text
    white = (of == SPACE) & follows
    starts[end[white] - 1] = True
    blank = white & (points[end - 1] == 0x20)
    starts[end[blank]] = False                             # the blank belongs to the run after it
    attached = np.zeros(len(run), bool)
    attached[1:] = blank[:-1]
    quote = np.flatnonzero((of == OTHER) & (end - run == 1) & (points[run] == 0x27) & ~attached & follows) if len(run) else []
    for r in quote:
        a, b = end[r], end[r + 1]
        if kind[a] != LETTER:
            continue
        two = "".join(map(chr, points[a:min(b, a + 2)]))
        size = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if size:
            starts[a] = False
            if a + size < b:
                starts[a + size] = True
    return np.flatnonzero(starts)


class Tokeniser:
    """Ids of texts; every distinct piece of up to ``LONGEST`` code points goes through the library once and is remembered.

    A piece is looked up by a hash and then compared with the one remembered, code point by code point; one that
    only shares the hash, and any longer piece, goes to the library by itself.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = None if special_as_text else SPECIAL
        self.kinds = _kinds()
        self._forget()

    def _forget(self):
        self.slot: dict[int, int] = {}
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.from_, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.met = np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0
        self.points, self.n_points = np.zeros(1 << 14, np.uint32), 0

    def _trim(self):
        n = len(self.slot)
        stay = np.sort(np.argsort(self.met[:n], kind="stable")[n - MAX_KNOWN // 3:])
        keys = np.fromiter(self.slot, np.uint64, n)[stay].tolist()
        ids, at = _gathered(self.ids, self.at[stay], self.size[stay])
        points, from_ = _gathered(self.points, self.from_[stay], self.length[stay])
        size, length = self.size[stay], self.length[stay]
        self._forget()
        self.slot = {k: i for i, k in enumerate(keys)}
        self.at, self.size, self.met = at, size, np.zeros(len(stay), np.int64)
        self.from_, self.length = from_, length
        self.ids, self.used, self.points, self.n_points = ids, len(ids), points, len(points)

    def _alone(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        new = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        size, length = np.fromiter(map(len, new), np.int64, len(new)), np.fromiter(map(len, pieces), np.int64, len(new))
        n, to = len(self.slot), len(self.slot) + len(new)
        if to > len(self.at):
            more = np.zeros(len(self.at) + len(new), np.int64)
            self.at, self.size, self.met, self.from_, self.length = (
                np.concatenate([x, more]) for x in (self.at, self.size, self.met, self.from_, self.length))
        total, letters = int(size.sum()), int(length.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + total, np.uint32)])
        if self.n_points + letters > len(self.points):
            self.points = np.concatenate([self.points, np.zeros(len(self.points) + letters, np.uint32)])
        self.slot.update(zip(keys, range(n, to)))
        self.at[n:to], self.size[n:to] = self.used + np.cumsum(size) - size, size
        self.from_[n:to], self.length[n:to] = self.n_points + np.cumsum(length) - length, length
        self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(new), np.uint32, total)
        self.points[self.n_points:self.n_points + letters] = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        self.used, self.n_points = self.used + total, self.n_points + letters

    def _chunk(self, texts: list[str]) -> Iterator[np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if len(self.slot) > MAX_KNOWN:
            self._trim()
        start = piece_starts(points, at, self.kinds)
        end = np.append(start[1:], len(points)) if len(start) else start
        length = end - start
        raw = points.tobytes()

        def text(i):
            return raw[4 * start[i]:4 * end[i]].decode("utf-32-le")
        keys, index, inverse, times = np.unique(span_hash(points, start, end), return_index=True, return_inverse=True, return_counts=True)
        keys = keys.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.slot and length[index[i]] <= LONGEST]
        for k in range(0, len(missing), LEARNED):
            some = missing[k:k + LEARNED]
            self._learn([keys[i] for i in some], [text(index[i]) for i in some])
        known = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        self.met[known[known >= 0]] += times[known >= 0]
        slot = known[inverse]
        own = np.flatnonzero((slot < 0) | (length != self.length[slot]))
        slot[own] = 0
        if len(start):                                     # pieces cover the chunk, so one pass compares them all
            beside = np.repeat((self.from_[slot] - start).astype(np.int32), length)
            beside += np.arange(len(points), dtype=np.int32)
            same = np.logical_and.reduceat(self.points.take(beside, mode="clip") == points, start)
            same[own] = False
            own = np.flatnonzero(~same)
        first, size, ids = self.at[slot], self.size[slot], self.ids
        if len(own):
            alone = self._alone([text(i) for i in own])
            sizes = np.array([len(x) for x in alone])
            first[own], size[own] = len(ids) + np.cumsum(sizes) - sizes, sizes
            ids = np.concatenate([ids, *alone])
        before = np.concatenate([[0], np.cumsum(size)])
        ids = _gathered(ids, first, size)[0]
        cut = before[np.searchsorted(start, at)]
        for a, b in zip(cut[:-1], cut[1:]):
            yield ids[a:b]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order; null is empty."""
        batch, size = [], 0
        for text in column.to_pylist():
            text = text or ""
            plain = text.isascii() or ord(max(text)) < LATIN
            if not plain or (self.special and self.special in text):
                yield from self._chunk(batch)
                batch, size = [], 0
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            batch.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._chunk(batch)
                batch, size = [], 0
        yield from self._chunk(batch)


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans ``at, size`` of ``data`` one behind the other, and where each now begins."""
    first = np.cumsum(size) - size
    return data[np.repeat(at - first, size) + np.arange(size.sum())], first


def kept_in_worker(key, make):
    """``make()`` once for each worker process. Functions travel by value, so what outlives a task needs a module of its own."""
    place = sys.modules.setdefault("lociflow_worker_state", types.ModuleType("lociflow_worker_state"))
    known = place.__dict__.setdefault("by_key", {})
    if key not in known:
        known[key] = make()
    return known[key]
