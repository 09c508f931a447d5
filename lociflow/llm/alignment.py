"""Two tokenizers aligned on bytes, and how often each pair of their tokens ends together, counted through sorted runs."""
from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.scratch import Scratch
from lociflow.llm.tokens import Tokeniser, kept_in_worker

CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 4096      # of one run; a longer text is a run of its own
RADIX = 32                                   # parts of the second side's ids
FAN_IN = 256                                 # runs merged in one task
BLOCK = 1 << 15                              # pairs of a run in one step of the merge
DOC_BITS = 16


class Side(NamedTuple):
    """Bytes of every id, one behind the other."""
    data: np.ndarray
    at: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(pieces: list[bytes]) -> Side:
        size = np.array([len(p) for p in pieces], np.int64)
        return Side(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its character and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Pair:
    """Both tokenizers and the bytes of their ids. Every id that text can give has a byte at least."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        self.first = Tokeniser(byte_bpe, special_as_text=True)
        letters = _byte_letters()
        vocabulary = self.first.library.get_vocab(with_added_tokens=True)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        made = [bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode()
                for i in range(self.second.get_piece_size())]
        self.a, self.b = Side.of(entries), Side.of(made)
        self.letters_a = np.array([f"{i}," for i in range(len(entries))] + [f"{i}|" for i in range(len(entries))], object)
        self.letters_b = np.array([f"{i}," for i in range(len(made))] + [f"{i};" for i in range(len(made))], object)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both sides; none by either where the bytes of one are not those of a blank and the text."""
        first = [x.astype(np.int64) for x in self.first.encode(pa.array([" " + t for t in texts], pa.string()))]
        second = [np.array(x, np.int64) for x in self.second.encode(texts, num_threads=1)] if texts else []
        for k, text in enumerate(texts):
            raw = np.frombuffer(b" " + text.encode(), np.uint8)
            if not text or not all(np.array_equal(side.joined(ids), raw) for side, ids in ((self.a, first[k]), (self.b, second[k]))):
                first[k] = second[k] = np.zeros(0, np.int64)
        return first, second


class Aligned(NamedTuple):
    """Texts aligned together: per text ``n_a, n_b, n_groups, groups``; per link its text and ids."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(pair: Pair, texts: list[str]) -> Aligned:
    """Groups end where tokens of both sides end; their last tokens are linked. ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids."""
    first, second = pair.encode(texts)
    n_a, n_b = (np.array([len(x) for x in s], np.int64) for s in (first, second))
    a, b = (np.concatenate([np.zeros(0, np.int64), *s]) for s in (first, second))
    end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
    ends = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
    ends[0, end_a], ends[1, end_b] = True, True
    cut_a, cut_b = ends[1, end_a], ends[0, end_b]          # a text's last tokens end together, so no group leaves its text
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    doc_of_a = np.repeat(np.arange(len(texts)), n_a)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    parts = np.empty(len(a) + len(b), object)
    parts[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = pair.letters_a[a + cut_a * len(pair.a.size)]
    parts[np.arange(len(b)) + (last_a[group_b] + 1 if len(b) else 0)] = pair.letters_b[b + cut_b * len(pair.b.size)]
    at = np.append(0, np.cumsum(n_a + n_b))
    groups = ["".join(parts[s:e].tolist())[:-1] for s, e in zip(at[:-1], at[1:])]
    doc = doc_of_a[last_a]
    return Aligned(n_a, n_b, np.bincount(doc, minlength=len(texts)), groups, doc, a[last_a], b[last_b])


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(x.tobytes()) for x in arrays], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(x.tobytes() for x in arrays))


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, out, at = np.frombuffer(raw, np.int64, len(kinds)), [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _head(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as gaps, and their counts."""
    return _packed(np.diff(keys, prepend=0), counts.astype(np.int64))


def _read_head(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = _unpacked(blob, np.int64, np.int64)
    return np.cumsum(gaps), counts


def merged(runs: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A k-way merge of ascending runs ``keys, counts`` by a heap of the ends of their present blocks.

    The least of these ends bounds what can be given out: all up to it is taken from every run and equal keys are added up.
    """
    at = [0] * len(runs)
    heap = [(int(k[min(block, len(k)) - 1]), i) for i, (k, _) in enumerate(runs) if len(k)]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        keys, counts = [], []
        for i, (k, c) in enumerate(runs):
            upto = at[i] + int(np.searchsorted(k[at[i]:], limit, side="right"))
            if upto > at[i]:
                keys.append(k[at[i]:upto])
                counts.append(c[at[i]:upto])
                at[i] = upto
        while heap and heap[0][0] <= limit:
            i = heapq.heappop(heap)[1]
            k = runs[i][0]
            if at[i] < len(k):
                heapq.heappush(heap, (int(k[min(at[i] + block, len(k)) - 1]), i))
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(all_keys, kind="stable")
        all_keys = all_keys[order]
        first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1]))
        yield all_keys[first], np.add.reduceat(all_counts[order], first)


def with_maxima(parts: Iterator[tuple[np.ndarray, np.ndarray]], size_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds to each pair whether its count is the highest of its second id. Pairs come by second id, so only the last one's wait."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def marked(keys, counts):
        side = keys // size_a
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        most = np.maximum.reduceat(counts, first)
        return keys, counts, counts == np.repeat(most, np.diff(np.append(first, len(keys))))
    for keys, counts in parts:
        keys, counts = np.concatenate([held[0], keys]), np.concatenate([held[1], counts])
        cut = int(np.searchsorted(keys, keys[-1] // size_a * size_a))
        held = keys[cut:], counts[cut:]
        if cut:
            yield marked(keys[:cut], counts[:cut])
    if len(held[0]):
        yield marked(*held)


class Alignment(NamedTuple):
    documents: DataFrame       # doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    pairs: DataFrame           # a_id, b_id, links, best


def align_tokenizers(docs: DataFrame, byte_bpe: str, pieces: str, radix: int = RADIX, fan_in: int = FAN_IN, chunk_rows: int = CHUNK_ROWS,
                     chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Alignment:
    """How each document's tokens by two vocabulary files line up, and every pair of ids with its count of links.

    A chunk of consecutive rows is encoded and aligned in one task. Its links become records (second id, first id,
    document, times), cut by the second id into ``radix`` parts, each a sorted run compressed with zstd: a head of pairs
    and their counts, and a body of documents and times. Only heads are read to count: tasks merge ``fan_in`` of them by a heap,
    in levels, ordered by the second id, so that its highest count is known when its pairs have passed. Counts then meet
    the whole runs, ``fan_in`` in a task, and give what each adds to its documents; those sums come together by chunk.
    A pair that occurs in every document is one entry of each head and spread over all those tasks.

    Null and empty texts, and texts that either side does not reproduce, have no tokens: zeros and an empty ``groups_sha256``.
    Repeated rows each get a row and count each; null identifiers stay null; a very long text is a chunk of its own; an empty
    table gives none; only the two named columns are read. Bounds: a task holds one chunk, or ``fan_in`` runs of one part.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    columns = ["doc_id", "chunk", "part", "idx", "n_a", "n_b", "n_groups", "groups_sha256", "head", "body"]
    shape = (f"doc_id {named.schema['doc_id'].dataType.simpleString()}, chunk long, part int, idx int, n_a long, n_b long, n_groups long, groups_sha256 string, "
             "head binary, body binary")

    def pair_here():
        return kept_in_worker(("pair", byte_bpe, pieces), lambda: Pair(byte_bpe, pieces))

    def encoded(chunk: int, ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        pair = pair_here()
        found = align(pair, texts)
        n = len(texts)
        sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(n, chunk)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(found.n_a), pa.array(found.n_b),
             pa.array(found.n_groups.astype(np.int64)), pa.array(sha, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], columns)
        size_a, size_b = len(pair.a.size), len(pair.b.size)
        records = ((((found.b % radix) * size_b + found.b) * size_a + found.a) << DOC_BITS) | found.doc
        records, times = np.unique(records, return_counts=True)
        part, key = np.divmod(records >> DOC_BITS, size_a * size_b)
        doc = (records & ((1 << DOC_BITS) - 1)).astype(np.uint16)
        parts, at = np.unique(part, return_index=True)
        heads, bodies = [], []
        for s, e in zip(at, np.append(at[1:], len(part))):
            first = np.flatnonzero(np.append(True, key[s + 1:e] != key[s:e - 1]))
            heads.append(_head(key[s:e][first], np.add.reduceat(times[s:e], first)))
            bodies.append(_packed(np.diff(np.append(first, e - s)).astype(np.uint16), doc[s:e], times[s:e].astype(np.uint32)))
        m = len(parts)

        def none(kind):
            return pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays(
            [none(ids.type), pa.array(np.full(m, chunk)), pa.array(parts.astype(np.int32)), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()),
             none(pa.string()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            upto, at = np.cumsum(sizes.astype(np.int64)), 0
            while at < b.num_rows:
                before = upto[at - 1] if at else 0
                to = min(max(at + 1, int(np.searchsorted(upto, before + chunk_bytes, side="right"))), at + chunk_rows, b.num_rows)
                piece = b.slice(at, to - at)
                yield from encoded(piece.column(2)[0].as_py(), piece.column(0), [t or "" for t in piece.column(1).to_pylist()])
                at = to
    made = scratch.write(named.mapInArrow(run, shape), "made")
    rows, runs = made.where("part < 0"), made.where("part >= 0")
    n_runs = rows.where("idx = 0").count()

    def group(n: int):
        return F.pmod(F.xxhash64("chunk"), F.lit(max(1, -(-n // fan_in)))).cast("int")

    def sizes_here():
        return len(pair_here().a.size)

    def counted(key, t):
        parts = list(merged([_read_head(h) for h in t["head"].to_pylist()]))
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts))
        return pa.table({"part": [key[0].as_py()], "chunk": [key[1].as_py()], "head": [_head(keys, counts)]},
                        schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("head", pa.binary())]))

    def ended(key, t):
        parts = list(with_maxima(merged([_read_head(h) for h in t["head"].to_pylist()]), sizes_here()))
        keys, counts, best = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"part": [key[0].as_py()], "head": [_head(keys, counts)], "best": [_packed(np.packbits(best))]},
                        schema=pa.schema([("part", pa.int32()), ("head", pa.binary()), ("best", pa.binary())]))
    level, n = runs.select("part", "chunk", "head"), n_runs
    while n > fan_in:
        level = (level.withColumn("group", group(n).cast("long")).groupBy("part", "group").applyInArrow(counted, "part int, chunk long, head binary"))
        n = -(-n // fan_in)
    counts = scratch.write(level.groupBy("part").applyInArrow(ended, "part int, head binary, best binary"), "counts")

    n_groups = max(1, -(-n_runs // fan_in))
    spread = counts.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    grouped = runs.select("part", "chunk", "head", "body").withColumn("group", group(n_runs))

    def added(key, t, c):
        keys, links = _read_head(c["head"][0].as_py())
        best = np.unpackbits(_unpacked(c["best"][0].as_py(), np.uint8)[0])[:len(keys)]
        out = []
        for blob, body in zip(t["head"].to_pylist(), t["body"].to_pylist()):
            mine, _ = _read_head(blob)
            n_docs, doc, times = _unpacked(body, np.uint16, np.uint16, np.uint32)
            at = np.repeat(np.searchsorted(keys, mine), n_docs)
            where, back = np.unique(doc, return_inverse=True)
            total, top = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
            np.add.at(total, back, links[at] * times)
            np.add.at(top, back, best[at] * times.astype(np.int64))
            out.append(_packed(where, top, total))
        return pa.table({"chunk": t["chunk"].combine_chunks(), "sums": pa.array(out, pa.binary())})
    sums = grouped.groupBy("part", "group").cogroup(spread.groupBy("part", "group")).applyInArrow(added, "chunk long, sums binary")

    def together(key, t):
        top, total = np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)
        for blob in t["sums"].to_pylist():
            where, more, sums_of = _unpacked(blob, np.uint16, np.int64, np.int64)
            top[where] += more
            total[where] += sums_of
        idx = np.flatnonzero(total)
        return pa.table({"chunk": pa.array(np.full(len(idx), key[0].as_py())), "idx": pa.array(idx.astype(np.int32)), "n_best": pa.array(top[idx]), "count_sum": pa.array(total[idx])})
    by_doc = sums.groupBy("chunk").applyInArrow(together, "chunk long, idx int, n_best long, count_sum long")
    documents = rows.select("doc_id", "chunk", "idx", "n_a", "n_b", "n_groups", "groups_sha256").join(by_doc, ["chunk", "idx"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for head, best in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, links = _read_head(head)
                marks = np.unpackbits(_unpacked(best, np.uint8)[0])[:len(keys)].astype(bool)
                b_id, a_id = np.divmod(keys, sizes_here())
                yield pa.RecordBatch.from_arrays([pa.array(a_id), pa.array(b_id), pa.array(links), pa.array(marks)], ["a_id", "b_id", "links", "best"])
    return Alignment(documents, counts.select("head", "best").mapInArrow(opened, "a_id long, b_id long, links long, best boolean"))
