"""SimHash fingerprints linked by anchor-point covering."""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import slices
from lociflow.llm.scratch import Scratch, keep_rows, row_key
from lociflow.operators.graph import connected_components

SEED = 42
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is set if it is in over half the XXH64 values of the word shingles; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(start[at:upto].tolist(), end[at + k - 1:upto + k - 1].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


class PerfectCode:
    """A perfect cyclic code of ``n`` bits and the codewords around any word.

    ``near[s]`` lists the error patterns of syndrome s with weight up to ``reach``; the word without one of them
    is a codeword. A codeword is named by its bits above the check bits.
    """

    def __init__(self, n: int, generator: int, reach: int):
        self.n, self.check = n, generator.bit_length() - 1
        remainder = []
        for i in range(n):
            r = 1 << i
            for j in range(i, self.check - 1, -1):
                if r >> j & 1:
                    r ^= generator << (j - self.check)
            remainder.append(r)
        self.parity = np.zeros(1 << (n - self.check), np.int64)
        for i in range(n - self.check):
            self.parity[1 << i:2 << i] = self.parity[:1 << i] ^ remainder[self.check + i]
        near = [[] for _ in range(1 << self.check)]
        for weight in range(reach + 1):
            for places in combinations(range(n), weight):
                s = 0
                for p in places:
                    s ^= remainder[p]
                near[s].append(sum(1 << p for p in places))
        self.count = np.array([len(x) for x in near])
        self.near = np.array([x + [0] * (self.count.max() - len(x)) for x in near], np.int64)

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, codeword) for every codeword within reach."""
        s = self.parity[words >> self.check] ^ (words & ((1 << self.check) - 1))
        k = self.count[s]
        index = np.repeat(np.arange(len(words)), k)
        nth = np.arange(len(index)) - np.repeat(np.cumsum(k) - k, k)
        return index, (words[index] ^ self.near[s[index], nth]) >> self.check


# Generator polynomials of the Golay code of 23 bits (covering radius 3) and the
# Hamming code of 15 bits (covering radius 1). Their anchors lie within the radius plus a threshold of one bit.
GOLAY = (23, 0b110001110101, 4)
HAMMING = (15, 0b10011, 2)
MAX_DISTANCE = 3


def _window(fp: np.ndarray, first: int, bits: int) -> np.ndarray:
    return ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def local_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest of its group) of distinct fingerprints linked within a cell; lone ones are left out."""
    n, root = len(fp), np.full(len(fp), -1, np.int64)
    fp = np.sort(fp)
    if n <= 1024:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        degree = near.sum(1)
        todo = np.flatnonzero(degree > 1)
    else:
        near, todo = None, np.arange(n)
    open_ = np.ones(n, bool)
    for i in todo:
        if not open_[i]:
            continue
        open_[i] = False
        front = np.array([i])
        while len(front):
            rest = np.flatnonzero(open_)
            if near is not None:
                new = rest[near[np.ix_(front, rest)].any(0)]
            else:
                got = np.zeros(len(rest), bool)
                step = max(1, (1 << 20) // max(1, len(rest)))
                for a in range(0, len(front), step):
                    got |= (np.bitwise_count(fp[front[a:a + step], None] ^ fp[rest][None, :]) <= distance).any(0)
                new = rest[got]
            open_[new] = False
            root[new] = i
            if len(new):
                root[i] = i
            front = new
    found = np.flatnonzero(root >= 0)
    return fp[found], fp[root[found]]


def near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    cell_rows: int = 8192) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept, row_key`` of every row.

    Fingerprints that differ in at most ``distance`` (up to 3) bits are linked; ``component_id`` is the smallest identifier
    reachable. Only distinct fingerprints are compared, so copies cost one comparison.

    Anchors are the codewords of a covering code. Two fingerprints that differ in at most
    three bits differ in at most one bit of either the lower or the upper half, so each
    half has a family of anchors on 23 of its bits: the Golay code, whose codewords cover every word within radius 3.
    A fingerprint goes to every anchor of both families within radius plus one bit (1 or 6 each); the anchor
    nearest to one of a linked pair is then shared by the other. Cells of over ``cell_rows`` are dealt out again by anchors of the
    Hamming code on the two quarters of the other half, under the same argument. A cell returns a
    star for each group, not pairs; the stars are joined by connected components over written tables.

    Null text is empty, with fingerprint zero, and linked like any other. A null identifier is never a
    component's; a component without identifiers has null. Exactly one row of a component is ``kept``: that of the smallest
    identifier, by text hash among several. Empty tables work.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {MAX_DISTANCE}")
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def prints(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fp, pa.int64())], ["doc_id", "row_key", "fp"])
    rows = scratch.write(named.mapInArrow(prints, named.drop("text").schema.add("fp", "long")), "rows")
    lead = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_key")
    distinct = scratch.write(rows.select("fp", lead.alias("lead")).groupBy("fp").agg(F.min("lead").alias("lead")), "distinct")

    def cells(batches):
        code = PerfectCode(*GOLAY)
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                i, word = code.anchors(_window(fp, 32 * half, 23))
                yield pa.RecordBatch.from_arrays([pa.array(word * 2 + half, pa.int64()), pa.array(np.zeros(len(i), np.int64)), pa.array(fp[i].view(np.int64))],
                                                 ["cell", "sub", "fp"])

    def again(batches):
        code = PerfectCode(*HAMMING)
        for b in batches:
            cell, fp = b.column(0).to_numpy(), b.column(2).to_numpy().view(np.uint64)
            for half in (0, 1):
                mine = np.flatnonzero(cell % 2 == half)
                for quarter in (0, 1):
                    i, word = code.anchors(_window(fp[mine], 32 * (1 - half) + 16 * quarter, 15))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[mine[i]]), pa.array(word * 2 + quarter + 1, pa.int64()), pa.array(fp[mine[i]].view(np.int64))],
                                                     ["cell", "sub", "fp"])
    shape = "cell long, sub long, fp long"
    placed = distinct.select("fp").mapInArrow(cells, shape)
    sizes = scratch.write(placed.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
    crowded = sizes.where(F.col("n") > cell_rows)
    n_placed = sizes.agg(F.sum("n")).first()[0] or 0
    if crowded.limit(1).count():
        hot = placed.join(crowded.select("cell"), "cell", "left_semi").mapInArrow(again, shape)
        placed = placed.join(crowded.select("cell"), "cell", "left_anti").unionByName(hot)
    n_groups = max(64, n_placed // 2048)                   # cells are small, several go to a call
    placed = placed.withColumn("group", F.pmod(F.xxhash64("cell", "sub"), F.lit(n_groups)))

    def stars(table: pa.Table) -> pa.Table:
        cell, sub, fp = (table[c].to_numpy() for c in ("cell", "sub", "fp"))
        order = np.lexsort((sub, cell))
        cell, sub, fp = cell[order], sub[order], fp[order].view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]), [True]]))
        found = [local_links(fp[a:b], distance) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
    edges = scratch.write(placed.groupBy("group").applyInArrow(stars, "a long, b long").where("a <> b").distinct(), "edges")
    joined = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(joined, "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
    known = scratch.write(rooted.drop("lead").join(roots, "root").select("fp", "lead"), "known")
    scratch.drop("sizes", "edges")
    return rows.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("lead.doc_id").alias("component_id"),
        (F.col("row_key") == F.col("lead.row_key")).alias("kept"), "row_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of ``docs``, in all its columns."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept").select("row_key").distinct()
    return keep_rows(docs, kept, id_col, text_col)
