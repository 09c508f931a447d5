"""Documents packed into sequences: best-fit decreasing with certified bin counts and repacking."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import slices
from lociflow.llm.scratch import Scratch, arrow_rows
from lociflow.llm.tokens import Tokeniser, kept_in_worker

TEXTS = 1024              # documents that a worker has at once


def _tokeniser(path: str) -> Tokeniser:
    return kept_in_worker(("ids", path), lambda: Tokeniser(path))


def pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document, its closing id 0 included; all but the first piece of a longer one are full."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches):
        zero = np.zeros(1, np.uint32)
        for b in slices(batches, TEXTS):
            row, part, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(_tokeniser(vocabulary).encode(b.column(1))):
                raw = np.concatenate([ids, zero]).astype("<u4").tobytes()
                n = len(raw) // 4
                at, upto, k = 0, (n - 1) % capacity + 1, 0
                while at < n:
                    row.append(r)
                    part.append(k)
                    start.append(at)
                    length.append(upto - at)
                    crc.append(zlib.crc32(raw[4 * at:4 * upto]))
                    at, upto, k = upto, upto + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    schema = named.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return named.mapInArrow(cut, schema)


def best_fit_decreasing(length: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: the longest first, each into the fullest bin that takes it.

    Open bins are stacked by the room they have left, and one bit for each room says whether there is any."""
    out = np.empty(len(length), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        left = room - size
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return out


def lower_bound(length: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions over the lengths that occur.

    One counts an item over C - e as a whole bin and one under e as none; the other, for k = 1, 2, …, counts an item as
    floor((k + 1)x / C) / k of a bin, or as x / C if (k + 1)x / C is whole. Under either, what fits one bin counts as one at most.
    """
    if not len(length):
        return 0
    n = np.bincount(length, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * x)
    e = np.arange(0, capacity // 2 + 1)
    large = count[capacity] - count[capacity - e]                  # over C - e
    below = np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    middle = total[capacity - e] - below
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 101):
        units, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, x * k, units * capacity)       # in units of 1 / (k * C)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, group_rows: int = 4096, fan_in: int = 8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    Full pieces are sequences of their own. The others are dealt into partitions of about ``group_rows`` and packed
    by best-fit decreasing. A partition whose bin count equals the dual-feasible lower bound is
    certified and done. One with a gap keeps its fullest bins and releases the documents
    of its emptiest eighth; ``fan_in`` such partitions exchange what they released, and pack it anew, until one is left. A
    repacking that saves no bin leaves the old bins. What is released shrinks as partitions do, so a later
    round's partition is no larger than a first one.

    Null text is empty: its closing id 0 alone, one token. Null identifiers and repeated rows are packed like any
    other. An empty table gives an empty result. Only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    made = pieces(docs, vocabulary, capacity, id_col, text_col)
    with arrow_rows(docs.sparkSession, TEXTS):
        made = scratch.write(made.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    full = made.where(F.col("length") == capacity).select(
        "*", (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < capacity)
    n_groups = max(1, -(-rest.count() // group_rows))
    todo = rest.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"),
                       F.pmod(F.xxhash64("row_no"), F.lit(n_groups)).alias("group"))
    shape = todo.schema
    def repacked(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("row_no")
            length, was = table["length"].to_numpy(), table["sequence_id"].to_pandas().to_numpy()
            group = table["group"][0].as_py()
            bins = best_fit_decreasing(length, capacity)
            ids = (level << 56) + (group << 24) + bins
            if level and len(np.unique(was)) <= bins.max() + 1:
                ids, bins = was.astype(np.int64), np.unique(was, return_inverse=True)[1]
            order = np.lexsort((np.arange(len(bins)), bins))
            before = np.cumsum(length[order]) - length[order]
            first = np.concatenate([[True], np.diff(bins[order]) > 0])
            offset = np.empty(len(bins), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            fill = np.bincount(bins, weights=length)
            next_group = np.full(len(bins), -1, np.int64)          # -1: stays where it is
            if not last and len(fill) > lower_bound(length, capacity):
                worst = np.argsort(fill, kind="stable")[:max(1, len(fill) // fan_in)]
                next_group[np.isin(bins, worst)] = group // fan_in
            return table.set_column(table.schema.get_field_index("sequence_id"), "sequence_id", pa.array(ids, pa.int64())) \
                .set_column(table.schema.get_field_index("offset"), "offset", pa.array(offset, pa.int64())) \
                .set_column(table.schema.get_field_index("group"), "group", pa.array(next_group, pa.int64()))
        return run

    done, level = [full], 0
    while True:
        last = n_groups == 1
        packed = todo.groupBy("group").applyInArrow(repacked(level, last), shape)
        if last:
            done.append(packed.drop("group"))
            break
        packed = scratch.write(packed, f"round{level}")
        done.append(packed.where("group < 0").drop("group"))
        todo, level, n_groups = packed.where("group >= 0"), level + 1, -(-n_groups // fan_in)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("row_no")
