"""Near copies by the Jaccard similarity of word shingles: MinHash proposes, the sets themselves decide."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from lociflow.llm.bytesplit import slices
from lociflow.llm.scratch import Scratch, arrow_rows, keep_rows, row_key
from lociflow.llm.simhash import ASCII_LOWER
from lociflow.operators.graph import connected_components

SEED = 42
BANDS, ROWS = 24, 5       # a pair of similarity s is proposed with 1 - (1 - s^5)^24: 0.99993 at 0.8
STEP = 4096               # shingles at once under all the hash functions
COLUMNS = 4096            # shingles at once when whole sets are compared
BLOCK_SHINGLES = 1 << 19
TEXTS = 1024              # documents that a worker has at once


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes, in order, of all runs of ``size`` words; a shorter text is one run, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    of = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ of[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Bands:
    """Band keys of shingle sets."""

    def __init__(self):
        r = np.random.RandomState(SEED)
        draw = lambda n: r.randint(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.times, self.plus, self.mix = draw(BANDS * ROWS)[:, None], draw(BANDS * ROWS)[:, None], draw(BANDS * ROWS)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), STEP):
            np.minimum(least, (grams[at:at + STEP] * self.times + self.plus).min(1), out=least)
        key = ((least ^ (least >> np.uint64(31))) * self.mix).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
        return (key ^ (key >> np.uint64(33))).view(np.int64)


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles, number of them in each set)."""
    size = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.combine_chunks().flatten().to_numpy().view(np.uint64), size


def _alike(common: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    return common >= similarity * (a + b - common) - 1e-9


def set_links(grams: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets each belongs with (the first of its group) when all pairs are compared."""
    n = len(size)
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    shared = times[column] > 1
    column, of = column[shared], of[shared]
    if len(column):
        _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has, where = np.unique(of[a:b], return_inverse=True)
        part = np.zeros((len(has), COLUMNS), np.float32)
        part[where, column[a:b] - first] = 1
        common[np.ix_(has, has)] += part @ part.T
    near = _alike(common, size[:, None], size[None, :], similarity)
    root = np.arange(n)
    open_ = np.ones(n, bool)
    for i in range(n):
        if not open_[i]:
            continue
        open_[i], front = False, np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(0) & open_)
            open_[front], root[front] = False, i
    return root


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text",
                block: int = 1024) -> DataFrame:
    """``doc_id, component_id, kept, row_key`` of every row.

    Rows are linked whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``;
    ``component_id`` is the smallest identifier reachable. Pairs are proposed by sharing one of 24 bands of five MinHash
    values and decided by the whole sets, so no link is wrong; a pair of similarity 0.8 is missed with 7 in 100 000.

    Equal sets are one. In every bucket each member is first compared with the smallest. Buckets whose members are then not
    all connected are compared in full, without the pairs that are connected already through that smallest one, in tasks of two
    blocks of about ``block`` sets. Stars come back instead of pairs, and connected components join them.

    Words are those of ``simhash``. Null and empty texts are one group. A null identifier is never a component's; a component
    without identifiers has null. Exactly one row of a component is ``kept``: that of the smallest identifier, by text hash
    among several. Empty tables work.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def name_of(grams: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(grams.tobytes(), SEED)

    def marks(batches):
        bands = Bands()
        for b in slices(batches):
            found = [shingles(t, shingle) for t in b.column(2).to_pylist()]
            fp = np.array([name_of(g) for g in found], np.uint64).view(np.int64)
            keys = np.concatenate([bands.keys(g) for g in found]) if found else np.zeros(0, np.int64)
            at = np.arange(len(found) + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(fp), pa.array([len(g) for g in found], pa.int64()), pa.ListArray.from_arrays(at, pa.array(keys))],
                ["doc_id", "row_key", "fp", "size", "bands"])
    made = named.mapInArrow(marks, named.drop("text").schema.add("fp", "long").add("size", "long").add("bands", ArrayType(LongType())))
    with arrow_rows(docs.sparkSession, TEXTS):
        rows = scratch.write(made, "rows")
    lead = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_key")
    distinct = scratch.write(rows.select("fp", "size", "bands", lead.alias("lead")).groupBy("fp").agg(
        F.min("lead").alias("lead"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct")

    # buckets with several sets, and the smallest of each
    placed = distinct.select("fp", "size", F.posexplode("bands").alias("band", "key")).select("fp", "size", F.xxhash64("band", "key").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("first")).where("n > 1")
    placed = scratch.write(placed.join(several, "bucket"), "placed")
    some = placed.select("fp").distinct().join(distinct, "fp").select("fp", F.col("lead.row_key").alias("row_key"))

    def whole(batches):
        for b in slices(batches):
            found = [shingles(t, shingle) for t in b.column(0).to_pylist()]
            fp = np.array([name_of(g) for g in found], np.uint64).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
            grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.ListArray.from_arrays(at, pa.array(grams.view(np.int64)))], ["fp", "grams"])
    with arrow_rows(docs.sparkSession, TEXTS):
        sets = scratch.write(keep_rows(docs, some, id_col, text_col).select(text_col).mapInArrow(whole, "fp long, grams array<long>"), "sets")

    def linked(tasks: DataFrame, name: str, star: bool) -> DataFrame:
        """Links within each task of ``tasks(task, fp, size, head)``; with ``star`` only those to the head."""
        n = tasks.agg(F.sum("size")).first()[0] or 0
        group = F.pmod(F.xxhash64("task"), F.lit(max(64, n // BLOCK_SHINGLES)))
        fed = tasks.select("task", "fp", "head").join(sets, "fp").withColumn("group", group)

        def links(table: pa.Table) -> pa.Table:
            table = table.sort_by([("task", "ascending"), ("head", "descending"), ("fp", "ascending")])
            task, fp = (table[c].to_numpy() for c in ("task", "fp"))
            cut = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])) if len(task) else np.zeros(1, np.int64)
            a, b = [], []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
                grams, size = _sets(table["grams"].slice(i, j - i))
                if star:
                    inside = np.concatenate([[0], np.cumsum(np.isin(grams, grams[:size[0]]))])
                    end = np.cumsum(size)
                    root = np.where(_alike(inside[end] - inside[end - size], size, size[0], similarity), 0, np.arange(j - i))
                else:
                    root = set_links(grams, size, similarity)
                a.append(fp[i:j])
                b.append(fp[i:j][root])
            none = [np.zeros(0, np.int64)]
            return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})
        return scratch.write(fed.groupBy("group").applyInArrow(links, "a long, b long").where("a <> b").distinct(), name)

    def blocks(n, grams):
        return F.ceil(F.greatest(n / F.lit(float(block)), grams / F.lit(float(BLOCK_SHINGLES)))).cast("int")

    def place(many):
        return F.pmod(F.xxhash64("fp", F.lit(1)), many).cast("int")
    # every member against the smallest of its bucket
    pairs = scratch.write(placed.where("fp <> first").select("first", "fp", "size").distinct(), "pairs")
    parts = pairs.groupBy("first").agg(blocks(F.count("*"), F.sum("size")).alias("parts"))
    members = pairs.join(parts, "first").select(F.xxhash64("first", place(F.col("parts"))).alias("task"), "fp", "size", F.lit(False).alias("head"))
    heads = parts.select(F.col("first").alias("fp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        F.xxhash64("fp", "part").alias("task"), "fp", F.lit(0).cast("long").alias("size"), F.lit(True).alias("head"))
    stars = linked(members.unionByName(heads), "stars", True)

    # buckets that these links leave in several pieces
    joined = connected_components(stars).select(F.col("node").alias("fp"), "component")
    at = placed.where("n > 2").join(joined, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    mine = at.where("fp = first").select("bucket", F.col("root").alias("main"))
    at = scratch.write(at.join(mine, "bucket").withColumn("rest", F.col("root") != F.col("main")), "at")
    rest = F.col("rest").cast("int")
    kinds = at.groupBy("bucket").agg(
        blocks(F.sum(1 - rest), F.sum((1 - rest) * F.col("size"))).alias("n_main"), blocks(F.sum(rest), F.sum(rest * F.col("size"))).alias("n_rest"),
        F.sum(rest).alias("apart"), blocks(F.count("*"), F.sum("size")).alias("n_all")).where("apart > 0")
    dealt = at.join(kinds, "bucket")
    mine_at = F.when(F.col("rest"), place(F.col("n_rest"))).otherwise(place(F.col("n_main")) + F.col("n_rest"))
    # blocks of the rest come first: each of them meets every block
    dealt = dealt.withColumn("i", mine_at).withColumn("j", F.explode(
        F.when(F.col("n_all") == 1, F.array(F.lit(-1))).when(F.col("rest"), F.sequence(F.lit(0), F.col("n_rest") + F.col("n_main") - 1))
        .otherwise(F.sequence(F.lit(0), F.col("n_rest") - 1))))
    tasks = dealt.select(F.when(F.col("j") < 0, F.xxhash64("bucket")).otherwise(
        F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j"))).alias("task"), "fp", "size", F.lit(False).alias("head"))
    edges = stars.unionByName(linked(scratch.write(tasks, "tasks"), "others", False))
    joined = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = distinct.join(joined, "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("lead").alias("lead"))
    known = scratch.write(rooted.drop("lead").join(roots, "root").select("fp", "lead"), "known")
    scratch.drop("placed", "sets", "pairs", "stars", "at", "tasks", "others")
    return rows.join(known, "fp").select("doc_id", F.col("lead.doc_id").alias("component_id"),
                                         (F.col("row_key") == F.col("lead.row_key")).alias("kept"), "row_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of ``docs``, in all its columns."""
    kept = near_copies(docs, id_col=id_col, text_col=text_col, **options).where("kept").select("row_key").distinct()
    return keep_rows(docs, kept, id_col, text_col)
