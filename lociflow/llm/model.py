"""Bounded training sets, folds and sparse linear models over hashed features."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lociflow.llm.bytesplit import slices

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo 5; fold 0 is held out. A null identifier is held out too."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled identifiers outside fold 0.

    If there are more, those with the smallest hash of their identifier are taken:
    the same ones in every run. The chosen identifiers are bounded by ``max_rows``,
    so they are broadcast and no text is shuffled. A null label or identifier does not count; an identifier labelled
    both ways counts as 1. Of rows that repeat an identifier the text with the smallest hash is taken, so the result has
    ``max_rows`` rows at most, however often one repeats.
    """
    usable = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
              .groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("label")))
    n = usable.count()
    rank = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    if n > max_rows:                                       # a share of the hash range first, so that few rows meet in one task
        share = min(1.0, 1.3 * max_rows / n + 0.001)
        usable = usable.where(F.pmod(rank, F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = usable.orderBy(F.pmod(rank, F.lit(1 << 30)), "doc_id").limit(max_rows)
    chosen = chosen.select("doc_id", "label")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"), F.first("label").alias("label"))
    return met.select("one.text", "label")


def fitted(rows: DataFrame, features: Callable, fit: Callable) -> np.ndarray:
    """``fit(list of sparse rows, labels)`` of a bounded table ``text, label``, in one task; its float32 vector.

    ``features(column)`` yields for each text its (ascending buckets, values or None).
    """
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(zlib.compress(np.diff(i, prepend=0).astype(np.int32).tobytes(), 1), b"" if v is None else v.astype(np.float32).tobytes())
                     for i, v in features(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()),
                                              b.column(1).cast(pa.int32())], ["i", "v", "label"])

    def one(table: pa.Table) -> pa.Table:
        i, v, y = table["i"].to_pylist(), table["v"].to_pylist(), table["label"].to_numpy()
        # in an order of their own, however the rows arrive
        order = np.lexsort((y, [zlib.crc32(x) for x in v], [zlib.crc32(x) for x in i], [len(x) for x in i])) if len(y) else []
        w = fit([(np.cumsum(np.frombuffer(zlib.decompress(i[k]), np.int32), dtype=np.int32), np.frombuffer(v[k], np.float32) if v[k] else None)
                 for k in order], y[order].astype(np.float32) if len(y) else y)
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})
    made = rows.mapInArrow(sparse, "i binary, v binary, label int").groupBy(F.lit(0).alias("all")).applyInArrow(one, "w binary").first()
    return np.frombuffer(made[0], np.float32) if made else fit([], np.zeros(0, np.float32)).astype(np.float32)


def scored(docs: DataFrame, columns: list[str], text_col: str, score: Callable, name: str = "score") -> DataFrame:
    """``columns`` of every row with ``score(text column)``, an array of doubles, in one pass without a shuffle."""
    kept = docs.select(*columns, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = pa.array(np.asarray(score(b.column(b.num_columns - 1)), np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*b.schema.names[:-1], name])
    schema = kept.drop("__text").schema.add(name, "double")
    return kept.mapInArrow(run, schema)


def scored_rows(docs: DataFrame, text_col: str, score: Callable) -> DataFrame:
    """``row, score``: whole rows as structs, whatever their columns are called, in one pass without a shuffle."""
    kept = docs.select(F.struct("*").alias("row"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = pa.array(np.asarray(score(pa.compute.struct_field(b.column(0), [at])), np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["row", "score"])
    return kept.mapInArrow(run, kept.select("*").schema.add("score", "double"))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
