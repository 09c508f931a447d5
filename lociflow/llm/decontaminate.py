"""Benchmark passages in documents by a prefix-filtered set join."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import Words, chunks, slices
from lociflow.llm.scratch import Scratch, row_key

FILTER_BITS = 22                   # of the filter before the join: 512 KB, whatever the benchmark's size
BUCKET = 1 << 15                   # bits of one bitmap of Spark's bitmap functions


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int, item_col: str, item_text: str) -> DataFrame:
    """``item, words, length, size, hashes`` of every window of every item.

    A window is ``length`` consecutive words, all of a shorter item; its set is the shingles of ``size`` words in it,
    ``shingle`` or as many as a shorter window has, in order of place.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for first, data, at in chunks(b.column(1)):
                w = Words(data, at)
                for d in range(len(at) - 1):
                    lo, hi = int(w.of[d]), int(w.of[d + 1])
                    if lo == hi:
                        continue
                    length = min(window, hi - lo)
                    size = min(shingle, length)
                    h, at_word = w.grams(size)
                    h = h[np.searchsorted(at_word, lo):np.searchsorted(at_word, hi)].view(np.int64)
                    words = [w.word(i).decode() for i in range(lo, hi)]
                    for s in range(0, hi - lo - length + 1, 4096):
                        starts = range(s, min(s + 4096, hi - lo - length + 1))
                        n = len(starts)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([first + d] * n, pa.int64())), pa.array([" ".join(words[i:i + length]) for i in starts], pa.string()),
                             pa.array([length] * n, pa.int32()), pa.array([size] * n, pa.int32()),
                             pa.array([h[i:i + length - size + 1].tolist() for i in starts], pa.list_(pa.int64()))], ["item", "words", "length", "size", "hashes"])
    return items.mapInArrow(run, "item string, words string, length int, size int, hashes array<long>")


def hash_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit for the leading ``bits`` of every hash, built by Spark; ``2 ** bits`` bits come to the driver."""
    place = F.expr(f"shiftrightunsigned(hash, {64 - bits}) + 1")
    made = hashes.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(1 << bits, bool)
    for r in made.collect():
        out[(r.bucket - 1) * BUCKET:r.bucket * BUCKET] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")[:len(out)]
    return np.packbits(out)


def _passing(w: Words, sizes: list[int], bits: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the shingles that pass the filter."""
    first, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        h, at = w.grams(size)
        maybe = np.flatnonzero(bits[h >> np.uint64(shift)])
        first.append(at[maybe])
        hashes.append(h[maybe])
    return np.concatenate(first), np.concatenate(hashes)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, filter_bits: int = FILTER_BITS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, row_key`` of every row.

    Words are runs of A-Z (lower-cased), digits and characters beyond ASCII. A window is ``window``
    consecutive words of an item, or all of a shorter item, and the set of its ``shingle``-word shingles. A document holds
    a window only if it holds all of its shingles, so one of them, its prefix, has to join: the one that is rarest over all
    documents. A first pass over the documents counts the benchmark's shingles; a window of which one does not
    occur at all is out. A second pass gives the places of prefixes, with the words around them, which meet their windows in an
    equi-join on the hash, are bounded by place and length (the window has to fit around the shingle and inside the text) and
    compared word by word, so that a hash decides nothing.

    Neither pass shuffles documents. What is broadcast is a filter of ``2 ** filter_bits`` bits; it never loses a
    shingle, and a fuller one only lets more candidates into the join. Windows and their items stay tables of
    any size; a prefix that many documents share is one side of that join, whose skewed partitions adaptive execution splits.

    Null texts have no words; items without words or of null text never occur; a null item id marks words as hit but names no
    item; repeated items count once; repeated rows each get a row; very long texts and items are read whole. Empty tables work.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(benchmark_windows(benchmark, window, shingle, item_col, item_text), "windows")
    found = found.withColumn("wid", F.sha2("words", 256))
    owners = found.where("item IS NOT NULL").select("wid", "item").distinct()
    windows = found.select("wid", "words", "length", "size", "hashes").dropDuplicates(["wid"])
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())           # 1 to ``shingle``
    shingles = scratch.write(windows.select("wid", F.posexplode("hashes").alias("at", "hash")), "shingles")
    shift = 64 - filter_bits
    named = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.monotonically_increasing_id().alias("row_no"),
                        F.col(text_col).alias("text"))

    def counter(packed: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(packed).astype(bool)
            for b in slices(batches):
                for _, data, at in chunks(b.column(0)):
                    h, n = np.unique(_passing(Words(data, at), sizes, bits, shift)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])
        return run
    counts = named.select("text").mapInArrow(counter(hash_filter(shingles, filter_bits)), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = shingles.join(counts, "hash", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at")).alias("p"))
    prefixes = rarest.where("p.n > 0").select("wid", "p.hash", "p.at").join(windows.select("wid", "words", "length"), "wid")
    prefixes = scratch.write(prefixes, "prefixes")
    kind = named.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "row_key", "row_no", "n_words", "place", "hash", "from", "around"]

    def finder(packed: np.ndarray):
        before, after = window - 1, window

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.unpackbits(packed).astype(bool)
            for b in slices(batches):
                for row, data, at in chunks(b.column(3)):
                    w, n = Words(data, at), len(at) - 1
                    size = np.diff(w.of)
                    none = pa.nulls(n, pa.int64())
                    own = b.slice(row, n)
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(size), none, none, none, pa.nulls(n, pa.string())], columns)
                    first, h = _passing(w, sizes, bits, shift)
                    if not len(first):
                        continue
                    of = np.searchsorted(w.of, first, side="right") - 1
                    lo, hi = np.maximum(first - before, w.of[of]), np.minimum(first + after, w.of[of + 1])
                    around = [" ".join(w.word(i).decode() for i in range(s, e)) for s, e in zip(lo.tolist(), hi.tolist())]
                    m = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, own.column(0).type), pa.nulls(m, pa.string()), own.column(2).take(pa.array(of)), pa.array(size[of]), pa.array(first - w.of[of]),
                         pa.array(h.view(np.int64)), pa.array(lo - w.of[of]), pa.array(around, pa.string())], columns)
        return run
    met = scratch.write(named.mapInArrow(finder(hash_filter(prefixes, filter_bits)),
                                         f"doc_id {kind}, row_key string, row_no long, n_words long, place long, hash long, from long, around string"), "met")
    rows, places = met.where("place IS NULL").select("doc_id", "row_key", "row_no", "n_words"), met.where("place IS NOT NULL")
    start = F.col("place") - F.col("at")
    near = places.join(prefixes, "hash").select("row_no", "wid", "words", "length", "n_words", "from", "around", start.alias("start"))
    fits = near.where((F.col("start") >= F.col("from")) & (F.col("start") + F.col("length") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("from") + 1).cast("int"), F.col("length")), " ")
    hits = scratch.write(fits.where(there == F.col("words")).select("row_no", "wid", "start", (F.col("start") + F.col("length")).alias("end")).distinct(), "hits")
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "end"))), none, lambda s, x: F.struct(
        (s["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["reach"]))).alias("total"), F.greatest(s["reach"], x["end"]).alias("reach")))
    spans = hits.groupBy("row_no").agg(covered["total"].alias("n_hit"))
    items = hits.select("row_no", "wid").distinct().join(owners, "wid").groupBy("row_no").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(spans, "row_no", "left").join(items, "row_no", "left").withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"), "items", "row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, in all their columns, whatever these are called.

    Null and empty texts stay, as does every row where the benchmark is empty; repeated rows share their fate; very long texts
    are searched whole; an empty table stays empty.
    """
    hit = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select("row_key").distinct()
    named = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("row_key"))
    return named.join(hit, "row_key", "left_anti").select("row.*")
