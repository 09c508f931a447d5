"""The curve against its definition, shards against a plain sort, files skipped by range."""
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from lociflow.llm import shards

DIMS = {"lang": "lang", "source": "source", "bytes": "octet_length(text)"}


def index(cell, bits):
    after, digit = shards.curve_tables(len(cell))
    state = at = 0
    for level in range(bits - 1, -1, -1):
        corner = sum(((c >> level) & 1) << j for j, c in enumerate(cell))
        k = (state << len(cell)) | corner
        at, state = at << len(cell) | digit[k], after[k]
    return at


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = {index(c, bits): c for c in itertools.product(range(1 << bits), repeat=dims)}
    assert sorted(cells) == list(range(1 << bits * dims))
    for i in range(len(cells) - 1):
        assert sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1


def test_index_by_functions(spark):
    rows = [(a, b, c) for a in (0, 1, 5, 7) for b in (0, 3, 6) for c in (2, 7)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {tuple(r)[:3]: r.h for r in df.select("*", shards.hilbert_index([F.col(x) for x in "abc"], 3).alias("h")).collect()}
    assert got == {r: index(r, 3) for r in rows}


def plain(rows, n_shards, bits=shards.BITS):
    """Rows of ``(doc_id, text, lang, source)`` under the law of counts."""
    def values(r):
        return r[2], r[3], None if r[1] is None else len(r[1].encode())
    codes = []
    for k in range(3):
        order = sorted((values(r)[k] for r in rows), key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0))
        first = {v: i for i, v in reversed(list(enumerate(order)))}
        codes.append({v: i * (1 << bits) // len(rows) for v, i in first.items()})
    placed = []
    for r in rows:
        raw = (r[1] or "").encode()
        curve = index(tuple(codes[k][v] for k, v in enumerate(values(r))), bits)
        placed.append((curve, (r[0] is not None, r[0] or 0), len(raw) + 16, zlib.crc32(raw), r[0]))
    placed.sort(key=lambda p: p[:4])
    base, longer = divmod(len(rows), n_shards)
    ends = list(itertools.accumulate(base + (s < longer) for s in range(n_shards)))
    out, s = [], 0
    for i, (curve, _, size, crc, doc) in enumerate(placed):
        while i >= ends[s]:
            s += 1
        out.append((doc, size, crc, curve, s, i - (ends[s - 1] if s else 0)))
    return out


@pytest.mark.parametrize("n_shards", [1, 7, 40, 500])
def test_law_of_rows(spark, odd_rows, n_shards):
    rows = [(i, t, [None, "en", "de"][k % 3], ["s", "s", "s", "r", None, "t"][k % 6]) for k, (i, t) in enumerate(odd_rows)]
    rows += [(9, "the same row", "en", "s")] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    df = df.withColumn("size", F.lit("clash")).withColumn("a.b", F.lit(1)).withColumn("no", F.lit(1)).withColumn("curve", F.lit(1))
    got = shards.hilbert_shards(df, DIMS, n_shards).select("doc_id", "size", "text_crc32", "curve", "shard", "slot").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, plain(rows, n_shards)))


def test_law_of_bytes(spark):
    rows = [(i, "x" * (i % 97), "en", f"s{i % 5}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = shards.hilbert_shards(df, DIMS, 8, "bytes").groupBy("shard").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    mean = sum(len(r[1]) + 16 for r in rows) / 8
    assert len(out) == 8 and all(abs(r["size"] - mean) <= 2 * 112 and r.low == 0 and r.high == r.n - 1 for r in out)


def test_empty_and_null(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert shards.hilbert_shards(spark.createDataFrame([], schema), DIMS, 40).collect() == []
    row = shards.hilbert_shards(spark.createDataFrame([(None, None, None, None)], schema), DIMS, 40).first()
    assert (row.doc_id, row.size, row.text_crc32, row.shard, row.slot) == (None, 16, 0, 0, 0)


def test_files_are_skipped_by_every_dimension(spark, tmp_path):
    rows = [(i, "x" * (i * 7919 % 1000), ["de", "en", "es", "fr"][i % 4], f"s{i * 31 % 16:02d}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("own"))
    ranges = shards.write_shards(df, f"{tmp_path}/s", DIMS, 64)
    assert ranges.count() == 64 and ranges.agg(F.sum("rows")).first()[0] == 4000
    for within, met in (({"lang": ("en", "en")}, 40), ({"source": ("s03", "s04")}, 40), ({"bytes": (100, 199)}, 40), ({"lang": ("de", "de"), "bytes": (0, 99)}, 16)):
        got = shards.read_shards(spark, f"{tmp_path}/s", **within)
        want = df
        for name, (low, high) in within.items():
            want = want.where(F.expr(DIMS[name]).between(low, high))
        assert got.columns == df.columns and sorted(got.collect()) == sorted(want.collect())
        for name, (low, high) in within.items():
            ranges_met = ranges.where((F.col(f"max_{name}") >= low) & (F.col(f"min_{name}") <= high))
        assert ranges_met.count() < 64
        assert got.select(F.input_file_name().alias("f")).distinct().count() <= met
