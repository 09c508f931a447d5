"""Shards along a Hilbert curve over metadata, so that files can be skipped by any of several dimensions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lociflow.llm.scratch import Scratch

OVERHEAD = 16                      # bytes counted for a row beside its text
BITS = 6                           # of each dimension's code
POSITION_BITS = 33                 # of monotonically_increasing_id below the partition number


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """``after, digit`` of the curve in ``dims`` dimensions, both indexed by ``state << dims | corner``.

    A state is the corner where a cell is entered and the axis along which it is left. A corner's digit is its
    place on the reflected Gray path through the cell's corners, turned into that state.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def turn(x, by):
        by %= dims
        return ((x << by) | (x >> (dims - by))) & mask

    def path(i):
        return i ^ (i >> 1)
    place = {path(i): i for i in range(size)}

    def enters(i):
        return path((i - 1) // 2 * 2) if i else 0

    def axis(i):
        ones = i if i % 2 else max(i - 1, 0)
        return (~ones & (ones + 1)).bit_length() - 1 if i else 0
    after, digit = [], []
    for state in range(size * dims):
        corner_in, along = divmod(state, dims)
        for corner in range(size):
            w = place[turn(corner ^ corner_in, -(along + 1))]
            digit.append(w)
            after.append((corner_in ^ turn(enters(w), along + 1)) * dims + (along + axis(w) % dims + 1) % dims)
    return after, digit


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Place of a cell on the curve: one step of the state table for each bit of the codes, the highest first."""
    n = len(codes)
    after, digit = (F.lit(t) for t in curve_tables(n))

    def step(acc, level):
        corner = sum((F.call_function("shiftright", c, level).bitwiseAND(F.lit(1)) * (1 << j) for j, c in enumerate(codes)), F.lit(0))
        at = acc["state"] * (1 << n) + corner
        return F.struct(F.get(after, at).alias("state"), (acc["index"] * (1 << n) + F.get(digit, at)).alias("index"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def equal_depth(rows: DataFrame, dims: list[str], bits: int, scratch: Scratch) -> list[Column]:
    """A code of ``bits`` bits for each dimension: the share of all rows whose value is smaller, nulls first.

    Equal values are counted before anything moves; the distinct ones are sorted by ranges and added up range by
    range. What reaches the driver is the first value of each code, ``2 ** bits`` a dimension at most.
    """
    values = [f"v{k}" for k in range(len(dims))]
    types = [rows.schema[d].dataType for d in dims]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), *(
        (F.col(d) if j == k else F.lit(None).cast(t)).alias(values[j]) for j, (d, t) in enumerate(zip(dims, types)))) for k in range(len(dims)))))
    counts = rows.select(each.alias("e")).select("e.*").groupBy("dim", *values).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col(c).asc_nulls_first() for c in ("dim", *values)]
    ranged = counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    upto = F.sum("n").over(W.partitionBy("part", "dim").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ranged = scratch.write(ranged.withColumn("before", upto - F.col("n")), "depths")
    parts = ranged.groupBy("dim", "part").agg(F.sum("n").alias("n"))             # one row for each range
    earlier = W.partitionBy("dim").orderBy("part")
    parts = parts.select("dim", "part", (F.sum("n").over(earlier) - F.col("n")).alias("offset"), F.sum("n").over(W.partitionBy("dim")).alias("total"))
    code = F.expr(f"((before + offset) * {1 << bits}) div total")
    firsts = ranged.join(parts, ["dim", "part"]).groupBy("dim", code.alias("code")).agg(*(F.min(v).alias(v) for v in values)).collect()
    out = []
    for k, (d, t) in enumerate(zip(dims, types)):
        known = sorted((r["code"], r[values[k]]) for r in firsts if r["dim"] == k and r[values[k]] is not None)
        bounds = F.array(*(F.lit(v) for _, v in known)).cast(f"array<{t.simpleString()}>")
        codes = F.array(F.lit(0), *(F.lit(int(c)) for c, _ in known))
        out.append(F.when(F.col(d).isNull(), F.lit(0)).otherwise(F.get(codes, F.size(F.filter(bounds, _not_over(d))))))
    return out


def _not_over(name: str):
    return lambda bound: bound <= F.col(name)


def hilbert_shards(docs: DataFrame, dims: dict[str, str], shards: int, law: str = "rows", bits: int = BITS, keep: tuple[str, ...] = (),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, (dims…), (keep…), curve, shard, slot`` of every row.

    Each of ``dims``, a name and an SQL expression over ``docs``, is quantised to codes of equal depth; rows are sorted by the curve's index, then identifier, size and
    checksum, and the order is cut into ``shards`` runs. ``law`` is ``rows``, counts at most one apart, or
    ``bytes``: a row goes where the bytes before it lie among all, so a shard differs from the mean by a row on either
    side at most. The sort is by ranges, with the row's number as last key, so that equal rows are split as well; places
    come from the row numbers of sorted ranges and the sizes of the ranges before, one small row each.

    Null text has no bytes; a null dimension has code 0, as the smallest values have; null identifiers come first; repeated
    rows each get a slot; very long texts are read once, for their length and checksum; an empty table gives none.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    scratch = Scratch(docs.sparkSession)
    names = list(dims)
    text = F.col(text_col)
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                       F.struct(*(F.expr(e).alias(n) for n, e in dims.items())).alias("dims"),
                       F.struct(F.lit(0).alias("none"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keep))).alias("kept"),
                       F.monotonically_increasing_id().alias("no"))
    thin = scratch.write(thin, "thin")
    codes = equal_depth(thin.select(*(F.col(f"dims.`{n}`").alias(f"d{i}") for i, n in enumerate(names))), [f"d{i}" for i in range(len(names))], bits, scratch)
    coded = thin.select("*", *(F.col(f"dims.`{n}`").alias(f"d{i}") for i, n in enumerate(names)))
    coded = coded.select("doc_id", "size", "text_crc32", "dims", "kept", "no", *(c.alias(f"c{i}") for i, c in enumerate(codes)))
    keyed = coded.withColumn("curve", hilbert_index([F.col(f"c{i}") for i in range(len(codes))], bits))
    by = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("no")]
    placed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "doc_id", "size", "text_crc32", "dims", "kept", "curve", F.monotonically_increasing_id().alias("pos"))
    placed = scratch.write(placed.withColumn("part", F.shiftright("pos", POSITION_BITS)), "placed")
    ranges = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))      # one row for each range of the sort
    earlier = W.partitionBy(F.lit(0)).orderBy("part")
    ranges = scratch.write(ranges.select("part", "n", "bytes", (F.sum("n").over(earlier) - F.col("n")).alias("rows_before"),
                                         (F.sum("bytes").over(earlier) - F.col("bytes")).alias("bytes_before")), "ranges")
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    place = F.col("rows_before") + F.col("pos") - F.shiftleft(F.col("part"), POSITION_BITS)
    ranked = placed.join(ranges.select("part", "rows_before", "bytes_before"), "part").withColumn("place", place)
    if law == "rows":
        base, longer = divmod(total["n"], shards)
        cut = longer * (base + 1)                          # the first ``longer`` shards have a row more
        ahead = F.col("place") < cut
        shard = F.when(ahead, F.expr(f"place div {base + 1}")).otherwise(longer + F.expr(f"(place - {cut}) div {max(base, 1)}"))
        slot = F.when(ahead, F.col("place") % (base + 1)).otherwise((F.col("place") - cut) % max(base, 1))
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot)
    else:
        upto = F.sum("size").over(W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        shard = F.expr(f"((bytes_before + upto - size) * {shards}L) div {max(total['bytes'], 1)}L")
        out = scratch.write(ranked.withColumn("upto", upto).withColumn("shard", shard.cast("int")), "cut")
        firsts = out.groupBy("shard").agg(F.min("place").alias("first"))                                 # one row for each shard
        out = out.join(firsts, "shard").withColumn("slot", F.col("place") - F.col("first"))
    return out.select("doc_id", "size", "text_crc32", *(F.col(f"dims.`{n}`").alias(n) for n in names),
                      *(F.col(f"kept.k{i}").alias(k) for i, k in enumerate(keep)), "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, dims: dict[str, str], shards: int, law: str = "bytes", bits: int = BITS, rows_per_file: int = 1_000_000,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of ``docs`` to ``path/rows/shard=…`` in the order of the curve, and to ``path/ranges`` what each shard holds:
    rows, bytes, and of each dimension the least and greatest value and the number of nulls. Returns the latter."""
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("words"), *(F.expr(e).alias(f"by{i}") for i, e in enumerate(dims.values())))
    placed = hilbert_shards(whole, {f"by{i}": f"by{i}" for i in range(len(dims))}, shards, law, bits, ("row",), "id", "words")
    order = ["shard", "slot"]
    placed.select("row", "shard", "slot", "size", *(f"by{i}" for i in range(len(dims)))).repartitionByRange(*order).sortWithinPartitions(*order).write \
        .partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    spark = docs.sparkSession
    of = spark.read.parquet(f"{path}/rows").groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"),
        *(f(F.col(f"by{i}")).alias(f"{label}_{n}") for i, n in enumerate(dims) for label, f in
          (("min", F.min), ("max", F.max), ("nulls", lambda c: F.sum(c.isNull().cast("long"))))))
    of.coalesce(1).write.parquet(f"{path}/ranges")
    return spark.read.parquet(f"{path}/ranges")


def read_shards(spark: SparkSession, path: str, **within) -> DataFrame:
    """Rows whose dimensions lie in ``name=(low, high)``, both included; only shards whose ranges meet all of them are read."""
    ranges = spark.read.parquet(f"{path}/ranges")
    names = [c[4:] for c in ranges.columns if c.startswith("min_")]
    rows = spark.read.parquet(f"{path}/rows")
    for name, (low, high) in within.items():
        ranges = ranges.where((F.col(f"max_{name}") >= F.lit(low)) & (F.col(f"min_{name}") <= F.lit(high)))
        rows = rows.where(F.col(f"by{names.index(name)}").between(F.lit(low), F.lit(high)))
    shards = [r["shard"] for r in ranges.select("shard").collect()]              # at most the number of shards
    return rows.where(F.col("shard").isin(shards) if shards else F.lit(False)).select("row.*")


def oracle_sql(dims: dict[str, str], shards: int, bits: int = BITS) -> str:
    """The shards under law ``rows`` in DuckDB's SQL; ``dims`` name expressions over ``doc_id, text, size, lang, source``."""
    n = len(dims)
    after, digit = curve_tables(n)
    nibbles = "list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    parts = [f"""digits AS (SELECT *, string_split(hex(coalesce(text, '')), '') AS h, coalesce(strlen(text), 0) + {OVERHEAD} AS size FROM documents),
base AS (SELECT row_number() OVER () AS no, doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(2 * (size - {OVERHEAD})),
    lambda j: instr('0123456789ABCDEF', h[CASE WHEN j % 2 = 0 THEN j + 2 ELSE j END]) - 1)), lambda c, b: xor(c >> 4, t[(xor(c, b) & 15) + 1]))) AS text_crc32,
    {', '.join(f'{e} AS d{i}' for i, e in enumerate(dims.values()))} FROM digits, crc)"""]
    for i in range(n):
        parts.append(f"q{i} AS (SELECT d{i}, ((sum(count(*)) OVER (ORDER BY d{i} NULLS FIRST ROWS UNBOUNDED PRECEDING) - count(*)) * {1 << bits} // (SELECT count(*) FROM base))::bigint AS c{i} FROM base GROUP BY d{i})")
    joins = " ".join(f"JOIN q{i} ON base.d{i} IS NOT DISTINCT FROM q{i}.d{i}" for i in range(n))
    parts.append(f"l{bits} AS (SELECT base.*, {', '.join(f'c{i}' for i in range(n))}, 0::bigint AS s, 0::bigint AS curve FROM base {joins})")
    for level in range(bits - 1, -1, -1):
        corner = " + ".join(f"((c{j} >> {level}) & 1) * {1 << j}" for j in range(n))
        parts.append(f"l{level} AS (SELECT * EXCLUDE (s, curve), (SELECT a FROM steps)[s * {1 << n} + {corner} + 1] AS s, curve * {1 << n} + (SELECT d FROM steps)[s * {1 << n} + {corner} + 1] AS curve FROM l{level + 1})")
    return f"""WITH crc AS (SELECT {nibbles} AS t), steps AS (SELECT {after} AS a, {digit} AS d),
{', '.join(parts)},
placed AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS n FROM l0),
cut AS (SELECT *, n // {shards} AS base, n % {shards} AS longer FROM placed),
dealt AS (SELECT *, CASE WHEN place < longer * (base + 1) THEN place // (base + 1) ELSE longer + (place - longer * (base + 1)) // greatest(base, 1) END AS shard FROM cut)
SELECT doc_id, size::bigint AS size, text_crc32::bigint AS text_crc32, 'rows' AS law, shard::int AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::bigint AS slot, NULL::int AS grown_shard, curve FROM dealt"""
