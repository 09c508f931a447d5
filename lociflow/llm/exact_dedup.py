"""Exact duplicates by a tree-merge of sorted digest runs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociflow.llm.scratch import Scratch, keep_rows, row_key

WHITE = "[\\x20\\x09-\\x0D]+"
SAME = ["sha", "n_bytes", "check"]


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Every row with the row that stays of its group: ``doc_id, keep_id, group_size, kept, text_sha256, row_key``.

    Texts are equal when they agree after each run of white space became one space.
    Every input partition makes a run: its digests, each once, with its smallest
    identifier and its count. In each round ``fan_in`` neighbouring runs are dealt
    out by leading digits of the digest and merged in order, until one run is left;
    then the outcome goes down the same tree to the rows. A digest is at most once
    in a run, so a group of any size puts ``fan_in`` rows into a merge, and no task
    ever holds a whole run above the leaves. An entry is verified at every level: only digests that
    also agree in byte length and a second hash merge.

    Null text counts as empty. A row without identifier stays only if its group has
    none with one; ``keep_id`` is then null. Of rows that repeat identifier and text
    exactly one has ``kept``. An empty table gives an empty result. Only the two
    named columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                        F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ").alias("plain"))
    rows = scratch.write(plain.select(
        "doc_id", "row_key", F.unhex(F.sha2("plain", 256)).alias("sha"), F.octet_length("plain").alias("n_bytes"),
        F.xxhash64("plain").alias("check"), F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_no")), "rows")
    lead = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row_no")
    lane = F.substring("sha", 1, 2).alias("lane")          # deals the digests out, whatever the run

    def merged(entries: DataFrame, size) -> DataFrame:
        dealt = entries.repartition("node", "lane").sortWithinPartitions("node", "lane", *SAME)
        return dealt.groupBy("node", "lane", *SAME).agg(F.min("lead").alias("lead"), size.alias("size"))

    levels = [scratch.write(merged(rows.select(F.col("run").alias("node"), lane, *SAME, lead.alias("lead")),
                                   F.count("*")), "level0")]
    nodes = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while nodes > 1:
        up = levels[-1].withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        levels.append(scratch.write(merged(up, F.sum("size")), f"level{len(levels)}"))
        nodes = -(-nodes // fan_in)
    known = levels.pop()
    while levels:
        below = levels.pop().select("node", F.floor(F.col("node") / fan_in).cast("int").alias("parent"), *SAME)
        known = below.join(known.select(F.col("node").alias("parent"), *SAME, "lead", "size"), ["parent", *SAME]).drop("parent")
    known = known.select(F.col("node").alias("run"), *SAME, "lead", "size")
    return rows.join(known, ["run", *SAME]).select(
        "doc_id", F.col("lead.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("lead.row_no")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, in all their columns."""
    kept = duplicate_groups(docs, id_col, text_col).where("kept")
    return keep_rows(docs, kept, id_col, text_col)
