"""From raw documents to packed sequences: each stage works on all that the one before has kept."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lociflow.llm import decontaminate, exact_dedup, overlap, packing, simhash, toxicity
from lociflow.llm.queries import BENCHMARK_WINDOW, CAPACITY, table, vocabulary
from lociflow.session import ensure_checkpoint_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash first; what differs by more than its three bits and shares four fifths of its word runs goes after it."""
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    simhash.drop_near_duplicates(docs).write.parquet(root)
    return overlap.drop_near_copies(spark.read.schema(docs.schema).parquet(root), similarity=0.8, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=BENCHMARK_WINDOW)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(), CAPACITY)


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("near dedup", without_near_copies),
          ("decontamination", without_benchmark), ("packing", packed)]

# SQL has neither the classifier nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
