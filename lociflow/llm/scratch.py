"""Tables written to the shared checkpoint folder, and the choice of whole rows by key."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lociflow.session import ensure_checkpoint_dir


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """No more than ``rows`` rows go to Python at once in the jobs that run meanwhile: a batch of whole texts lies in the
    executor and in its Python worker at the same time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Named tables in one folder under ``spark.checkpoint.dir``.

    A table that a result still reads has to stay; ``drop`` removes those that a
    later table has replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = hadoop(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Equal for rows that repeat both identifier and text, null counting as a value."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
                       F.xxhash64(F.col(text_col)).cast("string"), F.length(text_col).cast("string"))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is in ``keys(row_key)``, repeated rows once, in the columns of ``docs``.

    Repeats fall together before the shuffle, so a row that makes up much of the table sends one row from each partition.
    """
    named = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("row_key")).dropDuplicates(["row_key"])
    return named.join(keys.select("row_key"), "row_key", "left_semi").select("row.*")
