"""Helpers shared by the operators: reading tables and staging intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.session import scratch_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage on storage that every executor sees, so later steps survive the loss
    of executors and never recompute what stands here."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Have Arrow batches of texts sent to Python workers hold about ``size`` bytes.

    Spark's default of 64 MB is what one batch of long texts costs several times over - in the JVM,
    in the worker, and in what is made of it - for each core of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows kept away from learning: fold 2.  A null id is not held out (nor learned from)."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))
