"""Rows behind the watermark, kept and counted.

Spark drops a row whose window the watermark has passed and counts what its state operator saw, after partial
aggregation and for the last progresses only.  ``late_gate`` is a ``foreachBatch`` sink in front of the windows: it
holds back the same rows by the same rule and stores them.  For each micro-batch it writes, in folders
of the batch id that a replay overwrites,

* ``ontime``: the rows whose window is still open, the input of the windowed aggregates,
* ``late``: the other rows, with the watermark that they missed,
* ``marks``: one row of counters - rows, late rows, the newest event time so far - for any number of batches.

The watermark of a batch is the newest event time of all earlier batches less the delay, as in Spark: it comes from the
``marks`` row of the batch before, so it survives restarts and replays.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.sequence import interval_micros

MARKS = "batch bigint, n_rows bigint, n_late bigint, watermark_us bigint, newest_us bigint"


def _mark(spark: SparkSession, path: str, batch: int) -> int | None:
    """The newest event time up to and with ``batch``."""
    if batch < 0:
        return None
    return spark.read.schema(MARKS).parquet(os.path.join(path, "marks", f"batch_id={batch}")).first()["newest_us"]


def late_gate(path: str, window: str, delay: str, ts: str = "ts"):
    """``foreachBatch`` function that parts each batch into on-time and late rows (see module doc)."""
    width, wait = interval_micros(window), interval_micros(delay)

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        newest = _mark(spark, path, batch_id - 1)
        # Spark's watermark has milliseconds
        watermark = None if newest is None else (newest - wait) // 1000 * 1000
        us = F.unix_micros(F.col(ts))
        end = (F.floor(us / width) + 1) * width
        late = F.lit(False) if watermark is None else F.coalesce(end <= F.lit(watermark), F.lit(False))
        marked = df.withColumn("_late", late)
        out = os.path.join(path, "{}", f"batch_id={batch_id}")
        marked.where("NOT _late").drop("_late").write.mode("overwrite").parquet(out.format("ontime"))
        (marked.where("_late").drop("_late").withColumn("watermark", F.timestamp_micros(F.lit(watermark or 0)))
         .write.mode("overwrite").parquet(out.format("late")))
        marks = marked.agg(F.lit(batch_id).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("n_rows"), F.count_if("_late").alias("n_late"),
                           F.lit(watermark).cast("bigint").alias("watermark_us"),
                           F.greatest(F.max(us), F.lit(newest).cast("bigint")).alias("newest_us"))
        marks.write.mode("overwrite").parquet(out.format("marks"))
    return sink


def gate_rows(stream: DataFrame, run: str, window: str, delay: str, ts: str = "ts") -> None:
    """Pass the input there is through the gate and stop; the next call with the same ``run`` goes on."""
    from marketspark.streaming.jobs import advance
    advance(stream, run, sink=late_gate(run, window, delay, ts))


def read_gate(spark: SparkSession, run: str, which: str) -> DataFrame:
    """``ontime``, ``late`` or ``marks`` rows of all batches, with their ``batch_id``."""
    return spark.read.parquet(os.path.join(run, which))
