"""Micro-batch sinks: idempotent multi-table writes from ``foreachBatch``.

A micro-batch may be replayed after a failure (at-least-once delivery into
``foreachBatch``).  Each writer therefore overwrites the folder of its own batch id, so a
replay replaces rather than duplicates; errors propagate so the query stops and restarts
from its checkpoint instead of silently losing the batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, int], None]


def parquet_writer(path: str, select: Callable[[DataFrame], DataFrame] | None = None) -> Writer:
    """Writer that stores each batch under ``path/batch_id=<id>`` (overwrite = idempotent)."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = select(df) if select else df
        out.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


def jdbc_writer(url: str, table: str, properties: dict, select: Callable[[DataFrame], DataFrame] | None = None) -> Writer:
    """Store a batch in a JDBC staging table of its own, ``<table>_<batch id>`` (overwritten, so a replay
    replaces it), for the database to merge by its keys.  Needs the vendor driver."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = select(df) if select else df
        out.write.jdbc(url, f"{table}_{batch_id}", mode="overwrite", properties=properties)
    return write


def make_sink(*writers: Writer) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` callable feeding one batch to several writers, computed once."""
    def sink(df: DataFrame, batch_id: int) -> None:
        if len(writers) == 1:            # one consumer: nothing to share, no cache needed
            writers[0](df, batch_id)
            return
        df.persist()
        try:
            for w in writers:
                w(df, batch_id)
        finally:
            df.unpersist()
    return sink


def aggregates_writer(path: str) -> Writer:
    """sentiment_aggregates rows from a joined window batch (velocity = posts per minute)."""
    return parquet_writer(path, lambda df: df.select(
        "ticker", "window_start", "window_end", "avg_sentiment", "tweet_count", "bullish_ratio", "bearish_ratio",
        "velocity"))


def signals_writer(path: str) -> Writer:
    return parquet_writer(path, lambda df: df.select("ticker", "timestamp", "pearson", "lag", "signal", "confidence"))


def truncate(spark: SparkSession, path: str, schema) -> None:
    """Empty a stored table in place: overwrite it with zero rows of the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Union of all written batches (the ``batch_id`` partition column dropped)."""
    return spark.read.parquet(path).drop("batch_id")


def latest_state(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """For update-mode outputs: the row of the highest batch id per key."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in key and c != "batch_id"]
    g = d.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_s"))
    return g.select(*key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def joined_window_sink(aggregates_path: str, signals_path: str, pearson=None, enrich=None):
    """The streaming job's two-table sink: each joined-window batch is cached once and
    written as sentiment_aggregates rows and as signal rows (streaming preset rule).

    ``enrich(batch) -> batch`` may add a computed ``pearson`` column (see
    ``streaming.jobs.correlation_enricher``); otherwise ``pearson`` is the given Column, or
    NULL (which yields HOLD)."""
    from marketspark.operators.signals import signals_stream_preset

    def with_signal(df: DataFrame) -> DataFrame:
        if "pearson" not in df.columns:
            df = df.withColumn("pearson", pearson if pearson is not None else F.lit(None).cast("double"))
        return signals_stream_preset(df)

    inner = make_sink(aggregates_writer(aggregates_path), parquet_writer(signals_path, with_signal))
    if enrich is None:
        return inner

    def sink(df: DataFrame, batch_id: int) -> None:
        df.persist()                 # ``enrich`` looks at the batch before the writers do
        try:
            inner(enrich(df), batch_id)
        finally:
            df.unpersist()
    return sink
