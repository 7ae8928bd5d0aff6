"""Connectors: message-bus streams, JDBC tables, partitioned appends, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketspark.plans.snapshots import CSV_HEADER


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """Subscribe to a topic (needs the Kafka connector on the classpath); feed the result to
    ``parse_posts`` / ``parse_ticks``, which read its binary ``value`` column."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", starting).load())


def kafka_sink(records: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish (key, value) records (see ``encode_records``) to a topic."""
    return (records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Table scan over JDBC, range-partitioned on a numeric column when given."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def append_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Row inserts as a partitioned parquet append (e.g. by day), sorted for row-group skipping."""
    w = df.sortWithinPartitions(*[c for c in ("ticker", "ts") if c in df.columns]).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """CSV export with the UI's header; fields holding a comma are quoted by the writer.

    Rows are rebalanced into parts of Spark's advisory size, each a file with the header: a small export is one
    file, a large one as many as it needs, written in parallel.  ``files`` sets their number instead."""
    out = rows.select(*CSV_HEADER)
    (out.repartition(files) if files else out.hint("rebalance")).write.mode("overwrite").option("header", True).csv(path)
