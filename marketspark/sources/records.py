"""Wire records: encode rows as keyed JSON messages and parse them back.

``encode_records`` is the producer side (a Kafka-style key/value pair per row);
``parse_posts`` / ``parse_ticks`` are the consumer side of the streaming job and work on
any DataFrame with a string or binary ``value`` column (a Kafka source, a file source or
a batch table).  Malformed JSON gives a row of NULLs; a junk or missing time falls back
to ``default_ts``; ints that overflow parse as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("ticker", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("username", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("followers", T.IntegerType()),
    T.StructField("likes", T.IntegerType()), T.StructField("retweets", T.IntegerType()),
    T.StructField("views", T.IntegerType()), T.StructField("source", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()), T.StructField("bot_probability", T.DoubleType()),
])

TICK_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()), T.StructField("timestamp", T.StringType()),
])

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def encode_records(df: DataFrame, key_col: str = "ticker", ts_cols: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """(key, value) rows: key = ``key_col``, value = the row as JSON with times in ISO text."""
    cols = [F.date_format(F.col(c), ISO).alias(c) if c in ts_cols else F.col(c) for c in df.columns]
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*cols)).alias("value"))


def _parse(raw: DataFrame, schema: T.StructType, default_ts: Column | None) -> DataFrame:
    v = F.col("value").cast("string")
    d = raw.select(F.from_json(v, schema).alias("data")).select("data.*")
    ts = F.try_to_timestamp(F.col("timestamp"))
    if default_ts is not None:
        ts = F.coalesce(ts, default_ts)
    return d.withColumn("timestamp", ts)


def parse_posts(raw: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Social-post messages -> typed rows (full producer schema)."""
    return _parse(raw, POST_SCHEMA, default_ts)


def parse_ticks(raw: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Price-tick messages -> typed rows (volume as bigint)."""
    return _parse(raw, TICK_SCHEMA, default_ts)


def tick_wire(ticks: DataFrame) -> DataFrame:
    """Tick wire projection: ticker, price, volume, ISO timestamp."""
    return ticks.select("ticker", "price", "volume", F.date_format("ts", ISO).alias("timestamp"))
