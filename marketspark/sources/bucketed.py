"""Ticks and posts in one bucketed, sorted table, so that the signal chain needs no exchange.

The table holds the running-sum events of the trailing average - a post enters at its time and leaves right after the
look-back, a tick reads - with the ticker and the pane (the tumbling window) of each.  It is bucketed by
(ticker, pane) and sorted by them and by time.  A tick looks back within its own window only, so everything
that a window's signal needs stands in one bucket: running sums, correlation and sentiment are
computed where the rows lie.  The pane in the bucket key spreads a hot ticker over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators.align import ALIGN_DIGITS, SUM
from marketspark.operators.correlation import MIN_TICKS, window_aggregates
from marketspark.operators.sequence import interval_micros
from marketspark.operators.signals import signal_columns

ENTER, READ, LEAVE = 0, 1, 2          # at one instant a post counts from its own time to the end of its look-back
BUCKETS = 64
KEYS = ["ticker", "pane"]


def signal_events(ticks: DataFrame, posts: DataFrame, window: str, lookback: str) -> DataFrame:
    """Rows (ticker, pane, us, kind, c, n, compound, post_id, tick_id, price).

    A post without a score enters with nothing; one whose look-back outlasts its window has no leaving row."""
    width, back = interval_micros(window), interval_micros(lookback)
    us = F.unix_micros("ts")
    pane = F.floor(us / width)
    value = F.coalesce(F.col("compound").cast(SUM), F.lit(0).cast(SUM))
    one = F.when(F.col("compound").isNotNull(), 1).otherwise(0)
    none = F.lit(None)

    def event(at, kind, sign):
        return F.struct(at.alias("us"), F.lit(kind).alias("kind"), (value * sign).cast(SUM).alias("c"), (one * sign).cast("bigint").alias("n"))

    both = F.array(event(us, ENTER, 1), event(us + back, LEAVE, -1))
    stays = F.filter(both, lambda e: F.floor(e["us"] / width) == pane)
    p = posts.select("ticker", pane.alias("pane"), "compound", F.col("post_id").cast("bigint").alias("post_id"), F.explode(stays).alias("e"))
    p = p.select("ticker", "pane", "e.*", F.when(F.col("e.kind") == ENTER, F.col("compound")).alias("compound"),
                 F.when(F.col("e.kind") == ENTER, F.col("post_id")).alias("post_id"),
                 none.cast("bigint").alias("tick_id"), none.cast("double").alias("price"))
    t = ticks.select("ticker", pane.alias("pane"), us.alias("us"), F.lit(READ).alias("kind"), F.lit(0).cast(SUM).alias("c"), F.lit(0).cast("bigint").alias("n"),
                     none.cast("double").alias("compound"), none.cast("bigint").alias("post_id"), F.col("tick_id").cast("bigint").alias("tick_id"), "price")
    return p.unionByName(t)


def write_bucketed(events: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Store ``events`` at ``path`` as the table ``name``, bucketed by ticker and pane, sorted by them and time.

    One task writes each bucket, so a bucket is one sorted file and a reader need not sort it again."""
    dealt = events.repartition(buckets, *KEYS)
    (dealt.write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS, "us", "kind").option("path", path).saveAsTable(name))
    return events.sparkSession.table(name)


def bucketed_signals(events: DataFrame, window: str, min_ticks: int = MIN_TICKS, **thresholds) -> DataFrame:
    """The signals of ``operators.signals.signals`` from one scan of the stored events."""
    width = interval_micros(window)
    run = Window.partitionBy(*KEYS).orderBy("us", "kind")
    rows = events.select("*", F.sum("c").over(run).alias("_c"), F.sum("n").over(run).alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_c").cast("double") / F.col("_n")).otherwise(F.lit(0.0))
    read = F.col("kind") == READ
    rows = rows.select(*KEYS, "kind", "compound", F.when(read, F.timestamp_micros("us")).alias("ts"), "tick_id", F.when(read, F.col("price")).alias("price"),
                       F.when(read, F.round(mean, ALIGN_DIGITS)).alias("sentiment"))
    enters = F.col("kind") == ENTER
    g = window_aggregates(rows.groupBy(*KEYS), rows, "sentiment", F.count_if(read).alias("_ticks"),
                          F.avg("compound").alias("avg_sentiment"), F.count_if(enters).alias("_posts"))
    momentum = F.try_divide(F.col("last_price") - F.col("first_price"), F.col("first_price"))
    g = g.where((F.col("_ticks") >= min_ticks) & (F.col("_posts") > 0)).withColumn("momentum", momentum)
    signal, confidence = signal_columns(F.col("avg_sentiment"), F.col("pearson"), F.col("momentum"), **thresholds)
    start = F.timestamp_micros(F.col("pane") * width)
    end = F.timestamp_micros((F.col("pane") + 1) * width)
    return g.select("ticker", start.alias("window_start"), end.alias("window_end"), end.alias("timestamp"), "pearson", F.lit(0).alias("lag"),
                    "avg_sentiment", "momentum", F.col("_ticks").alias("n_ticks"), signal.alias("signal"), confidence.alias("confidence"))


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget the table; its files stay at their path."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
