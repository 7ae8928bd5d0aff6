"""A change feed with one high-water mark per subscriber.

Subscribers poll; each poll carries the newest message id of its time (``head``).  The stream's state holds a
mark per subscriber: a poll yields the range of ids since that subscriber's last poll, and nothing else is
kept.  The first poll only sets the mark, as a new connection does.  A subscriber silent for longer
than ``ttl`` is forgotten (an event-time timer frees its state), and joins anew with its next poll.

Ranges, not messages, leave the stateful step, so state and shuffle grow with polls.  A subscriber's polls of a
micro-batch are followed side by side in numpy.  ``deliver`` joins the ranges with the stored messages on buckets of
ids as wide as the ranges are long, so a message meets few ranges that do not hold it.  Marks live in the checkpoint: a restarted query goes on from them
and every message reaches each subscriber once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketspark.operators.align import asof_join
from marketspark.operators.sequence import interval_micros
from marketspark.streaming.sinks import Writer, make_sink, parquet_writer

RANGES = "subscriber string, us long, after long, upto long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ID_BUCKETS = (1 << 6, 1 << 12, 1 << 18)     # ids of a bucket, for short, longer and the longest ranges
CHUNK = 1 << 16         # rows handed back at once


class Marks(StatefulProcessor):
    """Value state (last poll, mark) of one subscriber, freed by a timer ``ttl`` after its last poll."""

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "seen long, head long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["us"].to_numpy(np.int64), r["head"].to_numpy(np.int64)) for r in rows]
        us, head = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((head, us))
        us, head = us[order], head[order]
        if self.mark.exists():                                  # the poll before the first: it has the mark for its head
            last, mark = self.mark.get()
            us, head = np.append(last, us), np.append(mark, head)
        anew = np.append(True, us[1:] - us[:-1] > self.ttl)
        # the mark after each poll: the largest head since the subscriber joined
        mark = pd.Series(head).groupby(np.cumsum(anew)).cummax().to_numpy()
        new = np.flatnonzero(~anew[1:] & (head[1:] > mark[:-1]))
        self.mark.update((int(us[-1]), int(mark[-1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((int(us[-1]) + self.ttl) // 1000 + 1)
        for lo in range(0, len(new), CHUNK):
            at = new[lo: lo + CHUNK]
            yield pd.DataFrame({"subscriber": key[0], "us": us[at + 1], "after": mark[at], "upto": head[at + 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.mark.clear()
        return iter([])

    def close(self) -> None:
        pass


def with_heads(polls: DataFrame, messages: DataFrame, id_col: str = "tick_id") -> DataFrame:
    """Polls (subscriber, ts) with ``head``: the largest message id at or before their time (-1 if there is none).

    Ids grow with time, as a table's key does; where some do not, the largest so far counts."""
    m = messages.select(F.lit(0).alias("_one"), "ts", F.col(id_col).alias("_id"))
    p = polls.withColumn("_one", F.lit(0))
    return asof_join(p, m, "_one", "ts", "ts", ["_id"], right_order=["_id"]).select(*polls.columns, F.coalesce("asof__id", F.lit(-1)).alias("head"))


def poll_ranges(polls: DataFrame, ttl: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Streaming (subscriber, ts, after, upto): the ids in (after, upto] are new to the subscriber at that poll."""
    p = polls.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts"))
    ranges = p.groupBy("subscriber").transformWithStateInPandas(
        statefulProcessor=Marks(interval_micros(ttl)), outputStructType=RANGES, outputMode="append", timeMode="eventTime")
    return ranges.select("subscriber", F.timestamp_micros("us").alias("ts"), "after", "upto")


def deliver(ranges: DataFrame, messages: DataFrame, id_col: str = "tick_id", buckets: tuple[int, ...] = ID_BUCKETS) -> DataFrame:
    """Messages per subscriber: (subscriber, polled_at, columns of ``messages``), by an equi-join on buckets of ids.

    A range takes the narrowest buckets of which it covers no more than the next width holds, so it has
    few of them and few ids beside its own; a message stands in one bucket of each width."""
    first, last = F.col("after") + 1, F.col("upto")
    width = F.lit(buckets[-1])
    for narrow, wide in reversed(list(zip(buckets, buckets[1:]))):
        width = F.when(last - first < wide, F.lit(narrow)).otherwise(width)
    r = ranges.select("subscriber", F.col("ts").alias("polled_at"), "after", "upto", width.cast("bigint").alias("_width"))
    r = r.withColumn("_bucket", F.explode(F.sequence(F.floor(first / F.col("_width")), F.floor(last / F.col("_width")))))
    m = messages.withColumn("_width", F.explode(F.array(*[F.lit(w).cast("bigint") for w in buckets])))
    m = m.withColumn("_bucket", F.floor(F.col(id_col) / F.col("_width")))
    near = m.join(r, ["_width", "_bucket"]).where((F.col(id_col) > F.col("after")) & (F.col(id_col) <= F.col("upto")))
    return near.select("subscriber", "polled_at", *[F.col(f"`{c}`") for c in messages.columns])


def run_feed(spark: SparkSession, polls: DataFrame, messages: DataFrame, run: str, ttl: str = "1 hour", watermark: str = "10 minutes",
             id_col: str = "tick_id", writer: Writer | None = None) -> None:
    """Serve the polls there are and stop; the next call with the same ``run`` folder goes on.

    Deliveries go to ``run``/out, a folder per micro-batch that a replay overwrites, or to ``writer``."""
    write = writer or parquet_writer(os.path.join(run, "out"))
    sink = make_sink(lambda ranges, batch_id: write(deliver(ranges, messages, id_col), batch_id))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)       # the only store with timers and several states per key
    try:
        q = (poll_ranges(polls, ttl, watermark).writeStream.outputMode("append").foreachBatch(sink)
             .option("checkpointLocation", os.path.join(run, "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
