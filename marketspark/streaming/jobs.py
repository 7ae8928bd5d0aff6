"""Structured Streaming jobs: watermarked windows, stream joins, alerts, dedupe, state.

Every function takes streaming DataFrames (post rows with ``ts``/``compound``, tick rows
with ``ts``/``price``) and returns a streaming DataFrame, so the same code runs on a Kafka
source (``parse_posts``/``parse_ticks`` over the ``value`` column) or on a file source.
``run_to_table`` drives one to completion with ``availableNow`` for batch-style checks.
"""

from __future__ import annotations

import os
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.signals import post_alerts
from marketspark.operators.sequence import interval_micros
from marketspark.operators.windows import price_windows, sentiment_windows, window_minutes
from marketspark.session import scratch_path
from marketspark.streaming.sinks import latest_state, make_sink, parquet_writer, read_batches

WATERMARK = "10 minutes"
WINDOW = "5 minutes"


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet folder as a stream (schema taken from the folder)."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def stream_sentiment(posts: DataFrame, window: str = WINDOW, slide: str | None = None,
                     watermark: str = WATERMARK, threshold: float = 0.15, panes: bool = False) -> DataFrame:
    """Watermarked post windows (append: a window is emitted once the watermark passes it;
    rows later than the watermark are dropped).

    ``panes=True`` (sliding windows whose length is a multiple of the slide) chains two
    windowed aggregations: rows -> slide-wide panes, then panes (at their ``window_time``)
    -> sliding windows, so state grows with panes, not rows x window/slide.  In-order input
    gives identical windows; rows later than the watermark may be dropped at pane rather
    than window granularity (both are within Spark's watermark contract), so the direct
    form stays the default."""
    wm = posts.withWatermark("ts", watermark)
    if not (panes and slide and interval_micros(window) % interval_micros(slide) == 0
            and interval_micros(window) > interval_micros(slide)):
        return sentiment_windows(wm, window, slide, panes=False)
    c = F.col("compound")
    panes = wm.groupBy(F.window("ts", slide).alias("pw"), "ticker").agg(
        F.sum(c).alias("_s"), F.count(c).alias("_n"), F.count(F.lit(1)).alias("_rows"),
        F.count("post_id").alias("_ids"), F.count(F.when(c > threshold, 1)).alias("_bull"),
        F.count(F.when(c < -threshold, 1)).alias("_bear"))
    panes = panes.select(F.window_time("pw").alias("_pt"), "ticker", "_s", "_n", "_rows", "_ids", "_bull", "_bear")
    g = panes.groupBy(F.window("_pt", window, slide).alias("w"), "ticker").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"),
        F.sum("_ids").alias("tweet_count"), F.sum("_bull").alias("_bull"), F.sum("_bear").alias("_bear"))
    return g.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    (F.col("_s") / F.col("_n")).alias("avg_sentiment"), "tweet_count",
                    (F.col("_bull") / F.col("_rows")).alias("bullish_ratio"),
                    (F.col("_bear") / F.col("_rows")).alias("bearish_ratio"),
                    (F.col("tweet_count") / F.lit(window_minutes(window))).alias("velocity"))


def stream_prices(ticks: DataFrame, window: str = WINDOW, slide: str | None = None,
                  watermark: str = WATERMARK) -> DataFrame:
    return price_windows(ticks.withWatermark("ts", watermark), window, slide)


def stream_join(posts: DataFrame, ticks: DataFrame, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """Stream-stream inner join of the two windowed aggregates on (ticker, window)
    (append mode: a pair is emitted when both closed windows have arrived)."""
    s = stream_sentiment(posts, window, watermark=watermark)
    p = stream_prices(ticks, window, watermark=watermark)
    return s.join(p, ["ticker", "window_start", "window_end"], "inner")


def stream_union(posts: DataFrame, ticks: DataFrame, window: str = WINDOW, watermark: str = WATERMARK,
                 threshold: float = 0.15) -> DataFrame:
    """Low-latency form of the join: one tagged union stream, one windowed aggregate with
    conditional averages (works in update mode, emits a window as soon as it changes)."""
    u = posts.select("ticker", "ts", F.col("compound"), F.lit(None).cast("double").alias("price")).unionByName(
        ticks.select("ticker", "ts", F.lit(None).cast("double").alias("compound"), F.col("price")))
    c = F.col("compound")
    g = u.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "ticker").agg(
        F.avg(c).alias("avg_sentiment"), F.count(c).alias("tweet_count"),
        F.avg(F.when(c > threshold, 1.0).when(c.isNotNull(), 0.0)).alias("bullish_ratio"),
        F.avg(F.when(c < -threshold, 1.0).when(c.isNotNull(), 0.0)).alias("bearish_ratio"),
        F.avg("price").alias("avg_price"), F.count("price").alias("price_tick_count"))
    return g.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "avg_sentiment", "tweet_count", "bullish_ratio", "bearish_ratio", "avg_price", "price_tick_count")


def stream_post_alerts(posts: DataFrame) -> DataFrame:
    """Stateless per-record alerting on the scored post stream (append)."""
    return post_alerts(posts)


def dedupe_stream(posts: DataFrame, key: str = "post_id", watermark: str = WATERMARK) -> DataFrame:
    """Drop repeated ids (first arrival wins) keeping state only within the watermark."""
    return posts.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def stream_board(ticks: DataFrame) -> DataFrame:
    """Per-ticker board state: latest (price, volume, ts) by (ts, tick_id); update mode."""
    g = ticks.groupBy("ticker").agg(F.max_by(F.struct("ts", "tick_id", "price", "volume"),
                                             F.struct("ts", "tick_id")).alias("_b"))
    return g.select("ticker", "_b.ts", "_b.tick_id", "_b.price", "_b.volume")


def stream_change_feed(ticks: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Push messages for new ticks and, given the scored post stream, for each new post and each alert
    it raises; the stream checkpoint is the high-water mark, so each message is emitted exactly
    once across restarts.  An alert's id is its time in microseconds."""
    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")

    out = ticks.select(F.lit("new_ticks").alias("type"), F.col("tick_id").cast("string").alias("id"), "ticker",
                       F.to_json(F.struct("ticker", "price", "volume", iso("ts"))).alias("payload"))
    if posts is None:
        return out
    tweets = posts.select(F.lit("new_tweet").alias("type"), F.col("post_id").cast("string").alias("id"), "ticker",
                          F.to_json(F.struct(F.col("post_id").alias("id"), "ticker", iso("ts"), "compound")).alias("payload"))
    number = F.unix_micros("timestamp")
    alerts = post_alerts(posts)
    alerts = alerts.select(F.lit("new_alerts").alias("kind"), number.cast("string").alias("id"), "ticker",
                           F.to_json(F.struct(number.alias("id"), "ticker", "severity", "message", "type", iso("timestamp"))).alias("payload"))
    return out.unionByName(tweets).unionByName(alerts.withColumnRenamed("kind", "type"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 key: list[str] | None = None, run: str | None = None) -> DataFrame:
    """Run ``stream`` until all available input is processed (``availableNow``) into an
    idempotent per-batch parquet sink under the shared checkpoint folder; return the
    result as a batch DataFrame (update mode: the latest row per ``key``).
    Calls with the same ``run`` folder go on from each other's checkpoint."""
    run = run or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    out, ckpt = os.path.join(run, "out"), os.path.join(run, "checkpoint")
    q = (stream.writeStream.outputMode(mode).foreachBatch(make_sink(parquet_writer(out)))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if not wrote(q):                # no micro-batch ran, so there is no output folder
        return spark.createDataFrame([], stream.schema)
    if mode == "update" and key:
        return latest_state(spark, out, key)
    return read_batches(spark, out)


def advance(stream: DataFrame, run: str, mode: str = "append", sink=None):
    """Process the input there is and stop; the next call goes on from the checkpoint in ``run``.  Returns the query.

    Without a sink the rows go nowhere: the stream is run for its state."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(run, "checkpoint")).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("noop")).start()
    q.awaitTermination()
    return q


def read_state(spark: SparkSession, run: str, batch_id: int | None = None, operator: int = 0) -> DataFrame:
    """Rows (partition_id, key, value) of a stateful operator as of the last committed batch, or of ``batch_id``.

    Read from the checkpoint by Spark's state data source, in one task per state partition, beside a running query."""
    r = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        r = r.option("batchId", batch_id)
    return r.load(os.path.join(run, "checkpoint"))


def state_versions(spark: SparkSession, run: str) -> DataFrame:
    """The stateful operators of a checkpoint: name, state store, partitions, batches that can be read."""
    return spark.read.format("state-metadata").load(os.path.join(run, "checkpoint"))


def board_from_state(spark: SparkSession, run: str, batch_id: int | None = None) -> DataFrame:
    """The board (ticker, ts, tick_id, price, volume) out of the state of ``stream_board``.

    The aggregate's buffer holds the row and the order it was chosen by; the row is its first field."""
    state = read_state(spark, run, batch_id)
    row = state.schema["value"].dataType.fields[0].name
    return state.select("key.ticker", *[F.col(f"value.{row}.{c}").alias(c) for c in ("ts", "tick_id", "price", "volume")])


def wrote(query) -> bool:
    """Whether the query ran any micro-batch (each writes its folder, even when empty)."""
    return any(p["batchId"] >= 0 and p["durationMs"].get("addBatch") is not None for p in query.recentProgress)


def dropped_by_watermark(query) -> int:
    """Rows dropped as too late, over all micro-batches that the query still reports.

    Spark keeps ``spark.sql.streaming.numRecentProgressUpdates`` of them (100 by default)."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def correlation_enricher(ticks: DataFrame, posts: DataFrame, window: str = WINDOW, lookback: str = "2 minutes",
                         min_ticks: int = 5):
    """``enrich`` for ``joined_window_sink``: adds the windows' sentiment-price Pearson.

    For a micro-batch of closed windows it reads only their time range from the stored
    ticks and posts (a literal range predicate, pushed into the scans) and runs the batch
    alignment and correlation operators; windows with too few ticks get NULL."""
    from marketspark.operators.align import rolling_sentiment_at_ticks
    from marketspark.operators.correlation import window_correlation

    def enrich(batch: DataFrame) -> DataFrame:
        b = batch.agg(F.date_format(F.min("window_start"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("lo"),
                      F.date_format(F.max("window_end"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("hi")).first()
        if b is None or b["lo"] is None:
            return batch.withColumn("pearson", F.lit(None).cast("double"))
        lo, hi = F.expr(f"TIMESTAMP '{b['lo']}'"), F.expr(f"TIMESTAMP '{b['hi']}'")
        t = ticks.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
        p = posts.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
        c = window_correlation(rolling_sentiment_at_ticks(t, p, window=window, lookback=lookback), min_ticks)
        return batch.join(c.select("ticker", "window_start", "window_end", "pearson"),
                          ["ticker", "window_start", "window_end"], "left")
    return enrich


def _since(lookback_us: int):
    """A UDF over one window's rows: for each tick the posts of the ``lookback_us`` before it, as the sums of their whole and
    fractional parts and their number.  Times are ascending; a tick finds both ends of its stretch in the running sums."""
    @F.arrow_udf("array<struct<whole: bigint, part: bigint, n: bigint>>")
    def since(ticks: pa.Array, posts: pa.Array, whole: pa.Array, part: pa.Array) -> pa.Array:
        offsets, out = [0], []
        for t, p, *sums in zip(ticks, posts, whole, part):
            at, post = (x.values.to_numpy(zero_copy_only=False) for x in (t, p))
            last = np.searchsorted(post, at, "right")
            first = np.searchsorted(post, at - lookback_us, "left")
            run = [np.append(0, np.cumsum(x.values.to_numpy(zero_copy_only=False).astype(np.int64))) for x in sums]
            out.append(pa.StructArray.from_arrays([pa.array(r[last] - r[first], pa.int64()) for r in run] + [pa.array(last - first, pa.int64())],
                                                  ["whole", "part", "n"]))
            offsets.append(offsets[-1] + len(at))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(out)) if out else pa.array([], LISTED)
    return since


LISTED = pa.list_(pa.struct([(c, pa.int64()) for c in ("whole", "part", "n")]))


def stream_interval_correlation(posts: DataFrame, ticks: DataFrame, window: str = WINDOW, lookback: str = "2 minutes",
                                watermark: str = WATERMARK, min_ticks: int = 5, salts: int = 1) -> DataFrame:
    """Per (ticker, window) the guarded Pearson of price and trailing sentiment, computed in state.

    Two stateful steps in one append-mode query, both evicted by the watermark:

    1. an aggregate per (ticker, window) that gathers the ticks and the posts of the window; once the watermark is
       ``lookback`` past its end, each tick gets the mean compound of the posts in [tick - ``lookback``, tick] of its
       window (0 without any).  The mean is the difference of two running sums over the posts in order of time, so a
       window costs its ticks and posts, never their pairs; sums are exact, so they do not depend on arrival order;
    2. an aggregate per (ticker, window): covariance, variances, first and last price.

    A tick that arrives twice counts once.  The first step's key holds the window, so one ticker's state is spread over
    its open windows; ``salts`` deals a hot ticker's ticks over that many rows of state, each with its own copy of the
    posts.  Results equal the batch operators' on closed windows."""
    from marketspark.operators.align import ALIGN_DIGITS, SUM
    from marketspark.operators.correlation import window_aggregates
    # a window waits for the look-back as well
    late = f"{interval_micros(watermark) + interval_micros(lookback)} microseconds"
    exact = F.col("compound").cast(SUM)
    whole = F.floor(exact)
    post = F.struct(F.unix_micros("ts").alias("us"), whole.cast("bigint").alias("whole"), ((exact - whole) * 10 ** 12).cast("bigint").alias("part"))
    tick = F.struct(F.unix_micros("ts").alias("us"), "tick_id", "price")
    p = (posts.where(F.col("compound").isNotNull() & F.col("ticker").isNotNull()).withWatermark("ts", late)
         .select("ticker", "ts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), post.alias("_post")))
    t = ticks.withWatermark("ts", late).select("ticker", "ts", F.pmod(F.xxhash64("tick_id"), F.lit(salts)).cast("int").alias("_salt"), tick.alias("_tick"))
    p, t = p.withColumn("_tick", F.lit(None).cast(t.schema["_tick"].dataType)), t.withColumn("_post", F.lit(None).cast(p.schema["_post"].dataType))
    each = t.unionByName(p).groupBy(F.window("ts", window).alias("w"), "ticker", "_salt").agg(
        F.collect_list("_tick").alias("_ticks"), F.collect_list("_post").alias("_posts"))
    each = each.select("ticker", F.window_time("w").alias("_at"), F.sort_array("_ticks").alias("_ticks"), F.sort_array("_posts").alias("_posts"))
    each = each.withColumn("_ticks", F.filter("_ticks", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("_ticks", i - 1))))
    near = _since(interval_micros(lookback))(F.col("_ticks.us"), F.col("_posts.us"), F.col("_posts.whole"), F.col("_posts.part"))
    rows = each.withColumn("_near", near).select("ticker", "_at", F.explode(F.arrays_zip("_ticks", "_near")).alias("_x"))
    found, n = F.col("_x._near"), F.col("_x._near.n")
    total = found["whole"].cast("decimal(20,0)") + found["part"].cast("decimal(20,0)") * F.lit(Decimal("0.000000000001"))
    mean = F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))
    rows = rows.select("ticker", "_at", F.timestamp_micros("_x._ticks.us").alias("ts"), F.col("_x._ticks.tick_id").alias("tick_id"),
                       F.col("_x._ticks.price").alias("price"), F.round(mean, ALIGN_DIGITS).alias("sentiment"))
    g = window_aggregates(rows.groupBy(F.window("_at", window).alias("w"), "ticker"), rows, "sentiment")
    return g.where(F.col("n_ticks") >= min_ticks).select(
        "ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_ticks", "pearson",
        F.lit(0).alias("lag"), "first_price", "last_price",
        F.try_divide(F.col("last_price") - F.col("first_price"), F.col("first_price")).alias("momentum"))


def run_joined_sink(spark: SparkSession, posts: DataFrame, ticks: DataFrame, window: str = WINDOW,
                    watermark: str = WATERMARK, name: str = "joined", enrich=None) -> tuple[DataFrame, DataFrame]:
    """Run the stream-stream join into the two-table sink (availableNow); return
    (aggregates, signals) as batch DataFrames."""
    from marketspark.streaming.sinks import joined_window_sink
    run = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    agg, sig = os.path.join(run, "aggregates"), os.path.join(run, "signals")
    q = (stream_join(posts, ticks, window, watermark).writeStream.outputMode("append")
         .foreachBatch(joined_window_sink(agg, sig, enrich=enrich))
         .option("checkpointLocation", os.path.join(run, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_batches(spark, agg), read_batches(spark, sig)


def scored_post_stream(raw: DataFrame, default_ts=None, model: str = "keyword") -> DataFrame:
    """Message stream (``value`` column, e.g. a Kafka source) -> typed, scored post rows
    (post_id, ticker, ts, username, compound, ...) ready for ``stream_sentiment``."""
    from marketspark.functions.sentiment import with_scores
    from marketspark.sources.records import parse_posts
    d = parse_posts(raw, default_ts)
    d = d.select(F.col("id").alias("post_id"), "ticker", F.col("timestamp").alias("ts"), "text", "username",
                 "followers")
    return with_scores(d, "text", model).drop("text")


def start_job(spark: SparkSession, stream: DataFrame, checkpoint: str, sink, mode: str = "append",
              processing_time: str | None = "15 seconds", available_now: bool = False):
    """Start a long-running stream into a ``foreachBatch`` sink.  ``checkpoint`` is a path on shared storage
    that the caller keeps across sessions: a restarted job (after a failure or redeploy) resumes from its
    committed offsets and state, so each input row is processed once into the idempotent
    sink.  ``processing_time`` is the micro-batch cadence (the reference's worker ran every
    15 seconds)."""
    w = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
