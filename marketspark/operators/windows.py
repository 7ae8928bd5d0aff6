"""Event-time window aggregates: sentiment, price, OHLC bars.

All are ``groupBy(window, ticker)`` with declarative aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle: a hot ticker costs one pre-reduced row
per map task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.topk import order_key
from marketspark.operators.sequence import interval_micros

DEFAULT_WINDOW = "5 minutes"
BULL_THRESHOLD = 0.15


def _window(ts: str, window: str, slide: str | None) -> Column:
    return F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)


def window_minutes(window: str) -> float:
    return interval_micros(window) / 60_000_000


def _pane_starts(ts: str, window: str, slide: str) -> tuple[Column, Column, int]:
    """(pane number, exploded window-start micros, windows per pane) for a sliding window
    whose length is a whole number of slides (windows start at multiples of the slide)."""
    w_us, s_us = interval_micros(window), interval_micros(slide)
    per = w_us // s_us
    pane = F.floor(F.unix_micros(F.col(ts)) / F.lit(s_us)).cast("long")
    return pane, F.lit(s_us), per


def _panes_ok(window: str, slide: str | None) -> bool:
    return bool(slide) and interval_micros(window) % interval_micros(slide) == 0 \
        and interval_micros(window) > interval_micros(slide)


def sentiment_windows(posts: DataFrame, window: str = DEFAULT_WINDOW, slide: str | None = None,
                      threshold: float = BULL_THRESHOLD, ts: str = "ts", id_col: str = "post_id",
                      panes: bool = True) -> DataFrame:
    """(ticker, window_start, window_end, avg_sentiment, tweet_count, bullish_ratio,
    bearish_ratio, velocity) per ticker and tumbling (or sliding) window.

    bullish/bearish ratio: share of posts with compound strictly above ``threshold`` /
    below ``-threshold``; velocity = posts per minute of window length.

    Sliding windows whose length is a multiple of the slide are built from slide-wide
    panes: raw rows are reduced once per (ticker, pane), and only the pane sums are
    copied into the window/slide windows that contain them (instead of copying every
    row, as ``window(ts, w, slide)`` does).  ``panes=False`` keeps the direct form
    (used on streams).
    """
    c = F.col("compound")
    if panes and _panes_ok(window, slide):
        pane, s_us, per = _pane_starts(ts, window, slide)
        pn = posts.groupBy("ticker", pane.alias("_pane")).agg(
            F.sum(c).alias("_s"), F.count(c).alias("_n"), F.count(F.lit(1)).alias("_rows"),
            F.count(F.col(id_col)).alias("_ids"),
            F.count(F.when(c > threshold, 1)).alias("_bull"), F.count(F.when(c < -threshold, 1)).alias("_bear"))
        pn = pn.withColumn("_k", F.explode(F.sequence(F.col("_pane") - (per - 1), F.col("_pane"))))
        g = pn.groupBy("ticker", "_k").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"),
                                          F.sum("_rows").alias("_rows"),
                                          F.sum("_ids").alias("tweet_count"), F.sum("_bull").alias("_bull"),
                                          F.sum("_bear").alias("_bear"))
        start = F.timestamp_micros(F.col("_k") * s_us)
        return g.select("ticker", start.alias("window_start"),
                        (start + F.expr(f"INTERVAL {window}")).alias("window_end"),
                        (F.col("_s") / F.col("_n")).alias("avg_sentiment"), "tweet_count",
                        (F.col("_bull") / F.col("_rows")).alias("bullish_ratio"),
                        (F.col("_bear") / F.col("_rows")).alias("bearish_ratio"),
                        (F.col("tweet_count") / F.lit(window_minutes(window))).alias("velocity"))
    agg = posts.groupBy(_window(ts, window, slide).alias("w"), "ticker").agg(
        F.avg(c).alias("avg_sentiment"),
        F.count(F.col(id_col)).alias("tweet_count"),
        F.avg(F.when(c > threshold, 1.0).otherwise(0.0)).alias("bullish_ratio"),
        F.avg(F.when(c < -threshold, 1.0).otherwise(0.0)).alias("bearish_ratio"),
    )
    return agg.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "avg_sentiment", "tweet_count", "bullish_ratio", "bearish_ratio",
                      (F.col("tweet_count") / F.lit(window_minutes(window))).alias("velocity"))


def trailing_sentiment(posts: DataFrame, as_of: Column, lookback: str = DEFAULT_WINDOW,
                       threshold: float = BULL_THRESHOLD, ts: str = "ts", id_col: str = "post_id") -> DataFrame:
    """The worker's rolling aggregate evaluated at one instant: posts with
    as_of - lookback <= ts <= as_of, per ticker (window_start/window_end = the bounds)."""
    start = as_of - F.expr(f"INTERVAL {lookback}")
    c = F.col("compound")
    p = posts.filter((F.col(ts) >= start) & (F.col(ts) <= as_of))
    agg = p.groupBy("ticker").agg(
        F.avg(c).alias("avg_sentiment"), F.count(F.col(id_col)).alias("tweet_count"),
        F.avg(F.when(c > threshold, 1.0).otherwise(0.0)).alias("bullish_ratio"),
        F.avg(F.when(c < -threshold, 1.0).otherwise(0.0)).alias("bearish_ratio"))
    return agg.select("ticker", start.alias("window_start"), as_of.alias("window_end"), "avg_sentiment",
                      "tweet_count", "bullish_ratio", "bearish_ratio",
                      (F.col("tweet_count") / F.lit(window_minutes(lookback))).alias("velocity"))


def price_windows(ticks: DataFrame, window: str = DEFAULT_WINDOW, slide: str | None = None,
                  ts: str = "ts") -> DataFrame:
    """(ticker, window_start, window_end, avg_price, price_tick_count)."""
    agg = ticks.groupBy(_window(ts, window, slide).alias("w"), "ticker").agg(
        F.avg("price").alias("avg_price"), F.count("price").alias("price_tick_count"))
    return agg.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "avg_price", "price_tick_count")


def ohlc_bars(ticks: DataFrame, window: str = DEFAULT_WINDOW, slide: str | None = None, ts: str = "ts",
              id_col: str = "tick_id") -> DataFrame:
    """OHLCV bars: open/close = first/last price in (ts, id) order, high/low, summed volume."""
    order = order_key(ticks, [ts, id_col])
    if order is None:
        order = F.struct(F.col(ts), F.col(id_col))
    agg = ticks.groupBy(_window(ts, window, slide).alias("w"), "ticker").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_ticks"))
    return agg.select("ticker", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "open", "high", "low", "close", "volume", "n_ticks")


def join_windows(sentiment: DataFrame, price: DataFrame) -> DataFrame:
    """Inner equi-join of sentiment and price window aggregates on (ticker, window)."""
    return sentiment.join(price, ["ticker", "window_start", "window_end"], "inner")
