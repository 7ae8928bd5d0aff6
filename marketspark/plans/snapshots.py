"""Snapshot queries over ticks, posts, aggregates and signals, evaluated at ``as_of``.

Each snapshot is a few per-ticker reductions (partial aggregates) joined on ticker; the
joined sides are one row per ticker, so the joins are tiny whatever the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.bands import (clock, fear_greed, label, mood5, open_or_price, pct_change)
from marketspark.operators.align import attach_containing_window
from marketspark.operators.topk import last_n_per_key, latest_per_key, top_k

# ---------------------------------------------------------------------------
# Snapshot defaults of the reference.
SUMMARY_DEFAULTS = {"avg_sentiment": 0.0, "bullish_ratio": 0.5, "tweet_count": 0, "signal": "HOLD",
                    "pearson": 0.0}
DETAIL_DEFAULTS = {"pearson": 0.0, "confidence": 0.5, "signal": "HOLD"}
TIMELINE_TICKS = 30
TRENDING_K, MOVERS_K, FEED_K = 4, 3, 6
ALERTS_DEFAULT, ALERTS_MIN, ALERTS_MAX = 20, 1, 100
CSV_HEADER = ["Ticker", "Company Name", "Price", "Volume", "AvgSentiment", "Signal"]
# ---------------------------------------------------------------------------


def interval(spec: str) -> Column:
    return F.expr(f"INTERVAL {spec}")


def latest_tick(ticks: DataFrame) -> DataFrame:
    return latest_per_key(ticks.select("ticker", "ts", "tick_id", "price", "open", "volume"), "ticker",
                          ["ts", "tick_id"])


def asof_tick(ticks: DataFrame, at: Column) -> DataFrame:
    """Last tick per ticker at or before ``at`` (filter pushed to the scan, then max_by)."""
    return latest_per_key(ticks.filter(F.col("ts") <= at).select("ticker", "ts", "tick_id", "price"), "ticker",
                          ["ts", "tick_id"])


def latest_aggregate(aggregates: DataFrame) -> DataFrame:
    return latest_per_key(aggregates.select("ticker", "window_end", "window_start", "avg_sentiment",
                                            "bullish_ratio", "tweet_count"), "ticker", ["window_end", "window_start"])


def latest_signal(sigs: DataFrame) -> DataFrame:
    return latest_per_key(sigs.select("ticker", "timestamp", "signal", "pearson", "confidence"), "ticker",
                          ["timestamp"])


def market_summary(ticks: DataFrame, aggregates: DataFrame, sigs: DataFrame, as_of: Column,
                   lookback: str = "1 hour") -> DataFrame:
    """Per ticker with a tick: current price, % change vs the last tick at or before
    as_of - lookback (else vs open, else vs price), volume, latest window sentiment and
    bullish ratio (rounded 3), tweet count, latest signal and Pearson (rounded 3)."""
    lt = latest_tick(ticks)
    old = asof_tick(ticks, as_of - interval(lookback)).select("ticker", F.col("price").alias("old_price"))
    sa = latest_aggregate(aggregates)
    sg = latest_signal(sigs)
    j = lt.join(old, "ticker", "left").join(sa, "ticker", "left").join(sg, "ticker", "left")
    base = F.coalesce(F.col("old_price"), open_or_price(F.col("open"), F.col("price")))
    d = SUMMARY_DEFAULTS
    return j.select(
        "ticker", F.col("price").alias("current_price"),
        pct_change(F.col("price"), base).alias("price_change_pct"), "volume",
        F.coalesce(F.round("avg_sentiment", 3), F.lit(d["avg_sentiment"])).alias("avg_sentiment"),
        F.coalesce(F.round("bullish_ratio", 3), F.lit(d["bullish_ratio"])).alias("bullish_ratio"),
        F.coalesce(F.col("tweet_count"), F.lit(d["tweet_count"]).cast("long")).alias("tweet_count"),
        F.coalesce(F.col("signal"), F.lit(d["signal"])).alias("signal"),
        F.coalesce(F.round("pearson", 3), F.lit(d["pearson"])).alias("pearson"))


def correlation_timeline(ticks: DataFrame, aggregates: DataFrame, sigs: DataFrame, n: int = TIMELINE_TICKS,
                         max_window: str = "1 day") -> DataFrame:
    """Correlation detail for every ticker at once: its last ``n`` ticks in time order, each
    with the sentiment of the earliest window containing it (0.0 if none) and the latest
    signal's pearson / confidence / signal (defaults 0.0 / 0.5 / HOLD)."""
    last = last_n_per_key(ticks.select("ticker", "ts", "tick_id", "price"), "ticker", ["ts", "tick_id"], n)
    att = attach_containing_window(last, aggregates, max_window=max_window)
    sg = latest_signal(sigs)
    j = att.join(sg.select("ticker", "pearson", "confidence", "signal"), "ticker", "left")
    d = DETAIL_DEFAULTS
    return j.select("ticker", "tick_id", "ts", clock(F.col("ts")).alias("time"), "price",
                    F.coalesce(F.col("avg_sentiment"), F.lit(0.0)).alias("sentiment"),
                    F.coalesce(F.col("pearson"), F.lit(d["pearson"])).alias("pearson"),
                    F.coalesce(F.col("confidence"), F.lit(d["confidence"])).alias("confidence"),
                    F.coalesce(F.col("signal"), F.lit(d["signal"])).alias("signal"),
                    (F.lit(n + 1) - F.col("rank")).alias("position"))


def fear_greed_index(posts: DataFrame, as_of: Column, lookback: str = "2 hours") -> DataFrame:
    """One row: average compound of posts in [as_of - lookback, as_of] (NULL -> 0), the
    0..100 score (truncated) and the five-level mood."""
    p = posts.filter((F.col("ts") >= as_of - interval(lookback)) & (F.col("ts") <= as_of))
    g = p.agg(F.avg("compound").alias("avg_compound"), F.count(F.lit(1)).alias("n_posts"))
    s = fear_greed(F.col("avg_compound"))
    return g.select(F.coalesce(F.col("avg_compound"), F.lit(0.0)).alias("avg_compound"), "n_posts",
                    s.alias("fear_greed_score"), mood5(s).alias("market_mood"))


def trending(posts: DataFrame, as_of: Column, lookback: str = "1 hour", k: int = TRENDING_K) -> DataFrame:
    """Most discussed tickers in [as_of - lookback, as_of]: mentions desc, ticker asc."""
    p = posts.filter((F.col("ts") >= as_of - interval(lookback)) & (F.col("ts") <= as_of))
    g = p.groupBy("ticker").agg(F.count("post_id").alias("mentions"))
    return top_k(g, [F.col("mentions").desc(), F.col("ticker").asc()], k)


def movers(ticks: DataFrame, k: int = MOVERS_K, universe: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(gainers, losers) by % change of the latest tick vs its open (NULL/0 open -> price).
    Equal changes keep universe order (the reference sorts stably over its ticker list)
    when ``universe`` (ticker, ordinal) is given, else ticker order."""
    lt = latest_tick(ticks)
    ch = lt.select("ticker", "price", pct_change(F.col("price"), open_or_price(F.col("open"), F.col("price")))
                   .alias("change"))
    tie = F.col("ticker").asc()
    if universe is not None:
        ch = ch.join(universe.select("ticker", F.col("ordinal").alias("_ord")), "ticker", "left")
        tie = F.col("_ord").asc_nulls_last()
    gainers = top_k(ch.filter(F.col("change") >= 0), [F.col("change").desc(), tie], k)
    losers = top_k(ch.filter(F.col("change") < 0), [F.col("change").asc(), tie], k)
    if universe is not None:
        gainers, losers = gainers.drop("_ord"), losers.drop("_ord")
    return gainers, losers


def news_feed(posts: DataFrame, k: int = FEED_K, texts: DataFrame | None = None) -> DataFrame:
    """The ``k`` newest posts with label and HH:mm:ss time.  When ``posts`` is the narrow
    ingest table, the headline text is joined from ``texts`` for the ``k`` rows only."""
    cols = ["post_id", "ticker", "username", "ts", "compound"] + (["text"] if texts is None else [])
    p = top_k(posts.select(*cols), [F.col("ts").desc(), F.col("post_id").desc()], k)
    if texts is not None:
        # k ids (bounded by the feature's limit) become a pushed-down IN filter, so the
        # text store is read only in row groups that can hold them
        ids = [r["post_id"] for r in p.select("post_id").collect()]
        t = texts.select("post_id", "text").filter(F.col("post_id").isin(ids))
        p = p.join(t, "post_id", "left")
    return p.select(F.col("post_id").alias("id"), "ticker", F.col("text").alias("headline"), "username",
                    label(F.col("compound")).alias("sentiment"), clock(F.col("ts")).alias("time"), "ts")


def ingest_metrics(posts: DataFrame, ticks: DataFrame, sigs: DataFrame, alerts: DataFrame) -> DataFrame:
    """(metric, value) rows: total posts, ticks, signals, alerts (four counts, no join)."""
    parts = [("total_tweets", posts), ("total_ticks", ticks), ("total_signals", sigs), ("total_alerts", alerts)]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = c if out is None else out.unionByName(c)
    return out


def search_tickers(summary: DataFrame, names: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive substring search on ticker or company name; blank query -> all."""
    j = summary.join(names.select("ticker", "name"), "ticker", "left")
    q = (query or "").strip().lower()
    if not q:
        return j
    return j.filter(F.lower("ticker").contains(q) | F.lower(F.coalesce("name", F.lit(""))).contains(q))


def export_rows(summary: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the market-summary CSV export with the UI's header names."""
    j = summary.join(names.select("ticker", "name"), "ticker", "left")
    return j.select(F.col("ticker").alias("Ticker"), F.coalesce("name", "ticker").alias("Company Name"),
                    F.col("current_price").alias("Price"), F.col("volume").alias("Volume"),
                    F.col("avg_sentiment").alias("AvgSentiment"), F.col("signal").alias("Signal"))


def latest_alerts(alerts: DataFrame, limit: int = ALERTS_DEFAULT, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    if not ALERTS_MIN <= int(limit) <= ALERTS_MAX:
        raise ValueError(f"limit must be in [{ALERTS_MIN}, {ALERTS_MAX}]")
    return top_k(alerts, [F.col(c).desc() for c in order], int(limit))


def board_cards(summary: DataFrame, names: DataFrame) -> DataFrame:
    """Per-ticker display texts of the market board: signed percent change, price, volume
    in thousands, volume with separators, sentiment (browser number formatting: exact
    binary value, ties away from zero), rendered natively on the per-ticker summary."""
    from marketspark.functions.fixed import with_fixed_text
    j = summary.join(names.select("ticker", "name"), "ticker", "left")
    j = with_fixed_text(j, {"_chg": (F.col("price_change_pct"), 2, "away"),
                            "_px": (F.col("current_price"), 2, "away"),
                            "_vk": (F.col("volume") / 1000, 0, "away"),
                            "_st": (F.col("avg_sentiment"), 2, "away")})
    pct = F.col("price_change_pct")
    return j.select(
        "ticker", F.coalesce("name", "ticker").alias("name"),
        F.concat(F.when(pct >= 0, F.lit("+")).otherwise(F.lit("")), F.col("_chg"), F.lit("%")).alias("change_text"),
        F.concat(F.lit("$"), F.col("_px")).alias("price_text"),
        F.concat(F.lit("Vol: "), F.col("_vk"), F.lit("k")).alias("vol_text"),
        F.format_number(F.col("volume").cast("long"), 0).alias("volume_text"),
        F.col("_st").alias("sentiment_text"))


def confidence_text(conf: Column) -> Column:
    """``Math.round(confidence * 100) + '%'``."""
    from marketspark.functions.formats import js_round
    return F.concat(js_round(conf * 100).cast("string"), F.lit("%"))


def correlation_detail(universe: DataFrame, sigs: DataFrame, timeline: DataFrame) -> DataFrame:
    """Detail header per supported ticker: latest signal's pearson / confidence / signal
    (defaults 0.0 / 0.5 / HOLD) and the number of timeline points.  Requests for tickers
    outside the universe are the caller's ``unsupported`` rows (anti join)."""
    sg = latest_signal(sigs)
    pts = timeline.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_points"))
    j = universe.select("ticker").join(sg, "ticker", "left").join(pts, "ticker", "left")
    d = DETAIL_DEFAULTS
    return j.select("ticker", F.coalesce("pearson", F.lit(d["pearson"])).alias("pearson_coefficient"),
                    F.coalesce("confidence", F.lit(d["confidence"])).alias("confidence_score"),
                    F.coalesce("signal", F.lit(d["signal"])).alias("trading_signal"),
                    F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"))
