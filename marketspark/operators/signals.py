"""Trading signals, confidence, and alerts (all native Column logic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.formats import render

# ---------------------------------------------------------------------------
# Signal thresholds and alert texts of the reference.
SENT_T, CORR_T, MOM_T = 0.4, 0.25, 0.002          # worker signal (authoritative)
STREAM_SENT_T, STREAM_CORR_T, STREAM_CONF = 0.5, 0.3, 0.8   # streaming-job preset
HOLD_CONF, CONF_CAP, CONF_BASE, CONF_R, CONF_MOM = 0.5, 0.99, 0.5, 0.4, 10.0
CRITICAL_AT = 0.75                                 # signal alert: confidence < 0.75 -> WARNING
EXTREME_T = 0.75                                   # post alert threshold (inclusive)
BEAR_MSG = "Panic Alert: Extreme Bearish Sentiment detected on ${ticker}. Username: @{username}"
BULL_MSG = "FOMO Alert: Extreme Bullish Sentiment detected on ${ticker}. Username: @{username}"
SIGNAL_MSG = "Trading Alert: Strong {signal} Signal generated for ${ticker}. Pearson: {pearson}. Confidence: {pct}%"
ALERT_MODES = {"CRITICAL": ("severity", "CRITICAL"), "WARNING": ("severity", "WARNING"),
               "SPIKE": ("type", "Bullish Spike")}
ALERT_BUFFER_CAP = 50
# ---------------------------------------------------------------------------


def signal_columns(avg: Column, r: Column, mom: Column, sent_t: float = SENT_T, corr_t: float = CORR_T,
                   mom_t: float = MOM_T) -> tuple[Column, Column]:
    """(signal, confidence): BUY / SELL need sentiment, correlation and momentum beyond the
    thresholds (strict); confidence = round(min(0.99, 0.5 + |r|*0.4 + |mom|*10), 2), HOLD 0.5."""
    buy = (avg > sent_t) & (r > corr_t) & (mom > mom_t)
    sell = (avg < -sent_t) & (r < -corr_t) & (mom < -mom_t)
    sig = F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD")
    conf = F.round(F.least(F.lit(CONF_CAP), F.lit(CONF_BASE) + F.abs(r) * CONF_R + F.abs(mom) * CONF_MOM), 2)
    return sig, F.when(buy | sell, conf).otherwise(F.lit(HOLD_CONF))


def signals(corr: DataFrame, sentiment: DataFrame, sent_t: float = SENT_T, corr_t: float = CORR_T,
            mom_t: float = MOM_T) -> DataFrame:
    """correlation_signals rows (ticker, timestamp, pearson, lag, signal, confidence, ...)
    for windows that have both a correlation (>= min ticks) and posts (inner join)."""
    j = corr.join(sentiment.select("ticker", "window_start", "window_end", "avg_sentiment", "tweet_count"),
                  ["ticker", "window_start", "window_end"], "inner")
    sig, conf = signal_columns(F.col("avg_sentiment"), F.col("pearson"), F.col("momentum"), sent_t, corr_t, mom_t)
    return j.select("ticker", "window_start", "window_end", F.col("window_end").alias("timestamp"), "pearson",
                    "lag", "avg_sentiment", "momentum", "n_ticks", sig.alias("signal"), conf.alias("confidence"))


def signals_stream_preset(joined: DataFrame, sent_t: float = STREAM_SENT_T, corr_t: float = STREAM_CORR_T,
                          confidence: float = STREAM_CONF) -> DataFrame:
    """Streaming-job rule: BUY if avg > 0.5 and r > 0.3, SELL if avg < -0.5 and r < -0.3,
    fixed confidence; fed a computed ``pearson`` column."""
    a, r = F.col("avg_sentiment"), F.col("pearson")
    sig = F.when((a > sent_t) & (r > corr_t), "BUY").when((a < -sent_t) & (r < -corr_t), "SELL").otherwise("HOLD")
    return joined.select("ticker", F.col("window_end").alias("timestamp"), "pearson", F.lit(0).alias("lag"),
                         sig.alias("signal"), F.lit(confidence).alias("confidence"))


def _py_round2_text(x: Column) -> Column:
    """Text of round(x, 2) as Python prints a float (shortest form, '.0' kept)."""
    return F.round(x, 2).cast("string")


def signal_alerts(sig: DataFrame, critical_at: float = CRITICAL_AT) -> DataFrame:
    """alerts for non-HOLD signals: WARNING below ``critical_at`` confidence else CRITICAL;
    the message carries round(r, 2) and the truncated integer percent."""
    s = sig.filter(F.col("signal") != "HOLD")
    pct = (F.col("confidence") * 100).cast("int").cast("string")     # int(): truncation
    msg = render(SIGNAL_MSG, signal=F.col("signal"), ticker=F.col("ticker"),
                 pearson=_py_round2_text(F.col("pearson")), pct=pct)
    return s.select("ticker", "timestamp",
                    F.when(F.col("confidence") < critical_at, "WARNING").otherwise("CRITICAL").alias("severity"),
                    msg.alias("message"), F.lit("Momentum Shift").alias("type"))


def post_alerts(posts: DataFrame, t: float = EXTREME_T) -> DataFrame:
    """alerts for extreme posts: compound <= -t CRITICAL 'Bearish Crash', >= t INFO 'Bullish Spike'."""
    c = F.col("compound")
    p = posts.filter((c <= -t) | (c >= t))
    bear = c <= -t
    parts = dict(ticker=F.col("ticker"), username=F.col("username"))
    msg = F.when(bear, render(BEAR_MSG, **parts)).otherwise(render(BULL_MSG, **parts))
    return p.select("post_id", "ticker", F.col("ts").alias("timestamp"),
                    F.when(bear, "CRITICAL").otherwise("INFO").alias("severity"), msg.alias("message"),
                    F.when(bear, "Bearish Crash").otherwise("Bullish Spike").alias("type"))


def filter_alerts(alerts: DataFrame, mode: str = "ALL") -> DataFrame:
    """Alert filter: ALL, CRITICAL / WARNING (severity), SPIKE (type 'Bullish Spike');
    unknown modes keep everything."""
    sel = ALERT_MODES.get((mode or "ALL").upper())
    return alerts if sel is None else alerts.filter(F.col(sel[0]) == sel[1])


def strong_buy_flag(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("strong_buy", F.col("message").contains("Strong BUY"))


def alert_buffer(old: DataFrame, new: DataFrame, order: list[str], cap: int = ALERT_BUFFER_CAP) -> DataFrame:
    """Newest-first buffer: union old and new, keep the ``cap`` newest by ``order`` (top-k)."""
    u = old.unionByName(new)
    return u.orderBy(*[F.col(c).desc() for c in order]).limit(cap)
