"""Registered queries over the supplied tables (whole tables, test window parameters).

Test parameters: the fixture has about one event per few minutes over a month, so the
queries use 1-day windows, a 12-hour look-back and 6-hour slides where the reference's
defaults are 5 minutes / 2 minutes / 15 seconds (those stay the library defaults).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions.bands import chart_band, label
from marketspark.functions.bands import fear_greed as _fg
from marketspark.functions.bands import mood3 as _mood3
from marketspark.functions.sentiment import scale_score, score_keyword, tone_from_logits, with_scores
from marketspark.operators import lexicon as LX
from marketspark.operators import sequence as SQ
from marketspark.operators.align import asof_join, rolling_sentiment_at_ticks
from marketspark.operators.correlation import correlation_matrix, window_correlation
from marketspark.operators.records_ops import change_feed, dedupe, manual_posts
from marketspark.operators.signals import (alert_buffer, filter_alerts, post_alerts, signal_alerts, signals, signals_stream_preset,
                                           strong_buy_flag)
from marketspark.operators.topk import first_k_by_ordinal, in_universe, last_n_per_key, merge_board, unsupported
from marketspark.operators.windows import (join_windows, ohlc_bars, price_windows, sentiment_windows,
                                           trailing_sentiment)
from marketspark.plans import oracle_sql as S
from marketspark.plans import reports as RP
from marketspark.plans import snapshots as SN
from marketspark.plans.registry import as_of_literal, register
from marketspark.sources import bucketed as BK
from marketspark.sources import news as NW
from marketspark.sources import quote_source as QS
from marketspark.session import scratch_path
from marketspark.sources.quotes import extract_quotes, with_fallback
from marketspark.sources.records import encode_records, parse_ticks, tick_wire
from marketspark.sources.tables import (fullest_ticker, load_chat_messages, load_logits, load_posts, load_questions, load_ticks,
                                        load_universe, post_texts, posts_table, posts_table_path, quote_documents, read_table,
                                        snapshot_key, spread, ticks_table, ticks_table_path, universe_aliases,
                                        written_table)
from marketspark.streaming import jobs as ST
from marketspark.streaming import late as LT
from marketspark.streaming import panes as PN
from marketspark.streaming import subscribers as SB
from marketspark.streaming.sinks import make_sink, read_batches, truncate

WINDOW, LOOKBACK, SLIDE = "1 day", "12 hours", "6 hours"


# --- shared stages ----------------------------------------------------------------------

def stage_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return ticks_table(spark, sf)


def stage_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts_table(spark, sf)


def stage_sentiment(spark, sf, posts=None) -> DataFrame:
    return sentiment_windows(posts if posts is not None else stage_posts(spark, sf), WINDOW)


def stage_aligned(spark, sf, ticks=None, posts=None) -> DataFrame:
    t = ticks if ticks is not None else stage_ticks(spark, sf)
    p = posts if posts is not None else stage_posts(spark, sf)
    return rolling_sentiment_at_ticks(t, p, window=WINDOW, lookback=LOOKBACK, bucket=stage_bucket(spark, sf))


def stage_bucket(spark, sf) -> str:
    """``whole`` where the stored counts show that every ticker fits one bucket."""
    return "whole" if fullest_ticker(spark, sf) <= SQ.TARGET_ROWS_PER_BUCKET else "auto"


def stage_corr(spark, sf, ticks=None, posts=None, lag: int = 0) -> DataFrame:
    return window_correlation(stage_aligned(spark, sf, ticks, posts), min_ticks=5, lag=lag, lag_bucket=stage_bucket(spark, sf))


def stage_signals(spark, sf, ticks=None, posts=None, **thresholds) -> DataFrame:
    p = posts if posts is not None else stage_posts(spark, sf)
    return signals(stage_corr(spark, sf, ticks, p), stage_sentiment(spark, sf, p), **thresholds)


def _stored(spark, sf, name: str, build, *sort: str) -> DataFrame:
    """A derived table written once per input snapshot, as the reference's worker stores it."""
    key = snapshot_key(spark, sf, ["documents", "events"], name)
    return spark.read.parquet(written_table(spark, key, name, build, sort=sort))


def stored_sentiment(spark, sf) -> DataFrame:
    return _stored(spark, sf, "aggregates", lambda: stage_sentiment(spark, sf), "window_start", "ticker")


def stored_signals(spark, sf) -> DataFrame:
    """Signals at the reference thresholds; snapshots read them here and plan no alignment."""
    return _stored(spark, sf, "signals", lambda: signals(stage_corr(spark, sf), stored_sentiment(spark, sf)), "timestamp", "ticker")


def stored_alerts(spark, sf) -> DataFrame:
    return _stored(spark, sf, "alerts", lambda: stage_alerts(spark, sf), "timestamp", "ticker")


# --- adapters and scoring -----------------------------------------------------------------

@register("q_ticks", "SRC3 FLT1 SCA18 adapter ticks, previous-price open (sequence.previous_value)",
          S.with_ctes(S.TICKS) + "SELECT tick_id, ticker, ts, price, open, volume FROM ticks",
          ["price", "open"])
def q_ticks(spark, sf):
    return load_ticks(spark, sf)


@register("q_posts_scored", "SCA1 PRJ4 keyword scorer over the posts adapter, score struct flattened",
          S.with_ctes(*S.BASE) + "SELECT post_id, ticker, ts, username, followers, compound, pos, neg, neu FROM posts",
          ["compound", "pos", "neg", "neu"])
def q_posts_scored(spark, sf):
    return load_posts(spark, sf).drop("text")


@register("q_post_labels", "SCA6 label, SCA8 chart band",
          S.with_ctes(*S.BASE) + """SELECT post_id, compound,
  CASE WHEN compound > 0.15 THEN 'BULLISH' WHEN compound < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label,
  CASE WHEN compound >= 0.15 THEN 'up' WHEN compound <= -0.15 THEN 'down' ELSE 'flat' END AS band
FROM posts""", ["compound"])
def q_post_labels(spark, sf):
    p = stage_posts(spark, sf)
    return p.select("post_id", "compound", label(F.col("compound")).alias("label"),
                    chart_band(F.col("compound")).alias("band"))


# --- window aggregates ---------------------------------------------------------------------

@register("q_sentiment_tumbling", "AGG1 AGG2 AGG5 PRJ5 tumbling sentiment windows, window struct flattened",
          S.with_ctes(*S.BASE, S.SENT_DAY) + "SELECT * FROM sent_day",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_sentiment_tumbling(spark, sf):
    return stage_sentiment(spark, sf)


@register("q_price_tumbling", "AGG3 tumbling price windows",
          S.with_ctes(S.TICKS, S.PRICE_DAY) + "SELECT * FROM price_day", ["avg_price"])
def q_price_tumbling(spark, sf):
    return price_windows(stage_ticks(spark, sf), WINDOW)


@register("q_ohlc_bars", "AGG9 AGG11 OHLCV bars",
          S.with_ctes(S.TICKS) + f"""SELECT ticker, {S.day('ts')} AS window_start,
  {S.day('ts')} + INTERVAL '1 day' AS window_end, arg_min(price, (ts, tick_id)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (ts, tick_id)) AS close, sum(volume) AS volume, count(*) AS n_ticks
FROM ticks GROUP BY 1, 2, 3""", ["open", "high", "low", "close"])
def q_ohlc_bars(spark, sf):
    return ohlc_bars(stage_ticks(spark, sf), WINDOW)


@register("q_sentiment_sliding", "AGG4 STR3 sliding sentiment windows (1 day every 6 hours)",
          S.with_ctes(*S.BASE) + """SELECT ticker, window_start, window_start + INTERVAL '1 day' AS window_end,
  avg(compound) AS avg_sentiment, count(post_id) AS tweet_count,
  avg(CASE WHEN compound > 0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bullish_ratio,
  avg(CASE WHEN compound < -0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bearish_ratio,
  count(post_id)::DOUBLE / 1440 AS velocity
FROM (SELECT p.*, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start
      FROM posts p, range(4) r(k)) s
GROUP BY 1, 2, 3""", ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_sentiment_sliding(spark, sf):
    return sentiment_windows(stage_posts(spark, sf), WINDOW, SLIDE)


@register("q_windowed_join", "JON1 STR5 (batch) join of sentiment and price windows",
          S.with_ctes(*S.BASE, S.SENT_DAY, S.PRICE_DAY) + """SELECT * FROM sent_day JOIN price_day
  USING (ticker, window_start, window_end)""",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity", "avg_price"])
def q_windowed_join(spark, sf):
    p, t = stage_posts(spark, sf), stage_ticks(spark, sf)
    return join_windows(sentiment_windows(p, WINDOW), price_windows(t, WINDOW))


# --- alignment, correlation, signals ---------------------------------------------------------

@register("q_rolling_sentiment_at_tick", "JON2 WIN3 trailing range average per tick",
          S.with_ctes(*S.BASE, S.ALIGNED) + "SELECT * FROM aligned", ["price", "sentiment"])
def q_rolling_sentiment_at_tick(spark, sf):
    return stage_aligned(spark, sf)


@register("q_window_pearson", "COR1 COR2 AGG10 FLT10 SCA14 guarded Pearson and momentum per window",
          S.with_ctes(*S.CHAIN) + "SELECT * FROM corr_day",
          ["pearson", "first_price", "last_price", "momentum"])
def q_window_pearson(spark, sf):
    return stage_corr(spark, sf)


@register("q_signals", "SIG1 SIG2 FLT9 signals at the reference thresholds",
          S.with_ctes(*S.CHAIN, S.signals_cte()) + "SELECT * FROM sig",
          ["pearson", "avg_sentiment", "momentum", "confidence"])
def q_signals(spark, sf):
    return stage_signals(spark, sf)


def bucketed_events(spark, sf) -> DataFrame:
    """The events of the signal chain as a bucketed table, written once per input snapshot."""
    key = snapshot_key(spark, sf, ["documents", "events"], "bucketed")
    if key not in _BUCKETED:
        name = f"signal_events_{uuid.uuid4().hex}"
        BK.write_bucketed(BK.signal_events(stage_ticks(spark, sf), stage_posts(spark, sf), WINDOW, LOOKBACK), name, scratch_path(spark, name), buckets=16)
        _BUCKETED[key] = name
    return spark.table(_BUCKETED[key])


_BUCKETED: dict[tuple, str] = {}


@register("q_signals_bucketed", "SRC3 SNK4 SIG1 COR2 JON2 signals from bucketed storage, no exchange above the scan",
          S.with_ctes(*S.CHAIN, S.signals_cte()) + "SELECT * FROM sig", ["pearson", "avg_sentiment", "momentum", "confidence"])
def q_signals_bucketed(spark, sf):
    return BK.bucketed_signals(bucketed_events(spark, sf), WINDOW)


@register("q_signals_low", "SIG1 SIG2 with lowered thresholds (0.1 / 0.1 / 0.002) to reach both branches",
          S.with_ctes(*S.CHAIN, S.signals_cte(0.1, 0.1, 0.002)) + "SELECT * FROM sig",
          ["pearson", "avg_sentiment", "momentum", "confidence"])
def q_signals_low(spark, sf):
    return stage_signals(spark, sf, sent_t=0.1, corr_t=0.1, mom_t=0.002)


_SIGNAL_ALERT_SQL = """SELECT ticker, timestamp,
  CASE WHEN confidence < 0.75 THEN 'WARNING' ELSE 'CRITICAL' END AS severity,
  'Trading Alert: Strong ' || signal || ' Signal generated for $' || ticker || '. Pearson: '
    || CAST(round(pearson, 2) AS VARCHAR) || '. Confidence: ' || CAST(CAST(trunc(confidence * 100) AS INTEGER) AS VARCHAR)
    || '%' AS message,
  'Momentum Shift' AS type
FROM sig WHERE signal <> 'HOLD'"""


@register("q_signal_alerts", "ALR2 alerts from signals at the reference thresholds",
          S.with_ctes(*S.CHAIN, S.signals_cte()) + _SIGNAL_ALERT_SQL)
def q_signal_alerts(spark, sf):
    return signal_alerts(stage_signals(spark, sf))


@register("q_post_alerts", "ALR1 extreme-post alerts",
          S.with_ctes(*S.BASE) + """SELECT post_id, ticker, ts AS timestamp,
  CASE WHEN compound <= -0.75 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CASE WHEN compound <= -0.75 THEN 'Panic Alert: Extreme Bearish' ELSE 'FOMO Alert: Extreme Bullish' END
    || ' Sentiment detected on $' || ticker || '. Username: @' || username AS message,
  CASE WHEN compound <= -0.75 THEN 'Bearish Crash' ELSE 'Bullish Spike' END AS type
FROM posts WHERE compound <= -0.75 OR compound >= 0.75""")
def q_post_alerts(spark, sf):
    return post_alerts(stage_posts(spark, sf))


@register("q_stream_preset_signals", "SIG3 PRJ6 streaming-job signal rule on joined windows with computed r",
          S.with_ctes(*S.CHAIN, S.PRICE_DAY) + """SELECT s.ticker, s.window_end AS timestamp, c.pearson, 0 AS lag,
  CASE WHEN s.avg_sentiment > 0.5 AND c.pearson > 0.3 THEN 'BUY'
       WHEN s.avg_sentiment < -0.5 AND c.pearson < -0.3 THEN 'SELL' ELSE 'HOLD' END AS signal,
  0.8::DOUBLE AS confidence
FROM sent_day s JOIN price_day p USING (ticker, window_start, window_end)
JOIN corr_day c USING (ticker, window_start, window_end)""", ["pearson", "confidence"])
def q_stream_preset_signals(spark, sf):
    p, t = stage_posts(spark, sf), stage_ticks(spark, sf)
    j = join_windows(sentiment_windows(p, WINDOW), price_windows(t, WINDOW))
    c = stage_corr(spark, sf, t, p).select("ticker", "window_start", "window_end", "pearson")
    return signals_stream_preset(j.join(c, ["ticker", "window_start", "window_end"]))


# --- latest rows, as-of, timeline, snapshots -----------------------------------------------


SEARCH_TEXT = "  COMPANY 3 "


def stage_alerts(spark, sf) -> DataFrame:
    """Alert table: extreme-post alerts plus signal alerts (reference thresholds)."""
    pa = post_alerts(stage_posts(spark, sf)).drop("post_id")
    return pa.unionByName(signal_alerts(stored_signals(spark, sf)))


def stage_summary(spark, sf) -> DataFrame:
    t = stage_ticks(spark, sf)
    return SN.market_summary(t, stored_sentiment(spark, sf), stored_signals(spark, sf), as_of_literal(t), lookback="1 hour")


@register("q_latest_tick", "WIN1 latest row per key (max_by)",
          S.with_ctes(S.TICKS, S.LATEST_TICK) + "SELECT ticker, ts, tick_id, price, open, volume FROM lt",
          ["price", "open"])
def q_latest_tick(spark, sf):
    return SN.latest_tick(stage_ticks(spark, sf))


@register("q_last30_ticks", "WIN2 SRT1 last 30 ticks per ticker (WindowGroupLimit)",
          S.with_ctes(S.TICKS) + """SELECT tick_id, ticker, ts, price, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) AS rank FROM ticks) WHERE rank <= 30""",
          ["price"])
def q_last30_ticks(spark, sf):
    t = stage_ticks(spark, sf).select("tick_id", "ticker", "ts", "price")
    return last_n_per_key(t, "ticker", ["ts", "tick_id"], 30)


@register("q_asof_tick", "JON4 per-row as-of lookup: last tick at or before each post",
          S.with_ctes(*S.BASE) + """SELECT p.post_id, p.ticker, p.ts, t.tick_id AS asof_tick_id, t.ts AS asof_ts,
  t.price AS asof_price
FROM posts p ASOF LEFT JOIN ticks t ON p.ticker = t.ticker AND p.ts >= t.ts""", ["asof_price"])
def q_asof_tick(spark, sf):
    p = stage_posts(spark, sf).select("post_id", "ticker", "ts")
    t = stage_ticks(spark, sf)
    return asof_join(p, t, "ticker", "ts", "ts", ["tick_id", "ts", "price"], right_order=["tick_id"], bucket=stage_bucket(spark, sf))


@register("q_asof_old_tick", "JON4 FLT3 last tick per ticker at or before as_of - 1 hour",
          S.with_ctes(S.TICKS) + """SELECT ticker, ts, tick_id, price FROM ticks
WHERE ts <= (SELECT max(ts) FROM ticks) - INTERVAL '1 hour'
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) = 1""", ["price"])
def q_asof_old_tick(spark, sf):
    t = stage_ticks(spark, sf)
    return SN.asof_tick(t, as_of_literal(t) - F.expr("INTERVAL 1 hour"))


@register("q_timeline", "COR3 SNP2 JON3 last 30 ticks with containing-window sentiment and latest signal",
          S.with_ctes(*S.CHAIN, S.SIG) + """, last AS (
  SELECT ticker, ts, tick_id, price, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) AS rnk
  FROM ticks QUALIFY rnk <= 30),
att AS (SELECT l.*, (SELECT s.avg_sentiment FROM sent_day s WHERE s.ticker = l.ticker AND s.window_start <= l.ts
                      AND s.window_end >= l.ts ORDER BY s.window_start, s.window_end LIMIT 1) AS sentiment FROM last l),
""" + S.LATEST_SIG + """
SELECT a.ticker, a.tick_id, a.ts, strftime(a.ts, '%H:%M:%S') AS time, a.price, coalesce(a.sentiment, 0.0) AS sentiment,
  coalesce(sg.pearson, 0.0) AS pearson, coalesce(sg.confidence, 0.5) AS confidence, coalesce(sg.signal, 'HOLD') AS signal,
  31 - a.rnk AS position
FROM att a LEFT JOIN sg USING (ticker)""", ["price", "sentiment", "pearson", "confidence"])
def q_timeline(spark, sf):
    return SN.correlation_timeline(stage_ticks(spark, sf), stored_sentiment(spark, sf), stored_signals(spark, sf), n=30,
                                   max_window=WINDOW)


@register("q_market_summary", "SNP1 JON5 FLT11 SCA13 SCA17 market summary over stored tables",
          S.with_ctes(*S.CHAIN, S.SIG, S.LATEST_TICK, S.LATEST_SENT, S.LATEST_SIG, S.SUMMARY)
          + "SELECT * FROM summary", ["current_price", "price_change_pct", "avg_sentiment", "bullish_ratio", "pearson"])
def q_market_summary(spark, sf):
    return stage_summary(spark, sf)


_POST_WINDOW = """FROM posts WHERE ts >= (SELECT max(ts) FROM posts) - INTERVAL '{lb}' AND ts <= (SELECT max(ts) FROM posts)"""


@register("q_fear_greed", "SNP3 AGG6 SCA10 SCA11 fear & greed index (12-hour look-back)",
          S.with_ctes(*S.BASE) + """SELECT coalesce(avg(compound), 0.0) AS avg_compound, count(*) AS n_posts,
  CAST(trunc((coalesce(avg(compound), 0.0) + 1.0) * 50) AS INTEGER) AS fear_greed_score,
  CASE WHEN fear_greed_score < 25 THEN 'EXTREME FEAR' WHEN fear_greed_score < 45 THEN 'FEAR'
       WHEN fear_greed_score <= 55 THEN 'NEUTRAL' WHEN fear_greed_score <= 75 THEN 'GREED' ELSE 'EXTREME GREED' END
    AS market_mood
""" + _POST_WINDOW.format(lb="12 hours"), ["avg_compound"])
def q_fear_greed(spark, sf):
    p = stage_posts(spark, sf)
    return SN.fear_greed_index(p, as_of_literal(p), lookback="12 hours")


@register("q_macro_mood", "SNP10 SCA12 macro mood (NULL or 0 average -> 0.15)",
          S.with_ctes(*S.BASE) + """SELECT coalesce(nullif(avg(compound), 0.0), 0.15) AS avg_used,
  CAST(trunc((coalesce(nullif(avg(compound), 0.0), 0.15) + 1.0) * 50) AS INTEGER) AS fg_score,
  CASE WHEN fg_score > 55 THEN 'GREED' WHEN fg_score < 45 THEN 'FEAR' ELSE 'NEUTRAL' END AS mood
""" + _POST_WINDOW.format(lb="2 hours"), ["avg_used"])
def q_macro_mood(spark, sf):
    p = stage_posts(spark, sf)
    a = as_of_literal(p)
    w = p.filter((F.col("ts") >= a - F.expr("INTERVAL 2 hours")) & (F.col("ts") <= a))
    g = w.agg(F.coalesce(F.nullif(F.avg("compound"), F.lit(0.0)), F.lit(0.15)).alias("avg_used"))
    s = _fg(F.col("avg_used"))
    return g.select("avg_used", s.alias("fg_score"), _mood3(s).alias("mood"))


@register("q_trending", "SNP4 AGG7 TOP2 most discussed tickers (1-day look-back)",
          S.with_ctes(*S.BASE) + """SELECT ticker, count(post_id) AS mentions
""" + _POST_WINDOW.format(lb="1 day") + " GROUP BY ticker ORDER BY mentions DESC, ticker LIMIT 4")
def q_trending(spark, sf):
    p = stage_posts(spark, sf)
    return SN.trending(p, as_of_literal(p), lookback="1 day", k=4)


_MOVERS = """movers AS (SELECT ticker, price,
  CASE WHEN coalesce(nullif(open, 0), price) > 0
       THEN round((price - coalesce(nullif(open, 0), price)) / coalesce(nullif(open, 0), price) * 100, 2)
       ELSE 0.0 END AS change FROM lt)"""


@register("q_gainers", "SNP5 TOP3 top gainers vs open",
          S.with_ctes(S.TICKS, S.LATEST_TICK, _MOVERS)
          + "SELECT * FROM movers WHERE change >= 0 ORDER BY change DESC, ticker LIMIT 3", ["price", "change"])
def q_gainers(spark, sf):
    return SN.movers(stage_ticks(spark, sf), k=3)[0]


@register("q_losers", "SNP5 TOP4 top losers vs open",
          S.with_ctes(S.TICKS, S.LATEST_TICK, _MOVERS)
          + "SELECT * FROM movers WHERE change < 0 ORDER BY change, ticker LIMIT 3", ["price", "change"])
def q_losers(spark, sf):
    return SN.movers(stage_ticks(spark, sf), k=3)[1]


@register("q_news_feed", "SNP6 TOP5 SCA6 SCA15 latest 6 posts",
          S.with_ctes(*S.BASE) + """SELECT post_id AS id, ticker, text AS headline, username,
  CASE WHEN compound > 0.15 THEN 'BULLISH' WHEN compound < -0.15 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment,
  strftime(ts, '%H:%M:%S') AS time, ts
FROM posts ORDER BY ts DESC, post_id DESC LIMIT 6""")
def q_news_feed(spark, sf):
    return SN.news_feed(stage_posts(spark, sf), k=6, texts=post_texts(spark, sf))


@register("q_metrics", "SNP7 AGG8 SNK4 counts over the stored posts, ticks, signals and alerts",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + """SELECT 'total_tweets' AS metric, count(*) AS value FROM posts
UNION ALL SELECT 'total_ticks', count(*) FROM ticks
UNION ALL SELECT 'total_signals', count(*) FROM sig
UNION ALL SELECT 'total_alerts', count(*) FROM alerts""")
def q_metrics(spark, sf):
    return SN.ingest_metrics(stage_posts(spark, sf), stage_ticks(spark, sf), stored_signals(spark, sf), stored_alerts(spark, sf))


@register("q_universe", "SNP8 universe of tickers with names",
          S.with_ctes(S.UNIVERSE) + "SELECT * FROM universe")
def q_universe(spark, sf):
    return load_universe(spark, sf)


@register("q_search", "FLT8 JON6 case-insensitive ticker / company search",
          S.with_ctes(*S.CHAIN, S.SIG, S.LATEST_TICK, S.LATEST_SENT, S.LATEST_SIG, S.SUMMARY, S.UNIVERSE)
          + f"""SELECT s.*, u.name FROM summary s LEFT JOIN universe u USING (ticker)
WHERE contains(lower(s.ticker), '{SEARCH_TEXT.strip().lower()}') OR contains(lower(coalesce(u.name, '')), '{SEARCH_TEXT.strip().lower()}')""",
          ["current_price", "price_change_pct", "avg_sentiment", "bullish_ratio", "pearson"])
def q_search(spark, sf):
    return SN.search_tickers(stage_summary(spark, sf), load_universe(spark, sf), SEARCH_TEXT)


@register("q_alert_filter", "FLT7 alert filter (SPIKE)",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + "SELECT * FROM alerts WHERE type = 'Bullish Spike'")
def q_alert_filter(spark, sf):
    return filter_alerts(stored_alerts(spark, sf), "SPIKE")


@register("q_latest_alerts", "TOP1 latest 20 alerts",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS)
          + "SELECT * FROM alerts ORDER BY timestamp DESC, ticker DESC, type DESC, message DESC LIMIT 20")
def q_latest_alerts(spark, sf):
    return SN.latest_alerts(stored_alerts(spark, sf), 20, order=("timestamp", "ticker", "type", "message"))


@register("q_trailing_sentiment", "AGG4 FLT2 rolling aggregate evaluated at as_of (12-hour look-back)",
          S.with_ctes(*S.BASE) + """SELECT ticker, (SELECT max(ts) FROM posts) - INTERVAL '12 hours' AS window_start,
  (SELECT max(ts) FROM posts) AS window_end, avg(compound) AS avg_sentiment, count(post_id) AS tweet_count,
  avg(CASE WHEN compound > 0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bullish_ratio,
  avg(CASE WHEN compound < -0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bearish_ratio,
  count(post_id)::DOUBLE / 720 AS velocity
""" + _POST_WINDOW.format(lb="12 hours") + " GROUP BY ticker",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_trailing_sentiment(spark, sf):
    p = stage_posts(spark, sf)
    return trailing_sentiment(p, as_of_literal(p), lookback="12 hours")


# --- lagged correlation, correlation matrix --------------------------------------------------

@register("q_lagged_corr", "COR4 Pearson of price vs sentiment one tick earlier (exact lag via row index)",
          S.with_ctes(*S.BASE, S.ALIGNED) + """, lagged AS (
  SELECT *, lag(sentiment, 1) OVER (PARTITION BY ticker, window_start ORDER BY ts, tick_id) AS ylag FROM aligned)
SELECT ticker, window_start, window_end, count(*) AS n_ticks,
  CASE WHEN count(ylag) <= 1 OR max(CASE WHEN ylag IS NOT NULL THEN price END) = min(CASE WHEN ylag IS NOT NULL THEN price END)
            OR max(ylag) = min(ylag) OR NOT isfinite(corr(price, ylag)) THEN 0.0 ELSE corr(price, ylag) END AS pearson,
  1 AS lag, arg_min(price, ts) AS first_price, arg_max(price, ts) AS last_price,
  (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) AS momentum
FROM lagged GROUP BY 1, 2, 3 HAVING count(*) >= 5""", ["pearson", "first_price", "last_price", "momentum"])
def q_lagged_corr(spark, sf):
    return stage_corr(spark, sf, lag=1)


FIXTURE_TICKERS = [f"T{i}" for i in range(8)]


@register("q_corr_matrix", "COR5 SCA9 cross-asset correlation matrix of daily average prices",
          S.with_ctes(S.TICKS) + f""", d AS (SELECT ticker, {S.day('ts')} AS bk, avg(price) AS p FROM ticks GROUP BY 1, 2),
u AS (SELECT unnest({FIXTURE_TICKERS!r}) AS ticker),
st AS (SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, {S.PEARSON.format(x='a.p', y='b.p')} AS pearson,
              count(*) AS n_buckets
       FROM d a JOIN d b ON a.bk = b.bk AND a.ticker <> b.ticker GROUP BY 1, 2),
diag AS (SELECT ticker AS ticker_a, ticker AS ticker_b, 1.0::DOUBLE AS pearson, count(*) AS n_buckets FROM d GROUP BY 1),
allp AS (SELECT ua.ticker AS ticker_a, ub.ticker AS ticker_b FROM u ua, u ub),
m AS (SELECT allp.ticker_a, allp.ticker_b,
             coalesce(diag.pearson, st.pearson, 0.0) AS pearson, coalesce(diag.n_buckets, st.n_buckets, 0) AS n_buckets
      FROM allp LEFT JOIN st USING (ticker_a, ticker_b)
      LEFT JOIN diag ON allp.ticker_a = allp.ticker_b AND diag.ticker_a = allp.ticker_a)
SELECT *, CASE WHEN ticker_a = ticker_b THEN 'diagonal' WHEN pearson > 0.5 THEN 'strong' WHEN pearson < 0.2 THEN 'weak'
               ELSE 'mid' END AS band FROM m""", ["pearson"])
def q_corr_matrix(spark, sf):
    return correlation_matrix(stage_ticks(spark, sf), FIXTURE_TICKERS, bucket="1 day", lookback=None)


# --- scorers on other inputs --------------------------------------------------------------


def _lexicon_sql() -> str:
    vals = ", ".join([f"('{w}', {LX.DEFAULT_VALENCE})" for w in LX.POSITIVE_WORDS]
                     + [f"('{w}', {-LX.DEFAULT_VALENCE})" for w in LX.NEGATIVE_WORDS])
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f""", lex(token, valence) AS (VALUES {vals}),
tk AS (SELECT post_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i
       FROM (SELECT post_id, regexp_extract_all(lower(text), '{LX.TOKEN_PATTERN}') AS t FROM posts)),
ctx AS (SELECT post_id, i, tok, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3
        FROM tk WINDOW w AS (PARTITION BY post_id ORDER BY i)),
v0 AS (SELECT c.*, coalesce(l.valence, 0.0) AS v,
              coalesce(list_contains({lst(LX.NEGATORS)}, c.p1) OR list_contains({lst(LX.NEGATORS)}, c.p2)
                       OR list_contains({lst(LX.NEGATORS)}, c.p3), false) AS negated,
              CASE WHEN list_contains({lst(LX.BOOSTERS)}, c.p1) THEN {LX.BOOST}
                   WHEN list_contains({lst(LX.DAMPENERS)}, c.p1) THEN -{LX.BOOST} ELSE 0.0 END AS b
       FROM ctx c LEFT JOIN lex l ON l.token = c.tok),
v1 AS (SELECT post_id, CASE WHEN v = 0 THEN 0.0 WHEN negated THEN (v + sign(v) * b) * {LX.NEGATION}
                            ELSE v + sign(v) * b END AS v FROM v0),
agg AS (SELECT post_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pm,
               sum(CASE WHEN v < 0 THEN -v + 1 ELSE 0 END) AS nm, sum(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS nn
        FROM v1 GROUP BY post_id)
SELECT p.post_id, coalesce(round(a.s / sqrt(a.s * a.s + {LX.ALPHA}), 4), 0.0) AS compound,
       coalesce(CASE WHEN a.pm + a.nm + a.nn > 0 THEN round(a.pm / (a.pm + a.nm + a.nn), 3) END, 0.0) AS pos,
       coalesce(CASE WHEN a.pm + a.nm + a.nn > 0 THEN round(a.nm / (a.pm + a.nm + a.nn), 3) END, 0.0) AS neg,
       coalesce(CASE WHEN a.pm + a.nm + a.nn > 0 THEN round(a.nn / (a.pm + a.nm + a.nn), 3) END, 0.0) AS neu
FROM posts p LEFT JOIN agg a USING (post_id)"""


@register("q_lexicon_score", "SCA2 UDF1 lexicon scorer with negation and boosters over whole texts",
          S.with_ctes(*S.BASE).rstrip() + _lexicon_sql(), ["compound", "pos", "neg", "neu"])
def q_lexicon_score(spark, sf):
    # score on the document scan (no shuffle of text), then keep the posts' ids
    scored = LX.score_lexicon(spread(post_texts(spark, sf))).drop("text")
    return scored.join(stage_posts(spark, sf).select("post_id"), "post_id", "left_semi")


CLAUSE_RULES = LX.Rules(negators=["was", "no"], boosters=["the", "of"], dampeners=["in", "to"], contrast=["that", "que", "und"], clauses=True)


def _clause_sql() -> str:
    """The clause rules over window functions, with the fixture's lexicon: words and word pairs of ``benchmark``."""
    r = CLAUSE_RULES
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    capital = lambda t: f"(upper({t}) = {t} AND lower({t}) <> {t})"

    def boost(k: int, fade: float) -> str:
        b = f"CASE WHEN list_contains({lst(r.boosters)}, low{k}) THEN 1 WHEN list_contains({lst(r.dampeners)}, low{k}) THEN -1 ELSE 0 END"
        return (f" + CASE WHEN coalesce(raw{k}, 0) = 0 AND low{k} IS NOT NULL THEN sign(raw) * ({b}) * "
                f"({LX.BOOST}::DOUBLE + CASE WHEN mixed AND {capital(f'tok{k}')} THEN {LX.CAPITALS}::DOUBLE ELSE 0 END) * {fade}::DOUBLE ELSE 0 END")

    back = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for c in ("tok", "low", "raw") for k in (1, 2, 3))
    negated = " OR ".join(f"coalesce(list_contains({lst(r.negators)}, low{k}), false)" for k in (1, 2, 3))
    return f"""WITH bench AS (SELECT regexp_extract_all(lower(text), '{LX.TOKEN_PATTERN}') AS t FROM benchmark),
lex AS (SELECT DISTINCT w, ((length(w) * 7) % 9 - 4)::DOUBLE AS v FROM (
  SELECT unnest(t) AS w FROM bench UNION ALL
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM bench) WHERE length(w) > 3 AND (length(w) * 7) % 9 <> 4),
docs AS (SELECT doc_id AS post_id, text, regexp_extract_all(text, '{LX.TOKEN_PATTERN}') AS t FROM documents),
toks AS (SELECT post_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM docs),
lows AS (SELECT *, lower(tok) AS low, lower(tok) || ' ' || lead(lower(tok)) OVER (PARTITION BY post_id ORDER BY i) AS pair FROM toks),
valued AS (SELECT x.post_id, x.i, x.tok, x.low, coalesce(a.v, 0) AS single, b.v AS pv FROM lows x LEFT JOIN lex a ON a.w = x.low LEFT JOIN lex b ON b.w = x.pair),
hits AS (SELECT post_id, i, i - row_number() OVER (PARTITION BY post_id ORDER BY i) AS island FROM valued WHERE pv IS NOT NULL),
chosen AS (SELECT post_id, i FROM (SELECT *, (i - min(i) OVER (PARTITION BY post_id, island)) % 2 = 0 AS first FROM hits) WHERE first),
raws AS (SELECT v.*, CASE WHEN c.i IS NOT NULL THEN v.pv WHEN d.i IS NOT NULL THEN NULL ELSE v.single END AS raw
         FROM valued v LEFT JOIN chosen c ON c.post_id = v.post_id AND c.i = v.i LEFT JOIN chosen d ON d.post_id = v.post_id AND d.i + 1 = v.i),
shape AS (SELECT post_id, count(*) FILTER (WHERE lower(tok) <> upper(tok)) AS words, count(*) FILTER (WHERE {capital('tok')}) AS loud,
                 min(i) FILTER (WHERE list_contains({lst(r.contrast)}, low)) AS turn FROM lows GROUP BY post_id),
ctx AS (SELECT r.*, (loud > 0 AND loud < words) AS mixed, turn, {back} FROM raws r JOIN shape USING (post_id)
        WINDOW w AS (PARTITION BY r.post_id ORDER BY r.i)),
adj AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN raw = 0 THEN 0 ELSE
          (raw + sign(raw) * CASE WHEN mixed AND {capital('tok')} THEN {LX.CAPITALS}::DOUBLE ELSE 0 END{boost(1, 1.0)}{boost(2, 0.95)}{boost(3, 0.9)})
          * CASE WHEN {negated} THEN {LX.NEGATION}::DOUBLE ELSE 1 END END AS v1 FROM ctx),
val AS (SELECT post_id, v1 * CASE WHEN turn IS NULL OR i = turn THEN 1::DOUBLE WHEN i < turn THEN {LX.BEFORE_CONTRAST}::DOUBLE ELSE {LX.AFTER_CONTRAST}::DOUBLE END AS v FROM adj),
agg AS (SELECT post_id, coalesce(sum(v), 0) AS s, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS pm, coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS nm,
               count(*) FILTER (WHERE v = 0) AS nn FROM val GROUP BY post_id),
marked AS (SELECT a.*, least(length(text) - length(replace(text, '!', '')), {LX.MOST_EXCLAIMS}) * {LX.EXCLAIM}::DOUBLE
             + CASE WHEN length(text) - length(replace(text, '?', '')) > {LX.MOST_QUESTIONS} THEN {LX.MANY_QUESTIONS}::DOUBLE
                    WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * {LX.QUESTION}::DOUBLE ELSE 0 END AS mark
           FROM agg a JOIN docs USING (post_id)),
fin AS (SELECT post_id, nn, s + sign(s) * mark AS s, pm + CASE WHEN pm > nm THEN mark ELSE 0 END AS pm, nm + CASE WHEN nm > pm THEN mark ELSE 0 END AS nm FROM marked)
SELECT d.post_id, coalesce(round(f.s / sqrt(f.s * f.s + {LX.ALPHA}::DOUBLE), 4), 0) AS compound,
  coalesce(CASE WHEN pm + nm + nn > 0 THEN round(pm / (pm + nm + nn), 3) END, 0) AS pos,
  coalesce(CASE WHEN pm + nm + nn > 0 THEN round(nm / (pm + nm + nn), 3) END, 0) AS neg,
  coalesce(CASE WHEN pm + nm + nn > 0 THEN round(nn / (pm + nm + nn), 3) END, 0) AS neu
FROM docs d LEFT JOIN fin f USING (post_id)"""


def fixture_lexicon(spark, sf) -> DataFrame:
    """Words and word pairs of ``benchmark`` with valences by length: phrases and words of both signs."""
    t = read_table(spark, sf, "benchmark").select(LX.tokens(F.col("text")).alias("t"))
    every = t.select(F.explode("t").alias("token")).unionByName(t.select(F.explode(LX.neighbours(F.col("t"), 2)).alias("token")))
    v = F.length("token") * 7 % 9 - 4
    return every.where((F.length("token") > 3) & (v != 0)).distinct().select("token", v.cast("double").alias("valence"))


@register("q_lexicon_clauses", "SCA2 UDF1 lexicon scorer with phrases, fading boosters, capitals, contrast clauses and marks",
          _clause_sql(), ["compound", "pos", "neg", "neu"])
def q_lexicon_clauses(spark, sf):
    return LX.score_lexicon(spread(post_texts(spark, sf)), fixture_lexicon(spark, sf), rules=CLAUSE_RULES).drop("text")


@register("q_tone_from_logits", "SCA3 softmax tone scores from three class logits",
          """WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c
                FROM embeddings),
y AS (SELECT vec_id, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb,
             exp(c - greatest(a, b, c)) AS ec FROM x)
SELECT vec_id, eb / (ea + eb + ec) - ec / (ea + eb + ec) AS compound, eb / (ea + eb + ec) AS pos,
       ec / (ea + eb + ec) AS neg, ea / (ea + eb + ec) AS neu FROM y""", ["compound", "pos", "neg", "neu"])
def q_tone_from_logits(spark, sf):
    s = tone_from_logits(F.col("logits"))
    return load_logits(spark, sf).select("vec_id", *[s[f].alias(f) for f in ("compound", "pos", "neg", "neu")])


@register("q_scaled_score", "SCA4 SCA5 scaled scorer (compound x 1.05 clamped)",
          S.with_ctes(*S.BASE) + """SELECT post_id, greatest(-1.0, least(1.0, compound * 1.05)) AS compound, pos, neg, neu
FROM posts""", ["compound", "pos", "neg", "neu"])
def q_scaled_score(spark, sf):
    p = stage_posts(spark, sf)
    s = scale_score(F.struct("compound", "pos", "neg", "neu"))
    return p.select("post_id", *[s[f].alias(f) for f in ("compound", "pos", "neg", "neu")])


# --- reports and question routing ----------------------------------------------------------


_FACTS_SQL = """facts AS (
  SELECT u.ticker, u.name, coalesce(lt.price, 200.0) AS price, coalesce(lt.volume, 1000000) AS volume,
         coalesce(sa.avg_sentiment, 0.45) AS avg_sentiment, coalesce(sa.bullish_ratio, 0.70) AS bullish_ratio,
         coalesce(sg.signal, 'BUY') AS signal, coalesce(sg.pearson, 0.52) AS pearson
  FROM universe u LEFT JOIN lt USING (ticker) LEFT JOIN sa USING (ticker) LEFT JOIN sg USING (ticker))"""


def _asset_text_sql(p: str = "") -> str:
    sent_status = (f"CASE WHEN {p}avg_sentiment > 0.4 THEN 'strongly bullish' WHEN {p}avg_sentiment > 0.1 "
                   f"THEN 'moderately bullish' WHEN {p}avg_sentiment < -0.1 THEN 'bearish' ELSE 'neutral' END")
    parts = dict(name=f"{p}name", tick=f"{p}ticker", price=f"format('{{:.2f}}', {p}price)",
                 vol=f"format('{{:,}}', {p}volume)", sent=f"format('{{:.3f}}', {p}avg_sentiment)",
                 sent_status=sent_status, bull=f"format('{{:.1f}}', {p}bullish_ratio * 100)",
                 pearson=f"format('{{:.3f}}', {p}pearson)", sig=f"{p}signal")
    return _render_sql(RP.ASSET_TEMPLATE, parts)


def _render_sql(template: str, parts: dict) -> str:
    out, rest = [], template
    while "{" in rest:
        i = rest.index("{")
        j = rest.index("}", i)
        out.append(_sql_str(rest[:i]))
        out.append(f"({parts[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    out.append(_sql_str(rest))
    return " || ".join(out)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _routing_sql() -> str:
    alias_case = " ".join(f"WHEN contains(lower(regexp_replace(message, '^\\s+|\\s+$', '', 'g')), 't{i}') THEN 'T{i}' "
                          f"WHEN contains(lower(regexp_replace(message, '^\\s+|\\s+$', '', 'g')), 'company {i}') THEN 'T{i}'" for i in range(8))
    mood = " OR ".join(f"contains(lower(regexp_replace(message, '^\\s+|\\s+$', '', 'g')), '{w}')" for w in RP.MOOD_WORDS)
    macro = _render_sql(RP.MACRO_TEMPLATE, dict(fg="CAST(mc.fg_score AS VARCHAR)", mood="mc.mood"))
    default = _render_sql(RP.DEFAULT_TEMPLATE, dict(query="regexp_replace(q.message, '^\\s+|\\s+$', '', 'g')"))
    return f""", questions AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS msg_id,
         CASE WHEN conv_id % 3 = 0 THEN 'T' || CAST(conv_id % 8 AS VARCHAR) || ' outlook? ' || text
              WHEN conv_id % 3 = 1 THEN 'Fear and greed today? ' || text ELSE text END AS message
  FROM conversations WHERE role = 'user'),
mc AS (SELECT CAST(trunc((coalesce(nullif(avg(compound), 0.0), 0.15) + 1.0) * 50) AS INTEGER) AS fg_score,
              CASE WHEN fg_score > 55 THEN 'GREED' WHEN fg_score < 45 THEN 'FEAR' ELSE 'NEUTRAL' END AS mood
       FROM posts WHERE ts >= (SELECT max(ts) FROM posts) - INTERVAL '2 hours' AND ts <= (SELECT max(ts) FROM posts)),
q AS (SELECT msg_id, message, CASE {alias_case} END AS ticker, {mood} AS moody
      FROM questions WHERE length(regexp_replace(message, '^\\s+|\\s+$', '', 'g')) > 0)
SELECT q.msg_id,
       CASE WHEN q.ticker IS NOT NULL THEN {_asset_text_sql('f.')} WHEN q.moody THEN {macro} ELSE {default} END AS reply,
       'native-nlp' AS source, q.ticker,
       CASE WHEN q.ticker IS NOT NULL THEN 'asset' WHEN q.moody THEN 'macro' ELSE 'default' END AS route
FROM q LEFT JOIN facts f ON f.ticker = q.ticker CROSS JOIN mc"""


def stage_facts(spark, sf):
    return RP.asset_facts(stage_ticks(spark, sf), stored_sentiment(spark, sf), stored_signals(spark, sf), load_universe(spark, sf))


_REPORT_CTES = [*S.CHAIN, S.SIG, S.LATEST_TICK, S.LATEST_SENT, S.LATEST_SIG, S.UNIVERSE, _FACTS_SQL]


@register("q_asset_report", "SNP9 JON6 SCA7 asset intelligence report text per ticker",
          S.with_ctes(*_REPORT_CTES) + f"SELECT ticker, name, {_asset_text_sql()} AS report FROM facts")
def q_asset_report(spark, sf):
    return RP.asset_reports(stage_facts(spark, sf))


@register("q_question_routing", "SNP10 SNP11 JON7 SCA21 question routing to asset / macro / default replies",
          S.with_ctes(*_REPORT_CTES).rstrip() + _routing_sql())
def q_question_routing(spark, sf):
    p = stage_posts(spark, sf)
    facts = stage_facts(spark, sf)
    macro = RP.macro_facts(p, as_of_literal(p), "2 hours")
    msgs = load_questions(spark, sf).select("msg_id", "message")
    return RP.route_questions(msgs, universe_aliases(load_universe(spark, sf)), facts, macro)


# --- sources: records, quotes, news; dedupe; manual log; change feed; CSV --------------------


@register("q_quote_extract", "SRC4 PRJ7 SCA22 quote documents -> ticks (last array element, fallbacks, rounding)",
          S.with_ctes(S.TICKS) + """SELECT ticker, round(price, 2) AS price, round(coalesce(nullif(open, 0), price), 2) AS open,
  round(coalesce(nullif(greatest(open, price), 0), price), 2) AS high,
  round(coalesce(nullif(least(open, price), 0), price), 2) AS low, round(price, 2) AS close,
  coalesce(volume, 0) AS volume, ts AS timestamp FROM ticks""", ["price", "open", "high", "low", "close"])
def q_quote_extract(spark, sf):
    docs = quote_documents(stage_ticks(spark, sf))
    return extract_quotes(docs, ts=F.col("ts"))


_QUOTES_SQL = S.with_ctes(S.TICKS) + """SELECT ticker, round(price, 2) AS price, round(coalesce(nullif(open, 0), price), 2) AS open,
  round(coalesce(nullif(greatest(open, price), 0), price), 2) AS high,
  round(coalesce(nullif(least(open, price), 0), price), 2) AS low, round(price, 2) AS close,
  coalesce(volume, 0) AS volume, ts AS timestamp FROM ticks"""


def _quote_files(spark, sf, slices: int = 1):
    """A folder of quote documents, written slice by slice (an iterator of the folder after each)."""
    QS.register(spark)
    path = scratch_path(spark, f"quote-docs-{uuid.uuid4().hex}")
    docs = quote_documents(stage_ticks(spark, sf)).select("tick_id", "ticker", "ts", "value")
    for k in range(slices):
        QS.write_quote_docs(docs.where(F.pmod(F.xxhash64("tick_id"), F.lit(slices)) == k) if slices > 1 else docs, path)
        yield path


@register("q_quote_source", "UDF3 SRC4 quote documents through a registered Python data source, many partitions",
          _QUOTES_SQL, ["price", "open", "high", "low", "close"])
def q_quote_source(spark, sf):
    path, = _quote_files(spark, sf)
    docs = spark.read.format(QS.NAME).option("splitBytes", 1 << 16).load(path)
    return extract_quotes(docs, ts=F.col("ts"))


@register("q_stream_quote_source", "UDF3 SRC4 STR7 the same source as a stream with file offsets, a restart between",
          _QUOTES_SQL, ["price", "open", "high", "low", "close"])
def q_stream_quote_source(spark, sf):
    run = scratch_path(spark, f"quote-stream-{uuid.uuid4().hex}")
    for path in _quote_files(spark, sf, slices=2):
        docs = spark.readStream.format(QS.NAME).load(path)
        out = ST.run_to_table(spark, extract_quotes(docs, ts=F.col("ts")), "quotes", run=run)
    return out


_NEWS_SQL = """news AS (
  SELECT page_id, 'news_' || md5(title) AS id, 'T' || CAST(page_id % 8 AS VARCHAR) AS ticker,
         '$' || 'T' || CAST(page_id % 8 AS VARCHAR) || ' News: ' || title || '. ' || substr(coalesce(description, ''), 1, 100) AS text,
         'YahooFinanceNews' AS username, NULL::TIMESTAMP AS timestamp, 1500000 AS followers,
         'Yahoo Finance RSS' AS source, 0.95::DOUBLE AS confidence_score, 0.05::DOUBLE AS bot_probability
  FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
               nullif(regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '<[^>]*>', '', 'g'), '') AS description
        FROM pages))"""


def stage_news(spark, sf):
    pages = read_table(spark, sf, "pages")
    items = NW.page_items(pages)
    return NW.news_to_posts(items, F.concat(F.lit("T"), F.pmod(F.col("page_id"), F.lit(8)).cast("string")))


@register("q_rss_posts", "SRC5 PRJ8 PRJ9 news items -> posts", S.with_ctes(_NEWS_SQL) + "SELECT * FROM news")
def q_rss_posts(spark, sf):
    return stage_news(spark, sf)


@register("q_dedupe_posts", "STR11 duplicate suppression by post id (first write wins)",
          S.with_ctes(_NEWS_SQL) + "SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id) = 1")
def q_dedupe_posts(spark, sf):
    return dedupe(stage_news(spark, sf), "id", ["page_id"])


_PAYLOADS = """payloads AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS msg_id, 't' || CAST(conv_id % 8 AS VARCHAR) AS ticker, text,
         CASE WHEN turn % 4 = 0 THEN NULL ELSE 'user' || CAST(conv_id AS VARCHAR) END AS username,
         CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(turn * 10 AS INTEGER) END AS followers
  FROM conversations WHERE role = 'user')"""


@register("q_manual_log", "SNK5 manual post injection with defaults and scoring",
          S.with_ctes(*S.BASE, _PAYLOADS).rstrip() + """, scored AS (
  SELECT p.*, CAST(""" + S._hits(S.POSITIVE_WORDS).replace("d.text", "p.text") + """ AS DOUBLE) AS np,
         CAST(""" + S._hits(S.NEGATIVE_WORDS).replace("d.text", "p.text") + """ AS DOUBLE) AS nn FROM payloads p)
SELECT 'tw_manual_' || msg_id AS id, upper(ticker) AS ticker, text,
  coalesce(username, 'manual_feed') AS username, (SELECT max(ts) FROM posts) AS timestamp,
  coalesce(followers, 500) AS followers, 0 AS likes, 0 AS retweets, 15 AS views, 'Manual API Feed' AS source,
  0.98::DOUBLE AS confidence_score, 0.01::DOUBLE AS bot_probability,
  CASE WHEN np + nn = 0 THEN 0.0 ELSE round((np - nn) / (np + nn), 3) END AS compound,
  CASE WHEN np + nn = 0 THEN 0.0 ELSE round(np / (np + nn), 3) END AS pos,
  CASE WHEN np + nn = 0 THEN 0.0 ELSE round(nn / (np + nn), 3) END AS neg,
  CASE WHEN np + nn = 0 THEN 1.0 ELSE 0.0 END AS neu
FROM scored""", ["compound", "pos", "neg", "neu", "confidence_score", "bot_probability"])
def q_manual_log(spark, sf):
    m = load_chat_messages(spark, sf)
    payloads = m.select("msg_id", F.concat(F.lit("t"), F.pmod(F.col("conv_id"), F.lit(8)).cast("string")).alias("ticker"),
                        F.col("message").alias("text"),
                        F.when(F.col("turn") % 4 != 0, F.concat(F.lit("user"), F.col("conv_id").cast("string"))).alias("username"),
                        F.when(F.col("turn") % 3 != 0, (F.col("turn") * 10).cast("int")).alias("followers"))
    return manual_posts(payloads, as_of_literal(stage_posts(spark, sf)))


LAST_PUSH_BEFORE = "1 day"   # the previous push happened this long before as_of


_TICK_JSON = """'{"ticker":"' || ticker || '","price":' || CAST(price AS VARCHAR) || ',"volume":' || CAST(volume AS VARCHAR)
  || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}'"""


@register("q_change_feed", "STR9 FLT4 FLT5 PRJ10 PRJ11 PRJ12 all three push messages with payloads since the previous push",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + f""", push AS (SELECT max(ts) - INTERVAL '{LAST_PUSH_BEFORE}' AS t0 FROM ticks),
newest AS (SELECT * FROM posts QUALIFY row_number() OVER (ORDER BY ts DESC, post_id DESC) = 1),
known AS (SELECT post_id FROM posts, push WHERE ts <= t0 QUALIFY row_number() OVER (ORDER BY ts DESC, post_id DESC) = 1)
SELECT 'new_ticks' AS type, CAST(tick_id AS VARCHAR) AS id, ticker, {_TICK_JSON} AS payload FROM ticks
WHERE tick_id > (SELECT max(tick_id) FROM ticks, push WHERE ts <= t0)
UNION ALL SELECT 'new_alerts', CAST(epoch_us(timestamp) AS VARCHAR), ticker,
  '{{"id":' || CAST(epoch_us(timestamp) AS VARCHAR) || ',"ticker":"' || ticker || '","severity":"' || severity || '","message":"' || message
  || '","type":"' || type || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"}}' FROM alerts, push WHERE timestamp > t0
UNION ALL SELECT 'new_tweet', CAST(n.post_id AS VARCHAR), n.ticker, '{{"id":' || CAST(n.post_id AS VARCHAR) || ',"ticker":"' || n.ticker
  || '","timestamp":"' || strftime(n.ts, '%Y-%m-%dT%H:%M:%S.%f') || '","compound":' || CAST(n.compound AS VARCHAR) || '}}'
  FROM newest n WHERE n.post_id NOT IN (SELECT post_id FROM known)""")
def q_change_feed(spark, sf):
    t, p = stage_ticks(spark, sf), stage_posts(spark, sf)
    push = as_of_literal(t) - F.expr(f"INTERVAL {LAST_PUSH_BEFORE}")
    # the marks of the previous push: one row each
    tick = t.filter(F.col("ts") <= push).agg(F.max("tick_id").alias("id"), F.max(F.unix_micros(push)).alias("at")).first()
    post = p.filter(F.col("ts") <= push).agg(F.max_by("post_id", F.struct("ts", "post_id")).alias("id")).first()
    alerts = stored_alerts(spark, sf).withColumn("alert_id", F.unix_micros("timestamp"))
    return change_feed(t, alerts, p, tick["id"] if tick["id"] is not None else -1, tick["at"] or 0, post["id"])


@register("q_tick_wire", "SRC7 PRJ10 SCA16 tick wire projection encoded as keyed JSON records",
          S.with_ctes(S.TICKS) + """SELECT ticker AS key, '{"ticker":"' || ticker || '","price":' || CAST(price AS VARCHAR)
  || ',"volume":' || CAST(volume AS VARCHAR) || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS value
FROM ticks""")
def q_tick_wire(spark, sf):
    return encode_records(tick_wire(stage_ticks(spark, sf)), "ticker", ts_cols=())


@register("q_parse_ticks", "PRJ2 PRJ3 parse encoded tick messages back into typed rows",
          S.with_ctes(S.TICKS) + """SELECT ticker, price, open, greatest(open, price) AS high, least(open, price) AS low,
  price AS close, volume, ts AS timestamp FROM ticks""", ["price", "open", "high", "low", "close"])
def q_parse_ticks(spark, sf):
    t = stage_ticks(spark, sf).select("ticker", "price", "open", F.greatest("open", "price").alias("high"),
                                     F.least("open", "price").alias("low"), F.col("price").alias("close"), "volume",
                                     F.col("ts").alias("timestamp"))
    return parse_ticks(encode_records(t, "ticker", ts_cols=("timestamp",)))


@register("q_csv_rows", "SNK7 JON6 CSV export rows of the market summary",
          S.with_ctes(*S.CHAIN, S.SIG, S.LATEST_TICK, S.LATEST_SENT, S.LATEST_SIG, S.SUMMARY, S.UNIVERSE)
          + """SELECT s.ticker AS "Ticker", coalesce(u.name, s.ticker) AS "Company Name", s.current_price AS "Price",
  s.volume AS "Volume", s.avg_sentiment AS "AvgSentiment", s.signal AS "Signal"
FROM summary s LEFT JOIN universe u USING (ticker)""", ['"Price"', '"AvgSentiment"'])
def q_csv_rows(spark, sf):
    return SN.export_rows(stage_summary(spark, sf), load_universe(spark, sf))


# --- streaming: run on the ingest tables as file streams, availableNow ----------------------


_PWM = "(SELECT max(ts) FROM posts) - INTERVAL '10 minutes'"
_TWM = "(SELECT least((SELECT max(ts) FROM posts), (SELECT max(ts) FROM ticks))) - INTERVAL '10 minutes'"


def _post_stream(spark, sf):
    return ST.read_stream(spark, posts_table_path(spark, sf))


def _tick_stream(spark, sf):
    return ST.read_stream(spark, ticks_table_path(spark, sf))


@register("q_stream_sentiment", "STR1 STR2 STR7 SNK1 watermarked tumbling windows, append, foreachBatch sink",
          S.with_ctes(*S.BASE, S.SENT_DAY) + f"SELECT * FROM sent_day WHERE window_end <= {_PWM}",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_stream_sentiment(spark, sf):
    return ST.run_to_table(spark, ST.stream_sentiment(_post_stream(spark, sf), WINDOW), "sentiment")


@register("q_stream_join", "STR5 JON1 stream-stream join of windowed aggregates (append)",
          S.with_ctes(*S.BASE, S.SENT_DAY, S.PRICE_DAY) + f"""SELECT * FROM sent_day JOIN price_day
  USING (ticker, window_start, window_end) WHERE window_end <= {_TWM}""",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity", "avg_price"])
def q_stream_join(spark, sf):
    return ST.run_to_table(spark, ST.stream_join(_post_stream(spark, sf), _tick_stream(spark, sf), WINDOW), "join")


@register("q_stream_union", "STR6 union stream, one windowed aggregate, update mode",
          S.with_ctes(*S.BASE, S.SENT_DAY, S.PRICE_DAY) + """SELECT ticker, window_start, window_end, s.avg_sentiment,
  coalesce(s.tweet_count, 0) AS tweet_count, s.bullish_ratio, s.bearish_ratio, p.avg_price,
  coalesce(p.price_tick_count, 0) AS price_tick_count
FROM sent_day s FULL OUTER JOIN price_day p USING (ticker, window_start, window_end)""",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "avg_price"])
def q_stream_union(spark, sf):
    u = ST.stream_union(_post_stream(spark, sf), _tick_stream(spark, sf), WINDOW)
    return ST.run_to_table(spark, u, "union", mode="update", key=["ticker", "window_start", "window_end"])


@register("q_stream_post_alerts", "STR8 ALR1 stateless alerting on the post stream",
          S.with_ctes(*S.BASE) + """SELECT post_id, ticker, ts AS timestamp,
  CASE WHEN compound <= -0.75 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
  CASE WHEN compound <= -0.75 THEN 'Panic Alert: Extreme Bearish' ELSE 'FOMO Alert: Extreme Bullish' END
    || ' Sentiment detected on $' || ticker || '. Username: @' || username AS message,
  CASE WHEN compound <= -0.75 THEN 'Bearish Crash' ELSE 'Bullish Spike' END AS type
FROM posts WHERE compound <= -0.75 OR compound >= 0.75""")
def q_stream_post_alerts(spark, sf):
    return ST.run_to_table(spark, ST.stream_post_alerts(_post_stream(spark, sf)), "alerts")


@register("q_stream_dedupe", "STR11 dropDuplicatesWithinWatermark over a replayed (doubled) post stream",
          S.with_ctes(*S.BASE) + "SELECT post_id, ticker, ts, compound FROM posts")
def q_stream_dedupe(spark, sf):
    a = _post_stream(spark, sf).select("post_id", "ticker", "ts", "compound")
    b = _post_stream(spark, sf).select("post_id", "ticker", "ts", "compound")
    return ST.run_to_table(spark, ST.dedupe_stream(a.unionByName(b)), "dedupe")


@register("q_stream_board", "STR12 JON8 per-ticker latest-tick board state (update mode)",
          S.with_ctes(S.TICKS, S.LATEST_TICK) + "SELECT ticker, ts, tick_id, price, volume FROM lt", ["price"])
def q_stream_board(spark, sf):
    return ST.run_to_table(spark, ST.stream_board(_tick_stream(spark, sf)), "board", mode="update", key=["ticker"])


@register("q_stream_board_state", "STR12 JON8 the board read from the running stream's state, no sink of update rows",
          S.with_ctes(S.TICKS, S.LATEST_TICK) + "SELECT ticker, ts, tick_id, price, volume FROM lt", ["price"])
def q_stream_board_state(spark, sf):
    """The board stream runs twice over one checkpoint, a restart between; its state is then the table."""
    path, run = scratch_path(spark, f"board-ticks-{uuid.uuid4().hex}"), scratch_path(spark, f"board-state-{uuid.uuid4().hex}")
    t = stage_ticks(spark, sf).select("ticker", "ts", "tick_id", "price", "volume")
    half = as_of_literal(t) - F.expr("INTERVAL 10 days")
    for part in (t.where(F.col("ts") <= half), t.where(F.col("ts") > half)):
        part.write.mode("append").parquet(path)
        ST.advance(ST.stream_board(ST.read_stream(spark, path)), run, "update")
    return ST.board_from_state(spark, run)


@register("q_stream_change_feed", "STR9 PRJ11 PRJ12 change feed of ticks, posts and alerts, the checkpoint as high-water mark",
          S.with_ctes(*S.BASE) + f"""SELECT 'new_ticks' AS type, CAST(tick_id AS VARCHAR) AS id, ticker, {_TICK_JSON} AS payload FROM ticks
UNION ALL SELECT 'new_tweet', CAST(post_id AS VARCHAR), ticker, '{{"id":' || CAST(post_id AS VARCHAR) || ',"ticker":"' || ticker
  || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","compound":' || CAST(compound AS VARCHAR) || '}}' FROM posts
UNION ALL SELECT 'new_alerts', CAST(epoch_us(ts) AS VARCHAR), ticker, '{{"id":' || CAST(epoch_us(ts) AS VARCHAR) || ',"ticker":"' || ticker
  || '","severity":"' || CASE WHEN compound <= -0.75 THEN 'CRITICAL' ELSE 'INFO' END || '","message":"'
  || CASE WHEN compound <= -0.75 THEN 'Panic Alert: Extreme Bearish' ELSE 'FOMO Alert: Extreme Bullish' END
  || ' Sentiment detected on $' || ticker || '. Username: @' || username || '","type":"'
  || CASE WHEN compound <= -0.75 THEN 'Bearish Crash' ELSE 'Bullish Spike' END
  || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}}' FROM posts WHERE compound <= -0.75 OR compound >= 0.75""")
def q_stream_change_feed(spark, sf):
    return ST.run_to_table(spark, ST.stream_change_feed(_tick_stream(spark, sf), _post_stream(spark, sf)), "feed")


PANE_DAYS = (0, 2, 10)      # snapshots as of the newest whole hour and so many days before


@register("q_pane_snapshots", "AGG6 AGG7 AGG8 SNP3 SNP4 SNP7 counters kept up by the sink: metrics, mood and trending from pane states only",
          S.with_ctes(*S.BASE).rstrip() + f""", newest AS (SELECT date_trunc('hour', max(ts)) AS t FROM posts),
asked AS (SELECT t - d * INTERVAL '1 day' AS as_of FROM newest, (SELECT unnest({list(PANE_DAYS)}) AS d)),
near AS (SELECT a.as_of, p.* FROM posts p JOIN asked a ON p.ts >= a.as_of - INTERVAL '1 day' AND p.ts < a.as_of),
ranked AS (SELECT as_of, ticker, count(post_id) AS mentions, row_number() OVER (PARTITION BY as_of ORDER BY count(post_id) DESC, ticker) AS nth
           FROM near GROUP BY as_of, ticker)
SELECT a.as_of, 'avg_compound' AS metric, NULL AS ticker, coalesce(avg(compound), 0)::DOUBLE AS value FROM asked a LEFT JOIN near n USING (as_of) GROUP BY a.as_of
UNION ALL SELECT a.as_of, 'n_posts', NULL, count(n.post_id)::DOUBLE FROM asked a LEFT JOIN near n USING (as_of) GROUP BY a.as_of
UNION ALL SELECT as_of, 'mentions', ticker, mentions::DOUBLE FROM ranked WHERE nth <= 4
UNION ALL SELECT NULL, 'total_posts', NULL, count(*)::DOUBLE FROM posts
UNION ALL SELECT NULL, 'total_ticks', NULL, count(*)::DOUBLE FROM ticks""", ["value"])
def q_pane_snapshots(spark, sf):
    panes, newest = stream_panes(spark, sf), stage_posts(spark, sf).agg(F.max(F.unix_micros("ts")).alias("t")).first()["t"]
    return pane_snapshots(panes, newest)


def stream_panes(spark, sf, pane: str = "1 hour") -> DataFrame:
    """Pane states of the post and tick streams, three micro-batches each at least."""
    path, run = scratch_path(spark, f"panes-{uuid.uuid4().hex}"), scratch_path(spark, f"panes-run-{uuid.uuid4().hex}")
    for kind, table, id_col, value in (("posts", stage_posts(spark, sf), "post_id", "compound"), ("ticks", stage_ticks(spark, sf), "tick_id", "price")):
        source = scratch_path(spark, f"panes-{kind}-{uuid.uuid4().hex}")
        table.repartition(3).write.parquet(source)
        ST.advance(ST.read_stream(spark, source, max_files=1), f"{run}/{kind}", sink=make_sink(PN.pane_writer(path, kind, pane, id_col, value)))
    PN.compact(spark, path, "posts", 1)
    return PN.read_panes(spark, path)


def pane_snapshots(panes: DataFrame, newest_us: int, pane: str = "1 hour", rows: DataFrame | None = None, back: int = 0) -> DataFrame:
    """(as_of, metric, ticker, value): mood and trending of the day before each instant, and the totals."""
    hour, day = 3_600_000_000, 86_400_000_000
    out = PN.totals(panes).select(F.lit(None).cast("timestamp").alias("as_of"), F.concat(F.lit("total_"), "kind").alias("metric"),
                                  F.lit(None).cast("string").alias("ticker"), F.col("value").cast("double").alias("value"))
    for days in PANE_DAYS:
        stop = newest_us // hour * hour - days * day - back
        states = PN.covered(panes, rows, "posts", stop - day, stop, pane, "post_id", "compound")
        at = F.timestamp_micros(F.lit(stop)).alias("as_of")
        m = PN.mood(states).select(F.explode(F.array(F.struct(F.lit("avg_compound").alias("metric"), F.col("avg_compound").alias("value")),
                                                     F.struct(F.lit("n_posts").alias("metric"), F.col("n_posts").cast("double").alias("value")))).alias("m"))
        out = out.unionByName(m.select(at, "m.metric", F.lit(None).cast("string").alias("ticker"), "m.value"))
        out = out.unionByName(PN.trending(states).select(at, F.lit("mentions").alias("metric"), "ticker", F.col("mentions").cast("double").alias("value")))
    return out


SLICES, LATE_DELAY = 8, "12 hours"


@register("q_late_rows", "STR10 SNK3 rows behind the watermark kept with the watermark they missed, counters per micro-batch",
          S.with_ctes(*S.BASE).rstrip() + f""", dealt AS (SELECT post_id, ticker, ts, CAST(epoch_us(ts) // 86400000000 * 5 % {SLICES} AS BIGINT) AS slice FROM posts),
slices AS (SELECT slice, row_number() OVER (ORDER BY slice) - 1 AS batch, max(epoch_us(ts)) AS newest FROM dealt GROUP BY slice),
marks AS (SELECT *, (max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000000) // 1000 * 1000 AS mark FROM slices)
SELECT d.post_id, d.ticker, d.ts, CAST(m.batch AS INTEGER) AS batch_id, make_timestamp(m.mark) AS watermark
FROM dealt d JOIN marks m USING (slice) WHERE (epoch_us(d.ts) // 86400000000 + 1) * 86400000000 <= m.mark""")
def q_late_rows(spark, sf):
    """The posts' days arrive out of order, in slices of one micro-batch each."""
    run = late_run(spark, sf)
    return LT.read_gate(spark, run, "late").select("post_id", "ticker", "ts", "batch_id", "watermark")


def late_run(spark, sf) -> str:
    p = stage_posts(spark, sf).select("post_id", "ticker", "ts", "compound")
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    path, run = scratch_path(spark, f"slices-{uuid.uuid4().hex}"), scratch_path(spark, f"gate-{uuid.uuid4().hex}")
    for k in range(SLICES):
        part = p.where(F.pmod(day * 5, F.lit(SLICES)) == k)
        if not part.isEmpty():                    # a slice without rows would not be a micro-batch
            part.write.mode("append").parquet(path)
            LT.gate_rows(ST.read_stream(spark, path), run, WINDOW, LATE_DELAY)
    return run


SUBSCRIBERS, SILENT = 3, "6 hours"


@register("q_subscriber_feed", "STR9 FLT4 FLT5 per-subscriber high-water marks in state, silent subscribers expire, a restart between",
          S.with_ctes(S.TICKS) + f""", polls AS (SELECT 'S' || CAST(user_id % {SUBSCRIBERS} AS VARCHAR) AS subscriber, ts FROM events
  WHERE event_type NOT IN ('view', 'purchase') GROUP BY 1, 2),
heads AS (SELECT ts, max(max(tick_id)) OVER (ORDER BY ts) AS head FROM ticks GROUP BY ts),
seen AS (SELECT p.subscriber, p.ts, coalesce(h.head, -1) AS head FROM polls p ASOF LEFT JOIN heads h ON p.ts >= h.ts),
ranges AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '{SILENT}' THEN lag(head) OVER w END AS mark FROM seen
  WINDOW w AS (PARTITION BY subscriber ORDER BY ts))
SELECT r.subscriber, r.ts AS polled_at, t.tick_id, t.ticker, t.price FROM ranges r JOIN ticks t ON t.tick_id > r.mark AND t.tick_id <= r.head""",
          ["price"])
def q_subscriber_feed(spark, sf):
    t = stage_ticks(spark, sf).select("tick_id", "ticker", "ts", "price")
    ev = read_table(spark, sf, "events").where(~F.col("event_type").isin("view", "purchase"))
    polls = ev.select(F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(SUBSCRIBERS)).cast("string")).alias("subscriber"),
                      F.col("ts").cast("timestamp").alias("ts")).distinct()
    heads = scratch_path(spark, f"heads-{uuid.uuid4().hex}")
    SB.with_heads(polls, t).write.parquet(heads)
    polls = spark.read.parquet(heads)
    path, run = scratch_path(spark, f"polls-{uuid.uuid4().hex}"), scratch_path(spark, f"feed-{uuid.uuid4().hex}")
    half = as_of_literal(t) - F.expr("INTERVAL 10 days")
    for part in (polls.where(F.col("ts") <= half), polls.where(F.col("ts") > half)):
        part.write.mode("append").parquet(path)
        SB.run_feed(spark, ST.read_stream(spark, path), t, run, ttl=SILENT)
    return read_batches(spark, f"{run}/out").select("subscriber", "polled_at", "tick_id", "ticker", "price")


@register("q_stream_sinks", "SNK1 SNK2 SNK3 STR7 joined windows written to aggregates and signals tables",
          S.with_ctes(*S.BASE, S.SENT_DAY, S.PRICE_DAY) + f"""SELECT ticker, window_start, window_end, avg_sentiment,
  tweet_count, bullish_ratio, bearish_ratio, velocity
FROM sent_day JOIN price_day USING (ticker, window_start, window_end) WHERE window_end <= {_TWM}""",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_stream_sinks(spark, sf):
    agg, sig = ST.run_joined_sink(spark, _post_stream(spark, sf), _tick_stream(spark, sf), WINDOW)
    return agg


def _dec(x: str, d: int) -> str:
    """Browser ``toFixed(d)`` in SQL: a value that is exactly a binary tie (x * 2^(d+1) is
    an integer and x * 10^d ends in .5) rounds away from zero via an exact DECIMAL; every
    other value goes through ``format``, which rounds the exact binary value."""
    k, m = 2 ** (d + 1), 10 ** d
    return (f"CASE WHEN ({x}) * {k} = floor(({x}) * {k}) AND ({x}) * {m} - floor(({x}) * {m}) = 0.5 "
            f"THEN CAST(round(({x})::DECIMAL(38,18), {d}) AS VARCHAR) ELSE format('{{:.{d}f}}', ({x})) END")


@register("q_board_cards", "SCA19 board display texts (signed percent, price, volume in thousands)",
          S.with_ctes(*S.CHAIN, S.SIG, S.LATEST_TICK, S.LATEST_SENT, S.LATEST_SIG, S.SUMMARY, S.UNIVERSE)
          + f"""SELECT s.ticker, coalesce(u.name, s.ticker) AS name,
  CASE WHEN s.price_change_pct >= 0 THEN '+' ELSE '' END || {_dec('s.price_change_pct', 2)} || '%' AS change_text,
  '$' || {_dec('s.current_price', 2)} AS price_text,
  'Vol: ' || {_dec('s.volume / 1000', 0)} || 'k' AS vol_text,
  format('{{:,}}', s.volume) AS volume_text,
  {_dec('s.avg_sentiment', 2)} AS sentiment_text
FROM summary s LEFT JOIN universe u USING (ticker)""")
def q_board_cards(spark, sf):
    return SN.board_cards(stage_summary(spark, sf), load_universe(spark, sf))


@register("q_stream_sliding", "STR3 STR1 watermarked sliding windows on the post stream (append)",
          S.with_ctes(*S.BASE) + f"""SELECT * FROM (SELECT ticker, window_start, window_start + INTERVAL '1 day' AS window_end,
  avg(compound) AS avg_sentiment, count(post_id) AS tweet_count,
  avg(CASE WHEN compound > 0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bullish_ratio,
  avg(CASE WHEN compound < -0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bearish_ratio,
  count(post_id)::DOUBLE / 1440 AS velocity
FROM (SELECT p.*, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start
      FROM posts p, range(4) r(k)) s
GROUP BY 1, 2, 3) WHERE window_end <= {_PWM}""", ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_stream_sliding(spark, sf):
    return ST.run_to_table(spark, ST.stream_sentiment(_post_stream(spark, sf), WINDOW, SLIDE), "sliding")


def _post_messages_path(spark, sf) -> str:
    """Post messages as a producer would publish them (key = ticker, JSON value), written
    once per input snapshot to the shared folder: the stream's source topic."""
    from marketspark.sources import tables as TB

    def build():
        p = TB.load_posts(spark, sf).select(F.col("post_id").cast("string").alias("id"), "ticker", "text", "username",
                                            F.col("ts").alias("timestamp"), F.col("followers").cast("int").alias("followers"))
        return encode_records(p, "ticker", ts_cols=("timestamp",))
    key = TB.snapshot_key(spark, sf, ["documents", "events"], "post-messages")
    return TB.written_table(spark, key, "post-messages", build, sort=())


@register("q_stream_messages", "SRC1 PRJ1 PRJ3 UDF1 STR1 STR2: JSON messages -> parse -> score -> watermark -> windows",
          S.with_ctes(*S.BASE, S.SENT_DAY) + f"SELECT * FROM sent_day WHERE window_end <= {_PWM}",
          ["avg_sentiment", "bullish_ratio", "bearish_ratio", "velocity"])
def q_stream_messages(spark, sf):
    raw = ST.read_stream(spark, _post_messages_path(spark, sf)).select("key", "value")
    posts = ST.scored_post_stream(raw)
    return ST.run_to_table(spark, ST.stream_sentiment(posts, WINDOW), "messages")


@register("q_stream_signals", "SNK2 SIG3 COR2 streaming signals with the per-window Pearson computed for closed windows",
          S.with_ctes(*S.CHAIN, S.PRICE_DAY) + f"""SELECT s.ticker, s.window_end AS timestamp, c.pearson, 0 AS lag,
  CASE WHEN s.avg_sentiment > 0.5 AND c.pearson > 0.3 THEN 'BUY'
       WHEN s.avg_sentiment < -0.5 AND c.pearson < -0.3 THEN 'SELL' ELSE 'HOLD' END AS signal,
  0.8::DOUBLE AS confidence
FROM sent_day s JOIN price_day p USING (ticker, window_start, window_end)
LEFT JOIN corr_day c USING (ticker, window_start, window_end)
WHERE s.window_end <= {_TWM}""", ["pearson", "confidence"])
def q_stream_signals(spark, sf):
    enrich = ST.correlation_enricher(stage_ticks(spark, sf), stage_posts(spark, sf), WINDOW, LOOKBACK)
    _, sig = ST.run_joined_sink(spark, _post_stream(spark, sf), _tick_stream(spark, sf), WINDOW, enrich=enrich)
    return sig


@register("q_stream_interval_corr", "STR5 JON2 COR2 tick-post interval join, per-tick means and Pearson in the stream's state",
          S.with_ctes(*S.CHAIN) + f"""SELECT * FROM corr_day WHERE window_end <= {_TWM} - INTERVAL '12 hours'""",
          ["pearson", "first_price", "last_price", "momentum"])
def q_stream_interval_corr(spark, sf):
    out = ST.stream_interval_correlation(_post_stream(spark, sf), _tick_stream(spark, sf), WINDOW, LOOKBACK)
    return ST.run_to_table(spark, out, "interval")


@register("q_correlation_detail", "SNP2 FLT6 correlation detail header per supported ticker",
          S.with_ctes(*S.CHAIN, S.SIG, S.LATEST_SIG, S.UNIVERSE) + """, pts AS (
  SELECT ticker, count(*) AS n_points FROM (
    SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) AS rnk FROM ticks)
  WHERE rnk <= 30 GROUP BY ticker)
SELECT u.ticker, coalesce(sg.pearson, 0.0) AS pearson_coefficient, coalesce(sg.confidence, 0.5) AS confidence_score,
  coalesce(sg.signal, 'HOLD') AS trading_signal, coalesce(pts.n_points, 0) AS n_points
FROM universe u LEFT JOIN sg USING (ticker) LEFT JOIN pts USING (ticker)""", ["pearson_coefficient", "confidence_score"])
def q_correlation_detail(spark, sf):
    t = stage_ticks(spark, sf)
    sigs = stored_signals(spark, sf)
    tl = last_n_per_key(t.select("ticker", "ts", "tick_id"), "ticker", ["ts", "tick_id"], 30)
    return SN.correlation_detail(load_universe(spark, sf), sigs, tl)


# --- further operators ----------------------------------------------------------------------

_SENT_SLIDE = """sent_slide AS (SELECT ticker, window_start, window_start + INTERVAL '1 day' AS window_end, avg(compound) AS avg_sentiment
FROM (SELECT p.*, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start FROM posts p, range(4) r(k)) s GROUP BY 1, 2, 3)"""
_ALIGNED_SLIDE = """aligned AS (
  SELECT t.tick_id, t.ticker, t.ts, t.price, t.window_start, t.window_start + INTERVAL '1 day' AS window_end,
         round(coalesce(avg(p.compound), 0.0), 9) AS sentiment, count(p.compound) AS n_posts
  FROM (SELECT x.*, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS window_start FROM ticks x, range(4) r(k)) t
  LEFT JOIN posts p ON p.ticker = t.ticker AND p.ts >= t.window_start AND p.ts >= t.ts - INTERVAL '12 hours' AND p.ts <= t.ts
  GROUP BY t.tick_id, t.ticker, t.ts, t.price, t.window_start)"""


@register("q_sliding_signals", "JON2 COR2 SIG1 rolling signal: 1-day windows every 6 hours over the trailing average",
          S.with_ctes(*S.BASE, _SENT_SLIDE.replace("sent_slide", "sent_day"), _ALIGNED_SLIDE, S.CORR, S.signals_cte(0.1, 0.1, 0.002))
          + "SELECT * FROM sig", ["pearson", "avg_sentiment", "momentum", "confidence"])
def q_sliding_signals(spark, sf):
    t, p = stage_ticks(spark, sf), stage_posts(spark, sf)
    aligned = rolling_sentiment_at_ticks(t, p, window=WINDOW, lookback=LOOKBACK, slide=SLIDE)
    return signals(window_correlation(aligned, min_ticks=5), sentiment_windows(p, WINDOW, SLIDE), sent_t=0.1, corr_t=0.1, mom_t=0.002)


@register("q_universe_filter", "FLT6 posts of supported (semi join) and unsupported (anti join) tickers",
          S.with_ctes(*S.BASE) + "SELECT post_id, ticker, ticker IN ('T0', 'T1', 'T2', 'T3') AS supported FROM posts")
def q_universe_filter(spark, sf):
    p = stage_posts(spark, sf).select("post_id", "ticker")
    half = load_universe(spark, sf).where("ordinal < 4")
    return (in_universe(p, half).withColumn("supported", F.lit(True))
            .unionByName(unsupported(p, half).withColumn("supported", F.lit(False))))


@register("q_board_merge", "JON8 newest ticks merged into the board of a day before",
          S.with_ctes(S.TICKS) + """, m AS (SELECT max(ts) - INTERVAL '1 day' AS t0 FROM ticks),
b AS (SELECT ticker, price, volume, tick_id AS board_tick FROM ticks, m WHERE ts <= t0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) = 1),
n AS (SELECT ticker, price, volume FROM ticks, m WHERE ts > t0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) = 1)
SELECT b.ticker, coalesce(n.price, b.price) AS price, coalesce(n.volume, b.volume) AS volume, board_tick FROM b LEFT JOIN n USING (ticker)""", ["price"])
def q_board_merge(spark, sf):
    t = stage_ticks(spark, sf)
    at = as_of_literal(t) - F.expr("INTERVAL 1 day")
    board = SN.latest_tick(t.where(F.col("ts") <= at)).select("ticker", "price", "volume", F.col("tick_id").alias("board_tick"))
    return merge_board(board, t.where(F.col("ts") > at))


@register("q_quote_fallback", "SET1 quotes with stored ticks for tickers that the source lacks",
          S.with_ctes(S.TICKS, S.LATEST_TICK) + """SELECT ticker, CASE WHEN substr(ticker, 2)::INT % 2 = 0 THEN round(price, 2) ELSE price END AS price,
  CASE WHEN substr(ticker, 2)::INT % 2 = 0 THEN 'quote' ELSE 'stored' END AS origin FROM lt""", ["price"])
def q_quote_fallback(spark, sf):
    latest = SN.latest_tick(stage_ticks(spark, sf))
    quotes = extract_quotes(quote_documents(latest.where(F.substring("ticker", 2, 9).cast("int") % 2 == 0)), ts=F.col("ts"))
    return with_fallback(quotes.select("ticker", "price", F.lit("quote").alias("origin")),
                         latest.select("ticker", "price", F.lit("stored").alias("origin")))


@register("q_alert_buffer", "TOP6 newest 50 of old and new alerts",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + "SELECT * FROM alerts ORDER BY timestamp DESC, ticker DESC, type DESC, message DESC LIMIT 50")
def q_alert_buffer(spark, sf):
    a = stored_alerts(spark, sf)
    at = as_of_literal(stage_ticks(spark, sf)) - F.expr("INTERVAL 1 day")
    return alert_buffer(a.where(F.col("timestamp") <= at), a.where(F.col("timestamp") > at), ["timestamp", "ticker", "type", "message"])


@register("q_first_tickers", "TOP7 first four tickers in universe order",
          S.with_ctes(S.TICKS, S.LATEST_TICK) + "SELECT ticker, price FROM lt ORDER BY ticker LIMIT 4", ["price"])
def q_first_tickers(spark, sf):
    return first_k_by_ordinal(SN.latest_tick(stage_ticks(spark, sf)).select("ticker", "price"), load_universe(spark, sf), 4).select("ticker", "price")


@register("q_strong_buy", "ALR3 strong-buy mark on alerts",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + "SELECT *, contains(message, 'Strong BUY') AS strong_buy FROM alerts")
def q_strong_buy(spark, sf):
    return strong_buy_flag(stored_alerts(spark, sf))


@register("q_scorer_by_name", "SCA5 scorer chosen by name",
          S.with_ctes(*S.BASE).rstrip() + ", lexed AS (WITH own AS (SELECT 1)" + _lexicon_sql().replace(", lex(token", ", lex(token", 1) + """)
SELECT 'VADER' AS model, post_id, compound FROM lexed
UNION ALL SELECT 'llm', post_id, greatest(-1.0, least(1.0, compound * 1.05)) FROM lexed
UNION ALL SELECT 'keyword', post_id, compound FROM posts""", ["compound"])
def q_scorer_by_name(spark, sf):
    ids = stage_posts(spark, sf).select("post_id")
    texts = post_texts(spark, sf)
    out = [LX.score_posts(texts, m).select(F.lit(m).alias("model"), "post_id", "compound").join(ids, "post_id", "left_semi")
           for m in ("VADER", "llm", "keyword")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("model", "post_id", "compound")


@register("q_scorer_fallback", "UDF2 fallback scorer where the primary yields no score",
          S.with_ctes(*S.BASE) + "SELECT post_id, CASE WHEN length(text) % 2 = 0 THEN greatest(-1.0, least(1.0, compound * 1.05)) ELSE compound END AS compound FROM posts",
          ["compound"])
def q_scorer_fallback(spark, sf):
    def primary(text):
        s = scale_score(score_keyword(text))
        return F.when(F.length(text) % 2 == 0, s).otherwise(F.lit(None))
    d = with_scores(post_texts(spark, sf), "text", primary, fallback=score_keyword)
    return d.select("post_id", "compound").join(stage_posts(spark, sf).select("post_id"), "post_id", "left_semi")


@register("q_parse_fallback", "PRJ3 junk and missing times fall back to the arrival time",
          S.with_ctes(S.TICKS) + """SELECT ticker, price, CASE WHEN tick_id % 5 IN (0, 1) THEN (SELECT max(ts) FROM ticks) ELSE ts END AS timestamp FROM ticks""", ["price"])
def q_parse_fallback(spark, sf):
    t = stage_ticks(spark, sf)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.when(F.col("tick_id") % 5 == 0, F.lit("soon")).when(F.col("tick_id") % 5 != 1, iso)
    raw = encode_records(t.select("ticker", "price", stamp.alias("timestamp")), "ticker", ts_cols=())
    return parse_ticks(raw, default_ts=as_of_literal(t)).select("ticker", "price", "timestamp")


@register("q_truncated", "SNK6 stored tables emptied in place: their rows before and after",
          S.with_ctes(*S.CHAIN, S.SIG, S.ALERTS) + """SELECT 'ticks' AS name, count(*) AS rows_before, 0 AS rows_after FROM ticks
UNION ALL SELECT 'aggregates', count(*), 0 FROM sent_day
UNION ALL SELECT 'signals', count(*), 0 FROM sig
UNION ALL SELECT 'alerts', count(*), 0 FROM alerts""")
def q_truncated(spark, sf):
    tables = {"ticks": stage_ticks(spark, sf), "aggregates": stored_sentiment(spark, sf), "signals": stored_signals(spark, sf),
              "alerts": stored_alerts(spark, sf)}
    out = None
    for name, table in tables.items():
        path = scratch_path(spark, f"truncated-{name}-{uuid.uuid4().hex}")
        table.write.parquet(path)
        before = spark.read.parquet(path).count()
        truncate(spark, path, table.schema)
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_after")).select(
            F.lit(name).alias("name"), F.lit(before).cast("bigint").alias("rows_before"), "rows_after")
        out = row if out is None else out.unionByName(row)
    return out


@register("q_rss_feed", "SRC5 PRJ8 PRJ9 feed items read as XML, with RFC 822 dates",
          """SELECT 'news_' || md5(title) AS id, 'NVDA' AS ticker, '$NVDA News: ' || title || '. ' AS text,
  TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1 hour' AS timestamp
FROM (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages) WHERE title <> ''""")
def q_rss_feed(spark, sf):
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST(page_id AS INT), 0, 0)")
    items = NW.page_items(read_table(spark, sf, "pages")).select(
        F.trim("title").alias("title"), F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pubDate"))
    path = scratch_path(spark, f"rss-{uuid.uuid4().hex}")
    items.where("title <> ''").write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return NW.news_to_posts(NW.read_rss(spark, path), F.lit("NVDA")).select("id", "ticker", "text", "timestamp")


def _tick_messages_path(spark, sf) -> str:
    """Tick messages as a producer would publish them, written once per input snapshot."""
    def build():
        t = stage_ticks(spark, sf).select("ticker", "price", "open", "volume", F.col("ts").alias("timestamp"))
        return encode_records(t, "ticker", ts_cols=("timestamp",))
    return written_table(spark, snapshot_key(spark, sf, ["events"], "tick-messages"), "tick-messages", build, sort=())


@register("q_stream_ticks", "SRC2 PRJ2 STR1 AGG3 tick messages: parse, watermark, price windows",
          S.with_ctes(S.TICKS, S.PRICE_DAY) + "SELECT * FROM price_day WHERE window_end <= (SELECT max(ts) FROM ticks) - INTERVAL '10 minutes'",
          ["avg_price"])
def q_stream_ticks(spark, sf):
    raw = ST.read_stream(spark, _tick_messages_path(spark, sf)).select("key", "value")
    ticks = parse_ticks(raw).withColumnRenamed("timestamp", "ts")
    return ST.run_to_table(spark, ST.stream_prices(ticks, WINDOW), "ticks")


@register("q_stream_late", "STR2 STR10 several micro-batches: rows behind the watermark are dropped, open windows carry over",
          S.with_ctes(*S.BASE) + f""", cut AS (SELECT {S.day('max(ts)')} - INTERVAL '4 days' AS t0 FROM posts),
kept AS (SELECT p.* FROM posts p, cut WHERE ts >= t0)
SELECT ticker, {S.day('ts')} AS window_start, {S.day('ts')} + INTERVAL '1 day' AS window_end, avg(compound) AS avg_sentiment, count(post_id) AS tweet_count
FROM kept GROUP BY 1, 2, 3 HAVING {S.day('ts')} + INTERVAL '1 day' <= {_PWM}""", ["avg_sentiment"])
def q_stream_late(spark, sf):
    """Day by day the newest days arrive first to last, then everything older, all too late."""
    p = stage_posts(spark, sf).select("post_id", "ticker", "ts", "compound")
    cut = F.date_trunc("day", as_of_literal(p)) - F.expr("INTERVAL 4 days")
    mid = cut + F.expr("INTERVAL 2 days")
    path, run = scratch_path(spark, f"late-{uuid.uuid4().hex}"), scratch_path(spark, f"late-run-{uuid.uuid4().hex}")
    for part in (p.where((F.col("ts") >= cut) & (F.col("ts") < mid)), p.where(F.col("ts") >= mid), p.where(F.col("ts") < cut)):
        part.write.mode("append").parquet(path)          # the files of a slice are one micro-batch, in this order
        out = ST.run_to_table(spark, ST.stream_sentiment(ST.read_stream(spark, path), WINDOW), "late", run=run)
    return out.select("ticker", "window_start", "window_end", "avg_sentiment", "tweet_count")


@register("q_pluggable_source", "UDF3 SRC3 a caller's loader in place of the parquet reader",
          S.with_ctes(S.TICKS) + "SELECT tick_id, ticker, ts, price, open, volume FROM ticks", ["price", "open"])
def q_pluggable_source(spark, sf):
    """The tick adapter over a loader that serves the whole table from another place and format."""
    return plugged_ticks(spark, sf)


def plugged_ticks(spark, sf):
    """All ticks, of events copied to ORC below the shared folder and read by a caller's loader."""
    folder = scratch_path(spark, f"plugged-{uuid.uuid4().hex}")
    read_table(spark, sf, "events").write.orc(f"{folder}/events")
    return load_ticks(spark, folder, reader=lambda session, place, name: session.read.orc(f"{place}/{name}"))
