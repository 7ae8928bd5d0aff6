"""DuckDB SQL fragments that restate the fixture adapters and shared stages.

They are the oracle side of the registered queries: plain SQL over the supplied tables,
written independently of the Spark plans (correlated range joins, ``corr``, ``lag`` over
whole tickers, ASOF JOIN) so that a match is evidence, not an echo.
"""

from __future__ import annotations

from marketspark.functions.sentiment import NEGATIVE_WORDS, POSITIVE_WORDS


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(d.text), '{w}') AS INTEGER)" for w in words)


TICKS = """ticks AS (
  SELECT event_id AS tick_id, 'T' || CAST(user_id % 8 AS VARCHAR) AS ticker, ts, 100 + value AS price,
         coalesce(lag(100 + value) OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id), 100 + value) AS open,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS volume
  FROM events WHERE event_type IN ('view', 'purchase'))"""

POSTS = f"""posts AS (
  SELECT post_id, ticker, ts, text, username, followers,
         CASE WHEN np + nn = 0 THEN 0.0 ELSE round((np - nn) / (np + nn), 3) END AS compound,
         CASE WHEN np + nn = 0 THEN 0.0 ELSE round(np / (np + nn), 3) END AS pos,
         CASE WHEN np + nn = 0 THEN 0.0 ELSE round(nn / (np + nn), 3) END AS neg,
         CASE WHEN np + nn = 0 THEN 1.0 ELSE 0.0 END AS neu
  FROM (SELECT d.doc_id AS post_id, 'T' || CAST(e.user_id % 8 AS VARCHAR) AS ticker, e.ts, d.text,
               d.source AS username, d.n_chars AS followers,
               CAST({_hits(POSITIVE_WORDS)} AS DOUBLE) AS np,
               CAST({_hits(NEGATIVE_WORDS)} AS DOUBLE) AS nn
        FROM documents d JOIN events e ON e.event_id = d.doc_id * 5) s)"""


def day(col: str) -> str:
    return f"time_bucket(INTERVAL '1 day', {col})"


SENT_DAY = f"""sent_day AS (
  SELECT ticker, {day('ts')} AS window_start, {day('ts')} + INTERVAL '1 day' AS window_end,
         avg(compound) AS avg_sentiment, count(post_id) AS tweet_count,
         avg(CASE WHEN compound > 0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bullish_ratio,
         avg(CASE WHEN compound < -0.15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bearish_ratio,
         count(post_id)::DOUBLE / 1440 AS velocity
  FROM posts GROUP BY 1, 2, 3)"""

PRICE_DAY = f"""price_day AS (
  SELECT ticker, {day('ts')} AS window_start, {day('ts')} + INTERVAL '1 day' AS window_end,
         avg(price) AS avg_price, count(price) AS price_tick_count
  FROM ticks GROUP BY 1, 2, 3)"""

# Range join written the obvious way (every post of the ticker-window within 12 h before
# the tick), independent of the Spark plan's chunked RANGE frame.
ALIGNED = f"""aligned AS (
  SELECT t.tick_id, t.ticker, t.ts, t.price, t.window_start, t.window_end,
         round(coalesce(avg(p.compound), 0.0), 9) AS sentiment, count(p.compound) AS n_posts
  FROM (SELECT *, {day('ts')} AS window_start, {day('ts')} + INTERVAL '1 day' AS window_end FROM ticks) t
  LEFT JOIN (SELECT ticker, ts, compound, {day('ts')} AS wb FROM posts) p
    ON p.ticker = t.ticker AND p.wb = t.window_start
   AND p.ts >= t.ts - INTERVAL '12 hours' AND p.ts <= t.ts
  GROUP BY t.tick_id, t.ticker, t.ts, t.price, t.window_start, t.window_end)"""

PEARSON = """CASE WHEN count(*) <= 1 OR max({x}) = min({x}) OR max({y}) = min({y})
                 OR NOT isfinite(corr({x}, {y})) THEN 0.0 ELSE corr({x}, {y}) END"""

CORR = f"""corr_day AS (
  SELECT ticker, window_start, window_end, count(*) AS n_ticks,
         {PEARSON.format(x='price', y='sentiment')} AS pearson, 0 AS lag,
         arg_min(price, ts) AS first_price, arg_max(price, ts) AS last_price,
         (arg_max(price, ts) - arg_min(price, ts)) / arg_min(price, ts) AS momentum
  FROM aligned GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


def signals_cte(sent_t: float = 0.4, corr_t: float = 0.25, mom_t: float = 0.002, name: str = "sig") -> str:
    buy = f"s.avg_sentiment > {sent_t} AND c.pearson > {corr_t} AND c.momentum > {mom_t}"
    sell = f"s.avg_sentiment < -{sent_t} AND c.pearson < -{corr_t} AND c.momentum < -{mom_t}"
    conf = "round(least(0.99, 0.5 + abs(c.pearson) * 0.4 + abs(c.momentum) * 10), 2)"
    return f"""{name} AS (
  SELECT c.ticker, c.window_start, c.window_end, c.window_end AS timestamp, c.pearson, c.lag,
         s.avg_sentiment, c.momentum, c.n_ticks,
         CASE WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'HOLD' END AS signal,
         CASE WHEN ({buy}) OR ({sell}) THEN {conf} ELSE 0.5 END AS confidence
  FROM corr_day c JOIN sent_day s USING (ticker, window_start, window_end))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [TICKS, POSTS]
CHAIN = [TICKS, POSTS, SENT_DAY, ALIGNED, CORR]

SIG = signals_cte()

LATEST_SENT = """sa AS (SELECT * FROM sent_day
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_end DESC, window_start DESC) = 1)"""
LATEST_SIG = """sg AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) = 1)"""
LATEST_TICK = """lt AS (SELECT * FROM ticks
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) = 1)"""

SUMMARY = f"""summary AS (
  SELECT lt.ticker, lt.price AS current_price,
         CASE WHEN b.base > 0 THEN round((lt.price - b.base) / b.base * 100, 2) ELSE 0.0 END AS price_change_pct,
         lt.volume, coalesce(round(sa.avg_sentiment, 3), 0.0) AS avg_sentiment,
         coalesce(round(sa.bullish_ratio, 3), 0.5) AS bullish_ratio, coalesce(sa.tweet_count, 0) AS tweet_count,
         coalesce(sg.signal, 'HOLD') AS signal, coalesce(round(sg.pearson, 3), 0.0) AS pearson
  FROM lt
  LEFT JOIN (SELECT ticker, price AS old_price FROM ticks
             WHERE ts <= (SELECT max(ts) FROM ticks) - INTERVAL '1 hour'
             QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, tick_id DESC) = 1) o USING (ticker)
  LEFT JOIN sa USING (ticker) LEFT JOIN sg USING (ticker)
  CROSS JOIN LATERAL (SELECT coalesce(o.old_price, nullif(lt.open, 0), lt.price) AS base) b)"""

ALERTS = """alerts AS (
  SELECT ticker, ts AS timestamp,
    CASE WHEN compound <= -0.75 THEN 'CRITICAL' ELSE 'INFO' END AS severity,
    CASE WHEN compound <= -0.75 THEN 'Panic Alert: Extreme Bearish' ELSE 'FOMO Alert: Extreme Bullish' END
      || ' Sentiment detected on $' || ticker || '. Username: @' || username AS message,
    CASE WHEN compound <= -0.75 THEN 'Bearish Crash' ELSE 'Bullish Spike' END AS type
  FROM posts WHERE compound <= -0.75 OR compound >= 0.75
  UNION ALL
  SELECT ticker, timestamp, CASE WHEN confidence < 0.75 THEN 'WARNING' ELSE 'CRITICAL' END,
    'Trading Alert: Strong ' || signal || ' Signal generated for $' || ticker || '. Pearson: '
      || CAST(round(pearson, 2) AS VARCHAR) || '. Confidence: '
      || CAST(CAST(trunc(confidence * 100) AS INTEGER) AS VARCHAR) || '%', 'Momentum Shift'
  FROM sig WHERE signal <> 'HOLD')"""

UNIVERSE = """universe AS (
  SELECT CAST(user_id % 8 AS INTEGER) AS ordinal, 'T' || CAST(user_id % 8 AS VARCHAR) AS ticker,
         'Company ' || CAST(user_id % 8 AS VARCHAR) AS name
  FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3)"""
