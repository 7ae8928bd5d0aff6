"""Record-level operators: dedupe by key, manual post injection, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.sentiment import with_scores
from marketspark.sources.records import ISO

# ---------------------------------------------------------------------------
# Manual post defaults of the reference.
MANUAL_USERNAME, MANUAL_FOLLOWERS = "manual_feed", 500
MANUAL_LIKES, MANUAL_RETWEETS, MANUAL_VIEWS = 0, 0, 15
MANUAL_SOURCE, MANUAL_CONFIDENCE, MANUAL_BOT = "Manual API Feed", 0.98, 0.01
# ---------------------------------------------------------------------------


def dedupe(df: DataFrame, key, order: list[str]) -> DataFrame:
    """Keep one row per key: the first in ``order`` (the primary key keeps the first write).

    ``min_by`` is a partial aggregate, so a key with a huge number of copies collapses
    map-side before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return g.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def manual_posts(payloads: DataFrame, as_of: Column, id_col: str = "msg_id", model: str = "keyword") -> DataFrame:
    """Manual post injection: upper-case ticker, default username / followers, fixed
    engagement fields, scored text, stamped ``as_of``; id derived from the payload id."""
    p = payloads.select(
        F.concat(F.lit("tw_manual_"), F.col(id_col).cast("string")).alias("id"),
        F.upper(F.col("ticker")).alias("ticker"), F.col("text"),
        F.coalesce(F.col("username"), F.lit(MANUAL_USERNAME)).alias("username"),
        as_of.alias("timestamp"),
        F.coalesce(F.col("followers"), F.lit(MANUAL_FOLLOWERS)).cast("int").alias("followers"),
        F.lit(MANUAL_LIKES).alias("likes"), F.lit(MANUAL_RETWEETS).alias("retweets"),
        F.lit(MANUAL_VIEWS).alias("views"), F.lit(MANUAL_SOURCE).alias("source"),
        F.lit(MANUAL_CONFIDENCE).alias("confidence_score"), F.lit(MANUAL_BOT).alias("bot_probability"))
    return with_scores(p, "text", model)


def change_feed(ticks: DataFrame, alerts: DataFrame | None, posts: DataFrame, after_tick: int,
                after_alert: int = 0, last_post_id=None) -> DataFrame:
    """Incremental push messages since the high-water marks, one row per record:
    (type, id, ticker, payload JSON).  ``new_tweet`` carries the latest post when its id
    differs from ``last_post_id``.  In streaming use the checkpoint is the high-water mark
    (see ``streaming.jobs.stream_change_feed``)."""
    t = ticks.filter(F.col("tick_id") > after_tick).select(
        F.lit("new_ticks").alias("type"), F.col("tick_id").cast("string").alias("id"), "ticker",
        F.to_json(F.struct("ticker", "price", "volume", F.date_format("ts", ISO).alias("timestamp"))).alias("payload"))
    parts = [t]
    if alerts is not None:
        parts.append(alerts.filter(F.col("alert_id") > after_alert).select(
            F.lit("new_alerts").alias("type"), F.col("alert_id").cast("string").alias("id"), "ticker",
            F.to_json(F.struct(F.col("alert_id").alias("id"), "ticker", "severity", "message", "type",
                           F.date_format("timestamp", ISO).alias("timestamp"))).alias("payload")))
    latest = posts.groupBy().agg(F.max_by(F.struct("post_id", "ticker", "ts", "compound"),
                                          F.struct("ts", "post_id")).alias("_p")).select("_p.*")
    if last_post_id is not None:
        latest = latest.filter(F.col("post_id") != F.lit(last_post_id))
    n = latest.select(F.lit("new_tweet").alias("type"), F.col("post_id").cast("string").alias("id"), "ticker",
                      F.to_json(F.struct(F.col("post_id").alias("id"), "ticker",
                                         F.date_format("ts", ISO).alias("timestamp"), "compound")).alias("payload"))
    out = parts[0]
    for x in parts[1:] + [n]:
        out = out.unionByName(x)
    return out
