"""Aligning posts with ticks: trailing range average, interval containment, as-of lookup.

None of these emits (tick, post) pairs.  The trailing average is a difference of running sums over
the union of both inputs; the containment lookup joins each tick to the few windows whose
time bucket it falls in (bounded by window geometry, not data); the as-of lookup is a
forward fill over a union.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.sequence import forward_fill, interval_micros, is_whole, time_bucket, with_bucket

ALIGN_DIGITS = 9   # rolling averages are rounded so equal values stay bit-equal across engines
SUM = "decimal(38,12)"   # running sums are exact, so any order of summing gives the same average


def rolling_sentiment_at_ticks(ticks: DataFrame, posts: DataFrame, window: str = "5 minutes",
                               lookback: str = "2 minutes", slide: str | None = None,
                               digits: int | None = ALIGN_DIGITS, bucket="auto") -> DataFrame:
    """Per tick and window: mean compound of the same ticker's posts with
    ts - lookback <= post.ts <= ts inside the same window (inclusive both ends); 0.0 if none.

    Linear in the input.  A post enters the running sum at its time and leaves it right after its
    look-back; a tick reads the running sum.  Where the window started within the look-back, the sum
    since that start is the difference of two prefix sums: the one at the tick, and the one over all
    earlier panes (slide-wide stretches between window starts), a table of one row per ticker and
    pane.  Posts are never copied to windows or look-backs; a tick has a row per window that
    holds it, as the result does.  The running sums are cut into buckets with carry-in, so a hot
    ticker is spread over many tasks.
    """
    lb, pane = interval_micros(lookback), interval_micros(slide or window)
    c = F.col("compound").cast(SUM)
    real = posts.where(F.col("compound").isNotNull())

    def event(df, kind, us, add, n, seen, **more):
        none = {"tick_id": "long", "price": "double"}
        return df.select("ticker", F.lit(kind).alias("_kind"), us.alias("_us"), add.cast(SUM).alias("_c"), F.lit(n).cast("long").alias("_n"),
                         F.lit(seen).cast("long").alias("_p"), *[more.get(k, F.lit(None).cast(t)).alias(k) for k, t in none.items()])

    us = F.unix_micros("ts")
    u = (event(real, 0, us, c, 1, 1)                                     # a post enters ...
         .unionByName(event(real, 2, us + lb, -c, -1, 0))                # ... and leaves after ticks of that time
         .unionByName(event(ticks, 1, us, F.lit(0), 0, 0, tick_id=F.col("tick_id"), price=F.col("price"))))
    u = u.withColumn("_ts", F.timestamp_micros("_us"))
    whole = is_whole(u, ["ticker"], "_ts", bucket)
    u = with_bucket(u, ["ticker"], "_ts", bucket, "_b")
    own, own_n = F.col("_c") * F.col("_p"), F.col("_p")                  # prefix: entering posts only
    parts = {"_tc": F.col("_c"), "_tn": F.col("_n"), "_pc": own, "_pn": own_n}
    # equal (time, kind) rows share a sum, so no tie-break is needed
    run = Window.partitionBy("ticker", "_b").orderBy("_us", "_kind")
    inside = u.select("ticker", "_b", "_us", "_kind", "tick_id", "price", *[F.sum(x).over(run).cast(SUM).alias(k) for k, x in parts.items()])
    at = inside.where(F.col("_kind") == 1)
    if not whole:
        totals = u.groupBy("ticker", "_b").agg(*[F.sum(x).cast(SUM).alias(k) for k, x in parts.items()])
        before = Window.partitionBy("ticker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select("ticker", "_b", *[F.coalesce(F.sum(k).over(before), F.lit(0)).cast(SUM).alias(f"{k}0") for k in parts])
        at = at.join(carry, ["ticker", "_b"], "left").select(
            "ticker", "_us", "tick_id", "price", *[(F.col(k) + F.coalesce(F.col(f"{k}0"), F.lit(0))).alias(k) for k in parts])

    # prefix sums at the pane starts
    number = F.floor(us / pane)
    panes = real.groupBy("ticker", number.alias("_pane")).agg(F.sum(c).cast(SUM).alias("_sc"), F.count(F.lit(1)).alias("_sn"))
    upto = Window.partitionBy("ticker").orderBy("_pane").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    panes = panes.select(F.col("ticker").alias("_pt"), "_pane", F.sum("_sc").over(upto).cast(SUM).alias("_sc"), F.sum("_sn").over(upto).alias("_sn"))
    def windowed(df, ts):
        w = F.window(ts, window, slide) if slide else F.window(ts, window)
        return df.select("*", w.alias("_w")).select("*", F.unix_micros("_w.start").alias("_start")).drop("_w")

    rows = windowed(at, F.timestamp_micros("_us")).withColumn("_short", F.col("_start") > F.col("_us") - lb)
    # the window starts to look up, from the ticks' times alone: the running sums are computed once
    starts = windowed(ticks.select("ticker", "ts"), F.col("ts")).select("ticker", F.floor(F.col("_start") / pane).alias("_at")).distinct()
    return _since(rows, starts, panes, pane, interval_micros(window), digits)


def _since(rows: DataFrame, need: DataFrame, panes: DataFrame, pane: int, width: int, digits: int | None) -> DataFrame:
    """Averages of ``rows``: over the look-back, or since the window's start where that is nearer."""
    # the prefix before a window start is that of the last pane with posts before it
    known = panes.select(F.col("_pt").alias("ticker"), (F.col("_pane") + 1).alias("_at"), "_sc", "_sn", F.lit(0).alias("_q"))
    asked = need.select("ticker", "_at", F.lit(None).cast(SUM).alias("_sc"), F.lit(None).cast("long").alias("_sn"), F.lit(1).alias("_q"))
    fill = Window.partitionBy("ticker").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.unionByName(asked)
    base = (both.select("ticker", "_at", "_q", F.last("_sc", True).over(fill).alias("_bc"), F.last("_sn", True).over(fill).alias("_bn"))
            .where("_q = 1").select(F.col("ticker").alias("_bt"), F.col("_at").alias("_ba"), "_bc", "_bn"))
    j = rows.join(base, (F.col("ticker") == F.col("_bt")) & (F.floor(F.col("_start") / pane) == F.col("_ba")), "left")
    zero = F.lit(0)
    total = F.when(F.col("_short"), F.col("_pc") - F.coalesce("_bc", zero)).otherwise(F.col("_tc"))
    n = F.when(F.col("_short"), F.col("_pn") - F.coalesce("_bn", zero)).otherwise(F.col("_tn")).cast("long")
    s = F.when(n > 0, total.cast("double") / n).otherwise(F.lit(0.0))
    if digits is not None:
        s = F.round(s, digits)
    return j.select("tick_id", "ticker", F.timestamp_micros("_us").alias("ts"), "price", F.timestamp_micros("_start").alias("window_start"),
                    F.timestamp_micros(F.col("_start") + width).alias("window_end"), s.alias("sentiment"), n.alias("n_posts"))


def attach_containing_window(ticks: DataFrame, aggregates: DataFrame, max_window: str = "1 day",
                             value_cols: tuple[str, ...] = ("avg_sentiment",), id_col: str = "tick_id") -> DataFrame:
    """Left-attach to each tick the aggregate row of its ticker whose
    [window_start, window_end] contains the tick time (both ends inclusive); when several
    do, the earliest (window_start, window_end).  Unmatched ticks keep NULLs.

    Aggregates are copied into every ``max_window``-wide time bucket they touch and ticks
    join on (ticker, bucket), so the lookup is exact for any width; with ``max_window`` at
    least the longest window each aggregate lands in at most three buckets and the
    candidate count per tick is bounded by the window geometry (overlapping windows).
    """
    a = aggregates.select("ticker", "window_start", "window_end", *value_cols)
    a = a.withColumn("_b", F.explode(F.sequence(time_bucket(F.col("window_start"), max_window),
                                                time_bucket(F.col("window_end"), max_window))))
    a = a.select(F.col("ticker").alias("_a_ticker"), "_b", "window_start", "window_end", *value_cols)
    t = ticks.withColumn("_b", time_bucket(F.col("ts"), max_window))
    cond = ((t["ticker"] == a["_a_ticker"]) & (t["_b"] == a["_b"]) & (a["window_start"] <= t["ts"])
            & (a["window_end"] >= t["ts"]))
    j = t.join(a, cond, "left").drop(a["_b"]).drop("_a_ticker")
    # candidates of a tick share its (ticker, bucket): partitioning the pick by those keys
    # too reuses the join's distribution instead of shuffling again by tick id
    w = Window.partitionBy("ticker", "_b", id_col).orderBy(
        F.col("window_start").asc_nulls_last(), F.col("window_end").asc_nulls_last())
    return (j.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .drop("_rn", "_b"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
              right_cols: list[str], right_order: list[str] | None = None, prefix: str = "asof_",
              bucket: str = "auto") -> DataFrame:
    """For each left row, the last right row of the same key with right_ts <= left_ts.

    Right rows sort before left rows at equal time (at-or-before is inclusive); among
    right rows ``right_order`` breaks ties (the last wins).  Implemented as a union and a
    bucketed forward fill: no per-key window, no pair emission.
    """
    right_order = right_order or []
    r_struct = F.struct(*[F.col(c).alias(c) for c in right_cols])
    lcols = left.columns
    l_ = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.lit(1).alias("_kind"),
                     *[F.lit(None).cast(right.schema[c].dataType).alias(f"_ro{i}") for i, c in enumerate(right_order)],
                     F.struct(*[F.col(c) for c in lcols]).alias("_l"),
                     F.lit(None).cast(right.select(r_struct.alias("x")).schema["x"].dataType).alias("_r"))
    r_ = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.lit(0).alias("_kind"),
                      *[F.col(c).alias(f"_ro{i}") for i, c in enumerate(right_order)],
                      F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in lcols]).alias("x"))
                                       .schema["x"].dataType).alias("_l"),
                      r_struct.alias("_r"))
    order = ["_t", "_kind", *[f"_ro{i}" for i in range(len(right_order))]]
    filled = forward_fill(l_.unionByName(r_), "_k", order, "_r", "_fill", ts="_t", bucket=bucket)
    out = filled.filter(F.col("_kind") == 1)
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                      *[F.col(f"_fill.{c}").alias(prefix + c) for c in right_cols])
