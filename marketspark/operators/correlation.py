"""Sentiment-price correlation per window, lagged correlation, cross-asset matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.bands import corr_band
from marketspark.functions.stats import pearson
from marketspark.operators.sequence import interval_micros, lag_rows, time_bucket
from marketspark.operators.topk import order_key

MIN_TICKS = 5


def window_correlation(aligned: DataFrame, min_ticks: int = MIN_TICKS, lag: int = 0,
                       lag_bucket: str = "auto") -> DataFrame:
    """Per (ticker, window): guarded Pearson of price vs rolling sentiment over the window's
    ticks, first/last price and momentum; windows with fewer than ``min_ticks`` ticks are
    dropped.  ``lag`` = k pairs each price with the sentiment k ticks earlier in the same
    window (k = 0: the reference's behaviour).

    One ``groupBy`` with partial aggregates (covariance, variances, min_by/max_by), so a
    hot (ticker, window) is pre-reduced map-side.
    """
    a = aligned
    y = "sentiment"
    if lag:
        a = lag_rows(a, ["ticker", "window_start"], ["ts", "tick_id"], "sentiment", lag, "_ylag",
                     bucket=lag_bucket)
        y = "_ylag"
    g = window_aggregates(a.groupBy("ticker", "window_start", "window_end"), a, y)
    g = g.filter(F.col("n_ticks") >= min_ticks)
    return g.select("ticker", "window_start", "window_end", "n_ticks", "pearson", F.lit(lag).alias("lag"),
                    "first_price", "last_price",
                    F.try_divide(F.col("last_price") - F.col("first_price"), F.col("first_price")).alias("momentum"))


def window_aggregates(grouped, rows: DataFrame, y: str, *more: Column) -> DataFrame:
    """n_ticks, guarded Pearson of price and ``y``, first and last price of the groups of ``rows``, and ``more`` aggregates.

    Rows without a time have no first or last price."""
    order = order_key(rows, ["ts", "tick_id"])
    if order is None:
        order = F.struct("ts", "tick_id")
    return grouped.agg(F.count(F.lit(1)).alias("n_ticks"), pearson(F.col("price"), F.col(y)).alias("pearson"),
                       F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"), *more)


BLOCK = 256          # tickers of a block of the matrix
CHUNK = 256          # buckets of a ticker's vector that are multiplied at once


def _vectors(avgs: DataFrame, universe: DataFrame, blocks: int, width: int, single: bool) -> DataFrame:
    """A row per universe ticker and chunk of time: its block and the dense vector of its bucket averages.

    Averages are taken relative to the ticker's mean, which leaves covariances as they are and keeps the sums
    of products from losing digits.  A ticker without data has vectors of nulls."""
    first, last = avgs.agg(F.min("_bk")).scalar(), avgs.agg(F.max("_bk")).scalar()
    place = F.col("_bk") - first
    sparse = (avgs.groupBy("ticker", F.floor(place / width).alias("_chunk"))
              .agg(F.map_from_entries(F.collect_list(F.struct((place % width).cast("int").alias("s"), "p"))).alias("_m")))   # ``width`` entries at most
    centre = avgs.groupBy("ticker").agg(F.avg("p").alias("_mean"))
    chunks = F.lit(0).cast("bigint") if single else F.coalesce(F.floor((last - first) / width), F.lit(0).cast("bigint"))
    every = universe.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks)))
    v = every.join(centre, "ticker", "left").join(sparse, ["ticker", "_chunk"], "left")
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.element_at("_m", s) - F.col("_mean"))
    return v.select("ticker", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("_block"), "_chunk", dense.alias("_v"))


def _products(a: Column, b: Column) -> Column:
    """Sums over the buckets that both vectors hold: n, x, y, xx, yy, xy and the ranges of x and y."""
    zero = F.lit(0.0)
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), *[zero.alias(c) for c in ("x", "y", "xx", "yy", "xy")],
                     *[none.alias(c) for c in ("x0", "x1", "y0", "y1")])

    def add(t, e):
        x, y = e["x"], e["y"]
        return F.struct((t["n"] + 1).alias("n"), (t["x"] + x).alias("x"), (t["y"] + y).alias("y"), (t["xx"] + x * x).alias("xx"),
                        (t["yy"] + y * y).alias("yy"), (t["xy"] + x * y).alias("xy"), F.least(t["x0"], x).alias("x0"),
                        F.greatest(t["x1"], x).alias("x1"), F.least(t["y0"], y).alias("y0"), F.greatest(t["y1"], y).alias("y1"))

    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda e: e["x"].isNotNull() & e["y"].isNotNull())
    return F.aggregate(F.coalesce(both, F.array().cast("array<struct<x:double,y:double>>")), start, add)


def _guarded(n: Column, x, y, xx, yy, xy, x0, x1, y0, y1) -> Column:
    """Guarded Pearson from merged sums: 0.0 for fewer than two buckets or a flat side."""
    den = F.sqrt(F.greatest(xx / n - (x / n) * (x / n), F.lit(0.0)) * F.greatest(yy / n - (y / n) * (y / n), F.lit(0.0)))
    r = F.try_divide(xy / n - (x / n) * (y / n), den)
    return F.when((n <= 1) | (x0 == x1) | (y0 == y1) | r.isNull() | F.isnan(r), F.lit(0.0)).otherwise(r)


def correlation_matrix(ticks: DataFrame, tickers, bucket: str = "1 hour", lookback: str | None = "24 hours",
                       as_of: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Cross-asset correlation of bucketed average prices, long form
    (ticker_a, ticker_b, pearson, n_buckets, band) for every ordered pair of ``tickers``, a list or a
    DataFrame with a ``ticker`` column.

    ``as_of`` defaults to the latest tick; ``lookback`` None takes all ticks.

    A blocked Gram matrix: tickers are dealt into blocks of about ``block``; each pair of blocks is a join
    key of its own that holds at most block * block pairs, and a ticker's vector of bucket averages goes
    once to each pair of its block.  A pair's sums are formed where its two vectors meet, so buckets
    multiply neither rows nor shuffles; only spans of more than CHUNK buckets are merged by pair afterwards.
    The result has a row per ordered pair, as asked."""
    spark = ticks.sparkSession
    universe = (tickers.select("ticker").distinct() if isinstance(tickers, DataFrame)
                else spark.createDataFrame([(x,) for x in dict.fromkeys(tickers)], "ticker string"))
    t = ticks.join(universe, "ticker", "left_semi")
    if lookback is not None:
        end = as_of if as_of is not None else ticks.agg(F.max("ts")).scalar()
        t = t.filter((F.col("ts") >= end - F.expr(f"INTERVAL {lookback}")) & (F.col("ts") <= end))
    avgs = (t.groupBy(time_bucket(F.col("ts"), bucket).alias("_bk"), "ticker").agg(F.avg("price").alias("p"))
            .where(F.col("p").isNotNull()))
    blocks = max(1, -(-universe.count() // block))
    if lookback is not None:
        span = interval_micros(lookback) // interval_micros(bucket) + 2                               # buckets that a look-back touches
    else:
        ends = t.agg(F.min(time_bucket(F.col("ts"), bucket)).alias("a"), F.max(time_bucket(F.col("ts"), bucket)).alias("z")).first()
        span = 1 if ends["a"] is None else ends["z"] - ends["a"] + 1
    single = span <= CHUNK
    v = _vectors(avgs, universe, blocks, span if single else CHUNK, single)
    # every ticker once as the lower and once as the upper block of each pair of its block
    a = v.select(F.col("ticker").alias("ticker_a"), F.col("_block").alias("_lo"), "_chunk", F.col("_v").alias("_va"),
                 F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1))).alias("_hi"))
    b = v.select(F.col("ticker").alias("ticker_b"), F.col("_block").alias("_hi"), "_chunk", F.col("_v").alias("_vb"),
                 F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_lo"))
    both = a.join(b, ["_lo", "_hi", "_chunk"]).where((F.col("_lo") < F.col("_hi")) | (F.col("ticker_a") <= F.col("ticker_b")))
    sums = both.select("ticker_a", "ticker_b", _products(F.col("_va"), F.col("_vb")).alias("s")).select("ticker_a", "ticker_b", "s.*")
    if not single:
        merge = {c: F.sum for c in ("n", "x", "y", "xx", "yy", "xy")} | {"x0": F.min, "x1": F.max, "y0": F.min, "y1": F.max}
        sums = sums.groupBy("ticker_a", "ticker_b").agg(*[f(c).alias(c) for c, f in merge.items()])
    r = _guarded(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy", "x0", "x1", "y0", "y1")])
    same = F.col("ticker_a") == F.col("ticker_b")
    found = sums.select("ticker_a", "ticker_b", F.when(same, 1.0).otherwise(r).alias("pearson"), F.col("n").alias("n_buckets"))
    ways = F.when(same, F.array(F.struct("ticker_a", "ticker_b"))).otherwise(
        F.array(F.struct("ticker_a", "ticker_b"), F.struct(F.col("ticker_b").alias("ticker_a"), F.col("ticker_a").alias("ticker_b"))))
    long = found.select(F.explode(ways).alias("w"), "pearson", "n_buckets").select("w.*", "pearson", "n_buckets")
    return long.withColumn("band", corr_band(F.col("pearson"), F.col("ticker_a") == F.col("ticker_b")))
