"""Latest-per-key, last-N-per-key and top-k helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def order_key(df: DataFrame, order: list[str]) -> Column | None:
    """``order`` as one DECIMAL(38,0): (timestamp), (timestamp, integer) or (integer); else None.

    A decimal is a mutable hash-aggregate buffer; a struct is not, and makes Spark sort."""
    kinds = [df.schema[c].dataType for c in order]
    integral = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)

    def number(c, kind):
        return F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.col(c)

    if len(order) == 1 and isinstance(kinds[0], (T.TimestampType, *integral)):
        return number(order[0], kinds[0]).cast("decimal(38,0)")
    if len(order) == 2 and isinstance(kinds[0], T.TimestampType) and isinstance(kinds[1], integral):
        # 10^20 exceeds the span of bigint, so ids (of either sign) never reach into the time digits
        high = number(order[0], kinds[0]).cast("decimal(17,0)") * F.lit(str(10 ** 20)).cast("decimal(21,0)")
        return (high + F.coalesce(F.col(order[1]), F.lit(str(-(2 ** 63))).cast(kinds[1])).cast("decimal(19,0)")).cast("decimal(38,0)")
    return None


def latest_per_key(df: DataFrame, key, order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key: a partial aggregate, so a hot key is reduced
    map-side (no whole-key sort).  Rows of fixed-width columns take one ``max_by`` per column over
    one decimal order key, which hash-aggregates; others one ``max_by`` of the whole row."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    by = order_key(df, order)
    if by is not None and all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in rest):
        g = df.withColumn("_by", by).groupBy(*keys).agg(*[F.max_by(c, F.col("_by")).alias(c) for c in rest])
        return g.select(*keys, *rest)
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_latest"))
    return g.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest])


def last_n_per_key(df: DataFrame, key, order: list[str], n: int, rank_col: str = "rank") -> DataFrame:
    """The ``n`` greatest rows per key by ``order`` (``rank`` 1 = newest).  Spark plans the
    rank filter as a WindowGroupLimit below the shuffle, so each map task ships at most
    ``n`` rows per key."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def top_k(df: DataFrame, order, k: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: per-partition top-k, then a k-row merge)."""
    return df.orderBy(*order).limit(k)


def first_k_by_ordinal(df: DataFrame, universe: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows in universe order (ordinal), e.g. the first tickers of a board."""
    j = df.join(universe.select("ticker", "ordinal"), "ticker", "inner")
    return j.orderBy("ordinal").limit(k)


def in_universe(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key is a supported ticker (left semi join; Spark picks the strategy by size)."""
    return df.join(universe.select(key), key, "left_semi")


def unsupported(df: DataFrame, universe: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key is not a supported ticker (left anti join)."""
    return df.join(universe.select(key), key, "left_anti")


def merge_board(board: DataFrame, ticks: DataFrame) -> DataFrame:
    """Apply the newest tick per ticker to a board (price and volume only; other board
    columns kept).  The newest tick is chosen by (ts, tick_id) with a partial aggregate."""
    latest = latest_per_key(ticks.select("ticker", "ts", "tick_id", "price", "volume"), "ticker", ["ts", "tick_id"])
    d = latest.select("ticker", F.col("price").alias("_np"), F.col("volume").alias("_nv"))
    j = board.join(d, "ticker", "left")
    cols = [F.coalesce("_np", "price").alias("price") if c == "price"
            else F.coalesce("_nv", "volume").alias("volume") if c == "volume" else F.col(c) for c in board.columns]
    return j.select(*cols)
