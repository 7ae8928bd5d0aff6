"""Quote documents (chart JSON) -> one tick row per document.

Document shape: chart.result[0] with meta.regularMarketPrice and
indicators.quote[0].{open, high, low, volume} arrays.  The newest (last) array element is
used; a NULL or zero element falls back to the price; values are rounded to 2 digits and
volume defaults to 0.  A document whose result is missing or empty is dropped from the
primary rows; ``with_fallback`` then supplies rows for those keys (the reference's
per-ticker fallback source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARR_D = T.ArrayType(T.DoubleType())
QUOTE_SCHEMA = T.StructType([T.StructField("chart", T.StructType([T.StructField("result", T.ArrayType(T.StructType([
    T.StructField("meta", T.StructType([T.StructField("regularMarketPrice", T.DoubleType())])),
    T.StructField("indicators", T.StructType([T.StructField("quote", T.ArrayType(T.StructType([
        T.StructField("open", _ARR_D), T.StructField("high", _ARR_D), T.StructField("low", _ARR_D),
        T.StructField("volume", T.ArrayType(T.LongType()))])))])),
])))]))])


def _last_or(arr: Column, price: Column) -> Column:
    return F.round(F.coalesce(F.nullif(F.try_element_at(arr, F.lit(-1)), F.lit(0.0)), price), 2)


def extract_quotes(raw: DataFrame, key_col: str = "ticker", value_col: str = "value",
                   ts: Column | None = None) -> DataFrame:
    """(ticker, price, open, high, low, close, volume[, timestamp]) from quote JSON rows."""
    d = raw.select(F.col(key_col).alias("ticker"), F.from_json(F.col(value_col), QUOTE_SCHEMA).alias("_q"),
                   *([ts.alias("timestamp")] if ts is not None else []))
    r = F.try_element_at(F.col("_q.chart.result"), F.lit(1))
    q = F.try_element_at(r["indicators"]["quote"], F.lit(1))
    d = d.select("ticker", *(["timestamp"] if ts is not None else []),
                 F.round(r["meta"]["regularMarketPrice"], 2).alias("price"), q.alias("_iq"))
    d = d.filter(F.col("price").isNotNull() & F.col("_iq").isNotNull())
    p = F.col("price")
    return d.select("ticker", "price", _last_or(F.col("_iq.open"), p).alias("open"),
                    _last_or(F.col("_iq.high"), p).alias("high"), _last_or(F.col("_iq.low"), p).alias("low"),
                    p.alias("close"),
                    F.coalesce(F.try_element_at(F.col("_iq.volume"), F.lit(-1)), F.lit(0)).cast("long").alias("volume"),
                    *(["timestamp"] if ts is not None else []))


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "ticker") -> DataFrame:
    """Primary rows plus fallback rows for keys the primary lacks (anti join + union)."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"),
                               allowMissingColumns=True)
