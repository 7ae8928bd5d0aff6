"""Snapshot counters kept up by the sink: mergeable partial states per (kind, ticker, pane).

Each micro-batch of rows is reduced to one row per ticker and pane - counts, an exact decimal sum, a sum of squares, the
newest time - and written to the folder of its batch id, which a replay overwrites.  Snapshots add up pane rows;
they read neither posts nor ticks.  A look-back whose ends lie inside a pane takes the rows of those
two panes alone from the stored table, by a range predicate that reaches the scan, so it is exact at any instant.
``compact`` folds finished batches into one.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.functions.bands import fear_greed, mood5
from marketspark.operators.sequence import interval_micros, time_bucket
from marketspark.operators.topk import top_k
from marketspark.plans.snapshots import TRENDING_K
from marketspark.streaming.sinks import Writer

PANE = "5 minutes"
SUM = "decimal(38,12)"
STATES = "kind string, ticker string, pane bigint, n bigint, ids bigint, valued bigint, s decimal(38,12), ss decimal(38,12), newest timestamp"


def partial_states(rows: DataFrame, kind: str, pane: str = PANE, id_col: str | None = None, value: str | None = None) -> DataFrame:
    """One row per (ticker, pane) of ``rows`` (ticker, ts, ...)."""
    v = F.col(value).cast(SUM) if value else F.lit(None).cast(SUM)
    g = rows.groupBy("ticker", time_bucket(F.col("ts"), pane).alias("pane")).agg(
        F.count(F.lit(1)).alias("n"), F.count(id_col or F.lit(1)).alias("ids"), F.count(v).alias("valued"),
        F.sum(v).cast(SUM).alias("s"), F.sum((v * v).cast(SUM)).cast(SUM).alias("ss"), F.max("ts").alias("newest"))
    return g.select(F.lit(kind).alias("kind"), *g.columns[:1], *g.columns[1:])


def pane_writer(path: str, kind: str, pane: str = PANE, id_col: str | None = None, value: str | None = None) -> Writer:
    """``foreachBatch`` writer of a batch's partial states to ``path``/kind=.../batch_id=..."""
    def write(df: DataFrame, batch_id: int) -> None:
        out = partial_states(df, kind, pane, id_col, value).drop("kind")
        out.write.mode("overwrite").parquet(os.path.join(path, f"kind={kind}", f"batch_id={batch_id}"))
    return write


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """All partial states; several rows of a (kind, ticker, pane), of different batches, add up."""
    return spark.read.schema(STATES + ", batch_id int").parquet(path).drop("batch_id")


def compact(spark: SparkSession, path: str, kind: str, upto: int) -> None:
    """Fold the batches 0 to ``upto`` of a kind into batch 0's folder.

    The merged rows are written beside the others first and renamed in one step each by the file system, batch
    by batch; run it while no query of this kind writes."""
    fs, base = _store(spark, path), os.path.join(path, f"kind={kind}")
    old = [os.path.join(base, f"batch_id={b}") for b in range(upto + 1) if fs.exists(_path(spark, os.path.join(base, f"batch_id={b}")))]
    if len(old) < 2:
        return
    rows = spark.read.parquet(*old)
    merged = rows.groupBy("ticker", "pane").agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in ("n", "ids", "valued", "s", "ss")],
                                               F.max("newest").alias("newest"))
    fresh = os.path.join(base, f"_merged-{upto}")
    merged.write.mode("overwrite").parquet(fresh)
    for folder in old:
        fs.delete(_path(spark, folder), True)
    fs.rename(_path(spark, fresh), _path(spark, old[0]))


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def covered(panes: DataFrame, rows: DataFrame | None, kind: str, start_us: int, stop_us: int, pane: str = PANE,
            id_col: str | None = None, value: str | None = None) -> DataFrame:
    """Partial states that make up [start, stop) exactly: whole panes, and rows of the panes at a ragged end."""
    width = interval_micros(pane)
    first, last = -(-start_us // width), stop_us // width              # whole panes: first <= p < last
    whole = panes.where((F.col("kind") == kind) & (F.col("pane") >= first) & (F.col("pane") < last))
    ends = []
    if first > last:                                                   # both ends in one pane
        ends = [(start_us, stop_us)]
    else:
        ends = [(a, b) for a, b in ((start_us, first * width), (last * width, stop_us)) if a < b]
    if not ends:
        return whole
    if rows is None:
        raise ValueError("an end within a pane needs the stored rows")
    cond = F.lit(False)
    for a, b in ends:
        cond = cond | ((F.col("ts") >= _at(a)) & (F.col("ts") < _at(b)))
    return whole.unionByName(partial_states(rows.where(cond), kind, pane, id_col, value))


def _at(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


def totals(panes: DataFrame) -> DataFrame:
    """(kind, value): rows of every kind."""
    return panes.groupBy("kind").agg(F.sum("n").alias("value"))


def mood(states: DataFrame) -> DataFrame:
    """One row: average value, rows, 0..100 score and five-level mood of the given states."""
    g = states.agg((F.sum("s").cast("double") / F.nullif(F.sum("valued"), F.lit(0))).alias("avg_compound"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_posts"))
    s = fear_greed(F.col("avg_compound"))
    return g.select(F.coalesce("avg_compound", F.lit(0.0)).alias("avg_compound"), "n_posts", s.alias("fear_greed_score"), mood5(s).alias("market_mood"))


def trending(states: DataFrame, k: int = TRENDING_K) -> DataFrame:
    """Most discussed tickers of the given states: mentions desc, ticker asc."""
    g = states.groupBy("ticker").agg(F.sum("ids").alias("mentions"))
    return top_k(g, [F.col("mentions").desc(), F.col("ticker").asc()], k)
