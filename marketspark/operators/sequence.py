"""Order-dependent per-key operators that do not put a whole key into one task.

A window ``PARTITION BY ticker`` sends every row of a ticker to one task; with a universe
of eight tickers (one of which may hold a third of the data) that does not scale.  The
operators here split each key into time buckets, solve inside a bucket with a window
partitioned by (key, bucket), and patch the first rows of every bucket with a carry-in
value computed from a per-(key, bucket) summary.  The summary has one row per
(key, bucket), so the only per-key window runs over a table whose size is bounded by
the time span divided by the bucket width, not by the data volume.

Results are exact for any bucketing; it only trades task size against the size of the
summary table.  A bucketing is an interval, a number of microseconds, or ``"auto"``: rows are
counted per (key, fine time slot) and neighbouring slots are packed into buckets of about
``TARGET_ROWS_PER_BUCKET`` rows, so bursts are cut as finely as quiet spans are merged.  Slots are
refined until none holds more than a target (rows of one microsecond stay together).  ``"whole"`` is for callers that
know from stored counts that no key exceeds a target: one bucket per key, nothing measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = "auto"
TARGET_ROWS_PER_BUCKET = 2_000_000     # rows of a (key, bucket) task
SLOTS_PER_TARGET = 8                   # fine slots that an evenly spread target of rows covers
REFINE = 64                            # a slot width that leaves a slot too full is divided by this


def interval_micros(spec: str) -> int:
    """'5 minutes' / '1 day' / '15 seconds' -> microseconds."""
    n, unit = spec.strip().split(None, 1)
    unit = unit.lower().rstrip("s")
    mult = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000,
            "hour": 3_600_000_000, "day": 86_400_000_000, "week": 7 * 86_400_000_000}[unit]
    return int(float(n) * mult)


def time_bucket(ts: Column, width) -> Column:
    """Bucket number of a timestamp: floor(epoch_micros / width); width is an interval
    string or a number of microseconds."""
    us = width if isinstance(width, int) else interval_micros(width)
    return F.floor(F.unix_micros(ts) / F.lit(us)).cast("long")


_SLOTS: dict[tuple, int] = {}


def slot_micros(df: DataFrame, keys: list[str], ts: str, target_rows: int) -> int:
    """Slot width at which no (key, slot) holds more than ``target_rows`` rows, 0 if no key has more
    than that in all.  Each look is an aggregate that returns one row; the result is memoised by
    the input plan's semantic hash, as it affects task sizes only, never results."""
    memo = (df.semanticHash(), tuple(keys), ts, target_rows)
    if memo not in _SLOTS:
        _SLOTS[memo] = _measure_slots(df, keys, ts, target_rows)
    return _SLOTS[memo]


def _measure_slots(df: DataFrame, keys: list[str], ts: str, target_rows: int) -> int:
    us = F.unix_micros(F.col(ts))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    r = per_key.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if r is None or not r["n"] or r["n"] <= target_rows:
        return 0
    width = max(1, int(r["hi"] - r["lo"] + 1) * target_rows // (int(r["n"]) * SLOTS_PER_TARGET))
    while width > 1:
        fullest = df.groupBy(*keys, F.floor(us / width)).count().agg(F.max("count").alias("n")).first()["n"]
        if fullest <= target_rows:
            break
        width = max(1, width // REFINE)
    return width


def is_whole(df: DataFrame, keys: list[str], ts: str, bucket) -> bool:
    """Whether every key fits one bucket, so that no carry-in exists and none need be joined."""
    return bucket == "whole" or (bucket == "auto" and not slot_micros(df, keys, ts, TARGET_ROWS_PER_BUCKET))


def with_bucket(df: DataFrame, keys: list[str], ts: str, bucket, out: str) -> DataFrame:
    """``df`` with bucket number ``out``: ascending in ``ts`` within a key."""
    if bucket == "whole":
        return df.withColumn(out, F.lit(0).cast("long"))
    if bucket != "auto":
        return df.withColumn(out, time_bucket(F.col(ts), bucket))
    target = TARGET_ROWS_PER_BUCKET
    width = slot_micros(df, keys, ts, target)
    if not width:
        return df.withColumn(out, F.lit(0).cast("long"))
    slot = F.floor(F.unix_micros(F.col(ts)) / width).cast("long")
    d = df.withColumn("_slot", slot)
    counts = d.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_slot_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = counts.select(*keys, "_slot", F.floor(F.coalesce(F.sum("_slot_n").over(before), F.lit(0)) / target).cast("long").alias(out))
    # rows without a key or time find no slot and share bucket 0
    return d.join(packed, [*keys, "_slot"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long"))).drop("_slot")


def _as_list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def previous_value(df: DataFrame, key, order: list[str], value: str, out: str,
                   ts: str | None = None, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """``out`` = ``value`` of the previous row of the same key in ``order`` (NULL for the first).

    Equivalent to ``lag(value) OVER (PARTITION BY key ORDER BY order)`` without the
    one-task-per-key window.
    """
    keys = _as_list(key)
    ts = ts or order[0]
    b = "_seq_b"
    d = with_bucket(df, keys, ts, bucket, b)
    w_in = Window.partitionBy(*keys, b).orderBy(*order)
    if is_whole(df, keys, ts, bucket):
        return d.withColumn(out, F.lag(F.col(value)).over(w_in)).drop(b)
    d = d.withColumn("_seq_prev", F.lag(F.struct(F.col(value).alias("v"))).over(w_in))
    summary = d.groupBy(*keys, b).agg(
        F.max_by(F.col(value), F.struct(*order)).alias("_seq_last"))
    w_key = Window.partitionBy(*keys).orderBy(b)
    carry = summary.select(*keys, b, F.lag("_seq_last").over(w_key).alias("_seq_carry"))
    j = d.join(carry, [*keys, b], "left")
    res = F.when(F.col("_seq_prev").isNull(), F.col("_seq_carry")).otherwise(F.col("_seq_prev.v"))
    return j.withColumn(out, res).drop(b, "_seq_prev", "_seq_carry")


def forward_fill(df: DataFrame, key, order: list[str], value: str, out: str,
                 ts: str | None = None, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """``out`` = last non-NULL ``value`` at or before each row of the same key in ``order``.

    Equivalent to ``last(value, true) OVER (PARTITION BY key ORDER BY order ROWS BETWEEN
    UNBOUNDED PRECEDING AND CURRENT ROW)``; this is the as-of lookup when ``value`` is set
    only on the right-side rows of a union.
    """
    keys = _as_list(key)
    ts = ts or order[0]
    b = "_ff_b"
    d = with_bucket(df, keys, ts, bucket, b)
    w_in = (Window.partitionBy(*keys, b).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if is_whole(df, keys, ts, bucket):
        return d.withColumn(out, F.last(F.col(value), ignorenulls=True).over(w_in)).drop(b)
    d = d.withColumn("_ff_in", F.last(F.col(value), ignorenulls=True).over(w_in))
    summary = d.groupBy(*keys, b).agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_ff_last"))
    w_key = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, b, F.last("_ff_last", ignorenulls=True).over(w_key).alias("_ff_carry"))
    j = d.join(carry, [*keys, b], "left")
    return j.withColumn(out, F.coalesce(F.col("_ff_in"), F.col("_ff_carry"))).drop(b, "_ff_in", "_ff_carry")


def row_index(df: DataFrame, key, order: list[str], out: str, ts: str | None = None,
              bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """1-based position of each row within its key in ``order`` (``row_number``), computed
    as in-bucket row number plus the row count of all earlier buckets of the key."""
    keys = _as_list(key)
    ts = ts or order[0]
    b = "_ri_b"
    d = with_bucket(df, keys, ts, bucket, b)
    d = d.withColumn("_ri_rn", F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)))
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_ri_n"))
    w_key = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, b, F.coalesce(F.sum("_ri_n").over(w_key), F.lit(0)).alias("_ri_off"))
    j = d.join(offs, [*keys, b], "left")
    return j.withColumn(out, (F.col("_ri_off") + F.col("_ri_rn")).cast("long")).drop(b, "_ri_rn", "_ri_off")


def lag_rows(df: DataFrame, key, order: list[str], value: str, k: int, out: str,
             ts: str | None = None, bucket: str = DEFAULT_BUCKET) -> DataFrame:
    """``lag(value, k)`` per key: ``lag`` inside the bucket; the first k rows of a bucket take theirs
    from the carry-in, the last k values of all earlier buckets of the key.  Neither the rows nor
    an index of them is joined with itself."""
    keys = _as_list(key)
    if k == 0:
        return df.withColumn(out, F.col(value))
    ts = ts or order[0]
    b = "_lag_b"
    d = with_bucket(df, keys, ts, bucket, b)
    w_in = Window.partitionBy(*keys, b).orderBy(*order)
    if is_whole(df, keys, ts, bucket):
        return d.withColumn(out, F.lag(F.col(value), k).over(w_in)).drop(b)
    d = d.withColumn("_lag_rn", F.row_number().over(w_in)).withColumn("_lag_in", F.lag(F.col(value), k).over(w_in))
    # the last k values of a bucket, oldest first
    back = Window.partitionBy(*keys, b).orderBy(*[F.col(c).desc() for c in order])
    tails = (d.select(*keys, b, F.struct(F.col(value).alias("v")).alias("_lag_v"), F.row_number().over(back).alias("_lag_back"))
             .where(F.col("_lag_back") <= k).groupBy(*keys, b)
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("_lag_back")).alias("o"), "_lag_v"))).alias("_lag_t")))
    # a bucket may have fewer than k rows, so as many earlier buckets as it takes (at most k) lend theirs
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(-k, -1)
    lent = F.flatten(F.collect_list(F.col("_lag_t._lag_v")).over(earlier))
    carry = tails.select(*keys, b, lent.alias("_lag_c"))
    j = d.join(carry, [*keys, b], "left")
    place = F.size("_lag_c") + F.col("_lag_rn") - k - 1          # from the left, counted from 0
    out_col = F.when(F.col("_lag_rn") > k, F.col("_lag_in")).when(place >= 0, F.get("_lag_c", place)["v"])
    return j.withColumn(out, out_col).drop(b, "_lag_rn", "_lag_in", "_lag_c")
