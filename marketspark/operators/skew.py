"""Equi-join of a large side with hot keys and a side with one row (or few) per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of the large side above this many rows is dealt over several tasks.
KEY_ROWS = 100_000
#: At most so many keys are dealt, whatever the size: the limit grows once rows / KEY_ROWS exceeds it.
MOST_HOT = 10_000


def skew_join(large: DataFrame, small: DataFrame, on: list[str], key_rows: int | None = None, how: str = "inner",
              counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``large`` joined with ``small`` on the columns ``on`` (inner or left; null keys match nothing).

    Rows per key of ``large`` are counted first (partial sums, keys only).  A key above the limit is cut
    into ceil(rows / limit) parts: its rows are dealt by a hash of the whole row, the matching rows of
    ``small`` are copied once per part, and everything else joins as usual.  The list of hot keys is
    broadcast; since each holds more than rows / MOST_HOT rows, it has fewer than MOST_HOT entries at any
    size.  ``large`` is read twice, so it should be a stored table; else ``counted`` gives the keys of its rows,
    or ``counts`` their numbers (``on`` and ``n``; keys it lacks are not hot).
    Names starting with ``_skew_`` are used in between and leave again."""
    key_rows = key_rows or KEY_ROWS
    if counts is None:
        known = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
        counts = (large if counted is None else counted).where(known).groupBy(*on).agg(F.count("*").alias("n"))
    top = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    limit = max(key_rows, (top["rows"] or 0) // MOST_HOT)
    if (top["most"] or 0) <= limit:
        return large.join(small, on, how)
    # fewer than MOST_HOT rows
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("_skew_parts")))
    parts = F.coalesce("_skew_parts", F.lit(1))
    dealt = large.join(hot, on, "left").withColumn("_skew_part", F.pmod(F.xxhash64(*large.columns), parts).cast("int")).drop("_skew_parts")
    copied = (small.join(hot, on, "left").withColumn("_skew_part", F.explode(F.sequence(F.lit(0), parts - 1)))
              .drop("_skew_parts"))
    return dealt.join(copied, [*on, "_skew_part"], how).drop("_skew_part")
