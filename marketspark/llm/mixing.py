"""Mixing sources to target weights by repeating documents.

Sizes (words) are summed per source.  Sources in code-point order, null last, take the weights in
turn and share ``share`` of all sizes by weight; a source stops at ``limit`` times its size and
what it leaves is shared again among the others, by weight, until none is above its limit.  A
source's rate is target / size.  Each document goes out floor(rate) times, plus once more if its
hash-seeded uniform number is below the rate's fraction.

Only per-source sums leave the scan before the shares are known, so a source that holds a third of
all rows costs one partial sum a task.  The rates go back to the documents by a join on the source.

Defined cases: a null text has size 0; a source of size 0 has target 0 and rate 0; rows with the
same doc_id draw the same number (a null doc_id draws by its text); reruns agree; other columns of ``docs`` may have any name (``plan`` does not read them, ``mix``
passes them through unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code-point order, null last, without a global window.

    A global sort numbers rows by (partition, place in it); the counts of the partitions - as many as
    Spark has shuffle partitions - turn that into places."""
    spread = staged(sources.orderBy(F.col("source").isNull(), "source").withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    before, offsets = 0, {}
    for r in spread.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets[r["p"]], before = before, before + r["count"]
    offset = F.lit(0).cast("bigint")
    if offsets:
        offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in offsets.items() for x in kv]), part)
    return spread.withColumn("place", offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows."""
    sources = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.lit(float(limit)) * F.col("source_size"))
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    unit = None                                   # words per weight of the sources below their limit
    while True:
        over = F.lit(False) if unit is None else F.col("weight") * F.lit(unit) > F.col("most")
        r = sources.agg(F.sum(F.when(over, F.col("most"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        now = (share * total - (r["full"] or 0.0)) / r["open"] if r["open"] else unit
        if now is None or unit == now:
            break
        if unit is not None and now < unit:       # only rounding can lower it
            break
        unit = now
    target = F.least(F.col("weight") * F.lit(float(unit or 0.0)), F.col("most"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return sources.select("source", "source_size", target.alias("target"), F.least(rate, F.lit(float(limit))).alias("rate"))


def uniform(doc_id: Column, text_hash: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of an md5 over seed and id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text_hash, F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(seed + " "), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 13))


def _measured(docs: DataFrame, seed: str) -> DataFrame:
    """The narrow (doc_id, source, size, u) rows of the documents; texts are read once, here."""
    u = uniform(F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.md5("text")), seed)
    return staged(docs.select("doc_id", "source", words(F.col("text")).alias("size"), u.alias("u")), "sizes")


def _copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("bigint")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies and taken (copies * size)."""
    rows = _measured(docs, seed)
    goal = staged(targets(rows, weights, share, limit), "targets").withColumnRenamed("source", "_source")
    both = rows.join(goal, rows["source"].eqNullSafe(goal["_source"]))
    copies = _copies(F.col("rate"), F.col("u"))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged, whatever their names: a row
    travels as one struct beside the operator's own columns."""
    goal = staged(targets(_measured(docs, seed), weights, share, limit), "targets").select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    u = uniform(F.col("_row.doc_id"), F.when(F.col("_row.doc_id").isNull(), F.md5("_row.text")), seed)
    both = packed.join(goal, F.col("_row.source").eqNullSafe(F.col("_source")))
    copies = F.array_repeat("_row", _copies(F.col("_rate"), u).cast("int"))
    return both.select(F.explode(copies).alias("_row")).select("_row.*")
