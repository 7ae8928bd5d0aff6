r"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A text is the sequence of its ``\n``-separated lines that hold words; a line is its 128-bit hash after trimming, and
the number of blank lines before it.  The window that starts at a line reaches until it holds ``min_words``
words, so it may be one long line or many short ones, ``min_words`` lines at most.  From each window the least
hash is its fingerprint (rightmost on ties): a run of lines with ``min_words`` words or more that
occurs twice holds the same window, hence the same fingerprint, in both places.

1. Select the window minima and count each fingerprint's positions; windows whose fingerprint
   stands at one position in the whole corpus cannot repeat and go no further.
2. Join the positions of shared fingerprints: windows that agree in fingerprint, in the hashes
   of all their lines and in the blank lines between them (128 bits each) are linked to the first of them, in
   order of doc_id, text hash and line.  No pairs are made: each later window meets one first window, and the
   windows of a common passage are dealt over tasks.
3. Extend each match to both sides of its fingerprint: back to the window's first line and
   forward while the following lines equal those at the first occurrence.  (Lines further back
   that belong to the run start windows of their own.)
4. Delete the union of the later runs, with the blank lines inside them; the first occurrence stays.

Defined cases: null text stays null; a text under ``min_words`` words stays; blank lines outside a repeated run stay,
but a text of which only blank lines would be left becomes the empty string; rows with equal doc_id and text are one
document and all get its result; a null doc_id orders last; a repeat within one document counts.  Blank lines weigh
nothing and cost nothing, however many a text holds, but must agree for a run to go on.  Columns besides id and
text pass through; the operator's own columns start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketspark.llm.common import staged
from marketspark.operators.skew import skew_join

MIN_WORDS = 50
UNIT = 1000      # a word; each line weighs one more, which orders the lines
BITS = 62        # line flags packed into one bigint
SPACE = " \t\r\f\x0b"


def text_hash(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _line(x: Column, i: Column) -> Column:
    plain = F.btrim(x, F.lit(SPACE))
    return F.struct(i.alias("pos"), F.xxhash64(plain).alias("h"), F.xxhash64(F.lit(1), plain).alias("h2"),
                    F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each complete window: document (_id, _th), first and last line ``pos`` and ``end``, fingerprint ``v`` with
    its line ``p``, ``s1`` and ``s2`` over the window's lines, and the lines from the next one on: hashes ``nxt``, positions ``at``."""
    texts = (docs.where(F.col("text").isNotNull())
             .select(F.col("doc_id").alias("_id"), text_hash(F.col("text")).alias("_th"),
                     F.filter(F.transform(F.split("text", "\n", -1), _line), lambda l: l["w"] > 0).alias("lines"))
             .dropDuplicates(["_id", "_th"]))
    lines = texts.select("_id", "_th", F.inline("lines"))
    doc = W.partitionBy("_id", "_th")
    order = doc.orderBy("pos")
    weight = F.col("w").cast("bigint") * UNIT + 1
    gap = F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(-1)) - 1
    lines = lines.select("*", gap.alias("gap"),
                         (F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)) - weight).alias("s"))
    reach = doc.orderBy("s").rangeBetween(0, min_words * UNIT - 1)
    whole = F.collect_list(F.struct("h", "h2", "gap", "pos"))
    lines = lines.select("_id", "_th", "pos", "s", whole.over(reach).alias("ls"), F.max(F.col("s") + weight).over(reach).alias("fin"),
                         F.min(F.struct("h", (-F.col("pos")).alias("p"))).over(reach).alias("least"))
    lines = lines.select("*", F.lead("ls", 1).over(doc.orderBy("s")).alias("next"))
    full = lines.where(F.col("fin") >= F.col("s") + min_words * UNIT)
    # the blank lines before the first line are not part of the window
    gaps = F.transform("ls", lambda l, i: F.when(i > 0, l["gap"]).otherwise(0))
    following = F.coalesce("next", F.array().cast(lines.schema["ls"].dataType))
    return full.select("_id", "_th", "pos", F.element_at("ls", -1)["pos"].alias("end"), F.col("least.h").alias("v"), (-F.col("least.p")).alias("p"),
                       F.xxhash64(F.transform("ls", lambda l: l["h"]), gaps).alias("s1"),
                       F.xxhash64(F.lit(1), F.transform("ls", lambda l: l["h2"]), gaps).alias("s2"),
                       F.transform(following, lambda l: F.xxhash64(l["h"], l["h2"], l["gap"])).alias("nxt"),
                       F.transform(following, lambda l: l["pos"]).alias("at"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Later repeated runs: (_id, _th, first, last) line positions; runs of a document may overlap."""
    wins = staged(windows(docs, min_words), "windows")
    shared = staged(wins.groupBy("v", "_id", "_th", "p").agg(F.count("*").alias("n")).groupBy("v")
                    .agg(F.count("*").alias("c"), F.sum("n").alias("n")).where("c > 1").select("v", "n"), "shared")
    found = staged(skew_join(wins, shared.select("v"), ["v"], counts=shared), "candidates")
    place = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_th").alias("c"),
                     F.col("pos").alias("d"))
    key = ["v", "s1", "s2"]
    firsts = staged(found.groupBy(*key).agg(F.min(F.struct(place.alias("place"), F.col("nxt").alias("nxt"))).alias("one"),
                                            F.count("*").alias("n"))
                    .where("n > 1").select(*key, F.col("one.place").alias("there"), F.col("one.nxt").alias("then"), "n"), "firsts")
    later = skew_join(found, firsts.drop("n"), key, counts=firsts.select(*key, "n")).where(~place.eqNullSafe(F.col("there")))
    differ = F.array_position(F.zip_with("nxt", "then", lambda x, y: x.eqNullSafe(y)), False)
    same = F.when(differ == 0, F.size("nxt")).otherwise(differ - 1).cast("int")
    return later.select("_id", "_th", F.col("pos").alias("first"),
                        F.greatest(F.col("end"), F.coalesce(F.get("at", same - 1), F.lit(0))).alias("last"))


def _flags(runs: DataFrame) -> DataFrame:
    """Per document a map from line position div BITS to the flags of its deleted lines."""
    words = F.explode(F.sequence(F.floor(F.col("first") / BITS), F.floor(F.col("last") / BITS)))
    cut = runs.distinct().select("_id", "_th", "first", "last", words.alias("word"))
    lo = F.greatest(F.col("first") - F.col("word") * BITS, F.lit(0)).cast("int")
    hi = F.least(F.col("last") - F.col("word") * BITS, F.lit(BITS - 1)).cast("int")
    one = F.lit(1).cast("bigint")
    bits = F.call_function("shiftleft", F.call_function("shiftleft", one, hi - lo + 1) - 1, lo)
    cut = cut.select("_id", "_th", "word", bits.alias("bits")).groupBy("_id", "_th", "word").agg(F.bit_or("bits").alias("bits"))
    return cut.groupBy("_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("_ld_bits"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs cut from the text, and ``_ld_lines`` / ``_ld_deleted`` line counts (0 for null).

    A text that is one repeated run becomes the empty string; the row stays."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    flags = _flags(repeated_runs(narrow, min_words))
    # the caller's row travels as one struct, so its columns may have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ld_row"), text_hash(F.col(text_col)).alias("_ld_th"))
    own = {c: F.col(f"_ld_row.`{c}`") for c in docs.columns}
    both = rows.join(flags, own[id_col].eqNullSafe(F.col("_id")) & (F.col("_ld_th") == F.col("_th")), "left")
    lines = F.split(own[text_col], "\n", -1)

    def stays(_, i):
        word = F.element_at("_ld_bits", F.floor(i / BITS))
        return F.call_function("shiftright", F.coalesce(word, F.lit(0).cast("bigint")), (i % BITS).cast("int")).bitwiseAND(F.lit(1)) == 0

    hit = F.col("_ld_bits").isNotNull() & own[text_col].isNotNull()
    kept = both.withColumn("_ld_kept", F.when(hit, F.filter(lines, stays)))
    # only blank lines left: the text is empty
    worded = F.regexp_replace(F.array_join("_ld_kept", "\n"), r"^[\x20\x09-\x0D]+$", "")
    kept = kept.withColumn("_ld_text", F.when(hit, worded))
    text = F.when(hit, F.col("_ld_text")).otherwise(own[text_col])
    total = F.when(own[text_col].isNotNull(), F.length(own[text_col]) - F.length(F.replace(own[text_col], F.lit("\n"))) + 1)
    gone = F.when(hit, total - F.when(F.col("_ld_text") == "", 0).otherwise(F.size("_ld_kept"))).otherwise(0)
    return kept.select(*[(text if c == text_col else own[c]).alias(c) for c in docs.columns],
                       F.coalesce(total, F.lit(0)).cast("bigint").alias("_ld_lines"), gone.cast("bigint").alias("_ld_deleted"))
