"""Importance resampling towards a target distribution, over hashed word n-grams.

Features are all runs of ``lo`` to ``hi`` words of a text, joined by one space; a feature's bucket is the
unsigned CRC-32 of its bytes modulo ``buckets``.  With the bucket counts of a corpus and of a target set,
every document gets the sum of its features' log-ratio gains, a hash-seeded Gumbel term is added, and the
highest scores are drawn: a sample without replacement, weighted by importance.

CRCs are computed over whole Arrow batches by length-bucketed matrices (``crc32``): the batch's distinct
features are grouped by byte length into two-dimensional uint8 arrays, all CRCs of a length advance one
column at a time through the polynomial's table, and the results are scattered back to the features and
from there to their occurrences.  A feature over ``WIDE`` bytes is cut into rows of that width, whose
registers go through the same matrices and are combined by CRC's linearity, so that one huge word
costs columns in proportion to its size and no loop over its bytes.

At scale: a task reduces its texts to at most ``buckets`` counts before anything is shuffled; the gains are
one array of ``buckets`` integers, which is the only thing that goes to the driver and back.  Scores stay in
a narrow stored table; it is dealt by ranges of (score, doc_id), each range numbers its own rows, and the
ranges' counts (one per range) turn these into ranks: no global sort in one task.

Defined cases: a null, empty or word-free text has no features and weight 0; a null doc_id draws as the
empty text and orders last among equal scores; rows with the same id draw the same number, and rows that
agree in score and id too are ranked by weight, then in any order; an empty corpus gives no rows; an empty target makes
all gains follow from t = T = 0; whole texts of any length are read; further columns are not read, so no names clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketspark.llm.common import bound_batches, staged
from marketspark.llm.tokens import Words, byte_set, spaced, word_bytes

#: ASCII other than 0-9 and a-z ends a word (capitals are lower-cased before).
ENDS = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
POLYNOMIAL = 0xEDB88320
WIDE = 256
RANGE_ROWS = 1 << 20


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(POLYNOMIAL) ^ (table >> 1), table >> 1)
    return table


TABLE = _table()


def _advance(register: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Registers after the bytes of their rows, one column at a time."""
    for column in matrix.T:
        register = TABLE[(register ^ column) & 0xFF] ^ (register >> np.uint32(8))
    return register


def crc32(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of every ``data[offsets[i]:offsets[i + 1]]``."""
    out = np.zeros(len(offsets) - 1, np.uint32)
    size, full = np.diff(offsets), np.uint32(0xFFFFFFFF)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for rows in np.split(order, cuts):
        if not len(rows):
            continue
        length, start = int(size[rows[0]]), offsets[rows]
        head = length if length <= WIDE else length % WIDE
        register = _advance(np.full(len(rows), full), data[start[:, None] + np.arange(head)])
        if head < length:
            out[rows] = _wide(data, start + head, (length - head) // WIDE, register) ^ full
        else:
            out[rows] = register ^ full
    return out


def _wide(data: np.ndarray, start: np.ndarray, pieces: int, register: np.ndarray) -> np.ndarray:
    """``register`` after ``pieces`` further rows of WIDE bytes from ``start``."""
    # the register after WIDE zero bytes, for each single bit set before
    bits = _advance(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((32, WIDE), np.uint8))
    at_once = max(1, (1 << 22) // (WIDE * len(start)))
    for k in range(0, pieces, at_once):
        n = min(at_once, pieces - k)
        where = (start[:, None] + (k + np.arange(n)) * WIDE).reshape(-1)
        part = _advance(np.zeros(len(where), np.uint32), data[where[:, None] + np.arange(WIDE)]).reshape(-1, n)
        for j in range(n):
            moved = np.where((register[:, None] >> np.arange(32, dtype=np.uint32)) & 1, bits, np.uint32(0))
            register = np.bitwise_xor.reduce(moved, axis=1) ^ part[:, j]
    return register


def features(col: pa.Array, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence, and the number of words of every text."""
    words = Words(col, ENDS)
    data, offsets = word_bytes(words.vocab)
    docs, found = [], []
    for length in range(lo, hi + 1):
        at = words.runs(length)
        if length == 1:
            crcs, back = crc32(data, offsets), words.ids
        else:
            rows = np.stack([words.ids[at + k] for k in range(length)], axis=1)
            kinds, back = np.unique(rows, axis=0, return_inverse=True)
            crcs, back = crc32(*_joined(kinds, data, offsets)), back.reshape(-1)
        docs.append(words.doc[at])
        found.append((crcs % np.uint32(buckets)).astype(np.int64)[back])
    return np.concatenate(docs), np.concatenate(found), words.counts


def _joined(kinds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the word rows ``kinds``, words joined by one space."""
    out, ends = spaced(data, offsets, kinds.reshape(-1), 0x20)
    last = ends[kinds.shape[1] - 1:: kinds.shape[1]] - 1       # the space after a feature's last word goes
    keep = np.ones(len(out), bool)
    keep[last] = False
    return out[keep], np.concatenate([[0], last - np.arange(len(last))])


def bucket_counts(texts: DataFrame, lo: int, hi: int, buckets: int) -> np.ndarray:
    """Feature occurrences per bucket over all rows of the single column of ``texts``."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, found, _ = features(batch.column(0), lo, hi, buckets)
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]                              # at most ``buckets`` rows
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its corpus share."""
    wide, s_all, t_all = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + wide) / ((s + 1.0) * (t_all + wide))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(text: Column, gain: np.ndarray, lo: int, hi: int) -> Column:
    """Column struct(n_words, n_features, weight) of a whole text."""
    @F.arrow_udf("struct<n_words bigint, n_features bigint, weight bigint>")
    def of(col: pa.Array) -> pa.Array:
        doc, found, counts = features(col, lo, hi, len(gain))
        total = np.zeros(len(col), np.int64)
        np.add.at(total, doc, gain[found])
        return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), pa.array(np.bincount(doc, minlength=len(col)).astype(np.int64)),
                                           pa.array(total)], ["n_words", "n_features", "weight"])
    return of(text.cast("binary"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256(``seed:doc_id``)."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` (read again, so stored ones) with their 1-based place in ``order``, without one global task."""
    count = rows.count()
    ranges = max(1, -(-count // RANGE_ROWS))
    dealt = staged(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():       # one row a range
        offsets += [F.lit(r["_range"]), F.lit(before)]
        before += r["count"]
    offset = F.element_at(F.create_map(*offsets), F.col("_range")) if offsets else F.lit(0)
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(rank, (offset + place).cast("bigint")).drop("_range")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: str = "2024", lo: int = 1, hi: int = 1,
             buckets: int = 10_000, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score and ``rank`` (null if not drawn).

    Of the N rows with ``min_words`` words, floor(percent * N / 100) are drawn.  ``target`` holds texts in ``text_col``."""
    bound_batches(docs.sparkSession)
    texts = F.col(text_col).cast("binary").alias("t")
    corpus = bucket_counts(docs.select(texts), lo, hi, buckets)
    gain = gains(corpus, bucket_counts(target.select(texts), lo, hi, buckets))
    seen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), weighed(F.col(text_col), gain, lo, hi).alias("w"))
    score = F.col("w.weight") + gumbel(F.col("doc_id"), seed)
    scored = staged(seen.select("doc_id", "w.n_words", "w.n_features", "w.weight", score.alias("score"))
                    .withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    # _row, stored with the rows, parts equal rows however many they are
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("_row").asc()]
    placed = ranked(fit, order, "rank")
    draw = fit.count() * percent // 100
    drawn = F.when(F.col("rank") <= draw, F.col("rank"))
    names = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words)
    return placed.select(*names, drawn.alias("rank")).unionByName(rest.select(*names, F.lit(None).cast("bigint").alias("rank")))
