"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix is a word position with the words after it in its piece, up to ``hi`` words.

1. Suffixes are routed globally by their leading words: routes are ranges of (lang, word 1, word 2, ...), cut at
   quantiles of a bounded sample of suffixes.  A hot leading word, or a hot pair, simply spans several routes,
   since the bounds are whole suffixes.  (The sample steers sizes only; counts cover every text.)
2. Each task cuts its texts into pieces and words, sorts a batch's suffixes, and packs those of one route and language
   into one row: equal suffixes once with their number, word numbers as small integers, and the words they
   stand for.  So a suffix costs some five bytes in the shuffle.
3. Each route sorts pointers to its suffixes by multikey three-way quicksort: a partition is split by a
   pivot at its current depth into less, equal and greater; an equal partition's weight is the count of
   that prefix, and it goes on with the next word, to the maximum depth.  A partition whose weight is
   below ``least`` holds no frequent phrase and is abandoned, whichever of the three it is.  All partitions of
   a depth are split together in numpy.  Only the prefixes of a route's first and last suffix may go
   on in a neighbouring route: these are kept whatever their weight and summed over the routes.
4. Candidates (``lo`` to ``hi`` words) are joined with the counts of their parts for every cut, scored in exact
   decimals, relieved of those that a longer candidate explains, and ranked per language in two
   steps (per hash bucket of a language, then per language), so no task sees more than
   BUCKETS * ``top`` rows of one.

Every part of a candidate is at least as frequent as the candidate, so its count stands among the frequent ones.

Defined cases: a null, empty or word-free text adds nothing; a null lang is ``und`` (and shares its counts with a
literal ``und``); repeated rows count each time; ties in score and count go by the phrase's UTF-8
bytes; an empty table gives no rows; whole texts of any length are read; only the two named columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketspark.llm.common import bound_batches, staged
from marketspark.llm.tokens import Words, byte_set, spaced, word_bytes
from marketspark.operators.skew import skew_join

#: Bytes that end a piece: . , ; : ! ? and line feed to carriage return.
BREAKS = byte_set(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
ENDS = BREAKS | byte_set((0x20, 0x20), (0x09, 0x09))
ROUTE_BYTES = 4 << 20    # text whose suffixes make a route, about; a task sorts one route at a time
MOST_ROUTES = 1 << 16    # the driver and every task hold the routes' bounds: routes grow beyond this many
SAMPLE_BYTES, SAMPLE_ROWS = 64 << 20, 100_000    # texts looked at for the bounds, and suffixes taken from them, about
BATCH_ROWS = 1 << 16
BUCKETS = 32
COUNT = "decimal(14,0)"  # 10^14 occurrences; products of two and the factor fit 38 digits


# --- suffixes ----------------------------------------------------------------------------------

def _suffix_keys(words: Words, lang: np.ndarray, depth: int) -> list[np.ndarray]:
    """Columns (lang, word 1, ..., word ``depth``) per position; words from 1, 0 past the piece's end."""
    keys, alive = [lang[words.doc]], np.ones(len(words.ids), bool)
    for d in range(depth):
        word = np.zeros(len(words.ids), np.int64)
        n = max(len(words.ids) - d, 0)
        if d:
            alive = alive.copy()
            alive[:n] &= words.chain[d - 1: d - 1 + n]
            alive[n:] = False
        word[:n] = np.where(alive[:n], words.ids[d:] + 1, 0)
        keys.append(word)
    return keys


def _combined(keys: list[np.ndarray], radix: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns (values below ``radix``) in order, and how often each occurs."""
    space = 1
    for r in radix:
        space *= r
    if space < 1 << 63:
        packed = np.zeros(len(keys[0]), np.int64)
        for k, r in zip(keys, radix):
            packed = packed * r + k
        packed, times = np.unique(packed, return_counts=True)
        out = []
        for r in reversed(radix):
            packed, k = np.divmod(packed, r)
            out.append(k)
        return out[::-1], times
    code, top = np.zeros(len(keys[0]), np.int64), 1
    for k, r in zip(keys, radix):
        if top * r >= 1 << 63:                       # dense numbers in the same order
            kinds, code = np.unique(code, return_inverse=True)
            top = len(kinds)
        code, top = code * r + k, top * r
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    return [k[first] for k in keys], times


class Batch:
    """The distinct suffixes of a batch in byte order: columns ``keys`` (lang, word 1, ...) of ranks and ``times``."""

    def __init__(self, lang: pa.Array, text: pa.Array, depth: int):
        words = Words(text, ENDS, BREAKS)
        coded = lang.dictionary_encode()
        self.langs, codes = _ranked(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False))
        self.vocab, words.ids = _ranked(words.vocab, words.ids)
        self.keys, self.times = _combined(_suffix_keys(words, codes, depth), [max(1, len(self.langs))] + [len(self.vocab) + 1] * depth)

    def place(self, bound: tuple[bytes, ...]) -> int:
        """How many of the suffixes come before ``bound``."""
        lo, hi = 0, len(self.times)
        for d, word in enumerate(bound):
            known = self.vocab if d else self.langs
            if d and not word:
                rank, exact = 0, True
            else:
                rank = bisect_left(known, word)
                exact = rank < len(known) and known[rank] == word
                rank += 1 if d else 0
            column = self.keys[d][lo:hi]
            first = lo + int(np.searchsorted(column, rank, "left"))
            if not exact:
                return first
            lo, hi = first, lo + int(np.searchsorted(column, rank, "right"))
        return lo

    def packed(self, bounds: list[tuple[bytes, ...]]):
        """Yield (route, lang, words, codes) for every route and language of the batch."""
        if not len(self.times):
            return
        cuts = {0: None, len(self.times): None} | {int(c): None for c in np.flatnonzero(np.diff(self.keys[0])) + 1}
        places = [self.place(b) for b in bounds]
        ends = sorted(cuts | {p: None for p in places})
        routes = np.searchsorted(places, ends[:-1], "right")
        data, offsets = word_bytes(pa.array(self.vocab, pa.large_binary()))
        for route, lo, hi in zip(routes.tolist(), ends[:-1], ends[1:]):
            part = np.stack([k[lo:hi] for k in self.keys[1:]])
            used, codes = np.unique(part, return_inverse=True)
            codes = codes.reshape(part.shape) + (used[0] != 0)          # 0 stays the end of a piece
            text, _ = spaced(data, offsets, used[used > 0] - 1, 0x0A)
            codes[0, 1:] -= codes[0, :-1].copy()                        # leading words ascend
            small = np.uint16 if len(used) < 1 << 16 else np.uint32
            times = self.times[lo:hi].astype(np.uint32)
            blob = bytes([np.dtype(small).itemsize]) + codes.astype(small).tobytes() + times.tobytes()
            yield route, self.langs[self.keys[0][lo]], text[:-1].tobytes(), blob


def _ranked(vocab: pa.Array, ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words in byte order, and ``ids`` renumbered to it."""
    order = pc.array_sort_indices(vocab).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return vocab.take(pa.array(order)).to_pylist(), rank[ids]


def suffix_count(blob: bytes, depth: int) -> int:
    return (len(blob) - 1) // (depth * blob[0] + 4)


def decoded(blob: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (depth x suffixes, 0 past the end) and times of one packed row."""
    n, small = suffix_count(blob, depth), np.uint16 if blob[0] == 2 else np.uint32
    codes = np.frombuffer(blob, small, depth * n, 1).reshape(depth, n).astype(np.int64)
    codes[0] = np.cumsum(codes[0])
    times = np.frombuffer(blob, np.uint8, 4 * n, 1 + depth * n * blob[0])
    return codes, times.view(np.uint32).astype(np.int64)


def unpacked(words: bytes, blob: bytes, depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, codes and times of one packed row."""
    return words.split(b"\n"), *decoded(blob, depth)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def route_bounds(docs: DataFrame, depth: int) -> list[tuple[bytes, ...]]:
    """Bounds between routes: quantiles of about SAMPLE_ROWS suffixes from about SAMPLE_BYTES of texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = min(MOST_ROUTES, -(-total // ROUTE_BYTES))
    if routes < 2:
        return []
    taken = min(1.0, SAMPLE_BYTES / total)
    share = min(1.0, SAMPLE_ROWS / (taken * total / 8))                 # a word of some eight bytes each

    def pick(batches):
        for number, batch in enumerate(batches):
            b = Batch(batch.column(0), batch.column(1), depth)
            chosen = np.random.default_rng(number).random(len(b.times)) < share
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.langs[k] for k in b.keys[0][chosen]], pa.binary())]
                + [pa.array([b.vocab[k - 1] if k else b"" for k in key[chosen]], pa.binary()) for key in b.keys[1:]], names)

    names = ["lang"] + [f"w{k + 1}" for k in range(depth)]
    seen = _texts(docs.sample(taken, 1) if taken < 1 else docs).mapInArrow(pick, ", ".join(f"{c} binary" for c in names)).collect()
    seen = sorted(tuple(bytes(x) for x in r) for r in seen)
    return sorted({seen[len(seen) * k // routes] for k in range(1, routes)}) if seen else []


def suffixes(docs: DataFrame, depth: int, bounds: list[tuple[bytes, ...]]) -> DataFrame:
    """Packed suffixes (route, lang, words, codes) of (lang, text) rows."""
    def cut(batches):
        for batch in batches:
            rows = list(Batch(batch.column(0), batch.column(1), depth).packed(bounds))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names)

    names, kinds = ["route", "lang", "words", "codes"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return _texts(docs).mapInArrow(cut, "route int, lang binary, words binary, codes binary")


# --- the sort ------------------------------------------------------------------------------------

def frequent_prefixes(keys: np.ndarray, weight: np.ndarray, least: int, ends: np.ndarray):
    """Yield (row, depth, count): prefixes ``keys[row, :depth]`` of weight ``least`` or more.

    ``keys`` holds a suffix per row, 0 past its end.  Prefixes of the rows ``ends`` come out whatever their
    weight.  A breadth-first multikey three-way quicksort: ``ptr`` holds the pointers, partition by partition."""
    depth_max = keys.shape[1]
    spare = np.zeros(len(keys), bool)
    spare[ends] = True
    ptr = np.arange(len(keys), dtype=np.int32)
    starts, depth = np.zeros(min(1, len(keys)), np.int64), np.zeros(min(1, len(keys)), np.int8)
    while len(ptr):
        sizes = np.diff(np.append(starts, len(ptr)))
        part = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
        key = keys[ptr, depth[part]]
        three = np.stack([key[starts], key[starts + sizes // 2], key[starts + sizes - 1]])
        pivot = np.median(three, axis=0).astype(key.dtype)[part]
        # stable three-way partition of every part at once
        moved = np.empty_like(ptr)
        base, kids = starts.copy(), []
        for mine in (key < pivot, key == pivot, key > pivot):
            before = np.cumsum(mine, dtype=np.int32) - mine
            of = part[mine]
            moved[base[of] + before[mine] - before[starts][of]] = ptr[mine]
            count = np.add.reduceat(mine, starts, dtype=np.int64)
            kids.append((base, count))
            base = base + count
        del part, key, pivot, before, of, mine
        ptr = moved
        first = np.stack([k[0] for k in kids], axis=1).reshape(-1)
        count = np.stack([k[1] for k in kids], axis=1).reshape(-1)
        level = np.repeat(depth, 3)
        equal = np.tile(np.array([False, True, False]), len(depth))
        some = count > 0
        first, count, level, equal = first[some], count[some], level[some], equal[some]
        total = np.add.reduceat(weight[ptr], first)
        keep = (total >= least) | np.logical_or.reduceat(spare[ptr], first)
        done = equal & (keys[ptr[first], level] == 0)             # the suffixes end here
        for k in np.flatnonzero(keep & equal & ~done):
            yield int(ptr[first[k]]), int(level[k]) + 1, int(total[k])
        level = level + equal
        keep &= ~done & (level < depth_max)
        ptr = ptr[np.repeat(keep, count)]
        count, depth = count[keep], level[keep]
        starts = np.cumsum(count) - count


def route_counts(table: pa.Table, depth: int, least: int) -> pa.Table:
    """Prefixes of one route's packed suffixes: lang, phrase, size, n (size 0: all words of the lang)."""
    lists = pc.split_pattern(table["words"].combine_chunks().cast(pa.large_binary()), pattern="\n")
    coded = lists.flatten().dictionary_encode()
    vocab, rank = _ranked(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False))
    rank = (rank + 1).astype(np.int32)
    base = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    named = table["lang"].combine_chunks().cast(pa.large_binary()).dictionary_encode()
    langs, lang = _ranked(named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    blobs = table["codes"].to_pylist()
    at = np.append(0, np.cumsum([suffix_count(b, depth) for b in blobs]))
    keys, weight = np.empty((at[-1], depth + 1), np.int32), np.empty(at[-1], np.int64)
    for k, blob in enumerate(blobs):                              # decoded one by one: few stand in memory at their full width
        codes, times = decoded(blob, depth)
        keys[at[k]: at[k + 1], 0] = lang[k] + 1
        keys[at[k]: at[k + 1], 1:] = np.append(np.int32(0), rank[base[k]: base[k + 1]])[codes].T
        weight[at[k]: at[k + 1]] = times
    del lists, coded, rank, blobs
    ends = []
    for pick in (np.min, np.max):                                 # the route's first and last suffix
        rows = np.arange(len(keys))
        for d in range(depth + 1):
            rows = rows[keys[rows, d] == pick(keys[rows, d])]
        ends.append(rows[0])
    found = list(frequent_prefixes(keys, weight, least, np.array(ends)))
    return pa.table({"lang": pa.array([langs[keys[r, 0] - 1] for r, _, _ in found], pa.binary()),
                     "phrase": pa.array([b" ".join(vocab[w - 1] for w in keys[r, 1:d]) for r, d, _ in found], pa.binary()),
                     "size": pa.array([d - 1 for _, d, _ in found], pa.int32()), "n": pa.array([c for _, _, c in found], pa.int64())})


def phrase_counts(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """(lang, phrase, size, n) of all phrases of 1 to ``depth`` words that occur ``least`` times; size 0: all words."""
    bounds = route_bounds(docs, depth)
    routed = suffixes(docs, depth, bounds).repartition(len(bounds) + 1, "route")
    counted = routed.groupBy("route").applyInArrow(lambda route: route_counts(route, depth, least), "lang binary, phrase binary, size int, n bigint")
    return (counted.groupBy(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "size")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# --- scores --------------------------------------------------------------------------------------

def _span(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, lo: int = 2, hi: int = 3, least: int = 10, top: int = 2000, share: int = 50,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two sides of its lowest-scoring cut, ``n`` the words of the
    language.  A phrase inside a longer candidate that has ``share`` percent of its count is dropped."""
    bound_batches(docs.sparkSession, "4m")                          # a batch's suffixes take some twenty times its bytes
    counts = staged(phrase_counts(docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), hi, least), "phrases")
    known = counts.where("size > 0").select("lang", "phrase", F.col("n").cast(COUNT).alias("f"))
    cand = counts.where(F.col("size") >= lo).select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = cand.select("lang", "phrase", "size", "a", "words", cut.alias("k")).select(
        "lang", "phrase", "a", "k", _span("words", 1, F.col("k")).alias("head"), _span("words", F.col("k") + 1, F.col("size")).alias("tail"))
    cuts = staged(cuts, "cuts")
    both = staged(skew_join(cuts, known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).drop("head"), "heads")
    both = skew_join(both, known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr(f"(CAST(a AS {COUNT}) * CAST(a AS {COUNT}) * CAST(1000000 AS decimal(7,0))) div (l * r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    scored = both.groupBy("lang", "phrase", "a").agg(lowest)
    # the most frequent longer candidate around each phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(lo), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " "))))
    around = (cand.where(F.col("size") > lo).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("longer").alias("longer")))
    free = (scored.join(around, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)))
    rows = free.select("lang", "phrase", "a", F.col("low.l").cast("bigint").alias("l"), F.col("low.r").cast("bigint").alias("r"),
                       F.col("low.score").cast("bigint").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    first = dealt.withColumn("_at", F.row_number().over(W.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_at") <= top)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
