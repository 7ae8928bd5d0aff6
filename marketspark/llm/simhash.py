"""SimHash near-duplicates with a Gray-ordered hierarchical index.

``fingerprint`` gives a 64-bit SimHash of a text's word shingles.  ``link_components`` joins
fingerprints that differ in at most ``distance`` bits and labels the connected classes:

1. Equal fingerprints collapse first, so a group of exact copies costs one row.
2. 64 bits are cut into ``blocks`` runs.  Two fingerprints within ``distance`` bits agree on
   ``blocks - distance`` runs at least, so each fingerprint is filed under every choice of that
   many runs and each close pair meets in some group.  ``blocks`` grows with the number of
   fingerprints, which keeps groups small; every choice is exact.
3. A group above ``GROUP_ROWS`` is cut by hash into chunks, and each pair of chunks is a group
   of its own: no group, however many near copies it has, goes to one task.
4. Each group sorts its fingerprints by Gray rank and builds the index over them bottom up:
   ``FANOUT`` neighbours share a node that holds the mask of the bits they agree on and their
   common pattern.  The search carries (fingerprint, node, differences so far) downwards,
   counts each bit once - where it first becomes common - and drops the node as soon as the sum
   exceeds the distance; a node whose free bits cannot push the sum over the distance is linked
   as a whole.
5. Of the links in a group only a spanning star per class leaves it, and min-label stars are
   contracted over the whole set until nothing changes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches, staged

GROUP_ROWS = 512      # a group above this is cut into pairs of chunks of half of it
GROUP_MEAN = 256      # wanted rows of an ordinary group
FANOUT = 16
PAIRS_AT_ONCE = 1 << 20


def shingle_fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned SimHash of UTF-8 ``text``: A-Z lower-cased, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: n - shingle + 1].tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:z], 42) for a, z in zip(starts, ends[shingle - 1:].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at: at + (1 << 16)], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text, shingle: int = 4):
    """Column: the fingerprint as a signed 64-bit integer.  Null and word-free texts give 0."""
    @F.arrow_udf("bigint")
    def of(col: pa.Array) -> pa.Array:
        got = np.fromiter((0 if b is None else shingle_fingerprint(b, shingle) for b in
                           (x.as_py() for x in col)), np.uint64, len(col))
        return pa.array(got.view(np.int64))
    return of(text.cast("binary"))


# --- the index -------------------------------------------------------------------------------

def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each code in the binary-reflected Gray sequence (prefix xor)."""
    r = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of nodes over Gray-sorted distinct fingerprints; level 0 holds the fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        ands, ors = [self.fps], [self.fps]
        while len(ands[-1]) > 1:
            cut = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], cut))
            ors.append(np.bitwise_or.reduceat(ors[-1], cut))
        self.pattern = ands
        self.mask = [~(o ^ a) & every for a, o in zip(ands, ors)]

    def links(self, queries: np.ndarray, distance: int):
        """Yield (query position, first, last) runs of fingerprint positions within ``distance``."""
        top = len(self.mask) - 1
        step = max(1, PAIRS_AT_ONCE // max(1, min(len(self.fps), 4096)))
        for at in range(0, len(queries), step):
            q = np.arange(at, min(at + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            diff = np.bitwise_count((queries[q] ^ self.pattern[top][0]) & self.mask[top][0]).astype(np.int64)
            for level in range(top, -1, -1):
                ok = diff <= distance
                q, node, diff = q[ok], node[ok], diff[ok]
                if level == 0:
                    yield q, node, node
                    break
                free = 64 - np.bitwise_count(self.mask[level][node]).astype(np.int64)
                whole = diff + free <= distance
                if whole.any():
                    span = FANOUT ** level
                    first = node[whole] * span
                    yield q[whole], first, np.minimum(first + span, len(self.fps)) - 1
                    q, node, diff = q[~whole], node[~whole], diff[~whole]
                below, known = len(self.mask[level - 1]), self.mask[level][node]
                kids = np.minimum(below - node * FANOUT, FANOUT)
                at_kid = np.repeat(node * FANOUT, kids) + (np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids))
                q, diff, known = np.repeat(q, kids), np.repeat(diff, kids), np.repeat(known, kids)
                new = self.mask[level - 1][at_kid] & ~known          # bits that become common here
                diff = diff + np.bitwise_count((queries[q] ^ self.pattern[level - 1][at_kid]) & new)
                node = at_kid


def spanning(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every linked class among distinct ``fps``; roots themselves left out."""
    index = GrayIndex(fps)
    n = len(index.fps)
    root = np.arange(n)

    def merge(a, b):
        nonlocal root
        while True:
            x, y = root[a], root[b]
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(nxt := root[root], root):
                root = nxt

    for q, first, last in index.links(index.fps, distance):
        runs = last > first
        for f, z in set(zip(first[runs].tolist(), last[runs].tolist())):    # a whole node is one class
            merge(np.full(z - f, f), np.arange(f + 1, z + 1))
        merge(q, first)
    low = np.full(n, np.iinfo(np.int64).max)
    signed = index.fps.view(np.int64)
    np.minimum.at(low, root, signed)
    low = low[root]
    keep = low != signed
    return signed[keep], low[keep]


# --- Spark -----------------------------------------------------------------------------------

def _blocks(rows: int, distance: int) -> int:
    """The fewest runs whose groups stay near GROUP_MEAN rows, tables permitting."""
    for blocks in range(distance + 1, distance + 5):
        if rows / 2 ** (64 * (blocks - distance) / blocks) <= 8 * GROUP_MEAN:
            break
    return blocks


def close_links(fps: DataFrame, distance: int) -> DataFrame:
    """Spanning links (src > dst) between distinct fingerprints ``fp`` within ``distance`` bits."""
    rows = fps.count()
    blocks = _blocks(rows, distance)
    agree = blocks - distance
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    # neighbouring key values share a group until it has about GROUP_MEAN rows
    spread = max(1, rows // GROUP_MEAN)

    def key(choice):
        value, bits = F.lit(0).cast("bigint"), 0
        for b in choice:
            width = cuts[b + 1] - cuts[b]
            part = F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << width) - 1))
            value, bits = F.shiftleft(value, width).bitwiseOR(part), bits + width
        return F.shiftright(value, max(0, bits - max(0, spread.bit_length() - 1)))

    keys = F.array(*[F.struct(F.lit(i).alias("way"), key(c).alias("val"))
                     for i, c in enumerate(combinations(range(blocks), agree))])
    assert comb(blocks, agree) == len(list(combinations(range(blocks), agree)))
    filed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.way", "k.val")
    hot = (filed.groupBy("way", "val").count().where(F.col("count") > GROUP_ROWS)
           .select("way", "val", F.ceil(F.col("count") / (GROUP_ROWS // 2)).cast("int").alias("chunks")))
    cut = filed.join(hot, ["way", "val"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    dealt = (cut.withColumn("mine", mine).withColumn("other", other)
             .select("fp", "way", "val", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        src, dst = spanning(group["fp"].to_numpy(np.int64).view(np.uint64), distance)
        return pd.DataFrame({"src": src, "dst": dst})

    return (dealt.groupBy("way", "val", "lo", "hi").applyInPandas(search, "src bigint, dst bigint").distinct())


def contract(links: DataFrame) -> DataFrame:
    """Connected classes of ``links`` (src, dst): (fp, root) with the smallest member as root.

    Alternates large and small stars; each round is written to shared storage.  The neighbours of
    a hub are reduced by partial minima and its rows are joined, never gathered in one task."""
    edges = staged(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            low = low.withColumn("m", F.least("u", "m"))
            out = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        return out.where(F.col("u") != F.col("v")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(edges)
    while was[0]:
        edges = staged(star(star(edges, True), False), "links")
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def link_components(marked: DataFrame, distance: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Classes of the fingerprints in ``marked`` (``id_col``, fp): (fp, root, component_id).

    One row per distinct fingerprint.  ``component_id`` is the smallest id of any row reachable
    over links, null if all of those ids are null.  An empty input gives no rows."""
    fps = staged(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "fps")
    roots = contract(close_links(fps.select("fp"), distance))
    joined = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.join(lows, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed), ``root`` (its class),
    ``fingerprint`` (16 hex digits) and ``component_id``.

    Null, empty and word-free texts have fingerprint zero and are linked like any other.  Repeated
    rows each give a row.  Only the two named columns are read, so further columns cannot clash."""
    bound_batches(docs.sparkSession)
    marked = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")), "marked")
    classes = staged(link_components(marked, distance).select("fp", "root", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                             "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest doc_id.

    Among rows of the class that repeat that id, and in a class without any id, one row stays.
    Columns are unchanged, whatever their names: a row travels as one struct beside the operator's own."""
    found = staged(near_duplicates(docs, distance, shingle).select("doc_id", "fp", "root", "component_id"), "found")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows of an id anywhere: its other rows may stand in another class, and only the fingerprint tells them apart
    ids = found.groupBy("doc_id").agg(F.count("*").alias("rows")).join(own.select("doc_id").distinct(), "doc_id")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = packed.join(ids.withColumnRenamed("doc_id", "id"), F.col("doc.doc_id") == F.col("id"))
    once = out.where("rows = 1").select("doc")
    # rows with a repeated id, or none, are few or odd: only for them the fingerprint is needed again
    again = out.where("rows > 1").select("doc").unionByName(packed.where(F.col("doc.doc_id").isNull()))
    roots = own.select(F.col("doc_id").alias("id"), F.col("fp").alias("of"), "root").distinct()
    again = again.withColumn("fp", fingerprint(F.col("doc.text"), shingle))
    again = again.join(roots, (F.col("fp") == F.col("of")) & F.col("doc.doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["root"])
    return once.unionByName(again.select("doc")).select("doc.*")
