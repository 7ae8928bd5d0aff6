"""Near-duplicates by b-bit MinHash over word shingles, confirmed on whole sets.

1. Every text becomes the set of its distinct ``shingle``-word runs (64-bit hashes).  Texts with equal sets
   share a 128-bit key and go on as one row.
2. ``LANES`` minima of the set are taken.  Groups of ``ROWS`` minima make the band keys; of each minimum
   only the low ``BITS`` bits are kept, packed into bigints.
3. Sets that share a band key are candidates.  Agreeing lanes are counted with xor and bit_count; two unrelated
   lanes agree by chance in one of 2^BITS cases, so the similarity is estimated as
   (agreeing / LANES - C) / (1 - C) with C = 2^-BITS.  Candidates whose estimate lies more than ``SIGMAS``
   standard deviations below the threshold are dropped: a link is lost there with a chance below 1e-9, and by
   the bands (0.8 similar, 32 bands of 4) with one below 5e-8.
4. What is left is confirmed on the full sets: 100 * common >= percent * union.

Candidates are not all pairs.  First every member of a band meets the band's first member only, and classes are
made of the links so found.  After that a band whose members are all in one class can add nothing.  In the others,
members of different classes are compared, in pairs of chunks of bounded size: by size, by the
estimate, and by parity sketches, which bound the similarity from above without error (a bit is the
parity of the shingles hashed to it, so each differing bit proves a shingle that only one set holds).  What
passes is nearly always a link.  A first look, at a part of the bands, confirms only the best candidate of each
pair of classes; the last look takes every band and confirms all that is still open, so no link between classes is
lost, while a group of thousands of near copies is not confirmed pair by pair.

At scale: copies collapse in a partial aggregate before any join; bands, links and classes are joined on row
numbers with hot keys dealt over tasks (``skew_join``); texts of candidates only are read again for their
sets; classes are contracted on stored tables (``simhash.contract``).  Nothing is gathered on the driver.

Defined cases: null, empty and word-free texts have an empty set and link with nothing (their component is their own
id); a text with fewer words than a shingle has its whole sequence as one; repeated rows each give a row; a class's
component is its smallest id, null if it holds none, and ``kept`` compares null-safely; an empty table gives no rows;
only the two named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches, staged
from marketspark.llm.simhash import contract
from marketspark.llm.tokens import SPACES, Words
from marketspark.operators.skew import skew_join

LANES, ROWS, BITS, SIGMAS = 128, 4, 2, 6.0
CHUNK = 256              # members of a band compared at once with as many others
TASK_ROWS = 8192         # members compared by one task, at most about
SKETCH_BITS = 1 << 18
SENT_IDS = 200_000       # a list of ids beyond this is not broadcast
GROUP_ROWS = 2048        # members of small bands compared in one group, about
PAIRS_AT_ONCE, SKETCHES_AT_ONCE = 1 << 17, 1 << 23       # pairs, and bytes of sketches, in one numpy step
FIRST_LOOK = 4           # one band of so many takes part in the first look
SEED = 11


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1 << 63, size=LANES, dtype=np.uint64), r.integers(1 << 63, size=LANES, dtype=np.uint64) * 2 + 1


def shingle_sets(col: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and where each text's start."""
    words = Words(col, SPACES)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words.vocab.to_pylist()), np.uint64, len(words.vocab))
    at = words.runs(shingle)
    h = np.full(len(at), np.uint64(shingle))
    with np.errstate(over="ignore"):
        for k in range(shingle):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + of_word[words.ids[at + k]])
        doc = words.doc[at]
        few = np.flatnonzero((words.counts > 0) & (words.counts < shingle))   # the whole sequence as one
        if len(few):
            first = np.searchsorted(words.doc, few)
            g = words.counts[few].astype(np.uint64)
            for k in range(shingle - 1):
                more = words.counts[few] > k
                g[more] = _mixed(g[more] * np.uint64(0x9E3779B97F4A7C15) + of_word[words.ids[first[more] + k]])
            doc, h = np.concatenate([doc, few]), np.concatenate([h, g])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(words.texts + 1))


def minima(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``LANES`` minima of every non-empty set, as (set, lane)."""
    flips, factors = _lanes()
    out = np.empty((len(bounds) - 1, LANES), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        starts = bounds[:-1][full]
        for lane in range(LANES):
            v = (h ^ flips[lane]) * factors[lane]
            v ^= v >> np.uint64(32)
            out[full, lane] = np.minimum.reduceat(v, starts)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of every lane, packed into 64-bit words: (set, word)."""
    per = 64 // BITS
    low = (least & np.uint64((1 << BITS) - 1)).reshape(len(least), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, the band's number mixed in."""
    out = np.tile(np.arange(LANES // ROWS, dtype=np.uint64), (len(least), 1))
    for k in range(ROWS):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS])
    return out


def sketch(text: Column, shingle: int) -> Column:
    """Column struct(n, key, sig, bands) of a whole text; all but ``n`` are null for an empty set."""
    @F.arrow_udf("struct<n bigint, key binary, sig array<bigint>, bands array<bigint>>")
    def of(col: pa.Array) -> pa.Array:
        h, bounds = shingle_sets(col, shingle)
        least = minima(h, bounds)
        n = np.diff(bounds)
        keys = [xxhash.xxh3_128_digest(h[a:z].tobytes()) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        void = pa.array(n == 0)

        def lists(rows: np.ndarray) -> pa.Array:
            wide = rows.shape[1]
            offsets = pa.array(np.arange(0, len(rows) * wide + 1, wide, dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1).view(np.int64)), mask=void if len(rows) else None)

        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(keys, pa.binary()), lists(packed(least)), lists(band_keys(least))],
                                          ["n", "key", "sig", "bands"])
    return of(text.cast("binary"))


def parity_sketch(h: np.ndarray) -> bytes:
    """8 to 16 bits per shingle (a power of two of them, SKETCH_BITS at most): parities of the shingles at each place."""
    bits = min(max(64, 1 << int(8 * len(h) - 1).bit_length()), SKETCH_BITS)
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def whole_set(text: Column, shingle: int) -> Column:
    """Column struct(items, odd): the sorted distinct shingle hashes of a whole text as bytes, and their parity sketch."""
    @F.arrow_udf("struct<items binary, odd binary>")
    def of(col: pa.Array) -> pa.Array:
        h, bounds = shingle_sets(col, shingle)
        sets = [h[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in sets], pa.binary()),
                                           pa.array([parity_sketch(x) for x in sets], pa.binary())], ["items", "odd"])
    return of(text.cast("binary"))


def common(a: Column, b: Column) -> Column:
    """Column: size of the intersection of two sorted sets."""
    @F.arrow_udf("bigint")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), np.int64)
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            out[i] = np.count_nonzero(y[at] == x)
        return pa.array(out)
    return of(a, b)


# --- estimates -------------------------------------------------------------------------------------

def least_lanes(percent: int) -> int:
    """Agreeing lanes below which two sets cannot be ``percent`` similar, but for SIGMAS deviations."""
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * percent / 100
    return int(np.floor(LANES * p - SIGMAS * np.sqrt(LANES * p * (1 - p))))


def estimate(agreeing, lanes: int = LANES):
    """Similarity from agreeing lanes, corrected for lanes that agree by chance."""
    chance = 2.0 ** -BITS
    return (agreeing / lanes - chance) / (1 - chance)


def _one_per_lane() -> int:
    return sum(1 << (BITS * k) for k in range(64 // BITS))


def agreeing(a: Column, b: Column) -> Column:
    """Lanes in which two packed signatures agree: LANES less the lanes with any differing bit."""
    ones = F.lit(_one_per_lane())

    def differing(x, y):
        d = x.bitwiseXOR(y)
        hit = d
        for k in range(1, BITS):
            hit = hit.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(hit.bitwiseAND(ones)).cast("int")

    return F.lit(LANES) - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda t, x: t + x)


def _fits(n_a, n_b, percent: int):
    """Sizes that allow ``percent`` similarity at all."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


# --- links -----------------------------------------------------------------------------------------

def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) whose sizes and estimate allow a link."""
    def side(name):
        return sets.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))

    both = skew_join(skew_join(pairs, side("src"), ["src"]), side("dst"), ["dst"])
    return (both.where(_fits(F.col("n_src"), F.col("n_dst"), percent) & (agreeing(F.col("sig_src"), F.col("sig_dst")) >= least_lanes(percent)))
            .select("src", "dst", "n_src", "n_dst"))


def _sent(ids: DataFrame) -> DataFrame:
    """``ids``, sent to every task if there are SENT_IDS at most (some 40 bytes each), else joined like any table."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) among pairs (src, dst, n_src, n_dst), by their whole sets ``full`` (sid, items)."""
    pairs = staged(pairs, "pairs")
    asking = full.join(_sent(pairs.select(F.col("src").alias("sid")).distinct()), "sid", "left_semi")
    left = skew_join(pairs, asking.select(F.col("sid").alias("src"), F.col("items").alias("items_src")), ["src"])
    # of the other sides only those asked for move; one that meets many sets is copied once per part of them
    asked = full.join(_sent(pairs.select(F.col("dst").alias("sid")).distinct()), "sid", "left_semi")
    both = skew_join(left, asked.select(F.col("sid").alias("dst"), F.col("items").alias("items_dst")), ["dst"], counted=pairs)
    both = both.withColumn("both", common(F.col("items_src"), F.col("items_dst")))
    return both.where(F.col("both") * 100 >= (F.col("n_src") + F.col("n_dst") - F.col("both")) * percent).select("src", "dst")


def _classes(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, root) for every set."""
    roots = contract(links).select(F.col("fp").alias("sid"), "root")
    return staged(sets.select("sid").join(roots, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root")), "roots")


def _folded(sketches: np.ndarray) -> np.ndarray:
    """The sketches of half as many bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _in_band(v: np.ndarray, chunk: np.ndarray):
    """Pairs of positions with equal ``v`` and, where rows of two chunks stand together, of different chunks; PAIRS_AT_ONCE or so at a time."""
    cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    length = np.diff(np.append(cut, len(v)))
    stop = np.repeat(cut + length, length)
    more = stop - np.arange(len(v)) - 1                     # partners behind each row
    done = np.cumsum(more)
    at = 0
    while at < len(v):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        x = np.repeat(np.arange(at, to), more[at:to])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more[at:to]) - more[at:to], more[at:to])
        apart = (chunk[x] < 0) | (chunk[x] != chunk[y])
        yield x[apart], y[apart]
        at = to


def compare(group: pd.DataFrame, percent: int, best: bool) -> pd.DataFrame:
    """Pairs of members of one band and different classes that may be linked; ``best``: the likeliest per pair of classes.

    ``group`` holds whole bands, or two chunks (``chunk``, else -1) of a large one."""
    group = group.sort_values("v", kind="stable")
    v, chunk, sid, root, n = (group[c].to_numpy(np.int64) for c in ("v", "chunk", "sid", "root", "n"))
    sig = np.stack(group["sig"].to_numpy()).astype(np.int64).view(np.uint64)
    enough, ones = least_lanes(percent), np.uint64(_one_per_lane())
    sizes = group["odd"].map(len).to_numpy(np.int64)
    place, full, half = np.zeros(len(sid), np.int64), {}, {}
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        place[rows] = np.arange(len(rows))
        full[size] = np.frombuffer(b"".join(group["odd"].iloc[rows]), np.uint64).reshape(len(rows), -1)
        half[size] = _folded(full[size]) if full[size].shape[1] > 1 else full[size]
    out = []
    for x, y in _in_band(v, chunk):
        fit = (root[x] != root[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y = x[fit], y[fit]
        d = sig[x] ^ sig[y]
        hit = d.copy()
        for k in range(1, BITS):
            hit |= d >> np.uint64(k)
        near = LANES - np.bitwise_count(hit & ones).sum(axis=1, dtype=np.int64) >= enough
        x, y = x[near], y[near]
        x, y = np.where(sizes[x] <= sizes[y], x, y), np.where(sizes[x] <= sizes[y], y, x)
        for small, large in {*zip(sizes[x].tolist(), sizes[y].tolist())}:
            these = np.flatnonzero((sizes[x] == small) & (sizes[y] == large))
            step = max(1, SKETCHES_AT_ONCE // small)
            for at in range(0, len(these), step):
                i, k = x[these[at: at + step]], y[these[at: at + step]]
                # sizes that allow a link differ by a factor of two at most
                other = full[large][place[k]] if small == large else half[large][place[k]]
                apart = np.bitwise_count(full[small][place[i]] ^ other).sum(axis=1, dtype=np.int64)
                both = n[i] + n[k]
                ok = (both - apart) * 100 >= (both + apart) * percent
                out.append((i[ok], k[ok], apart[ok] / both[ok]))
    x, y, apart = (np.concatenate([np.zeros(0, t), *[o[k] for o in out]]) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    found = pd.DataFrame({"src": np.maximum(sid[x], sid[y]), "dst": np.minimum(sid[x], sid[y]),
                          "a": np.maximum(root[x], root[y]), "b": np.minimum(root[x], root[y]), "apart": apart})
    return found.sort_values(["apart", "src", "dst"]).drop_duplicates(["a", "b"]) if best else found.drop_duplicates(["src", "dst"])


def open_pairs(members: DataFrame, sketches: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Likely pairs (src, dst, n_src, n_dst) of different classes within a band, each once.

    Bands of one class are left out; the members of the others are cut into chunks, and every pair of
    chunks is a group of its own."""
    placed = staged(members.join(classes, "sid"), "placed")
    mixed = staged(placed.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
                   .where("low < high").select("v", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "mixed")
    rows = mixed.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    filed = skew_join(placed, mixed.select("v", "chunks"), ["v"], counts=mixed.select("v", "n"))
    mine = F.pmod(F.xxhash64("sid"), "chunks").cast("int")
    dealt = filed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # a large band's pairs of chunks are groups of their own; small bands share one
    large, groups = F.col("chunks") > 1, max(1, rows // GROUP_ROWS)
    lone = F.lit(-1)
    dealt = dealt.select("v", "sid", "root", F.when(large & (F.col("mine") != F.col("other")), F.col("mine")).otherwise(lone).alias("chunk"),
                         F.when(large, F.col("v")).otherwise(F.pmod(F.xxhash64("v"), F.lit(groups))).alias("unit"),
                         F.when(large, F.least("mine", "other")).otherwise(lone).alias("lo"), F.when(large, F.greatest("mine", "other")).otherwise(lone).alias("hi"))
    dealt = dealt.join(sketches, "sid").repartition(max(1, rows // TASK_ROWS), "unit", "lo", "hi")
    found = staged(dealt.groupBy("unit", "lo", "hi").applyInPandas(
        lambda group: compare(group, percent, best), "src bigint, dst bigint, a bigint, b bigint, apart double"), "open")
    if best:
        found = found.groupBy("a", "b").agg(F.min(F.struct("apart", "src", "dst")).alias("x")).select("x.src", "x.dst")
    sizes = sketches.select("sid", "n")
    return (found.select("src", "dst").distinct().join(sizes.select(F.col("sid").alias("src"), F.col("n").alias("n_src")), "src")
            .join(sizes.select(F.col("sid").alias("dst"), F.col("n").alias("n_dst")), "dst"))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col)
    marked = staged(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"),
                                sketch(text, shingle).alias("s"))
                    .select("doc_id", "t1", "t2", "s.*").withColumn("row", F.monotonically_increasing_id()), "marked")
    # one row a distinct set; sid is stored, so it never changes
    sets = (marked.where("n > 0").groupBy("key")
            .agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t1", "t2")).alias("at"), F.first("n").alias("n"),
                 F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    sets = staged(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    narrow = sets.select("sid", "n", "sig")
    filed = sets.select("sid", F.explode("bands").alias("v"))
    shared = staged(filed.groupBy("v").agg(F.count("*").alias("n"), F.min("sid").alias("first")).where("n > 1"), "shared")
    members = staged(skew_join(filed, shared.select("v", "first"), ["v"], counts=shared.select("v", "n")), "members")
    # whole sets of the members only: their texts are met again by id and text hash
    wanted = staged(members.select("sid").distinct().join(sets.select("sid", "at"), "sid").select("sid", "at.*"), "wanted")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    same = (texts["t1"] == wanted["t1"]) & (texts["t2"] == wanted["t2"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    full = texts.join(_sent(wanted), same).groupBy("sid").agg(F.first("text").alias("text"))
    full = staged(full.select("sid", whole_set(F.col("text"), shingle).alias("s")).select("sid", "s.*"), "full")
    items = full.select("sid", "items")
    sketches = staged(full.select("sid", "odd").join(narrow, "sid"), "sketches")
    stars = members.where("sid <> first").select(F.col("sid").alias("src"), F.col("first").alias("dst")).distinct()
    links = staged(confirmed(_likely(staged(stars, "stars"), narrow, percent), items, percent), "links")
    members = members.select("sid", "v")
    part = members.where(F.pmod("v", F.lit(FIRST_LOOK)) == 0)
    links = staged(links.unionByName(confirmed(open_pairs(part, sketches, _classes(sets, links), percent, best=True), items, percent)), "links")
    classes = _classes(sets, links)
    more = confirmed(open_pairs(members, sketches, classes, percent, best=False), items, percent)
    # links between classes, then everything by the roots' roots
    roots = more.join(classes.select(F.col("sid").alias("src"), F.col("root").alias("a")), "src").join(
        classes.select(F.col("sid").alias("dst"), F.col("root").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = contract(roots).select(F.col("fp").alias("root"), F.col("root").alias("top"))
    final = classes.join(joined, "root", "left").select("sid", F.coalesce("top", "root").alias("root"))
    final = final.join(sets.select("sid", "key", "low"), "sid")
    lows = final.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = staged(final.join(lows, "root").select("key", "component_id"), "answer")
    linked = skew_join(marked.where("n > 0").select("row", "doc_id", "n", "key"), answer, ["key"])
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
