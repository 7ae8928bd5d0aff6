"""Byte-level BPE over length-bucketed numpy matrices.

``Tokenizer.encode_batch`` splits texts with the vocabulary's pattern and encodes the distinct
pieces that it does not remember.  A piece that is itself in the vocabulary is one token.  The
others start as rows of byte ranks in padded matrices, one per length bucket, and all rows of a
matrix advance together: each round every row merges its leftmost pair of least rank, closes the
gap (compaction) and looks up its two new pairs in a hash table; rows without a pair to merge leave.

A row needs a round per merge, so a single piece of n bytes costs n * n steps.  Above ``QUEUE_FROM``
bytes a priority queue of (rank, position) makes the same merges in the same order.
"""

from __future__ import annotations

import hashlib
import base64
import re
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marketspark.llm.common import bound_batches

NONE = np.int32(2**31 - 1)      # rank of a pair that the vocabulary does not hold
QUEUE_FROM = 1024
CACHE_PIECES = 200_000          # distinct pieces a task remembers before it starts afresh
TEXT_AT_ONCE = 1_000_000        # characters split before their new pieces are encoded
CELLS = 1 << 19                 # cells of one matrix: its arrays stay in the processor's cache


def latin_pattern(pattern: str) -> str:
    """``pattern`` for ``re`` and texts of code points below 256: its classes (\\p{..}, \\s, \\S)
    written out as the characters that they match there."""
    low = [chr(c) for c in range(256)]
    out, inside, at = [], False, 0
    for m in regex.finditer(r"\\p\{\w+\}|\\[sS]|\\.|[\[\]]|[^\\\[\]]+", pattern):
        assert m.start() == at, "an unforeseen pattern"
        at, token = m.end(), m[0]
        if token in "[]":
            inside = token == "["
        elif len(token) > 2 and token[0] == "\\" or token in ("\\s", "\\S"):
            token = "".join(f"\\x{ord(c):02x}" for c in low if regex.fullmatch(token, c))
            token = token if inside else f"[{token}]"
        out.append(token)
    # beyond the listed characters nothing may match \\S, but such texts do not come here
    return "".join(out)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing table from a pair of token ids to the merged token's rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(2.5 * len(rank)).bit_length())
        self.shift, self.wrap = np.uint64(64 - size.bit_length() + 1), size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = left << 32 | right
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):                       # place a whole round of keys, then the ones that lost a slot
            self.probes += 1
            empty = self.keys[at] == -1
            self.keys[at[empty]] = keys[todo[empty]]
            won = self.keys[at] == keys[todo]
            self.ranks[at[won]] = rank[todo[won]]
            todo, at = todo[~won], at[~won] + 1 & self.wrap

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & self.wrap
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find_any, self.find_latin = ranks, regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        assert (self.byte >= 0).all(), "the vocabulary must hold every single byte"
        cuts = [(a, b, rank) for token, rank in ranks.items() for cut in range(1, len(token))
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None]
        self.pairs = PairTable(*np.array(cuts, np.int64).reshape(-1, 3).T)
        top = max(ranks.values()) + 1
        inverse = {rank: token for token, rank in ranks.items()}
        self.size = np.array([len(inverse.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(inverse.get(i, b"") for i in range(top)), np.uint8)
        self._forget()

    # -- encoding

    def _forget(self) -> None:
        self.number: dict[str, int] = {}          # piece -> its place in the arrays below
        self.ids = np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find_pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def _merge_rows(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all ``rows``, which share a length bucket, one after the other; their counts."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(size.max())
        mat = np.full((len(rows), width), -1, np.int32)
        mat[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((len(rows), width), NONE, np.int32)              # of the pair that starts here
        real = np.arange(width - 1) < size[:, None] - 1
        ranks[:, :-1][real] = self.pairs.find(mat[:, :-1][real], mat[:, 1:][real])
        ids, counts = np.empty_like(mat), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while True:
            at = np.arange(len(live))
            best = ranks.argmin(axis=1)                                  # the leftmost of the least
            least = ranks[at, best]
            done = least == NONE
            if done.any():
                ids[live[done], :width] = mat[done]
                counts[live[done]] = size[done]
                stay = ~done
                live, mat, size, ranks, best, least = (x[stay] for x in (live, mat, size, ranks, best, least))
                if not len(live):
                    return ids[np.arange(ids.shape[1]) < counts[:, None]], counts
                width = int(size.max())
                mat, ranks, at = mat[:, :width], ranks[:, :width], at[: len(live)]
            before = np.arange(width - 1) <= best[:, None]               # every row gives up one place
            mat = np.where(before, mat[:, :-1], mat[:, 1:])
            ranks = np.where(before, ranks[:, :-1], ranks[:, 1:])
            mat[at, best] = least
            size -= 1
            width -= 1
            for left in (best - 1, best):
                ok = (left >= 0) & (left + 1 < size)
                r, c = at[ok], left[ok]
                ranks[r, c] = self.pairs.find(mat[r, c], mat[r, c + 1])
            last = best + 1 >= size                                      # the merged token ends its row
            ranks[at[last], best[last]] = NONE

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long row, least rank and then leftmost first, from a queue."""
        part: list = [raw[i: i + 1] for i in range(len(raw))]
        after, prior = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        ranks = self.ranks.get
        queue = [(r, i, part[i], part[i + 1]) for i in range(len(raw) - 1) if (r := ranks(part[i] + part[i + 1])) is not None]
        heapify(queue)
        while queue:
            _, i, a, b = heappop(queue)
            j = after[i]
            if part[i] != a or j >= len(raw) or part[j] != b:            # one side has been merged since
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            if k < len(raw):
                prior[k] = i
                if (r := ranks(part[i] + part[k])) is not None:
                    heappush(queue, (r, i, part[i], part[k]))
            h = prior[i]
            if h >= 0 and (r := ranks(part[h] + part[i])) is not None:
                heappush(queue, (r, h, part[h], part[i]))
        return np.array([self.ranks[p] for p in part if p is not None], np.int32)

    def _learn(self, pieces: list[str]) -> None:
        raws = [p.encode() for p in pieces]
        whole = np.fromiter(map(self.ranks.get, raws, repeat(-1)), np.int64, len(raws))
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        order = np.argsort(np.where(whole >= 0, 0, size), kind="stable")
        single = int((whole >= 0).sum())
        ids, counts = [whole[order[:single]].astype(np.int32)], [np.ones(single, np.int64)]
        at, short = single, int(np.searchsorted(size[order[single:]], QUEUE_FROM)) + single
        while at < short:                                                # a bucket's widths differ by a quarter at most
            width = int(size[order[at]])
            end = int(np.searchsorted(size[order[single:short]], width + (width >> 2), "right")) + single
            end = min(end, at + max(1, CELLS // (width + (width >> 2))))
            flat, count = self._merge_rows([raws[i] for i in order[at:end].tolist()])
            ids.append(flat), counts.append(count)
            at = end
        for i in order[short:].tolist():
            ids.append(self._merge_long(raws[i]))
            counts.append(np.array([len(ids[-1])]))
        known, count = len(self.number), np.concatenate(counts)
        self.number.update(zip([pieces[i] for i in order.tolist()], range(known, known + len(pieces))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *ids])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            split, total = [], 0
            for text in texts[len(out):]:
                if split and total + len(text) > TEXT_AT_ONCE:
                    break
                total += len(text)
                split.append(self.find_pieces(text))
            wanted = set().union(*split)
            fresh = wanted.difference(self.number)
            if fresh and len(self.number) + len(fresh) > CACHE_PIECES:
                self._forget()
                fresh = wanted
            if fresh:
                self._learn(list(fresh))
            for pieces in split:
                which = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
                size = self.count[which]
                ends = np.cumsum(size)
                n = int(ends[-1]) if len(ends) else 0
                out.append(self.ids[np.arange(n) + np.repeat(self.first[which] - (ends - size), size)])
        return out

    # -- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, gathered from the vocabulary's byte table."""
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)
        return self.bytes[at].tobytes()


_TOKENIZERS: dict[tuple, Tokenizer] = {}


def _tokenizer(shared, pattern: str) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    ranks = shared.value
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(ranks, pattern)
    return _TOKENIZERS[key]


class Codec:
    """Columns that encode and decode with one vocabulary file.

    The driver reads the file (its size is fixed by the vocabulary) and broadcasts the ranks."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        bound_batches(spark)
        self.ranks, self.pattern = spark.sparkContext.broadcast(load_ranks(path)), pattern

    def encode(self, text: Column) -> Column:
        """array<int>: the ids of the whole text; a null text is empty."""
        shared, pattern = self.ranks, self.pattern
        made: list[Tokenizer] = []

        @F.arrow_udf("array<int>")
        def ids(col: pa.Array) -> pa.Array:
            if not made:
                made.append(_tokenizer(shared, pattern))
            got = made[0].encode_batch([x or "" for x in col.to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            values = np.concatenate(got) if got else np.zeros(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
        return ids(text)

    def decode(self, ids: Column) -> Column:
        """binary: the bytes that the ids stand for."""
        shared, pattern = self.ranks, self.pattern
        made: list[Tokenizer] = []

        @F.arrow_udf("binary")
        def text(col: pa.Array) -> pa.Array:
            if not made:
                made.append(_tokenizer(shared, pattern))
            return pa.array([made[0].decode(x.values.to_numpy(zero_copy_only=False)) for x in col], pa.binary())
        return text(ids)

    def round_trip(self, text: Column) -> Column:
        """struct(ids, decoded_sha256): the ids of the whole text, and the digest of what those ids decode to.

        One function, since a column that decodes an encoded column would encode it anew."""
        shared, pattern = self.ranks, self.pattern
        made: list[Tokenizer] = []

        @F.arrow_udf("struct<ids array<int>, decoded_sha256 string>")
        def both(col: pa.Array) -> pa.Array:
            if not made:
                made.append(_tokenizer(shared, pattern))
            got = made[0].encode_batch([x or "" for x in col.to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            values = np.concatenate(got) if got else np.zeros(0, np.int32)
            decoded = [hashlib.sha256(made[0].decode(x)).hexdigest() for x in got]
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))),
                                               pa.array(decoded, pa.string())], ["ids", "decoded_sha256"])
        return both(text)


def digests(docs, codec: Codec, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False):
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded bytes); with ``keep_ids`` also the ids themselves.

    Null and empty texts have no tokens and the digests of the empty string; repeated rows each
    give a row; other columns are not read."""
    both = docs.select(F.col(id_col).alias("doc_id"), codec.round_trip(F.col(text_col)).alias("r")).select("doc_id", "r.ids", "r.decoded_sha256")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       "decoded_sha256", *(["ids"] if keep_ids else []))
