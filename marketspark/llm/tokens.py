"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """Membership table of the bytes in the given inclusive spans."""
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo: hi + 1] = True
    return table


#: Words end at ASCII white space.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))


class Words:
    """Words of the texts in ``col`` with A-Z lower-cased: runs of bytes outside ``ends``.

    ``doc`` is each word's text, ``ids`` its place in ``vocab`` (the batch's distinct words as a binary
    array), ``chain`` tells whether the word after it belongs to the same text with no byte of ``breaks``
    between.  A null text has no words.  Bytes from 0x80 on never end a word unless ``ends`` says so,
    hence UTF-8 needs no decoding."""

    def __init__(self, col: pa.Array, ends: np.ndarray, breaks: np.ndarray | None = None):
        col = col.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        raw = np.frombuffer(col.buffers()[2] or b"", np.uint8) if len(col) else np.zeros(0, np.uint8)
        data = LOWER[raw[bounds[0]: bounds[-1]]]
        bounds = bounds - bounds[0]
        inside = ~ends[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.texts = len(col)
        self.doc = np.searchsorted(bounds, starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.texts)
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(stops - starts, out=offsets[1:])
        found = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                      [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.vocab, self.ids = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.chain = np.zeros(len(starts), bool)
        if len(starts) > 1:
            self.chain[:-1] = self.doc[1:] == self.doc[:-1]
            if breaks is not None:
                cut = np.cumsum(breaks[data])[starts]
                self.chain[:-1] &= cut[1:] == cut[:-1]

    def runs(self, length: int) -> np.ndarray:
        """Positions where ``length`` chained words start."""
        ok = np.ones(len(self.ids), bool)
        for k in range(length - 1):
            n = max(len(ok) - k, 0)
            ok[:n] &= self.chain[k: k + n]
            ok[n:] = False
        return np.flatnonzero(ok)


def word_bytes(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large-binary array without nulls."""
    n = len(vocab)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset: vocab.offset + n + 1]
    return np.frombuffer(vocab.buffers()[2] or b"", np.uint8), offsets


def spaced(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The words ``ids`` one after the other, each with the byte ``gap`` after it, and where each ends (its gap included)."""
    size = offsets[ids + 1] - offsets[ids] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, gap, np.uint8)
    within = np.arange(len(out)) - np.repeat(ends - size, size)
    word = within < np.repeat(size - 1, size)
    out[word] = data[(np.repeat(offsets[ids], size) + within)[word]]
    return out, ends
