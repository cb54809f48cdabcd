"""Vectorised text helpers shared by the operators of this subpackage.

They work on the UTF-8 bytes of an Arrow string column, so no Python string is
made per word.  Everything here runs inside Spark tasks; nothing holds more
than one Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are cut at a separator.
SEGMENT = 1 << 21

_WHITE = [0x20, *range(0x09, 0x0E)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class WordTable:
    """Which bytes belong to words, and the value each byte adds to a word's hash."""

    def __init__(self, alnum_only: bool = False):
        keep = np.ones(256, bool)
        if alnum_only:  # letters, digits and every non-ASCII byte
            keep[:128] = False
            for a, b in ((48, 58), (65, 91), (97, 123)):
                keep[a:b] = True
        else:
            keep[_WHITE] = False
        self.word = keep
        values = stream(256, 11)
        values[65:91] = values[97:123]  # A-Z count as a-z
        values[~keep] = 0
        self.values = values
        self.powers = np.ones(64, np.uint64)
        self._grow(4096)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            base = np.full(n, 0x9E3779B97F4A7C55, np.uint64)
            base[0] = 1
            self.powers = np.multiply.accumulate(base)

    def hashes(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of every word of one stretch of bytes."""
        inside = self.word[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        rel = np.arange(len(buf), dtype=np.int64)
        rel -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(buf)]))))
        longest = int(rel.max()) + 1
        if longest > len(self.powers):
            self._grow(longest)
        v = self.values[buf]
        v *= self.powers[rel]
        return mix64(np.add.reduceat(v, starts)), starts


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    buf = buf[off[0] : off[-1]]
    return buf, off - off[0]


def word_hashes(column: pa.Array, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets by document) of a string column."""
    buf, off = utf8(column)
    parts, counts = [], np.zeros(len(off) - 1, np.int64)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SEGMENT, "right")) - 1)
        if j == i + 1 and off[j] - off[i] > SEGMENT:  # one long text: by segments that end at a separator
            at, end = int(off[i]), int(off[j])
            while at < end:
                cut = min(end, at + SEGMENT)
                while cut < end and table.word[buf[cut]] and table.word[buf[cut - 1]]:
                    gap = np.flatnonzero(~table.word[buf[cut : min(end, cut + SEGMENT)]])
                    cut = cut + int(gap[0]) if len(gap) else min(end, cut + SEGMENT)
                h, _ = table.hashes(buf[at:cut])
                parts.append(h)
                counts[i] += len(h)
                at = cut
        else:  # a separator after each text keeps words apart
            lens = np.diff(off[i : j + 1])
            joined = np.full(int(lens.sum()) + (j - i), 0x20, np.uint8)
            to = np.arange(int(lens.sum())) + np.repeat(np.arange(j - i), lens)
            joined[to] = buf[off[i] : off[j]]
            h, starts = table.hashes(joined)
            parts.append(h)
            bounds = (off[i : j + 1] - off[i]) + np.arange(j - i + 1)
            counts[i:j] = np.diff(np.searchsorted(starts, bounds))
        i = j
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles by document.

    With short, a document of 1..k-1 words has one shingle, the whole sequence.
    """
    counts = np.diff(off)
    n = np.maximum(counts - k + 1, 0)
    mult = stream(k, 77) | np.uint64(1)
    out_off = np.concatenate(([0], np.cumsum(np.where((n == 0) & (counts > 0), 1, n) if short else n)))
    out = np.empty(int(out_off[-1]), np.uint64)
    if len(words) >= k:
        total = words[: len(words) - k + 1] * mult[0]
        for i in range(1, k):
            total += words[i : len(words) - k + 1 + i] * mult[i]
        total = mix64(total)
        full = np.flatnonzero(n > 0)
        lens = n[full]
        if len(full):
            within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            out[np.repeat(out_off[full], lens) + within] = total[np.repeat(off[full], lens) + within]
    if short:
        for d in np.flatnonzero((n == 0) & (counts > 0)):
            w = words[off[d] : off[d + 1]]
            out[out_off[d]] = mix64(np.array([(w * mult[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))]))[0]
    return out, out_off


def unique_by_document(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each document, and new offsets."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.concatenate(([0], np.cumsum(np.bincount(d[keep], minlength=len(off) - 1))))
