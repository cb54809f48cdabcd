"""Runs: maximal periodic stretches of words, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and at least
max(LEAST, 2 * q) words that no neighbouring word extends keeping period q.

Every text is searched by itself; a batch of texts shares its arrays:

1. Ranks of all stretches of 2^k words, by doubling.  The last ranks are the suffix array,
   and the stretches that equal a given one are a range of it.
2. A run of period q has 2 * q words, so its first q words hold a dyadic block (2^k words that
   start at a multiple of 2^k, 2^(k+1) - 1 <= q) and the run repeats that block q words on.  For each
   block the wavelet tree over the suffix array tells its next occurrence in the neighbouring
   window, and the one after that: the range successor.
3. Occurrences closer than half a block form a progression, whose end follows from its common
   extension; it is passed over in one step.  Inside one stretch of its own period
   it tells that period only; between two such stretches each member is a candidate.
4. A candidate period is extended both ways by the ranks; of the periods of one stretch the smallest is its period.

Memory is bounded by a batch (SPAN words) or, beyond that, by the longest text: a few numbers a word and level.

Defined cases: null and empty texts have no words and no runs; rows that repeat an id are
searched each for itself; an empty table gives no rows; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .session import fresh

#: Fewest words of a run, words that are searched together, candidates that are extended together.
LEAST, SPAN, CHUNK = 12, 1 << 18, 1 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and offsets by text; space and 09-0D separate, nulls have none."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    off = parts.offsets.to_numpy().astype(np.int64)
    words = parts.values.slice(off[0], off[-1] - off[0])
    there = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), before[off - off[0]]


class WaveletTree:
    """Values 0..n-1 in a fixed order; asks for the least value from x on within a range of places."""

    def __init__(self, values: np.ndarray):
        self.n, self.zeros, self.bits = len(values), [], max(1, int(len(values)).bit_length())
        for b in range(self.bits - 1, -1, -1):
            low = (values >> b) & 1 == 0
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(low, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[low], values[~low]))

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value >= x among places lo to hi, or n where there is none."""
        a, z, less = lo, hi, np.zeros(len(lo), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a0, z0, one = zeros[a], zeros[z], (x >> b) & 1 == 1
            less += np.where(one, z0 - a0, 0)
            a, z = np.where(one, zeros[-1] + a - a0, a0), np.where(one, zeros[-1] + z - z0, z0)
        out = np.full(len(lo), self.n)
        some = np.flatnonzero((less < hi - lo) & (x < self.n))
        a, z, k, v = lo[some], hi[some], less[some], np.zeros(len(some), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a0, z0 = zeros[a], zeros[z]
            right = k >= z0 - a0
            k = np.where(right, k - (z0 - a0), k)
            v |= right.astype(np.int64) << b
            a, z = np.where(right, zeros[-1] + a - a0, a0), np.where(right, zeros[-1] + z - z0, z0)
        out[some] = v
        return out


class Ranks:
    """For each k, the place of every word's stretch of 2^k words among all sorted ones; equal stretches share it."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, ends: np.ndarray):
        n = len(words)
        self.n, at = n, np.arange(n)
        rank = np.empty(n, np.int64)
        key = doc * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        rank[order] = _firsts(key[order])
        self.levels = [self._padded(rank)]
        size, step = np.bincount(rank, minlength=n), 1
        live = np.flatnonzero(size[rank] > 1)
        while len(live):
            on = live + step
            second = np.where(on < ends[live], rank[np.minimum(on, n - 1)], -1)
            key = rank[live] * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            old = rank[live[order]]
            rank = rank.copy()
            rank[live[order]] = old + _firsts(sorted_key) - _firsts(old)
            self.levels.append(self._padded(rank))
            size, step = np.bincount(rank, minlength=n), 2 * step
            live = live[size[rank[live]] > 1]
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = at

    @staticmethod
    def _padded(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[a + out] == level[np.minimum(b + out, self.n)]).astype(np.int64) << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, x = self.levels[k], a - out - (1 << k)
            out += ((x >= 0) & (level[np.maximum(x, 0)] == level[np.maximum(b - out - (1 << k), 0)])).astype(np.int64) << k
        return out


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with an equal value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _expand(start: np.ndarray, step: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start + i * step) for i below each row's count."""
    row = np.repeat(np.arange(len(start)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, start[row] + i * step[row]


def _candidates(ranks: Ranks, tree: WaveletTree, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance to an occurrence) by levels; every run has one with its period."""
    for k in range(1, len(ranks.levels)):
        block = 1 << k
        # Runs have LEAST = 12 words: blocks of four serve periods below six too, and six itself takes blocks of two.
        least, most = {1: (6, 6), 2: (1, 14)}.get(k, (2 * block - 1, 4 * block - 2))
        _, b = _expand(off[:-1], np.full(len(off) - 1, block), np.diff(off) // block)
        rank = ranks.levels[k][:-1]
        size = np.bincount(rank, minlength=ranks.n)
        b = b[size[rank[b]] > 1]
        lo = rank[b].astype(np.int64)
        hi, x, end = lo + size[lo], b + least, b + most
        while len(b):
            y = tree.successor(lo, hi, x)
            ok = y <= np.minimum(end, ranks.n - 1)
            b, lo, hi, end, y = b[ok], lo[ok], hi[ok], end[ok], y[ok]
            if not len(b):
                break
            after = np.where(y < end, tree.successor(lo, hi, y + 1), ranks.n)
            gap = after - y
            close = (after <= end) & (gap <= block // 2)
            last, count = y.copy(), np.ones(len(y), np.int64)
            i = np.flatnonzero(close)
            if len(i):
                g = gap[i]
                last[i] = y[i] + (g + ranks.ahead(y[i], y[i] + g) - block) // g * g
                own = ranks.ahead(b[i], b[i] + g) + g >= y[i] - b[i] + block  # one stretch of period g holds both
                count[i] = np.where(own, 1, (np.minimum(last[i], end[i]) - y[i]) // g + 1)
            edge = np.concatenate(([0], np.cumsum(count)))
            p = 0
            while p < len(b):  # members of long progressions, some at a time
                q = max(p + 1, int(np.searchsorted(edge, edge[p] + CHUNK, "right")) - 1)
                row, found = _expand(y[p:q], np.maximum(gap[p:q], 1), count[p:q])
                yield b[p:q][row], found - b[p:q][row]
                p = q
            on = last < end
            b, lo, hi, end, x = b[on], lo[on], hi[on], end[on], last[on] + 1


def word_runs(words: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, starts counted over all texts, in order of start and period.

    words: a number for each word, equal for equal words; off: offsets by text; least: at least LEAST.
    """
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none, none
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ranks = Ranks(words, doc, off[doc + 1])
    tree = WaveletTree(ranks.suffixes)
    found = []
    for b, d in _candidates(ranks, tree, off):
        left, right = ranks.behind(b, b + d), ranks.ahead(b, b + d)
        start, length = b - left, left + right + d
        ok = length >= np.maximum(least, 2 * d)
        found.append(np.unique(np.stack((start[ok], length[ok], d[ok])), axis=1))
    if not found:
        return none, none, none
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _searched(texts: pa.Array, least: int) -> Iterator[list[pa.Array]]:
    """n_words, runs and collapsed text of every text, SPAN words at a time."""
    words, off = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SPAN, "right")) - 1)
        own = off[i : j + 1] - off[i]
        start, length, period = word_runs(codes[off[i] : off[j]], own, least)
        edges = np.zeros(own[-1] + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, start + length, -1)
        kept = np.cumsum(edges[:-1]) == 0
        doc = np.searchsorted(own, start, "right") - 1
        bounds = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - own[doc], length, period)], ["start", "length", "period"])
        left = np.concatenate(([0], np.cumsum(kept)))[own].astype(np.int32)
        chosen = words.slice(off[i], own[-1]).filter(pa.array(kept))
        yield [pa.array(np.diff(own)), pa.ListArray.from_arrays(pa.array(bounds), runs), pc.binary_join(pa.ListArray.from_arrays(pa.array(left), chosen), " ")]
        i = j


def find(docs: DataFrame, least: int = LEAST, rewrite: Callable[[pa.Array, pa.Array], pa.Array] | None = None) -> DataFrame:
    """Columns of docs but text, and n_words, runs (start, length, period; by start, then period) and collapsed.

    collapsed: the words that no run holds after its first period, joined by one space.
    rewrite(doc_ids, texts) may change the texts of a batch before they are searched.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not searched for")
    given = [c for c in docs.columns if c.lower() != "text"]
    names = [*given, *fresh(docs.select(*[f"`{c}`" for c in given]), "n_words", "runs", "collapsed")]
    key = next((i for i, c in enumerate(given) if c.lower() == "doc_id"), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(given))
            if rewrite is not None:
                texts = rewrite(b.column(key), texts)
            at = 0
            for cols in _searched(texts, least):
                rows = b.slice(at, len(cols[0]))
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(len(given))], *cols], names)
                at += len(cols[0])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.select(*[f"`{c}`" for c in given]).dtypes], f"`{names[-3]}` bigint", f"`{names[-2]}` array<struct<start: bigint, length: bigint, period: bigint>>", f"`{names[-1]}` string"])
    return docs.select(*[f"`{c}`" for c in given], "text").mapInArrow(run, schema)


def fold_tails(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """Texts of every tenth id by crc32, given a periodic tail; a null id changes nothing.

    With h = crc32 of the id in decimal, g = h // 10 and n words, where 10 divides h each word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    import zlib

    hashes = [None if x is None else zlib.crc32(str(x).encode()) for x in ids.to_pylist()]
    chosen = np.array([h is not None and h % 10 == 0 for h in hashes], bool)
    if not chosen.any():
        return texts
    words, off = split_words(texts.filter(pa.array(chosen)))
    at = np.arange(len(words))
    for i, h in enumerate(h for h, c in zip(hashes, chosen) if c):
        n, g = int(off[i + 1] - off[i]), h // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[off[i] + a : off[i + 1]] = off[i] + a + np.arange(n - a) % p
    folded = pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), words.take(pa.array(at))), " ")
    return pc.replace_with_mask(texts, pa.array(chosen), folded)
