"""Benchmark decontamination by size-partitioned MinHash containment search.

`leaks(docs, items)` finds every (document, item) where the document holds at
least `threshold` of the item's distinct five-word shingles.  Words are
lower-cased runs of letters, digits and non-ASCII characters, so case,
punctuation and spacing do not hide a passage.

Why plain MinHash fails here: a 30-shingle item inside a 20,000-shingle document
has Jaccard similarity 0.0015.  So the search is partitioned by size: items
fall in classes of (W/2, W] shingles, and for each class a document's shingle
sequence is cut into pieces of W.  For b hash functions the expected number of
equal minima, summed over all pieces, is at least b * threshold * q / (q + W)
>= b * threshold / 3 wherever the item's shingles lie, scattered or not; with b = 64 and
0.8 a true pair is missed with probability below exp(-17).  Candidates are then
verified by exact containment of the item's shingles in the whole document.

The items are the query set.  They are taken in blocks of bounded size; a block
travels to the tasks, documents are read once for each block and never shuffled.

Defined cases: null and wordless items or documents match nothing; an item of
fewer than five words is one shingle, its whole sequence, looked for in the
document's runs of that length; repeated item ids are separate rows; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import WordTable, shingle_hashes, stream, word_hashes

K, THRESHOLD, HASHES = 5, 0.8, 64
#: Characters and rows of items in one block.
BLOCK_CHARS, BLOCK_ITEMS = 16_000_000, 20_000
#: Shingles hashed at once.
PIECE = 1 << 15

WORD = re.compile(r"[^\x00-/:-`{-\x7f]+")
FOUND = "doc_id bigint, item_id bigint, n_item bigint, n_found bigint, containment double"
_TABLE = WordTable(alnum_only=True)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingle_set(words: list[str], k: int = K) -> set[tuple[str, ...]]:
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def _hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(pa.array(texts, pa.large_string()), _TABLE)


class ItemBlock:
    """The sketch of one block of items, as the tasks use it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []  # (item_id, k, shingle set)
        by_size: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            s = shingle_set(words_of(text))
            if s:
                k = len(next(iter(s)))
                by_size[k, 1 << (len(s) - 1).bit_length()].append(len(self.items))
                self.items.append((item_id, k, s))
        mult = stream(HASHES, 5) | np.uint64(1)
        self.sketches = {}  # k -> width -> for each hash function (sorted minima, item indexes)
        for (k, width), which in sorted(by_size.items()):
            minima = np.empty((len(which), HASHES), np.uint64)
            for r, i in enumerate(which):
                words, off = _hash_words([" ".join(t) for t in self.items[i][2]])
                h, _ = shingle_hashes(words, off, k)
                minima[r] = (h[:, None] * mult).min(axis=0)
            order = np.argsort(minima, axis=0, kind="stable")
            tables = [(minima[order[:, j], j], np.array(which)[order[:, j]]) for j in range(HASHES)]
            seen = np.zeros((HASHES, 1 << 16), bool)  # quick test by the low bits
            for j in range(HASHES):
                seen[j, (tables[j][0] & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.sketches.setdefault(k, {})[width] = (tables, seen)

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text index, item index) pairs that agree on a minimum."""
        out: set[tuple[int, int]] = set()
        words, off = _hash_words(texts)
        mult = stream(HASHES, 5) | np.uint64(1)
        for k, widths in self.sketches.items():
            sh, so = shingle_hashes(words, off, k, short=False)
            counts = np.diff(so)
            if not len(sh):
                continue
            narrow = min(widths)
            pieces = -(-counts // narrow)
            doc = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = so[doc] + nth * narrow
            minima = np.empty((len(doc), HASHES), np.uint64)
            per = max(1, PIECE // narrow)
            for a in range(0, len(doc), per):  # pieces a..b of the shingles
                b = min(len(doc), a + per)
                lo, hi = start[a], start[b] if b < len(doc) else len(sh)
                for j in range(HASHES):
                    minima[a:b, j] = np.minimum.reduceat(sh[lo:hi] * mult[j], start[a:b] - lo)
            for width in sorted(widths):
                if width > narrow:  # a wide piece is some narrow ones
                    wide = nth // (width // narrow)
                    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (wide[1:] != wide[:-1]))))
                    m, d = np.minimum.reduceat(minima, first, axis=0), doc[first]
                else:
                    m, d = minima, doc
                tables, seen = widths[width]
                for j in range(HASHES):
                    col = m[:, j]
                    maybe = np.flatnonzero(seen[j, (col & np.uint64(0xFFFF)).astype(np.int64)])
                    if len(maybe):
                        keys, items = tables[j]
                        lo, hi = np.searchsorted(keys, col[maybe], "left"), np.searchsorted(keys, col[maybe], "right")
                        for p, x, y in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo]):
                            out.update((int(d[p]), int(i)) for i in items[x:y])
        return out

    def verified(self, texts: list[str], threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(text index, item_id, n_item, n_found) by exact containment."""
        by_text = defaultdict(list)
        for t, i in self.candidates(texts):
            by_text[t].append(i)
        for t, which in sorted(by_text.items()):
            words = words_of(texts[t])
            sets = {k: shingle_set(words, k) for k in {self.items[i][1] for i in which}}
            for i in sorted(which):
                item_id, k, s = self.items[i]
                found = len(s & sets[k]) if len(words) >= k else 0
                if found >= threshold * len(s) - 1e-9:
                    yield t, item_id, len(s), found


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, read one after the other; at most one block is on the driver."""
    block, chars = [], 0
    for r in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        block.append((r.item_id, r.text))
        chars += len(r.text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment of every match."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    out = spark.createDataFrame([], FOUND)
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made = ItemBlock(sent.value)
            for b in batches:
                ids, texts = b.column(0).to_pylist(), [t.lower() for t in b.column(1).to_pylist()]
                hits = list(made.verified(texts, threshold))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[t] for t, *_ in hits], pa.int64()),
                        pa.array([i for _, i, _, _ in hits], pa.int64()),
                        pa.array([n for *_, n, _ in hits], pa.int64()),
                        pa.array([f for *_, f in hits], pa.int64()),
                        pa.array([f / n for *_, n, f in hits], pa.float64()),
                    ],
                    [c.split()[0] for c in FOUND.split(", ")],
                )

        out = out.unionByName(rows.mapInArrow(run, FOUND))
    return out


def drop_leaky(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows whose text holds a benchmark item; nothing is shuffled."""
    at = docs.columns.index("text")
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            made = ItemBlock(sent.value)
            for b in batches:
                texts = [(t or "").lower() for t in b.column(at).to_pylist()]
                bad = {t for t, *_ in made.verified(texts, threshold)}
                yield b.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
