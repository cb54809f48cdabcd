"""Quality classifier: histogram gradient-boosted trees over document statistics.

`train(docs, labels)` fits a small ensemble by binned Newton boosting on a bounded
sample of labelled rows; `score(docs, model)` computes the same statistics for
every whole text in Arrow batches and walks all trees at once, flattened into
arrays (feature, threshold, leaf), in numpy.

Inputs are statistics of the text alone: never labels, language, source or id.

Defined cases: null text counts as empty; an empty text has all statistics 0 and
is scored like any other; labels that are null are not learnt from; without
labelled rows, or with one class only, the model is the class's share (0.5 if
there is none); repeated rows get equal scores; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import hash_bound
from .textkit import SEGMENT, WordTable, unique_by_document, utf8, word_hashes

#: Labelled rows that a fit sees at most (in expectation: rows are picked by a hash of their id).
MAX_LABELLED = 20_000

#: Byte classes counted in each text.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n",
    "stop": b".", "comma": b",;:", "shout": b"!", "ask": b"?", "odd": b"#$%&*@^~+=<>{}[]\\/_`", "pipe": b"|", "quote": b"\"'()-",
}
FEATURES = [*CLASSES, "other_byte", "log_bytes", "log_words", "word_length", "words_per_line", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "words_per_stop", "odd_word_end", "upper_word"]

_WORDS, _LINES = WordTable(), WordTable()
_LINES.word = np.ones(256, bool)
_LINES.word[10] = False
_LINES.values = _LINES.values.copy()
_LINES.values[32] = np.uint64(0x1234567)

_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _i


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for every text."""
    buf, off = utf8(texts)
    n, kinds = len(off) - 1, len(CLASSES) + 1
    counts = np.zeros((n, kinds))
    ends = np.zeros((n, 2))  # words that end in an odd byte; words of capitals alone (two or more)
    of = lambda at: np.searchsorted(off, at, "right") - 1
    for a in range(0, len(buf), SEGMENT):
        b = min(len(buf), a + SEGMENT)
        lo, hi = of(a), of(b - 1)
        doc = np.repeat(np.arange(lo, hi + 1), np.diff(np.clip(off[lo : hi + 2], a, b)))
        kind = _CLASS[buf[a:b]]
        counts[lo : hi + 1] += np.bincount((doc - lo) * kinds + kind, minlength=(hi - lo + 1) * kinds).reshape(-1, kinds)
        solid = (kind != 3) & (kind != 4)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        ends[lo : hi + 1, 0] += np.bincount(doc[last & ((kind == 9) | (kind == 7) | (kind == 10))] - lo, minlength=hi - lo + 1)
        pair = np.zeros(b - a, bool)
        pair[1:] = (kind[1:] == 0) & (kind[:-1] == 0)
        ends[lo : hi + 1, 1] += np.bincount(doc[pair] - lo, minlength=hi - lo + 1)
    size = np.diff(off).astype(float)
    words, woff = word_hashes(texts, _WORDS)
    lines, loff = word_hashes(texts, _LINES)
    nw, nl = np.diff(woff).astype(float), np.diff(loff).astype(float)
    at = np.maximum(nw, 1)
    distinct = np.diff(unique_by_document(words, woff)[1])
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words[:0]
    pdoc = np.repeat(np.arange(n), np.diff(woff))
    within = pdoc[:-1] == pdoc[1:] if len(words) > 1 else np.empty(0, bool)
    poff = np.concatenate(([0], np.cumsum(np.maximum(np.diff(woff) - 1, 0))))
    dpairs = np.diff(unique_by_document(pairs[within], poff)[1])
    top = _top_share(words, woff)
    dlines = np.diff(unique_by_document(lines, loff)[1])
    share = counts / np.maximum(size, 1)[:, None]
    letters = size - counts[:, 3] - counts[:, 4]
    rest = [
        np.log1p(size), np.log1p(nw), letters / at, nw / np.maximum(nl, 1), distinct / at, top, dpairs / np.maximum(nw - 1, 1),
        dlines / np.maximum(nl, 1), nw / (counts[:, 5] + 1), ends[:, 0] / at, ends[:, 1] / np.maximum(size, 1),
    ]
    return np.column_stack([share, *rest])


def _top_share(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of the most frequent word."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])))) if len(w) else np.empty(0, int)
    runs = np.diff(np.concatenate((first, [len(w)])))
    top = np.zeros(len(off) - 1)
    np.maximum.at(top, d[first], runs)
    return top / np.maximum(np.diff(off), 1)


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i+1 and 2i+2."""

    base: float
    depth: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(self.depth):
                f, t = self.feature[trees, node], self.threshold[trees, node]
                node = 2 * node + 1 + (np.take_along_axis(rows, f, axis=1) > t)
            total[a : a + 4096] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Newton boosting on binned features for 0/1 labels."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return Trees(float(np.log(p / (1 - p))))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])  # bin > b means x > edges[b]
    model = Trees(float(np.log(y.mean() / (1 - y.mean()))), depth, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    raw = np.full(n, model.base)
    usable = np.zeros((m, bins), bool)
    for j in range(m):
        usable[j, : len(edges[j])] = True
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            local = node - (width - 1)
            key = (local[:, None] * m + np.arange(m)) * bins + binned
            size = width * m * bins
            G = np.bincount(key.ravel(), np.repeat(g, m), size).reshape(width, m, bins).cumsum(2)
            H = np.bincount(key.ravel(), np.repeat(h, m), size).reshape(width, m, bins).cumsum(2)
            C = np.bincount(key.ravel(), minlength=size).reshape(width, m, bins).cumsum(2)
            tg, th, tc = G[:, :1, -1:], H[:, :1, -1:], C[:, :1, -1:]
            gain = G**2 / (H + ridge) + (tg - G) ** 2 / (th - H + ridge) - tg**2 / (th + ridge)
            gain = np.where(usable & (C >= least) & (tc - C >= least), gain, 0.0).reshape(width, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(width), best] > 1e-9):
                j, b = divmod(int(best[k]), bins)
                model.feature[t, width - 1 + k], model.threshold[t, width - 1 + k] = j, edges[j][b]
            f, th_ = model.feature[t, node], model.threshold[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > th_)
        leaf = node - (2**depth - 1)
        G, H = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        model.leaf[t] = -rate * G / (H + ridge)
        raw += model.leaf[t, leaf]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from the fit."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Fits on labelled documents that are not held out, at most about max_labelled, picked by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.xxhash64(F.lit(3), "label_id") < hash_bound(n, max_labelled))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("label_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label_id", "y", "x"])

    got = rows.mapInArrow(run, "label_id bigint, y int, x array<double>").collect()  # bounded: a row of numbers for each labelled document
    got.sort(key=lambda r: (r.label_id, r.y, r.x))
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs, all columns, with quality_score appended; a column of that name is replaced."""
    name = "quality_score"
    docs = docs.select(*[c for c in docs.columns if c.lower() != name])
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.predict(statistics(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score is below least."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.predict(statistics(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)
