"""Removal of repeated passages of words: seed and extend.

A window is LENGTH consecutive words of one document.  Every word is removed that a window covers whose
words also start in a document with a smaller id.  Windows are judged on the input; overlaps count.

1. Seeds.  A window is known by the least hash among its stretches of SEED words (of equal ones the last),
   the winnowed anchor: equal windows have it at the same place.  The windows of one anchor form a piece of at most
   LENGTH - SEED + 1 windows.  Documents are joined on the hashes of their anchors; anchors that one id has alone end here.
2. Whole extension.  Pieces that are equal to both ends are one class, known by 128 bits.  All its documents
   but that of the least id lose the whole piece; that one stands for the class.
3. Extension word by word.  The classes of an anchor are extended to the left and to the right, one word at a time, as
   long as words agree: after each word the classes that still agree share a number.  A window that reaches i words to
   the left repeats where both numbers, left after i and right after the rest, are shared with a smaller id.
   No pairs are listed, so the work grows with the number of classes.
4. Windows that hit are joined to maximal stretches, and the words outside them are kept.

An anchor with more than MOST classes, however many, isn't held in one task: its windows are told apart by their
128-bit keys, of which Spark aggregates the least id.  Texts travel once, into a bucketed table that is read twice.

Defined cases: null text has no words; texts under LENGTH words lose nothing; a null id comes before all others; rows
that repeat an id are not smaller than each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .periodic import split_words
from .session import kept, release, shared_folder
from .textkit import mix64, stream

LENGTH, SEED = 50, 12
#: Windows of a piece at most (below 64: their hits are the bits of a long).
REACH = LENGTH - SEED + 1
#: Words handled together, classes of an anchor that one task extends, rows that it extends together.
SPAN, MOST, TOGETHER = 1 << 18, 20_000, 40_000

_VALUE, _GRAM = stream(256, 41), stream(SEED, 43) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.empty(0, np.uint8)
    out, i = np.empty(len(words), np.uint64), 0
    while i < len(words):
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
        own = off[i : j + 1] - off[i]
        v = _VALUE[data[off[i] : off[j]]]
        v *= _powers(0, int(np.diff(own).max()))[0][np.arange(own[-1]) - np.repeat(own[:-1], np.diff(own))]
        out[i:j] = mix64(np.add.reduceat(v, own[:-1]))
        i = j
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, computed once in a process."""
    if which not in _TABLES or len(_TABLES[which][0]) < n:
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(max(n, SPAN), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _TABLES[which] = out[0], out[1]
    return _TABLES[which]


def keys_of(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of stretches of words, by running sums."""
    out = []
    for which in (0, 1):
        powers, inverse = _powers(which, len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(which)) * powers[: len(h)])))
        out.append(mix64((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64)))
    return out[0], out[1]


def anchors(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a batch of texts: (start of the first window, windows, place of the anchor in the piece, its hash)."""
    n = len(h)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    gram = h[: n - SEED + 1] * _GRAM[0]
    for i in range(1, SEED):
        gram += h[i : n - SEED + 1 + i] * _GRAM[i]
    gram, at, have = mix64(gram), np.arange(n - SEED + 1), 1
    while have < REACH:  # the least of 2, 4, 8, ... neighbours, the later of equal ones
        more = min(have, REACH - have)
        right = gram[more:] <= gram[:-more]
        gram, at = np.where(right, gram[more:], gram[:-more]), np.where(right, at[more:], at[:-more])
        have += more
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= off[doc + 1]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    size = np.add.reduceat(inside.astype(np.int64), first)
    return first, size, at[first] - first, gram[first]


def _groups(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts that are handled together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SPAN, "right")) - 1)
        yield i, j
        i = j


# ------------------------------------------------------------- extension by words


def extended(seed: np.ndarray, ids: np.ndarray, size: np.ndarray, place: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """For each piece, a bit for each window that a piece of the same seed and a smaller id also has.

    words: the words of each piece as numbers; place: of its anchor; size: its windows.
    """
    m = len(seed)
    flat, lens = np.concatenate(words), np.array([len(w) for w in words])
    _, flat = np.unique(flat, return_inverse=True)
    first, bound = np.cumsum(lens) - lens, int(flat.max()) + 1 + m
    _, group = np.unique(seed, return_inverse=True)
    rows = np.arange(m)

    def sides(step: int, edge: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
        """Numbers of the classes that agree on 0, 1, 2, ... words from edge on; a piece that ends agrees with none."""
        out = [group]
        for i in range(REACH - 1):
            here = i < room
            word = np.where(here, flat[np.clip(first + edge + step * i, 0, len(flat) - 1)], bound - m + rows)
            out.append(np.unique(out[-1] * bound + word, return_inverse=True)[1])
        return out

    left = sides(-1, place - 1, place)
    right = sides(1, place + SEED, lens - place - SEED)
    hits = np.zeros(m, np.int64)
    for reach in range(REACH):
        window = place - reach
        own = np.flatnonzero((window >= 0) & (window < size))
        if len(own):
            _, shared = np.unique(left[reach][own] * m + right[REACH - 1 - reach][own], return_inverse=True)
            least = np.full(int(shared.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, shared, ids[own])
            hit = own[least[shared] < ids[own]]
            hits[hit] |= np.int64(1) << window[hit]
    return hits


# -------------------------------------------------------------------------- the job


def _identified(docs: DataFrame) -> DataFrame:
    """id (null first), rid (a hash of the text) and doc_id, text: id and rid know a row, up to equal rows."""
    lowest = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), F.xxhash64("text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _pieces(docs: DataFrame) -> DataFrame:
    """id, rid, and of each distinct piece of the text: seed, one, two (its keys), size, place and ats (where it stands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, off = split_words(b.column(2))
            for i, j in _groups(off):
                own = off[i : j + 1] - off[i]
                if own[-1] < LENGTH:
                    continue
                h = hashed(words.slice(off[i], own[-1]))
                at, size, place, seed = anchors(h, own)
                if not len(at):
                    continue
                one, two = keys_of(h, at, size + LENGTH - 1)
                doc = np.searchsorted(own, at, "right") - 1
                order = np.lexsort((at, two, one, seed, doc))
                at, size, place, seed, one, two, doc = (x[order] for x in (at, size, place, seed, one, two, doc))
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                lead = np.flatnonzero(new)
                ats = pa.ListArray.from_arrays(pa.array(np.append(lead, len(at)).astype(np.int32)), pa.array((at - own[doc]).astype(np.int32)))
                row = pa.array(doc[lead] + i)
                cols = [b.column(0).take(row), b.column(1).take(row), *[pa.array(x[lead].view(np.int64)) for x in (seed, one, two)], *[pa.array(x[lead].astype(np.int32)) for x in (size, place)], ats]
                yield pa.RecordBatch.from_arrays(cols, ["id", "rid", "seed", "one", "two", "size", "place", "ats"])

    return docs.select("id", "rid", "text").mapInArrow(run, "id bigint, rid bigint, seed bigint, one bigint, two bigint, size int, place int, ats array<int>")


def _marks(pieces: DataFrame, most: int) -> DataFrame:
    """By row (id, rid): the pieces that others have, or may share windows with, and what is to be done with them.

    kind 0: a smaller id has the whole piece; 1: its windows are to be compared; 2: the same, for an anchor with many classes.
    """
    class_ = ["seed", "one", "two"]
    # aggregates are written before they are joined: only then Spark may split a key that very many pieces have
    seeds = kept(pieces.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select(F.col("seed").alias("s")), "seeds")
    joined = kept(pieces.join(seeds, F.col("seed") == F.col("s")).drop("s"), "joined")
    classes = kept(joined.groupBy(*class_).agg(F.min("id").alias("lead"), F.max("id").alias("last")), "classes")
    many = kept(classes.groupBy(F.col("seed").alias("s")).agg(F.count("*").alias("n")), "many")
    fate = classes.join(many, F.col("seed") == F.col("s")).filter("n > 1 or lead < last").select(*[F.col(c).alias(f"c_{c}") for c in class_], "lead", "n")
    met = joined.join(fate, [F.col(c) == F.col(f"c_{c}") for c in class_]).filter("id > lead or n > 1")
    kind = F.when(F.col("id") > F.col("lead"), 0).when(F.col("n") <= most, 1).otherwise(2)
    out = met.select("id", "rid", F.struct(kind.alias("kind"), "seed", "size", "place", "ats").alias("mark"))
    return out.groupBy("id", "rid").agg(F.collect_set("mark").alias("marks"))


_NEXT = "seed bigint, id bigint, rid bigint, at int, size int, place int, words binary"


def _contested(texts: DataFrame, kind: int) -> DataFrame:
    """The marked pieces of one kind, with the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(i, [m for m in marks or () if m["kind"] == kind]) for i, marks in enumerate(b.column(3).to_pylist())]
            some = [(i, marks) for i, marks in some if marks]
            ids, rids, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, marks in some:
                h = hashed(split_words(b.column(2).slice(i, 1))[0])
                for m in marks:
                    at = m["ats"][0]
                    rows.append((m["seed"], ids[i], rids[i], at, m["size"], m["place"], h[at : at + m["size"] + LENGTH - 1].tobytes()))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _NEXT.split(", ")])

    return texts.filter(F.exists("marks", lambda m: m["kind"] == kind)).select("id", "rid", "text", F.filter("marks", lambda m: m["kind"] == kind).alias("own")).mapInArrow(run, _NEXT)


_HITS = "id bigint, rid bigint, at int, hits bigint"


def _by_words(pieces: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Hits of pieces whose anchors have few classes: whole anchors are extended together in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(7)]

        def done(n: int) -> pa.RecordBatch:
            seed, ids, rid, at, size, place, words = (c[:n] for c in held)
            hits = extended(np.array(seed), np.array(ids), np.array(size), np.array(place), [np.frombuffer(w, np.uint64) for w in words])
            for c in held:
                del c[:n]
            hit = np.flatnonzero(hits)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for i in hit], k) for x, k in ((ids, pa.int64()), (rid, pa.int64()), (at, pa.int32()))] + [pa.array(hits[hit])], ["id", "rid", "at", "hits"])

        for b in batches:
            for c, x in zip(held, b.columns):
                c += x.to_pylist()
            while len(held[0]) >= together:  # the last anchor may go on in the next batch
                n = together
                while n and held[0][n - 1] == held[0][-1]:
                    n -= 1
                if not n:
                    break
                while held[0][n - 1] == held[0][n]:
                    n += 1
                yield done(n)
        if held[0]:
            yield done(len(held[0]))

    return pieces.repartition("seed").sortWithinPartitions("seed").mapInArrow(run, _HITS)


def _by_keys(pieces: DataFrame) -> DataFrame:
    """Hits of pieces whose anchors have very many classes: windows by their keys, least ids by aggregates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64)
            size = b.column(4).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            window = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            first = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
            one, two = keys_of(h, first[row] + window, np.full(len(row), LENGTH))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in (1, 2, 3)], pa.array(np.int64(1) << window), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "rid", "at", "bit", "one", "two"])

    windows = kept(pieces.mapInArrow(run, "id bigint, rid bigint, at int, bit bigint, one bigint, two bigint"), "windows")
    least = windows.groupBy(F.col("one").alias("o"), F.col("two").alias("t")).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    return windows.join(least, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).filter("lo < id").groupBy("id", "rid", "at").agg(F.bit_or("bit").alias("hits"))


RESULT = "doc_id bigint, n_words bigint, removed array<struct<start: bigint, end: bigint>>, kept string"


def _cut(texts: DataFrame) -> DataFrame:
    """The words of each text outside its hits, and the stretches that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_words, all_off = split_words(b.column(1))
            marks, hits = b.column(2), b.column(3)
            for i, j in _groups(all_off):
                words, off = all_words.slice(all_off[i], all_off[j] - all_off[i]), all_off[i : j + 1] - all_off[i]
                edges = np.zeros(off[-1] + 1, np.int64)
                for k in range(i, j):
                    own = {h["at"]: h["hits"] for h in hits[k].as_py() or ()}
                    for m in marks[k].as_py() or ():
                        ats = np.array(m["ats"]) + off[k - i]
                        bits = own.get(m["ats"][0], 0)
                        if m["kind"] == 0:
                            spans = [(0, m["size"])]
                        else:
                            spans, text = [], f"{bits:b}"[::-1] if bits else ""
                            s = text.find("1")
                            while s >= 0:
                                e = text.find("0", s)
                                e = len(text) if e < 0 else e
                                spans.append((s, e))
                                s = text.find("1", e)
                        for s, e in spans:
                            np.add.at(edges, ats + s, 1)
                            np.add.at(edges, ats + e + LENGTH - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                doc = np.repeat(np.arange(j - i), np.diff(off))
                start, end = gone.copy(), gone.copy()
                start[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
                end[:-1] &= ~gone[1:] | (doc[1:] != doc[:-1])
                start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
                of = np.searchsorted(off, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start - off[of]), pa.array(end - off[of])], ["start", "end"])
                bounds = np.searchsorted(of, np.arange(j - i + 1)).astype(np.int32)
                left = np.concatenate(([0], np.cumsum(~gone)))[off].astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(~gone))), " ")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(bounds), spans), text], ["doc_id", "n_words", "removed", "kept"])

    return texts.mapInArrow(run, RESULT)


def remove(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_words, removed (maximal stretches of words, end exclusive) and kept (the other words, joined by one space).

    most: classes of one anchor that a task extends; beyond, windows are told apart by keys, with the same result.
    """
    spark, name = docs.sparkSession, f"passages_{uuid.uuid4().hex}"
    rows, parts = _identified(docs), int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = kept(_marks(kept(_pieces(rows), "pieces"), most), "marks")
    release(spark)
    marked = rows.join(marks.withColumnsRenamed({"id": "i", "rid": "r"}), (F.col("id") == F.col("i")) & (F.col("rid") == F.col("r")), "left").drop("i", "r")
    marked.write.bucketBy(parts, "id", "rid").option("compression", "zstd").option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name)
    release(spark)
    try:
        texts = spark.table(name)
        hits = _by_words(_contested(texts, 1)).unionByName(_by_keys(_contested(texts, 2)))
        hits = kept(hits.groupBy(F.col("id").alias("i"), F.col("rid").alias("r")).agg(F.collect_set(F.struct("at", "hits")).alias("hits")), "hits")
        release(spark)
        cut = _cut(texts.join(hits, (F.col("id") == F.col("i")) & (F.col("rid") == F.col("r")), "left").select("doc_id", "text", "marks", "hits"))
        return kept(cut, "passages")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
