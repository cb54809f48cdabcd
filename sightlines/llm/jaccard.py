"""N-gram Jaccard join: size-aware, heavy and light.

Two documents link when the Jaccard similarity of their sets of distinct word
shingles is at least `percent` / 100.  `link(docs)` gives every document its set
size and component, and `links` the verified edges between different sets.

Documents with equal sets are one node.  Let a set of n shingles be allowed to
miss d(n) = n - ceil(n * percent / 100) of them.

* Light: for sets of at most B shingles all subsets that miss at most d(n) are
  enumerated.  Two light sets link exactly if they share such a subset of enough
  size, so the smallest set of each subset's list, linked with the others, keeps
  all connections.  Subsets are known by 128 bits.
* Heavy: other sets go to inverted lists.  Shingles are dealt by hash; a
  shingle in one set only cannot be shared, so a set whose shared shingles are
  fewer than percent of all is dropped.  The rest are ordered rarest first and
  a set enters the lists of its first d(n) + 1 shingles, unshared ones counted first.
  Two sets that link meet in such a list.  In each list, the set with the fewest unshared
  shingles is held against all others.  Then come those pairs of a list that are still in different components and that size,
  unshared shingles and positions do not rule out.  A list is split by a second common shingle
  (two sets that link share two of their first d(n) + 2), a third and a fourth, where that
  is less work than its pairs.
  Every pair is verified by exact intersection.
* The boundary B minimises the estimated cost over the sizes that occur; sets just
  below it take part in both ways, so that light-heavy pairs meet too.

Defined cases: null, empty and blank texts have an empty set and link with
nothing; a text of fewer than k words has its whole sequence as one shingle;
repeated rows are copies of each other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .session import fresh, kept, row_key
from .textkit import WordTable, mix64, shingle_hashes, unique_by_document, word_hashes

#: Largest set that the light way is considered for; copies that a task remembers.
LIGHT_MOST, SEEN_MOST = 26, 2_000_000
#: Pairs that one entry of longer lists has to save, most common shingles of a list.
SPLIT_GAIN, DEEPEST = 64, 4
#: Shingles of a bucket (16 bytes each), of which a worker holds one at a time.
BUCKET_SHINGLES = 1 << 24

_WORDS = WordTable()


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and offsets."""
    return unique_by_document(*shingle_hashes(*word_hashes(texts, _WORDS), k))


def set_keys(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set's content, 0 for empty ones."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = mix64(np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5A5A5)), off[full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def missing(n: np.ndarray | int, percent: int):
    """d(n): how many of its shingles a set of n may lack in another that it links with."""
    return n - -(-n * percent // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, i) for i in range(missing(n, percent) + 1))


def boundary(counts: dict[int, int], percent: int) -> int:
    """B: the size up to which enumerating subsets costs less than lists.

    A light set costs its subsets; a heavy one its shingles, and its list
    entries times what verifying one candidate reads.
    """
    light = lambda n: subset_count(n, percent)
    heavy = lambda n: n + (missing(n, percent) + 1) * 2 * n

    def cost(b: int) -> int:
        both = b + 1 - missing(b + 1, percent)  # sizes from here on are in lists as well
        return sum(c * (light(n) * (n <= b) + heavy(n) * (n >= both)) for n, c in counts.items())

    return min(range(0, LIGHT_MOST + 1), key=cost)


def _arrow(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names)


def members(docs: DataFrame, k: int) -> DataFrame:
    """Columns of docs but text, and key, n; small: the set itself where it has at most LIGHT_MOST shingles."""
    given = [c for c in docs.columns if c != "text"]
    names = [*given, "key", "n", "small"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, off = shingle_sets(b.column(len(given)), k)
            n, keys = np.diff(off), set_keys(sets, off)
            small = [sets[off[i] : off[i + 1]].view(np.int64) if 0 < c <= LIGHT_MOST else None for i, c in enumerate(n.tolist())]
            yield _arrow(names, [*[b.column(i) for i in range(len(given))], pa.array(keys), pa.array(n), pa.array(small, pa.list_(pa.int64()))])

    schema = ", ".join(f"{c} {t}" for c, t in docs.select(*given).dtypes)
    return docs.select(*given, "text").mapInArrow(run, f"{schema}, key bigint, n bigint, small array<bigint>")


# ------------------------------------------------------------------------ light


def light_edges(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Edges (a, b) among distinct sets (key, n, small) of at most `most` shingles."""

    names = ["key", "subset", "subset2", "s"]

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[int]] = [[], [], [], []]
        take = lambda: _arrow(names, [pa.array(r, pa.int64()) for r in rows])
        for b in batches:
            for key, small in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = mix64(np.array(small, np.int64).view(np.uint64))
                both = np.stack([v, mix64(v ^ np.uint64(0x3C3C3C3C3C3C3C3C))], axis=1)  # 128 bits a shingle
                whole = both.sum(0)
                for d in range(missing(len(v), percent) + 1):
                    for out in itertools.combinations(range(len(v)), d):
                        one, two = (whole - both[list(out)].sum(0, dtype=np.uint64)).view(np.int64).tolist()
                        for col, x in zip(rows, (key, one, two, len(v) - d)):
                            col.append(x)
                if len(rows[0]) > 100_000:
                    yield take()
                    rows = [[], [], [], []]
        yield take()

    few = sets.filter(F.col("n").between(1, most))
    listed = few.select("key", "small").mapInArrow(subsets, ", ".join(f"{c} bigint" for c in names)).join(few.select("key", "n"), "key")
    first = F.min(F.struct("n", "key")).over(Window.partitionBy("subset", "subset2", "s"))
    star = listed.withColumn("f", first).filter("f.key <> key")
    return star.filter(F.col("s") * 100 >= (F.col("n") + F.col("f.n") - F.col("s")) * percent).select(F.col("f.key").alias("a"), F.col("key").alias("b"))


# ------------------------------------------------------------------------ heavy


def _pack(bucket: np.ndarray, cols: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns of each bucket, as bytes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else np.empty(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[a]]), [c[order[a:b]].tobytes() for c in cols]


def _grouped(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Joins the packed columns of each bucket; rows come sorted by bucket."""
    now, parts = None, [[] for _ in kinds]
    for b in batches:
        for i, bucket in enumerate(b.column(0).to_pylist()):
            if bucket != now and now is not None:
                yield now, [np.frombuffer(b"".join(p), t) for p, t in zip(parts, kinds)]
                parts = [[] for _ in kinds]
            now = bucket
            for j in range(len(kinds)):
                parts[j].append(b.column(j + 1)[i].as_py())
    if now is not None:
        yield now, [np.frombuffer(b"".join(p), t) for p, t in zip(parts, kinds)]


def _rows(names: list[str], packed: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    return _arrow(names, [pa.array([p[0] for p in packed], pa.int32()), *[pa.array([p[1][j] for p in packed], pa.binary()) for j in range(len(names) - 1)]])


_LISTED, _SHARED = ["bucket", "nodes", "toks", "m_nodes", "m_n"], ["bucket", "nodes", "toks", "df", "m_nodes", "m_n"]
_I8, _U8, _I4 = np.int64, np.uint64, np.int32


def n_buckets(parts: int, shingles: int) -> int:
    """A power of two: as many buckets as partitions, and one for each BUCKET_SHINGLES, at least."""
    buckets = 64
    while buckets < max(parts, shingles // BUCKET_SHINGLES):
        buckets *= 2
    return buckets


def heavy_sets(docs: DataFrame, k: int, percent: int, least: int, shingles: int) -> DataFrame:
    """key, n, alone (shingles in no other set), toks (the others), prefix (struct(tok, at)) of every set that can link.

    Shingles travel packed by bucket: to the bucket of their hash, where those of
    one set only fall out, and on to the bucket of their set.  A worker holds one bucket, whose size does not grow with the input
    (shingles: how many all texts have).
    """
    mask = np.uint64(n_buckets(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles) - 1)
    home = lambda node: ((node.view(_U8) >> np.uint64(20)) & mask).astype(_I4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets, off = shingle_sets(b.column(0), k)
            n, keys = np.diff(off), set_keys(sets, off)
            fresh = np.zeros(len(n), bool)
            for i in np.flatnonzero(n >= least).tolist():
                key = int(keys[i])
                if key not in seen:
                    fresh[i] = True
                    if len(seen) < SEEN_MOST:
                        seen.add(key)
            tok, node = sets[np.repeat(fresh, n)], np.repeat(keys[fresh], n[fresh])
            none = b""
            packed = [(x, [*cols, none, none]) for x, cols in _pack((tok & mask).astype(_I4), [node, tok])]
            packed += [(x, [none, none, *cols]) for x, cols in _pack(home(keys[fresh]), [keys[fresh], n[fresh].astype(_I4)])]
            yield _rows(_LISTED, packed)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (node, tok, m_node, m_n) in _grouped(batches, [_I8, _U8, _I8, _I4]):
            order = np.lexsort((node, tok))
            node, tok = node[order], tok[order]
            own = np.ones(len(tok), bool)  # a set may come from several tasks
            own[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            node, tok = node[own], tok[own]
            first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.empty(0, int)
            df = np.repeat(np.diff(np.append(first, len(tok))), np.diff(np.append(first, len(tok))))
            two = df >= 2
            packed = [(x, [*cols, b"", b""]) for x, cols in _pack(home(node[two]), [node[two], tok[two], df[two].astype(_I4)])]
            yield _rows(_SHARED, [*packed, (bucket, [b"", b"", b"", m_node.tobytes(), m_n.tobytes()])])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n", "alone", "toks", "prefix"]
        kind = pa.list_(pa.struct([("tok", pa.int64()), ("at", pa.int64())]))
        for _, (node, tok, df, m_node, m_n) in _grouped(batches, [_I8, _U8, _I4, _I8, _I4]):
            ids, first = np.unique(m_node, return_index=True)
            size = m_n[first].astype(np.int64)
            count = np.bincount(np.searchsorted(ids, node), minlength=len(ids))
            can = np.flatnonzero(count * 100 >= size * percent)
            keep = np.isin(node, ids[can])
            node, tok, df = node[keep], tok[keep], df[keep]
            order = np.lexsort((tok, df, node))
            node, tok = node[order], tok[order].view(np.int64)
            start = np.searchsorted(node, ids[can], "left")
            out = []
            for i, a in zip(can.tolist(), start.tolist()):
                c, n = int(count[i]), int(size[i])
                alone, own = n - c, tok[a : a + c]
                lists = max(0, int(missing(n, percent)) + 1 - alone)
                out.append((int(ids[i]), n, alone, own, [{"tok": int(t), "at": alone + j} for j, t in enumerate(own[:lists])]))
                if len(out) >= 500:
                    yield _arrow(names, [*[pa.array([o[j] for o in out], pa.int64()) for j in range(3)], pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[4] for o in out], kind)])
                    out = []
            if out:
                yield _arrow(names, [*[pa.array([o[j] for o in out], pa.int64()) for j in range(3)], pa.array([o[3] for o in out], pa.list_(pa.int64())), pa.array([o[4] for o in out], kind)])

    kind = ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in _LISTED)
    dealt = docs.select("text").mapInArrow(deal, kind).repartition("bucket").sortWithinPartitions("bucket")
    kind = ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in _SHARED)
    shared = dealt.mapInArrow(share, kind).repartition("bucket").sortWithinPartitions("bucket")
    return shared.mapInArrow(prefixes, "key bigint, n bigint, alone bigint, toks array<bigint>, prefix array<struct<tok:bigint,at:bigint>>")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """Least intersection of two sizes that link."""
    return F.ceil((na + nb) * percent / F.lit(100 + percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets link, by exact intersection."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("toks").alias(f"t_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    i = F.size(F.array_intersect("t_a", "t_b"))
    return both.filter(i * 100 >= (F.col("n_a") + F.col("n_b") - i) * percent).select("a", "b")


def _further(level: int, percent: int) -> Column:
    """How many shingles after an entry's own can be the next that it shares: the first d(n) + level + 1 hold level + 1 of them."""
    return F.greatest(F.lit(0), F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + level - F.col("at")).cast("int")


def longer_lists(lists: DataFrame, sets: DataFrame, level: int, percent: int) -> DataFrame:
    """Entries (tok, at, key, n, alone, label) of the lists that a further common shingle splits lists into."""
    start = (F.col("at") - F.col("alone") + 2).cast("int")  # the place after the list's shingle in toks
    nexts = F.slice("toks", start, _further(level, percent))
    return lists.join(sets.select("key", "toks"), "key").select("tok", "at", "key", "n", "alone", "label", F.posexplode(nexts).alias("j", "next")).select(
        F.xxhash64("tok", "next").alias("tok"), (F.col("at") + 1 + F.col("j")).alias("at"), "key", "n", "alone", "label"
    )


def heavy_edges(sets: DataFrame, percent: int, light: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links among the heavy sets, given those among the light ones."""
    lists = kept(sets.filter("size(prefix) > 0").select(F.col("key"), "n", "alone", F.explode("prefix").alias("p")).select("p.tok", "p.at", "key", "n", "alone"), "lists")
    # First round: the first set of each list against the others.  The minimum is combined before its shuffle,
    # and where a list is long Spark deals its side of the join to several tasks.
    me = F.struct("alone", "key", "n")
    first = lists.groupBy(F.col("tok").alias("t")).agg(F.min(me).alias("f"), F.count("*").alias("c")).filter("c > 1").drop("c")
    star = lists.select("tok", me.alias("m")).join(first.hint("merge"), F.col("tok") == F.col("t")).filter("f.key <> m.key")
    shared_only = F.least(F.col("f.n") - F.col("f.alone"), F.col("m.n") - F.col("m.alone")) >= _need(F.col("f.n"), F.col("m.n"), percent)
    pairs = star.filter(shared_only).select(F.least("f.key", "m.key").alias("a"), F.greatest("f.key", "m.key").alias("b")).distinct()
    one = kept(verified(pairs, sets, percent), "star")
    label = kept(components(one.unionByName(light)), "labels")
    open_ = lists.join(label, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key")).drop("node")
    # What is still in different components: pair by pair, or split by a further common shingle where that is less work.
    out, level = one, 1
    while True:
        of_label = open_.groupBy("tok", "label").agg(F.count("*").alias("c"), F.sum(_further(level, percent)).alias("more"), F.min("n").alias("n"))
        tall = of_label.groupBy(F.col("tok").alias("t")).agg(
            F.count("*").alias("labels"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"), F.sum("more").alias("more"), F.min("n").alias("least")
        )
        gains = (F.col("pairs") > SPLIT_GAIN * F.col("more")) & (F.col("least") * percent > 100 * level)  # two sets that link share level + 1 then
        tall = tall.filter("labels > 1").select("t", (gains if level < DEEPEST else F.lit(False)).alias("long"))
        split = kept(open_.join(tall, F.col("tok") == F.col("t")).drop("t"), "split")
        me = F.struct("key", "n", "alone", "at", "label")
        short = split.filter("not long")
        x, y = short.select("tok", me.alias("x")), short.select("tok", me.alias("y"))
        room = level - 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # what two sets of a list can share
        can = F.least(room, F.col("x.n") - F.col("x.alone"), F.col("y.n") - F.col("y.alone")) >= _need(F.col("x.n"), F.col("y.n"), percent)
        rest = x.join(y, "tok").filter((F.col("x.key") < F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & can)
        out = out.unionByName(verified(rest.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), sets, percent))
        long = split.filter("long")
        if level == DEEPEST or not long.limit(1).count():
            return out
        open_ = longer_lists(long.drop("long"), sets, level, percent)
        level += 1


def links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, edges): the set key of every row (columns of docs but text), and edges between keys that connect all that links."""
    all_ = kept(members(docs, k), "members")
    sets = kept(all_.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("small", ignorenulls=True).alias("small")).filter(F.col("n") <= LIGHT_MOST), "small")
    counts = {r.n: r["count"] for r in sets.groupBy("n").count().collect()}  # at most LIGHT_MOST rows
    most = boundary(counts, percent)
    light = kept(light_edges(sets, most, percent).distinct(), "light")
    shingles = int(all_.agg(F.sum("n")).first()[0] or 0)
    heavy = kept(heavy_sets(docs, k, percent, max(1, most + 1 - int(missing(most + 1, percent))), shingles), "heavy")
    return all_, kept(heavy_edges(heavy, percent, light).unionByName(light), "links")


def classes(all_: DataFrame, edges: DataFrame, least: Column) -> DataFrame:
    """k, lead: for each set key, the least value of `least` among the rows of its component."""
    firsts = all_.filter("n > 0").groupBy("key").agg(F.min(least).alias("first"))
    named = firsts.join(components(edges), F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("first").alias("lead"))
    return kept(named.join(lowest, "label").select(F.col("key").alias("k"), "lead"), "classes")


def link(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of every document."""
    all_, edges = links(docs.select(F.col("doc_id").cast("long"), "text"), k, percent)
    of_key = classes(all_, edges, F.col("doc_id"))
    return all_.join(of_key, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lead", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component alone: the least by doc_id (null last), then by row hash.

    Rows count by their content, not their id: a row that repeats an id with another text is judged
    by that text.  Rows without a set (null or blank text) link with nothing and all stay.
    """
    one, two = fresh(docs, "row1", "row2")
    keyed = docs.withColumns(dict(zip((one, two), row_key(docs))))
    all_, edges = links(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(one).alias("r1"), F.col(two).alias("r2"), "text"), k, percent)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    of_key = classes(all_, edges, place)
    found = all_.filter("n > 0").join(of_key, F.col("key") == F.col("k"))
    gone = kept(found.filter((F.col("r1") != F.col("lead.r1")) | (F.col("r2") != F.col("lead.r2"))).select("r1", "r2").distinct(), "gone")
    left = keyed.join(gone.hint("merge"), (F.col(one) == F.col("r1")) & (F.col(two) == F.col("r2")), "left_anti")  # one plan at every size
    again = found.groupBy("r1", "r2").count().filter("count > 1").select("r1", "r2")
    again = kept(again, "again")
    if not again.limit(1).count():
        return left.drop(one, two)
    same = (F.col(one) == F.col("r1")) & (F.col(two) == F.col("r2"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([one, two])).drop(one, two)
