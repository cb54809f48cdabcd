"""Mixing sources to target weights by Pareto order sampling.

`mix(docs, weights)` decides how many words of each document a mix takes so
that every source comes near its target.

* Targets: the mix is `total` words (default: all words).  Sources share it by
  weight; a target stops at `max_copies` times its source's words and the
  excess is shared again among the others until none is above.
* Copies: within a source a document is wanted `m = min(max_copies, c *
  size**size_power)` times, c chosen so that the wanted words add up to the
  target.  floor(m) whole copies are certain.
* The rest is one unequal-probability sample of fixed size (in words): every
  document draws odds u/(1-u) divided by its inclusion odds p/(1-p), p = m -
  floor(m), and the smallest are taken while they fit in the source's
  remaining words; where one does not fit, later ones that do fill the gap.  u is a hash of seed and doc_id: reruns agree.

The running total over a source's order is found by histogram: words are summed
in fixed bins of the order's rank value, only the bin that holds the cut is
opened, again and again, until it is small.  No source is ever sorted whole.
What the documents before that bin leave is filled from the bin and all later ones,
in order, until nothing fits; bins and their bounds do not change what is taken.

Defined cases: null or blank text has size 0 and is never taken; a null source
is a source of its own, last in order; rows that repeat a doc_id are separate
rows and tie (rows alike in id and size are interchangeable); a source without words has
target 0; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import few, fresh, kept, row_key

WHITE = r"\x20\x09-\x0D"
#: Bins of one look at a source's order, rows that one cut bin may hold at the end, shares that the documents of one size are dealt to.
BINS, SMALL, SHARES = 4096, 20_000, 64


def word_count(text: Column) -> Column:
    """Words of a text, counted in the JVM: each word with the space before it becomes one x."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WHITE}]*+[^{WHITE}]++", "x")
    return F.length(F.regexp_replace(bare, rf"[{WHITE}]++$", "")).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds rank 0.. by code point, null last, without a single-task sort of all sources."""
    sorted_ = kept(
        sources.sort(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources"
    ).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, {}
    for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).sort("part").collect():  # one row for each partition
        starts[r.part] = before
        before += r.n
    start = F.lit(0).cast("long")
    for part, n in starts.items():
        start = F.when(F.col("part") == part, F.lit(n).cast("long")).otherwise(start)
    return sorted_.withColumn("rank", start + F.col("row")).drop("at", "part", "row")


def water_fill(groups: DataFrame, total: float, cap: Column, weight: Column) -> DataFrame:
    """Adds `target`: min(cap, level * weight) with targets adding up to total (or all caps, if those are less).

    Only sums come to the driver; the groups stay distributed.
    """
    rows = groups.withColumns({"cap": cap.cast("double"), "w": weight.cast("double")}).withColumn("bound", F.col("cap") / F.col("w"))
    level = -1.0
    while True:
        free = F.col("bound") > level
        s = rows.agg(F.sum(F.when(free, F.col("w"))).alias("w"), F.sum(F.when(~free, F.col("cap"))).alias("cap")).first()
        if not s.w:
            level = float("inf")
            break
        up = (total - (s.cap or 0.0)) / s.w
        if up <= level * (1 + 1e-12):
            break
        level = up
    filled = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.lit(max(level, 0.0)) * F.col("w"))
    return rows.withColumn("target", filled).drop("cap", "w", "bound")


def wanted_copies(sized: DataFrame, targets: DataFrame, max_copies: int, size_power: float) -> DataFrame:
    """Adds `m`, the wanted copies of each document: every source's m * size adds up to its target."""
    shape = F.pow(F.col("size").cast("double"), F.lit(size_power))
    level = targets.select(F.col("source").alias("s"), F.col("target").alias("goal"), F.lit(-1.0).alias("c"))
    while True:
        rows = sized.filter("size > 0").join(F.broadcast(level) if few(level) else level, F.col("source").eqNullSafe(F.col("s")))
        free = (F.lit(float(max_copies)) / shape) > F.col("c")
        sums = rows.groupBy("s").agg(
            F.first("goal").alias("goal"),
            F.first("c").alias("was"),
            F.sum(F.when(free, shape * F.col("size"))).alias("free"),
            F.sum(F.when(~free, F.col("size") * float(max_copies))).alias("full"),
        )
        up = F.when(F.coalesce("free", F.lit(0.0)) <= 0, F.lit(float("inf"))).otherwise(
            (F.col("goal") - F.coalesce("full", F.lit(0.0))) / F.col("free")
        )
        level = kept(sums.select("s", "goal", F.greatest(up, "was").alias("c"), (up > F.col("was") * (1 + 1e-12)).alias("more")), "levels")
        if not level.filter("more").limit(1).count():
            break
        level = level.drop("more")
    level = level.select("s", "c")
    out = sized.join(F.broadcast(level) if few(level) else level, F.col("source").eqNullSafe(F.col("s")), "left")
    m = F.least(F.lit(float(max_copies)), F.greatest(F.lit(0.0), F.col("c")) * shape)
    return out.withColumn("m", F.when(F.col("size") > 0, m).otherwise(0.0)).drop("s", "c")


def sample_rest(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Adds `extra` (0 or 1): the order sample that fills what certain copies leave of each target."""
    spark = docs.sparkSession
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    p = F.col("m") - F.floor("m")
    odds = F.log(unit / (1 - unit)) - F.log(p / (1 - p))
    place = 1 / (1 + F.exp(-odds))  # the order of the odds, within 0..1
    drawn = docs.withColumns({"certain": F.floor("m").cast("long"), "q": F.when(p > 1e-12, place)})
    base = drawn.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    left = kept(
        targets.select(F.col("source").alias("s"), "target").join(base, F.col("s").eqNullSafe(F.col("source"))).select(
            "s", (F.col("target") - F.col("sure")).alias("rest"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")
        ),
        "rest",
    )
    left = kept(left.withColumn("rows", F.lit(1 << 62)), "cuts")  # every source is looked at once at least
    while left.filter((F.col("rows") > SMALL) & (F.col("high") - F.col("low") > 1e-13)).limit(1).count():  # narrow each large source's bin
        open_ = (F.col("rows") > SMALL) & (F.col("high") - F.col("low") > 1e-13)
        large = left.filter(open_).drop("rows")
        inside = drawn.filter("q is not null and size > 0").join(F.broadcast(large) if few(large) else large, F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter("q >= low and q < high")
        bins = inside.groupBy("s", F.floor((F.col("q") - F.col("low")) / (F.col("high") - F.col("low")) * BINS).alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("low").alias("low"), F.first("high").alias("high")
        )
        by_bin = Window.partitionBy("s").orderBy("bin")
        cut = bins.withColumn("upto", F.sum("words").over(by_bin.rowsBetween(Window.unboundedPreceding, 0))).withColumn("last", F.lead("bin").over(by_bin).isNull())
        width = (F.col("high") - F.col("low")) / BINS
        found = cut.filter((F.col("upto") - F.col("words") <= F.col("rest")) & ((F.col("upto") > F.col("rest")) | F.col("last"))).select(
            "s", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("rest"), (F.col("low") + F.col("bin") * width).alias("low"), (F.col("low") + (F.col("bin") + 1) * width).alias("high"), "rows"
        )
        left = kept(left.filter(~open_).select("s", "rest", "low", "high", "rows").unionByName(found), "cuts")
    left = left.drop("rows")
    placed = drawn.join(F.broadcast(left) if few(left) else left, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    counts = F.col("q").isNotNull() & (F.col("size") > 0)
    placed = placed.withColumn("extra", F.when(counts & (F.col("q") < F.col("low")), 1).otherwise(0))
    may = F.coalesce(counts & (F.col("q") >= F.col("low")) & (F.col("size") <= F.col("rest")), F.lit(False))
    # The bin that holds the cut is walked first: what then is left of a gap is less than a document of it, so
    # that of the documents behind the bin only few are short enough to be tried.
    bin_ = F.coalesce(may & (F.col("q") < F.col("high")), F.lit(False))
    names = placed.columns
    walked = kept(filled(placed.filter(bin_)), "walked")
    spent = walked.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("extra") * F.col("size")).alias("spent"))
    behind = placed.filter(may & ~bin_).join(F.broadcast(spent) if few(spent) else spent, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("rest", F.col("rest") - F.coalesce("spent", F.lit(0))).select(*names)
    tried, untried = first_fits(behind)
    return placed.filter(~may).unionByName(walked).unionByName(untried).unionByName(filled(tried)).drop("rest", "low", "high", "q")


def first_fits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each source's documents of one size the first rest / size in its order, and the others: a gap that only shrinks takes no more.

    They are found in SHARES parts of each size first, so that no task orders a whole source.
    """
    most = F.floor(F.col("rest") / F.col("size"))
    part = Window.partitionBy("source", "size", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).orderBy("q", "doc_id")
    parted = rows.filter(most >= 1).withColumn("nth", F.row_number().over(part))
    whole = parted.filter(F.col("nth") <= most).withColumn("nth", F.row_number().over(Window.partitionBy("source", "size").orderBy("q", "doc_id")))
    untried = rows.filter(most < 1).unionByName(parted.filter(F.col("nth") > most).drop("nth")).unionByName(whole.filter(F.col("nth") > most).drop("nth"))
    return whole.filter(F.col("nth") <= most).drop("nth"), untried


def filled(tried: DataFrame) -> DataFrame:
    """Sets `extra` of documents in their source's order: each is taken that fits in what those before it left of `rest`."""
    names = tried.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, gap = run, 0.0  # no source yet
        for b in batches:
            extra = []
            for s, size, rest in zip(*(b.column(names.index(c)).to_pylist() for c in ("source", "size", "rest"))):
                if s != source:
                    source, gap = s, rest
                extra.append(int(size <= gap))
                gap -= size * extra[-1]
            yield b.set_column(names.index("extra"), "extra", pa.array(extra, pa.int32()))

    return tried.repartition("source").sortWithinPartitions("source", "q", "doc_id", "size").mapInArrow(run, tried.schema)


def mix(
    docs: DataFrame,
    weights: Callable[[Column], Column] | None = None,
    total_share: float = 1.0,
    max_copies: int = 3,
    size_power: float = 0.25,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, source_size, target, wanted (copies, fractional), taken_copies, taken.

    weights maps a source's rank column (by code point, null last) to its weight;
    the default is 1, 2, 3, repeating.
    """
    sized = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = kept(ranked_sources(sources), "ranked")
    weight = (weights or (lambda rank: rank % 3 + 1))(F.col("rank"))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * total_share
    targets = kept(water_fill(ranked, total, F.col("source_size") * float(max_copies), weight), "targets")
    wanted = wanted_copies(sized, targets, max_copies, size_power)
    done = sample_rest(wanted, targets, seed)
    goals = targets.select(F.col("source").alias("s"), "source_size", "target")
    copies = F.coalesce(F.col("certain"), F.lit(0)) + F.col("extra")
    return done.join(F.broadcast(goals) if few(goals) else goals, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "size", "source_size", "target", F.col("m").alias("wanted"), copies.alias("taken_copies"), (copies * F.col("size")).alias("taken"), "source"
    )


def drawn(docs: DataFrame, **options) -> DataFrame:
    """docs that the mix takes, all columns, with mix_copies (1 or more), the times it takes each; options are those of mix.

    Rows are known by all their columns.  Of equal rows as many stay as the mix takes, each with its own
    copies.  A column mix_copies of docs is replaced; docs without a row give none.
    """
    base = docs.select(*[c for c in docs.columns if c.lower() != "mix_copies"])
    one, two = fresh(base, "row1", "row2")
    keyed = base.withColumns(dict(zip((one, two), row_key(base))))
    id_ = F.struct(one, two)
    mixed = mix(keyed.select(id_.alias("doc_id"), "source", "text"), **options).filter("taken_copies > 0")
    times = mixed.groupBy("doc_id", "taken_copies").agg(F.count("*").alias("n"))
    times = times.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("taken_copies", "n"))).alias("t"))  # two values at most
    taken = kept(times.select(F.col("doc_id")[one].alias("r1"), F.col("doc_id")[two].alias("r2"), "t"), "copies")
    same = (F.col(one) == F.col("r1")) & (F.col(two) == F.col("r2"))
    cols = [F.col(f"`{c}`") for c in base.columns]
    single = (F.size("t") == 1) & (F.col("t")[0]["n"] == 1)
    out = keyed.join(taken.filter(single), same).select(*cols, F.col("t")[0]["taken_copies"].alias("mix_copies"))
    several = taken.filter(~single)
    if not several.limit(1).count():
        return out
    each = F.explode(F.flatten(F.transform("t", lambda x: F.array_repeat(x["taken_copies"], x["n"].cast("int")))))
    return out.unionByName(keyed.dropDuplicates([one, two]).join(several, same).select(*cols, each.alias("mix_copies")))
