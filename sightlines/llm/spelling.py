"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by variable-length grams.

Two words are near if their edit distance is exactly one.  A word's form is its near word of largest
count, if that is at least TIMES its own; its root is where the forms lead.

1. Gram dictionary.  Grams have SHORTEST to LONGEST code points of a word and its end mark.  A gram that
   more than FREQUENT places of the vocabulary have is pruned in favour of its extensions.
2. Decomposition.  From each place of a word the shortest gram that isn't pruned is taken (or LONGEST). What it
   is depends on its own code points alone, so an edit elsewhere leaves it, and no gram is dropped for another's sake.
3. Bound.  An edit changes the grams over its place; the most that lie over one place are a word's affected
   grams.  Words of LEAST code points have more grams than LONGEST, so one stays in any case: near words share a gram.
4. Lists.  Of its grams, a word with a affected ones takes the a + 1 rarest: the lists of two near words meet in one of
   them.  A list holds a gram at a place in words of one length; an edit moves gram and length by one at most.
5. Candidates from merged lists are verified by their distance.

No list is read for all its pairs but where place, length and rarity agree; lists are split by the dictionary where they would
be long.  Everything is joins and aggregates of DataFrames; the vocabulary is never sent whole to a task.

Defined cases: null words are left out, words under LEAST code points are near none; rows that repeat a word add up; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import kept

#: Code points of a compared word, of a gram, and places of a gram that is extended.
LEAST, SHORTEST, LONGEST, FREQUENT = 5, 2, 4, 50
#: A form has so many times a word's count.
TIMES = 2
LETTERS = r"[A-Za-zÀ-ÿ]+"


def lower_ascii(run: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def letter_runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: maximal runs of letters of every text, A-Z lower-cased."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    return runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))


def one_dropped(doc_id: Column, run: Column, every: int = 97) -> Column:
    """run without one code point where the crc32 of `<doc_id>:<run>` is divisible; a null id changes nothing."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, least: int = 3) -> DataFrame:
    """word, n of every word of LEAST code points that occurs `least` times."""
    return words.filter(F.char_length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _key() -> Column:
    """Stands for a word where many rows have it: itself, or its digest if it is longer than that."""
    return F.when(F.char_length("word") < 64, F.col("word")).otherwise(F.sha2(F.col("word").cast("binary"), 256))


def decomposed(words: DataFrame) -> DataFrame:
    """key, size, grams (at, reach, often, gram: the chosen gram of each place, its code points and frequency) and reach."""
    letters = words.select(_key().alias("key"), F.char_length("word").alias("size"), F.split(F.concat("word", F.lit("\0")), "").alias("letters"))
    places = letters.select("key", "size", F.posexplode(F.transform("letters", lambda c, i: F.slice("letters", i + 1, F.lit(LONGEST)))).alias("at", "ahead")).filter("at < size")
    lengths = F.sequence(F.lit(SHORTEST), F.size("ahead"))
    cut = places.select("key", "size", "at", "ahead", F.explode(lengths).alias("reach")).select("key", "size", "at", "reach", F.array_join(F.slice("ahead", F.lit(1), F.col("reach")), "").alias("gram"))
    often = cut.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("often"))
    gram = F.struct("reach", "often", "gram")
    met = cut.join(often, F.col("gram") == F.col("g")).groupBy("key", "size", "at")
    chosen = met.agg(F.coalesce(F.min(F.when(F.col("often") <= FREQUENT, gram)), F.max(gram)).alias("c"))
    grams = F.array_sort(F.collect_list(F.struct("at", "c.reach", "c.often", "c.gram")))
    return chosen.groupBy("key", "size").agg(grams.alias("grams"), F.transform(grams, lambda g: g["reach"]).alias("reach"))


def affected(reach: Column, size: Column) -> Column:
    """The most grams that one edit changes: those over one place. reach: a column, since it is looked into for each place."""
    over = lambda i: sum((F.coalesce((F.get(reach, i - j) > j).cast("int"), F.lit(0)) for j in range(LONGEST)), F.lit(0))
    return F.array_max(F.transform(F.sequence(F.lit(0), size), over))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of all near pairs of words (word, n), each once."""
    known = kept(decomposed(words).withColumn("taken", affected(F.col("reach"), F.col("size")) + 1), "grams")
    rarest = F.slice(F.array_sort(F.transform("grams", lambda g: F.struct(g["often"].alias("often"), g["gram"].alias("gram"), g["at"].alias("at")))), F.lit(1), F.col("taken"))
    chosen = known.select("key", "size", rarest.alias("rarest")).join(words.select(_key().alias("key"), "word", "n"), "key")
    lists = chosen.select("word", "n", "size", F.explode("rarest").alias("g")).select("word", "n", "size", "g.gram", "g.at")
    moves = F.explode(F.array(*[F.struct((F.col("size") + d).alias("size"), (F.col("at") + s).alias("at")) for d, s in ((0, 0), (1, 0), (1, 1))]))
    asked = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("gram").alias("g"), F.col("size").alias("own"), moves.alias("k"))
    met = asked.join(lists, (F.col("g") == F.col("gram")) & (F.col("k.size") == F.col("size")) & (F.col("k.at") == F.col("at")))
    other = (F.col("own") < F.col("size")) | (F.col("a") < F.col("word"))
    return met.filter(other & (F.levenshtein("a", "word", 1) == 1)).select("a", F.col("word").alias("b"), "n_a", F.col("n").alias("n_b")).distinct()


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of words (word, n)."""
    words = kept(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words.filter(F.char_length("word") >= LEAST))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("n_b").alias("m"), F.col("b").alias("o")), F.struct(F.col("b").alias("w"), F.col("n_a").alias("m"), F.col("a").alias("o")))).alias("p")).select("p.*")
    best = both.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "o")).alias("top"))
    has = -F.col("top.m") >= TIMES * F.col("n")
    formed = kept(words.join(best, F.col("word") == F.col("w"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("top.o")).alias("form"), F.when(has, -F.col("top.m")).alias("form_n")), "formed")
    roots = followed(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots.select(F.col("word").alias("w"), "root"), F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """word, root: links (word, root) followed to the last; each round doubles what a link spans. Links have no cycles."""
    now = kept(links, "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now = kept(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("w").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")
