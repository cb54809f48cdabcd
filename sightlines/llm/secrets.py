"""Secret scans by fixed patterns and character Markov models, with DataFrame functions alone.

Base spans are leftmost non-overlapping matches of three patterns (assign,
access, hex); a match that is too short is dropped and not tried again.

The method adds `random` spans: whole tokens of 20 or more characters
`[A-Za-z0-9+/_=-]` whose characters a Markov chain trained on random strings
explains better than one trained on ordinary identifiers.  Both chains are
first-order models of character pairs with add-half smoothing, trained from a labelled sample
(`string`, `label`): by default random hex, base64 and upper-case strings that Spark
derives, against words and identifiers built from the words of a bounded sample
of the documents.  A token is random where the mean log-likelihood ratio of its
pairs is above `margin` and it has a digit among its letters.

Positions are code points, end exclusive.  They are found natively: one pattern
anchored at the end of the last match yields what lies before each match with the
match, and the match itself; running sums of their lengths, taken by blocks, give the offsets.

Defined cases: null text is empty and has no spans; texts are read whole; equal
texts get equal spans; an empty table gives no rows; without words to train on,
identifiers count as uniform; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import hash_bound, kept

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a run that is long enough is found by its length alone, where it begins.
ACCESS, HEX, TOKEN = "AKIA[A-Z0-9]{16,}+", "(?<![0-9a-f])[0-9a-f]{24,}+", "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Documents of the sample that identifiers are built from, random strings of each form, tokens of a model's alphabet.
SAMPLE_DOCS, RANDOM_STRINGS, CODES = 2_000, 3_000, 128
#: Lengths that are summed up together.
BLOCK = 256

_NONE = "cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"


def _named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers, by blocks: an array grows by appending only within a block."""
    none = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("sums"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.array_append(acc["sums"], at).alias("sums"))

    def total(runs: Column) -> Column:
        before = F.aggregate(F.transform(runs, lambda r: r["at"]), none, step)["sums"]
        return F.flatten(F.zip_with(runs, before, lambda r, upto: F.transform(r["sums"], lambda x: x + upto - r["at"])))

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK))
        return _named(F.transform(starts, lambda i: F.aggregate(F.slice(all_, i, F.lit(BLOCK)), none, step)), total)

    return _named(numbers, blocks)


def matches(text: Column, pattern: str, may: Column, groups: int = 0) -> Column:
    """array of struct(start, end, value) of all matches, leftmost first; `may` says cheaply where there can be any.

    value is the pattern's last group where it has one, else the match.
    """
    step = F.lit(rf"(?s)\G(.*?)(?:({pattern})|\z)")
    whole = F.regexp_extract_all(text, step, F.lit(0))
    got = F.regexp_extract_all(text, step, F.lit(2))
    value = F.regexp_extract_all(text, step, F.lit(3)) if groups else got
    ends = running_sums(F.transform(whole, lambda x: F.length(x).cast("long")))
    spans = F.transform(F.arrays_zip(ends.alias("e"), got.alias("m"), value.alias("v")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["v"].alias("value")))
    return F.when(may, F.filter(spans, lambda x: x["end"] > x["start"])).otherwise(F.expr(_NONE))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind as array<struct<start,end,value>>."""
    low = F.lower(text)
    words = low.contains(WORDS[0])
    for w in WORDS[1:]:
        words = words | low.contains(w)
    return {
        "assign": F.filter(matches(text, ASSIGN, words, 1), lambda m: F.length(m["value"]) >= 6),
        "access": matches(text, ACCESS, text.contains("AKIA")),
        "hex": matches(text, HEX, text.rlike("[0-9a-f]{24}")),
    }


# ------------------------------------------------------------------ the models


def labelled_strings(docs: DataFrame) -> DataFrame:
    """The default labelled sample: rows of string and label ('random' or 'plain')."""
    spark = docs.sparkSession
    texts = docs.select("text").filter("text is not null")
    n = texts.select(F.xxhash64(F.lit(4), "text").alias("h")).distinct().count()
    some = texts if n <= SAMPLE_DOCS else texts.filter(F.xxhash64(F.lit(5), "text") < hash_bound(n, SAMPLE_DOCS))
    some = some.distinct()  # a text that rows repeat counts once
    words = some.select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).filter("length(w) between 2 and 40").groupBy("w").count()
    keyed = words.select("w", F.xxhash64("w").alias("h"), F.lower("w").alias("l"), F.initcap("w").alias("c"))
    plain = keyed.select(F.explode(F.array("w", F.concat_ws("_", "l", F.lower("w")), F.concat("l", "c"), F.concat_ws("-", "l", F.pmod("h", F.lit(1000)).cast("string")))).alias("string"))
    ids = spark.range(RANDOM_STRINGS).select(F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 256).alias("x"))
    b64 = F.base64(F.unhex("x"))
    random_ = ids.select(F.explode(F.array(F.substring("x", 1, 40), F.translate(b64, "=", ""), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))).alias("string"))
    return plain.withColumn("label", F.lit("plain")).unionByName(random_.withColumn("label", F.lit("random")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over plain) of each pair of character codes, CODES * CODES values."""
    code = lambda c: F.least(F.ascii(c), F.lit(CODES - 1))
    pairs = labelled.filter("length(string) >= 2").select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: code(F.col("string").substr(i, F.lit(1))) * CODES + code(F.col("string").substr(i + 1, F.lit(1))))).alias("pair")
    )
    rows = pairs.groupBy("label", "pair").count().collect()  # at most 2 * CODES^2 rows
    alphabet = 66.0
    count = {"random": {}, "plain": {}}
    for r in rows:
        count[r.label][r.pair] = r["count"]
    first = {k: {} for k in count}
    for k, table in count.items():
        for pair, c in table.items():
            first[k][pair // CODES] = first[k].get(pair // CODES, 0) + c
    p = lambda k, a, b: (count[k].get(a * CODES + b, 0) + 0.5) / (first[k].get(a, 0) + 0.5 * alphabet)
    return [round(math.log(p("random", a, b) / p("plain", a, b)), 5) for a in range(CODES) for b in range(CODES)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    pairs = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.element_at(table, a * CODES + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.length(token) - 1)


def random_spans(text: Column, model: list[float], margin: float) -> Column:
    shaped = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.filter(matches(text, TOKEN, text.rlike(TOKEN)), lambda m: shaped(m["value"]) & (ratio(m["value"], model) > margin))


def scan(docs: DataFrame, labelled: DataFrame | None = None, margin: float = 0.5) -> DataFrame:
    """doc_id, text and one span array per kind: assign, access, hex, random."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = train(kept(labelled if labelled is not None else labelled_strings(rows), "strings"))
    text = F.col("text")
    return rows.withColumns(base_spans(text)).withColumn("random", random_spans(text, model, margin))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""

    def marked(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("n"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    all_ = F.array_sort(F.concat(*[marked(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(all_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), joined(KINDS).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
