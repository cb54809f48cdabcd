"""URL filters by association rules, with DataFrame functions alone.

`learn(labelled)` runs Spark's FP-growth over the tokens of labelled URLs plus
one token for the label, and keeps the rules "token combination -> label" that
pass minimal support (a share and a number of URLs) and confidence.  `match(urls, rules)` finds, through an
inverted index from a rule's rarest token to the rule, the rules whose tokens a URL all has; the
most confident one decides.  `judge(pages, policy)` puts fixed host/path rules
before the learnt ones.

Tokens of a URL: every host label with its place from the right (`h1=net`), every
word of a host label split at a hyphen (`w=spam`), every path segment (`p=en`; digits count
as `p=#`, the first extension as `x=html`) and query keys (`k=page`).

Defined cases: a null url or one without `://` has empty host and path and no
tokens, and is allowed; a URL that no rule matches is allowed; ties among rules go to
higher confidence, then support, then block; equal URLs get equal verdicts and count
once when rules are learnt; an empty or unlabelled table learns no rule.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import few, kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed policy: (verdict, host, path).
POLICY = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.reverse(F.split(host, r"\.")), lambda x: x != "")
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), (i + 1).cast("string"), F.lit("="), x))
    words = F.transform(F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("w="), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    paths = F.transform(parts, lambda x: F.concat(F.lit("p="), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), "[0-9]+", "#")))
    ext = F.transform(F.filter(parts, lambda x: x.rlike(r"\.[A-Za-z0-9]+$")), lambda x: F.concat(F.lit("x="), F.regexp_extract(x, r"\.([A-Za-z0-9]+)$", 1)))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("k="), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_distinct(F.concat(placed, words, paths, ext, keys))


def policy_rule(host: Column, path: Column, policy=POLICY) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(policy, key=lambda r: len(r[1] + r[2])):  # a longer one overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def merged_tokens(rows: DataFrame) -> DataFrame:
    """token, merged, members: tokens that the same labelled URLs have are one item, named after its least member.

    Covers are compared by their size and two sums of 64-bit hashes, so no list of URLs is gathered.
    """
    cover = rows.select("url_key", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("url_key").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "url_key")).alias("two")
    )
    groups = cover.groupBy("n", "one", "two").agg(F.array_sort(F.collect_set("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.col("members")[0].alias("merged"), "members", F.col("n").alias("cover"))


def learn(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_urls: int = 20) -> DataFrame:
    """rule_id, tokens, rarest (of its tokens), label, confidence, support from rows of url and label ('block' or 'allow').

    A rule needs min_support of the labelled URLs and min_urls of them at least, and min_confidence; of rules
    with the same label, one whose tokens include a shorter rule's and that is no more confident is left out.
    Tokens with equal covers are merged before mining, and a rule asks for all that were merged; tokens that
    every labelled URL has tell nothing and are left out.  A merged item has a token for each part of a URL at most.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("url is not null and label is not null").select(
        tokens_of(F.col("url")).alias("tokens"), F.col("label").cast("string").alias("label"), F.xxhash64("url", "label").alias("url_key")
    )
    rows = kept(rows.dropDuplicates(["url_key"]), "labelled")
    total = rows.count()
    kind = "rule_id bigint, tokens array<string>, rarest string, label string, confidence double, support double"
    if total < min_urls:
        return spark.createDataFrame([], kind)
    least = max(min_urls, math.ceil(min_support * total))
    names = kept(merged_tokens(rows).filter((F.col("cover") >= least) & (F.col("cover") < total)), "tokens")
    had = rows.select("url_key", "label", F.explode("tokens").alias("token")).join(names.filter("token = merged").select("token"), "token")
    items = had.groupBy("url_key").agg(F.array_append(F.array_sort(F.collect_list("token")), F.concat(F.lit("label="), F.min("label"))).alias("items"))
    items = kept(items.select("items"), "items")
    mined = FPGrowth(itemsCol="items", minSupport=least / total).fit(items).freqItemsets
    is_label = lambda t: t.startswith("label=")
    tokens = F.array_sort(F.filter("items", lambda t: ~is_label(t))).alias("tokens")
    sets = kept(mined.select(tokens, F.substring(F.get(F.filter("items", is_label), F.lit(0)), 7, 99).alias("label"), "freq"), "sets")
    bare = sets.filter("label is null").select("tokens", F.col("freq").alias("of"))
    rules = sets.filter("label is not null and size(tokens) > 0").join(bare, "tokens").select(
        F.xxhash64("tokens", "label").alias("rule_id"), "tokens", "label", (F.col("freq") / F.col("of")).alias("confidence"), (F.col("freq") / F.lit(items.count())).alias("support")
    )
    best = unbeaten(kept(rules, "rules"), min_confidence)
    each = best.select("rule_id", F.explode("tokens").alias("merged")).join(names.filter("token = merged").select("merged", "members", "cover"), "merged")
    whole = each.groupBy("rule_id").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("all"), F.min(F.struct("cover", "merged"))["merged"].alias("rarest"))
    return kept(best.join(whole, "rule_id").select("rule_id", F.col("all").alias("tokens"), "rarest", "label", "confidence", "support"), "best")


def unbeaten(rules: DataFrame, min_confidence: float) -> DataFrame:
    """The rules with min_confidence that are more confident than every rule of fewer of their tokens and the same label.

    rules hold every frequent combination, so each part of a rule is there too.  Level by level, a rule hears from the
    parts that lack one token what is best among them and all of theirs: as many rows as a rule has tokens, not as it has parts.
    """
    size, sure = F.size("tokens"), F.col("confidence") >= min_confidence
    longest = rules.filter(sure).agg(F.max(size)).first()[0] or 1
    level = rules.filter(size == 1)
    best, level = level.filter(sure), level.select("rule_id", F.col("confidence").alias("top"))
    for n in range(2, longest + 1):
        here = rules.filter(size == n)
        parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.xxhash64(F.filter("tokens", lambda t, j: j != i), F.col("label")))
        heard = here.select("rule_id", F.explode(parts).alias("part")).join(level.withColumnRenamed("rule_id", "part"), "part").groupBy("rule_id").agg(F.max("top").alias("most"))
        rows = kept(here.join(heard, "rule_id"), "level")
        best = best.unionByName(rows.filter(sure & (F.col("confidence") > F.col("most"))).drop("most"))
        level = rows.select("rule_id", F.greatest("confidence", "most").alias("top"))
    return best


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, label, confidence, rule_id of the best rule that each distinct URL matches fully.

    The inverted index holds each rule once, under its rarest token; a URL meets the rules of its own tokens
    and each is then held against all of them.
    """
    index = rules.select("rule_id", F.col("tokens").alias("need"), "label", "confidence", "support", F.col("rarest").alias("token"))
    has = urls.select("url").filter("url is not null").distinct().withColumn("tokens", tokens_of(F.col("url")))
    hits = has.withColumn("token", F.explode("tokens")).join(F.broadcast(index) if few(index) else index, "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", (F.col("label") == "block").alias("b"), "label", "rule_id"))
    return hits.groupBy("url").agg(best.alias("m")).select("url", F.col("m.label").alias("label"), "m.confidence", "m.rule_id")


def judge(pages: DataFrame, policy=POLICY, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, learnt_confidence.

    labelled defaults to the pages that a fixed rule decides, with its verdict as label.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("fixed", policy_rule(F.col("host"), F.col("path"), policy))
    if labelled is None:
        labelled = rows.filter("fixed is not null").select("url", F.col("fixed.verdict").alias("label"))
    learnt = match(rows.filter("fixed is null"), learn(labelled)).withColumnRenamed("url", "u")
    return rows.join(learnt, F.col("url") == F.col("u"), "left").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "label", F.lit("allow")).alias("verdict"), F.col("confidence").alias("learnt_confidence"),
    )
