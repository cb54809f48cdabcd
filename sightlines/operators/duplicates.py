"""Which pages stand for others: redirect aliases, canonical and equal content, and links followed to one representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlines.functions.urls import candidate_identity

#: Words and different words of a page whose content may tell that it equals another.
LEAST_WORDS, LEAST_DISTINCT = 100, 40


def _keep(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """domain, url, decision and duplicate_of of every page.

    pages: domain, url, final_url, redirected, canonical, fingerprint, words, distinct_words, priority.  A redirected request is an
    alias of where it ends, a page with another canonical address a duplicate of that one; else a
    page of substantial content that equals others is a duplicate of the one of highest priority (then least url).
    """
    of = lambda c: candidate_identity(F.col(c), F.col("domain"))
    t = pages.withColumns({"own": of("url"), "canon": of("canonical")}).withColumn("end", F.coalesce(of("final_url"), "own"))
    alias = F.coalesce(F.col("redirected") & (F.col("end") != F.col("own")), F.lit(False))
    elsewhere = F.coalesce(F.col("canon") != F.col("end"), F.lit(False))
    t = t.withColumns({"alias": alias, "has": F.coalesce(F.col("fingerprint"), F.lit("")) != ""})
    leads = t.filter("has and not alias and words >= %d" % LEAST_WORDS).groupBy(F.col("domain").alias("d"), F.col("fingerprint").alias("f")).agg(F.min(F.struct((-F.col("priority")).alias("p"), "url", "end")).alias("lead"))
    j = t.join(leads, (F.col("domain") == F.col("d")) & (F.col("fingerprint") == F.col("f")), "left")
    same = F.coalesce(F.col("has") & (F.col("words") >= LEAST_WORDS) & (F.col("distinct_words") >= LEAST_DISTINCT) & (F.col("lead.url") != F.col("url")) & (F.col("lead.end") != F.col("end")), F.lit(False))
    pick = lambda a, b, c, d: F.when(F.col("alias"), a).when(elsewhere, b).when(same, c).otherwise(d)
    text = F.lit
    return j.select("domain", "url", pick(text("redirect_alias"), text("canonical_duplicate"), text("exact_content_duplicate"), text("unique")).alias("decision"), pick(F.col("end"), F.col("canon"), F.col("lead.url"), text(None)).alias("duplicate_of"))


#: Decisions that following a redirect may have made of an alias.
MISTAKEN = ["exact_content_duplicate", "canonical_or_content_duplicate", "redirect_alias"]


def repair_aliases(inventory: DataFrame) -> DataFrame:
    """inventory (domain, url, final_url, eligibility, decision_reason, duplicate_of, noindex) with aliases told from content duplicates.

    A row that a redirect led elsewhere is an alias of that address.  Where a page was called a duplicate
    of a request that redirects to it, the pair is turned round: the request becomes the alias, the page is crawled again.
    """
    of = lambda c: candidate_identity(F.col(c), F.col("domain"))
    t = inventory.withColumns({"own": of("url"), "end": of("final_url")})
    moved = F.coalesce((F.col("end") != F.col("own")) & F.col("decision_reason").isin(MISTAKEN), F.lit(False))
    t = t.withColumns({"eligibility": F.when(moved, "duplicate").otherwise(F.col("eligibility")), "decision_reason": F.when(moved, "redirect_alias").otherwise(F.col("decision_reason")), "duplicate_of": F.when(moved, F.col("end")).otherwise(F.col("duplicate_of"))})
    t = _keep(t.withColumn("dup", candidate_identity(F.col("duplicate_of"), F.col("domain"))))
    ends = t.filter("end is not null").groupBy(F.col("domain").alias("d"), F.col("own").alias("o")).agg(F.first("end").alias("there"))
    turned = t.filter("decision_reason = 'exact_content_duplicate'").join(ends, (F.col("domain") == F.col("d")) & (F.col("dup") == F.col("o"))).filter("there = own")
    free = turned.select(F.col("domain").alias("d"), F.col("own").alias("o"), F.lit("free").alias("role"), F.lit(None).cast("string").alias("to"))
    alias = turned.groupBy(F.col("domain").alias("d"), F.col("dup").alias("o")).agg(F.lit("alias").alias("role"), F.min("own").alias("to"))
    roles = free.unionByName(alias).groupBy("d", "o").agg(F.max("role").alias("role"), F.max("to").alias("to"))
    j = t.join(roles, (F.col("domain") == F.col("d")) & (F.col("own") == F.col("o")), "left")
    is_ = lambda r: F.coalesce(F.col("role") == r, F.lit(False))

    def then(alias: Column, free: Column, else_: str) -> Column:
        return F.when(is_("alias"), alias).when(is_("free"), free).otherwise(F.col(else_))

    barred = F.coalesce(F.col("noindex"), F.lit(False))
    return j.select(
        "domain", "url", "final_url", then(F.lit("duplicate"), F.when(barred, "excluded").otherwise("eligible"), "eligibility").alias("eligibility"),
        then(F.lit("redirect_alias"), F.when(barred, "noindex").otherwise("redirect_final_resource"), "decision_reason").alias("decision_reason"), then(F.col("to"), F.lit(""), "duplicate_of").alias("duplicate_of"), "noindex",
    )


def settle_duplicates(pages: DataFrame) -> DataFrame:
    """url, representative: every page (url, duplicate_of, priority) with the one that its chain of duplicates ends at.

    In a circle the page of highest priority (then least url) stands for all.  An address that no
    page has ends a chain too.  Each round doubles what a link spans, so long chains take few.
    """
    linked = pages.select("url", F.nullif(F.col("duplicate_of"), F.lit("")).alias("to"), F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), "url").alias("best"))
    absent = linked.filter("to is not null").select(F.col("to").alias("url")).distinct().join(linked.select("url"), "url", "left_anti")
    links = linked.unionByName(absent.select("url", F.lit(None).cast("string").alias("to"), F.struct(F.lit(0).cast(linked.schema["best"].dataType["p"].dataType).alias("p"), "url").alias("best")))
    # at: where 2^k links lead (an end leads to itself); best: the best page on the way
    state, mark = _keep(links.select("url", F.coalesce("to", "url").alias("at"), "best", F.coalesce(F.col("to") != F.col("url"), F.lit(False)).alias("goes"))), None
    while True:
        total = state.agg(F.countDistinct("at").alias("ends"), F.sum(F.xxhash64("best").cast("decimal(38,0)")).alias("bests")).first()
        if tuple(total) == mark:
            break
        mark = tuple(total)
        ahead = state.select(F.col("url").alias("u"), F.col("at").alias("a"), F.col("best").alias("b"))
        state = _keep(state.join(ahead, F.col("at") == F.col("u")).select("url", F.col("a").alias("at"), F.least("best", "b").alias("best"), "goes"))
    # what is led to after so many links is an end or stands in a circle, whose best page all its members know
    ends = state.join(state.select(F.col("at").alias("x")).distinct(), F.col("url") == F.col("x"), "left_semi").select(F.col("url").alias("u"), F.when(F.col("goes"), F.col("best.url")).otherwise(F.col("url")).alias("representative"))
    return state.join(ends, F.col("at") == F.col("u")).join(pages.select("url"), "url", "left_semi").select("url", "representative")
