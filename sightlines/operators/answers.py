"""AI-answer operators: visibility, sources, agreement between providers, share of voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.functions.citations import cited_sources
from sightlines.functions.numbers import js_round
from sightlines.functions.urls import source_type


def host_of(url: Column) -> Column:
    """Lower-case host without www and port; empty for what is no address."""
    bare = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), "^www\\.", ""), ":[0-9]+$", "")


def controlled_by(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def percent(part: Column, whole: Column) -> Column:
    return js_round(F.when(whole > 0, part / whole * 100), 1)


def ai_metrics(checks: DataFrame, citations: DataFrame, domain: str, by: list[str]) -> DataFrame:
    """Mention and citation rates over all answers, those with an error included, and the share of citations that are of the own domain."""
    own = citations.groupBy("check_id").agg(F.count_if(host_of(F.col("url")) == domain.lower()).alias("own"), F.count("*").alias("cites"))
    n, cites = F.count("*"), F.coalesce(F.sum("cites"), F.lit(0))
    return checks.join(own, "check_id", "left").groupBy(*by).agg(
        n.alias("answers"), percent(F.count_if(F.col("verdict").isin("cited", "mentioned")), n).alias("mention_rate"), percent(F.count_if(F.col("verdict") == "cited"), n).alias("citation_rate"),
        percent(F.coalesce(F.sum("own"), F.lit(0)), cites).alias("first_party_rate"), cites.alias("citations"),
    )


def answer_sources(responses: DataFrame, controlled: list[str]) -> DataFrame:
    """responses (provider_status, citations, raw_answer, ...) and what each cites.

    sources: its citations that have a domain; usable: whether there are any; own and external: the distinct domains of each
    kind; company_source: whether an own one is among them, null where nothing is usable.
    """
    sources = F.filter(cited_sources(F.col("citations"), F.col("raw_answer")), lambda c: c["domain"].isNotNull())
    t = responses.withColumn("sources", sources)
    domains = F.array_sort(F.array_distinct(F.transform("sources", lambda c: c["domain"])))
    t = t.withColumns({"own": F.filter(domains, lambda d: controlled_by(d, controlled)), "external": F.filter(domains, lambda d: ~controlled_by(d, controlled)), "usable": F.size("sources") > 0})
    return t.withColumn("company_source", F.when(F.col("usable"), F.size("own") > 0))


def source_analysis(responses: DataFrame, controlled: list[str], by: list[str]) -> DataFrame:
    """Of the successful answers with usable sources, how many cite a company-controlled one."""
    t, counts = answer_sources(responses, controlled), (F.col("provider_status") == "success") & F.col("usable")
    own, all_ = F.count_if(counts & F.col("company_source")), F.count_if(counts)
    return t.groupBy(*by).agg(own.alias("numerator"), all_.alias("denominator"), F.when(all_ > 0, own / all_ * 100).alias("percentage"))


def external_domains(responses: DataFrame, controlled: list[str], by: list[str]) -> DataFrame:
    """Answers that cite each domain outside the company, and citations of it."""
    t = answer_sources(responses, controlled).select(*by, "external", F.col("sources.domain").alias("all_"))
    each = F.transform("external", lambda d: F.struct(d.alias("domain"), F.size(F.filter("all_", lambda x: x == d)).alias("n")))
    return t.select(*by, F.explode(each).alias("x")).groupBy(*by, F.col("x.domain").alias("domain")).agg(F.count("*").alias("responses"), F.sum("x.n").alias("citations"))


def concept_metrics(presence: DataFrame) -> DataFrame:
    """Agreement of a question's providers on concepts (question, engine, concept, present): mean pairwise Jaccard, and concepts by who has them.

    Every provider of a question counts, also one without a present concept (its concept may be null); two empty sets agree fully.
    A concept of all providers is shared, of exactly one specific, else inconsistent.  Providers are few, so are pairs of a question's.
    """
    sets = presence.groupBy("question", "engine").agg(F.array_sort(F.collect_set(F.when(F.col("present"), F.col("concept")))).alias("c"))
    a, b = sets.select("question", F.col("engine").alias("e1"), F.col("c").alias("c1")), sets.select("question", F.col("engine").alias("e2"), F.col("c").alias("c2"))
    union = F.size(F.array_union("c1", "c2"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("c1", "c2")) / union)
    pairs = a.join(b, "question").filter("e1 < e2").groupBy("question").agg(js_round(F.sum(j.cast("decimal(20,12)")).cast("double") / F.count("*"), 3).alias("consistency"), F.count("*").alias("pairs"))
    each = presence.filter("concept is not null").groupBy("question", "concept").agg(F.countDistinct(F.when(F.col("present"), F.col("engine"))).alias("n"))
    n = sets.groupBy("question").agg(F.count("*").alias("engines"))
    shared, one = F.col("n") == F.col("engines"), F.col("n") == 1
    known = F.col("concept").isNotNull()
    kinds = n.join(each, "question", "left").groupBy("question").agg(
        F.first("engines").alias("engines"), F.count_if(known & shared).alias("shared"), F.count_if(known & ~shared & one).alias("specific"), F.count_if(known & ~shared & ~one).alias("inconsistent"), F.count("concept").alias("concepts")
    )
    return kinds.join(pairs, "question", "left")


def consistency_rollup(metrics: DataFrame, families: DataFrame) -> DataFrame:
    """Agreement by question family."""
    m = metrics.join(families, "question")
    mean = F.sum(F.round(F.col("consistency") * 1000).cast("bigint")) / (1000 * F.count("consistency"))
    return m.groupBy("family").agg(F.count("*").alias("questions"), js_round(mean, 3).alias("consistency"), F.sum("shared").alias("shared"), F.sum("specific").alias("specific"))


def share_of_voice(mentions: DataFrame, brands: DataFrame) -> DataFrame:
    """Mentions of every brand of the set, none included, and their share."""
    n = mentions.groupBy("brand").agg(F.count("*").alias("mentions"))
    t = brands.select("brand").distinct().join(n, "brand", "left").fillna(0, ["mentions"])
    total = t.agg(F.sum("mentions").alias("total"))  # one row
    return t.join(F.broadcast(total)).select("brand", "mentions", js_round(F.when(F.col("total") > 0, F.col("mentions") / F.col("total") * 100).otherwise(0.0), 1).alias("share"))


def citation_landscape(citations: DataFrame) -> DataFrame:
    """For each question: domains, citations, their largest domain, and the percent that the three largest hold."""
    d = citations.withColumn("domain", host_of(F.col("url"))).groupBy("question", "domain").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), "domain"))
    t = d.withColumn("place", place).groupBy("question").agg(F.count("*").alias("domains"), F.sum("n").alias("citations"), F.sum(F.when(F.col("place") <= 3, F.col("n"))).alias("top3"), F.max(F.when(F.col("place") == 1, F.col("domain"))).alias("top_domain"))
    return t.select("question", "domains", "citations", "top_domain", js_round(F.col("top3") / F.col("citations") * 100).cast("int").alias("top3_share"))


def _touched(citations: DataFrame, scanned: DataFrame, opened: DataFrame) -> DataFrame:
    """(question, domain, cites, cited, scanned, opened) of every domain that an answer's research met."""
    met = None
    for name, rows in (("cited", citations), ("scanned", scanned), ("opened", opened)):
        x = rows.select("question", host_of(F.col("url")).alias("domain"), F.lit(name).alias("how"))
        met = x if met is None else met.unionByName(x)
    has = lambda n: F.bool_or(F.col("how") == n).alias(n)
    return met.groupBy("question", "domain").agg(F.count_if(F.col("how") == "cited").alias("cites"), has("cited"), has("scanned"), has("opened"))


def source_types(citations: DataFrame, scanned: DataFrame, opened: DataFrame) -> DataFrame:
    """For each question and type of source: citations, domains and percent of all citations."""
    t = _touched(citations, scanned, opened).groupBy("question", source_type(F.col("domain")).alias("type")).agg(F.sum("cites").alias("cites"), F.count("*").alias("domains"))
    total = F.sum("cites").over(Window.partitionBy("question"))
    return t.withColumn("pct", F.when(total > 0, js_round(F.col("cites") / total * 100)).otherwise(0.0).cast("int"))


def domain_trust(citations: DataFrame, scanned: DataFrame, opened: DataFrame, k: int = 12) -> DataFrame:
    """The k most trusted domains of each question: half for being cited, the rest for its share of the most cited, for being found, opened and scanned."""
    t = _touched(citations, scanned, opened)
    most = F.greatest(F.lit(1), F.max("cites").over(Window.partitionBy("question")))
    one = lambda c: F.col(c).cast("int")
    # what a search found is what was scanned: both shares go together
    trust = js_round(0.5 * one("cited") + 0.2 * F.col("cites") / most + 0.15 * one("scanned") + 0.10 * one("opened") + 0.05 * one("scanned"), 2)
    t = t.withColumns({"trust": trust, "type": source_type(F.col("domain"))})
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("trust"), F.desc("cites"), "domain"))
    return t.withColumn("place", place).filter(F.col("place") <= k).select("question", "domain", "type", "cited", "opened", "cites", "trust", "place")


def answer_coverage(runs: DataFrame, expected: int) -> DataFrame:
    """Manual answer runs by site: providers, valid payloads, answers against what is expected."""
    t = runs.groupBy("site_id").agg(F.countDistinct("engine").alias("providers"), F.count("*").alias("runs"), F.count_if("valid").alias("valid"), F.coalesce(F.sum(F.when(F.col("valid"), F.col("answers"))), F.lit(0)).alias("answers"))
    want = F.col("providers") * expected
    return t.withColumn("expected", want).withColumn("complete", (F.col("answers") >= want) & (F.col("valid") == F.col("runs")))


def citation_sentiment(rows: DataFrame, emotions: list[str]) -> DataFrame:
    """Counts by domain and polarity, and the strongest emotion of each group (rows carry one score column for each, and positive, neutral and negative).

    The largest score above zero decides, of equal ones the first named; without one a row is neutral, or has no emotion.
    """

    def strongest(names: list[str]) -> Column:
        scores = F.array(*[F.struct(F.coalesce(F.col(n), F.lit(0)).cast("double").alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(names)])
        return F.when(F.array_max(scores)["score"] > 0, F.array_max(scores)["name"])

    t = rows.withColumns({"emotion": strongest(emotions), "polarity": F.coalesce(strongest(["positive", "neutral", "negative"]), F.lit("neutral"))}).groupBy("domain", "polarity", "emotion").agg(F.count("*").alias("n"))
    return t.groupBy("domain", "polarity").agg(F.sum("n").alias("pages"), F.max_by("emotion", F.when(F.col("emotion").isNotNull(), F.struct("n", "emotion"))).alias("top_emotion"))


def aeo_verdict(answer: Column, brand: Column, domain: Column, urls: Column) -> Column:
    """struct(verdict, rank): cited where a source is on the domain, else mentioned where the answer names the brand."""
    hosts = F.array_distinct(F.filter(F.transform(urls, host_of), lambda h: h != ""))
    mine = F.transform(hosts, lambda h: (h == domain) | F.endswith(h, F.concat(F.lit("."), domain)))
    rank = F.array_position(mine, F.lit(True))
    named = mentions_term(answer, brand)
    return F.struct(F.when(rank > 0, "cited").when(named, "mentioned").otherwise("absent").alias("verdict"), F.when(rank > 0, rank).alias("rank"))


def mentions_term(text: Column, term: Column) -> Column:
    """Whether text holds the term between characters that are no letters or digits, in any case."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), term, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.coalesce((F.length(term) > 0) & F.regexp_like(text, quoted), F.lit(False))


def links_from_text(text: Column) -> Column:
    """Distinct addresses in a text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def snippet_around(text: Column, term: Column, chars: int = 80) -> Column:
    """The stretch of text around the first occurrence of term."""
    at = F.instr(F.lower(text), F.lower(term))
    start = F.greatest(at - chars, F.lit(1))
    return F.when(at > 0, F.substring(text, start, F.length(term) + 2 * chars))
