"""Keyword, link and demand operators: gaps, verdicts, caches, clusters, domains."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.functions.numbers import js_round

# Fixed limits of a gap verdict.
CLOSE_POSITION = 30
# Name servers of these say nothing about who owns a domain.
COMMON_DNS = ("cloudflare.com", "awsdns", "googledomains.com", "google.com", "domaincontrol.com", "registrar-servers.com", "namecheaphosting.com", "azure-dns", "digitalocean.com", "hostinger.com", "dnsimple.com", "nsone.net", "vercel-dns.com", "netlify.com")


def own_positions(page_query: DataFrame) -> DataFrame:
    """site_id, keyword, own_position, own_url, impressions: each query's page of best mean position."""
    mean = F.sum(F.col("position").cast("decimal(20,6)")).cast("double") / F.count("position")
    t = page_query.withColumn("keyword", F.lower(F.trim("query"))).filter("keyword <> ''").groupBy("site_id", "keyword", "url").agg(F.coalesce(mean, F.lit(0.0)).alias("p"), F.coalesce(F.sum("impressions"), F.lit(0)).alias("impressions"))
    best = t.groupBy("site_id", "keyword").agg(F.min(F.struct("p", "url", "impressions")).alias("b"))
    return best.select("site_id", "keyword", F.col("b.p").alias("own_position"), F.col("b.url").alias("own_url"), "b.impressions")


def keyword_gap(competitor: DataFrame, page_query: DataFrame, limit_position: int = CLOSE_POSITION) -> DataFrame:
    """Competitor keywords with our mean position on our best page: close, weak (shown, but further down) or missing."""
    j = competitor.join(own_positions(page_query), ["site_id", "keyword"], "left")
    verdict = F.when(F.col("own_position") <= limit_position, "close").when(F.col("impressions") > 0, "weak").otherwise("missing")
    return j.withColumns({"verdict": verdict, "own_position": js_round("own_position", 1)}).drop("impressions")


def demand_verdicts(keywords: DataFrame, page_query: DataFrame, reach: float = CLOSE_POSITION) -> DataFrame:
    """none, reach or wrong_page for each keyword (site_id, keyword) by position alone; null where a site has no queries at all."""
    own = own_positions(page_query).withColumnRenamed("keyword", "k").drop("impressions")
    known = page_query.select("site_id").distinct().withColumn("known", F.lit(True))
    j = keywords.withColumn("k", F.lower(F.trim("keyword"))).join(own, ["site_id", "k"], "left").join(known, "site_id", "left")
    shown = js_round("own_position", 1)
    verdict = F.when(shown.isNull(), "none").when(shown <= reach, "reach").otherwise("wrong_page")
    return j.select(*keywords.columns, shown.alias("own_position"), "own_url", F.when(F.col("known"), verdict).alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("site_id", "verdict").agg(F.count("*").alias("keywords"))


def best_keyword_metric(cache: DataFrame) -> DataFrame:
    """One cached row for each keyword and country: with difficulty first, then the newest."""
    w = Window.partitionBy("keyword", "country").orderBy(F.col("kd").isNull(), F.desc("checked_at"), "provider", F.desc_nulls_last("volume"), "kd")
    return cache.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def metric_candidates(striking: DataFrame, markets: DataFrame, cache: DataFrame, as_of: date, ttl_days: int, budget: int) -> DataFrame:
    """Striking-distance queries to price: once for each market, without fresh ones, best first within each market's budget."""
    rows = striking.join(markets, "site_id").groupBy(F.lower("query").alias("keyword"), "country").agg(F.sum("impressions").alias("impressions"))
    fresh = cache.filter(F.datediff(F.lit(as_of), "checked_at") <= ttl_days).select("keyword", "country").distinct()
    left = rows.join(fresh, ["keyword", "country"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("impressions"), "keyword"))).filter(F.col("place") <= budget)


def domain_metrics(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """Requested domains with their newest cached row; `loaded` tells which have one."""
    last = cache.groupBy("domain").agg(F.max_by(F.struct("dr", "links"), F.struct("last_seen", "provider")).alias("m"))
    return requested.select("domain").distinct().join(last, "domain", "left").select("domain", "m.dr", "m.links", F.col("m").isNotNull().alias("loaded"))


def union_keywords(sources: list[DataFrame]) -> DataFrame:
    """Union of keyword tables (keyword, volume) in order of priority, one row for each normalised keyword."""
    norm = F.trim(F.regexp_replace(F.lower("keyword"), r"\s+", " "))
    all_ = None
    for i, s in enumerate(sources):
        part = s.select("keyword", "volume", F.lit(i).alias("source"))
        all_ = part if all_ is None else all_.unionByName(part)
    w = Window.partitionBy("norm").orderBy("source", F.desc_nulls_last("volume"), "keyword")
    return all_.withColumn("norm", norm).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def execution_matrix(questions: DataFrame, providers: list[str], modes: list[str], repeats: int) -> DataFrame:
    """Every question with every provider, search mode and repeat; the three lists are fixed and short."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    return questions.select("*", F.explode(lits(providers)).alias("provider")).select("*", F.explode(lits(modes)).alias("mode")).select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))


def demand_trend(points: Column) -> Column:
    """Newer half of a volume series (array<struct<date,volume>>) against the older one, in whole percents; null for under six points."""
    v = F.transform(F.array_sort(F.filter(points, lambda p: p["volume"].isNotNull())), lambda p: p["volume"].cast("double"))
    half = F.floor(F.size(v) / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    old, new = mean(F.slice(v, 1, half)), mean(F.slice(v, F.size(v) - half + 1, half))
    return F.when(F.size(v) >= 6, F.when(old > 0, js_round((new - old) / old * 100, 0).cast("int")))


def spend_by_month(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """Spend of each user, provider and month (refunds reduce it, never below zero) against the user's cap."""
    t = ledger.groupBy("user_id", "provider", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("units").alias("u"))
    t = t.withColumn("units", F.greatest(F.col("u"), F.lit(0))).drop("u").join(caps, "user_id", "left")
    return t.withColumn("over_cap", F.coalesce(F.col("units") > F.col("cap"), F.lit(False)))


def field_support(rows: DataFrame, fields: list[str], least: int = 20) -> DataFrame:
    """Whether an endpoint ever fills a field: unsupported if null on all of at least `least` rows that have anything."""
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f).isNotNull()
    t = rows.groupBy("host", "endpoint").agg(F.count_if(some).alias("n"), *[F.bool_or(F.col(f).isNotNull()).alias(f) for f in fields])
    cols = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("seen")) for f in fields]))
    return t.select("host", "endpoint", "n", cols.alias("x")).select("host", "endpoint", "x.field", F.when(F.col("x.seen"), "supported").when(F.col("n") >= least, "unsupported").otherwise("unknown").alias("support"))


# ----------------------------------------------------------------------- links


def backlink_status(links: DataFrame, by: list[str]) -> DataFrame:
    """Counts of alive, dead, blocked and indexed links; rows without a state fall back on the old flag."""
    state = F.coalesce("state", F.when(F.col("is_alive"), "alive").otherwise("dead"))
    return links.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ("alive", "dead", "blocked")], F.count_if(F.coalesce("indexed", F.lit(False))).alias("indexed"))


def linking_domains(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("ref_domain").agg(F.countDistinct("target").alias("brands"), F.sum("links").alias("links"), F.max("dr").alias("max_dr"))


def outreach_stats(prospects: DataFrame, backlinks: DataFrame, as_of: date) -> DataFrame:
    """Campaign totals: prospects by state, due follow-ups, won links, conversion."""
    live = backlinks.select(F.col("ref_domain").alias("domain"), F.col("target").alias("site_id")).distinct().withColumn("linked", F.lit(True))
    p = prospects.join(live, ["site_id", "domain"], "left")
    won = F.col("linked") & (F.col("state") != "draft")
    t = p.groupBy("site_id", "campaign").agg(
        F.count("*").alias("prospects"), F.count_if(F.col("state") == "contacted").alias("contacted"), F.count_if(won).alias("won"), F.count_if((F.col("state") == "contacted") & (F.col("follow_up") <= F.lit(as_of))).alias("due")
    )
    return t.withColumn("conversion", js_round(F.when(F.col("prospects") > 0, F.col("won") / F.col("prospects") * 100).otherwise(0.0), 1))


def related_domains(prints: DataFrame) -> DataFrame:
    """Pairs of domains that share a fingerprint (domain, kind, value, strength), strong before weak.

    Left out, as the definition has it: name servers of providers that everybody uses, and
    addresses that belong to a CDN (an optional column behind_cdn says so).  How many share a
    value does not matter: each domain of a group is paired with the group's first one, so
    the links of a group stay linear in its size.
    """
    common = (F.col("kind") == "ns") & F.lower("value").rlike("|".join(x.replace(".", r"\.") for x in COMMON_DNS))
    if "behind_cdn" in prints.columns:
        common = common | ((F.col("kind") == "ip") & F.col("behind_cdn"))
    p = prints.filter(~F.coalesce(common, F.lit(False))).select("domain", "kind", "value", "strength").distinct()
    groups = p.groupBy("kind", "value").agg(F.min("domain").alias("first"), F.max("domain").alias("last")).filter("first <> last").drop("last")
    pairs = p.join(groups, ["kind", "value"]).filter("domain <> first").groupBy(F.col("first").alias("a"), F.col("domain").alias("b")).agg(
        F.max(F.when(F.col("strength") == "strong", 2).otherwise(1)).alias("s"), F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))), "|").alias("values")
    )
    return pairs.select("a", "b", F.when(F.col("s") == 2, "strong").otherwise("weak").alias("strength"), "shared", "values")


# -------------------------------------------------------------------- clusters


def overlap_edges(serps: DataFrame, least: int) -> DataFrame:
    """Keyword pairs that share at least `least` urls (keyword, url).

    Of a keyword's n urls, rarest first, only the first n - least + 1 make candidates: two keywords that
    share enough meet there, so a url that everybody ranks with makes hardly any.
    """
    s = serps.select("keyword", F.regexp_replace(F.lower("url"), "/+$", "").alias("url")).distinct()
    df = s.groupBy("url").agg(F.count("*").alias("df")).filter("df > 1")
    sets = s.join(df, "url").groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "url"))), lambda x: x["url"]).alias("urls")).filter(F.size("urls") >= least)
    first = sets.select("keyword", F.explode(F.slice("urls", 1, F.size("urls") - (least - 1))).alias("url"))
    pairs = first.select(F.col("keyword").alias("a"), "url").join(first.select(F.col("keyword").alias("b"), "url"), "url").filter("a < b").select("a", "b").distinct()
    side = lambda x: sets.select(F.col("keyword").alias(x), F.col("urls").alias(f"u_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("u_a", "u_b")).cast("bigint").alias("shared"))
    return both.filter(F.col("shared") >= least)


def cluster_by_serp(serps: DataFrame, volumes: DataFrame, least: int = 3, keep=None) -> DataFrame:
    """Greedy clusters in order of volume, in parallel rounds.

    Priority is (volume desc, keyword).  A keyword whose neighbours of higher priority
    are all settled and none a seed becomes a seed; a neighbour of a seed joins its first
    one.  Rounds go on until all are settled, with the same result as one keyword at a time.
    `keep` cuts lineage between rounds; by default a reliable checkpoint where a folder is set.
    """
    spark = serps.sparkSession
    keep = keep or (lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist())
    nodes = keep(volumes.select("keyword", F.struct((-F.coalesce("volume", F.lit(0))).alias("v"), "keyword").alias("p")).distinct())
    e = overlap_edges(serps, least).select("a", "b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = nodes.withColumnRenamed("p", "q")
    # towards neighbours of higher priority
    up = keep(both.join(nodes, F.col("a") == F.col("keyword")).drop("keyword").join(rank, F.col("b") == F.col("keyword")).filter("q < p").select(F.col("a"), F.col("b"), F.col("q")))
    state = keep(nodes.select("keyword", F.lit(None).cast("string").alias("seed")))
    while state.filter("seed is null").limit(1).count():
        known = state.select(F.col("keyword").alias("b"), "seed")
        seen = up.join(known, "b").groupBy(F.col("a").alias("keyword")).agg(
            F.count_if(F.col("seed").isNull()).alias("open"), F.min(F.when(F.col("seed") == F.col("b"), F.col("q"))).alias("s"), F.min(F.when(F.col("seed").isNull(), F.col("q"))).alias("first_open")
        )
        join_ = F.col("s").isNotNull() & (F.col("first_open").isNull() | (F.col("s") < F.col("first_open")))
        fresh = F.when(join_, F.col("s.keyword")).when(F.coalesce("open", F.lit(0)) == 0, F.col("keyword"))
        state = keep(state.join(seen, "keyword", "left").select("keyword", F.coalesce("seed", fresh).alias("seed")))
    return state


# Fixed page types of the kinds of sites that answer a query.
PAGE_TYPES = {"official_store": "product_offer", "aggregator": "aggregator_listing", "forum_ugc": "ugc_thread", "editorial": "guide", "monobrand": "brand_page"}


def serp_intent(results: DataFrame) -> DataFrame:
    """Dominant intent of each keyword's results (keyword, position, intent, site_type), their commonest page type and its share in whole percent.

    Transactional where half or more of the results want to sell (intent buy).  Of page types with equal counts the one that
    ranks first wins; without any site type the intent decides, with a share of 0.
    """
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PAGE_TYPES.items() for x in kv]), F.col("site_type")), F.nullif("site_type", F.lit("")))
    t = results.withColumn("page_type", label).groupBy("keyword", "page_type").agg(F.count("*").alias("n"), F.count_if(F.col("intent") == "buy").alias("buy"), F.min("position").alias("first"))
    known = F.col("page_type").isNotNull()
    best = F.max_by(F.struct("page_type", "n"), F.when(known, F.struct("n", (-F.col("first")).alias("first"), "page_type"))).alias("best")
    g = t.groupBy("keyword").agg(best, F.sum("n").alias("results"), F.sum("buy").alias("buy"))
    intent = F.when(2 * F.col("buy") >= F.col("results"), "transactional").otherwise("informational")
    plain = F.when(F.col("intent") == "transactional", "product_offer").otherwise("guide")
    return g.withColumn("intent", intent).select(
        "keyword", F.col("intent").alias("dominant_intent"), F.coalesce("best.page_type", plain).alias("page_type"), js_round(F.coalesce("best.n", F.lit(0)) / F.col("results") * 100, 0).cast("int").alias("share"), "results"
    )


def inspection_targets(page_day: DataFrame, sitemap: DataFrame, inspected: DataFrame, as_of: date, k: int = 20, ttl_days: int = 1) -> DataFrame:
    """The k pages of each site with most impressions, filled from its sitemap, without those inspected lately."""
    top = page_day.groupBy("site_id", "url").agg(F.sum("impressions").alias("score"))
    more = sitemap.select("site_id", "url").distinct().join(top, ["site_id", "url"], "left_anti").withColumn("score", F.lit(0))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "url"))
    best = top.unionByName(more).withColumn("place", place).filter(F.col("place") <= k)
    fresh = inspected.filter(F.datediff(F.lit(as_of), "inspected_on") < ttl_days).select("site_id", "url").distinct()
    return best.join(fresh, ["site_id", "url"], "left_anti")


def wanted_keywords(wanted: DataFrame, targets: DataFrame, tags: DataFrame) -> DataFrame:
    """Wanted keywords with their target page and sorted tags."""
    t = tags.groupBy("keyword").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return wanted.join(targets, "keyword", "left").join(t, "keyword", "left")


def pages_overview(pages: DataFrame, page_query: DataFrame, wanted: DataFrame, notes: DataFrame) -> DataFrame:
    """Pages with their counts of ranking and wanted keywords and whether they have a note."""
    r = page_query.groupBy("url").agg(F.countDistinct("query").alias("rankings"))
    w = wanted.groupBy("url").agg(F.count("*").alias("wanted"))
    n = notes.select("url").distinct().withColumn("has_note", F.lit(True))
    return pages.select("url").distinct().join(r, "url", "left").join(w, "url", "left").join(n, "url", "left").fillna(0, ["rankings", "wanted"]).fillna(False, ["has_note"])


def tag_filter(rows: DataFrame, tags: DataFrame, show: list[str] | None = None, hide: list[str] | None = None, key: str = "keyword") -> DataFrame:
    """Rows by tag (key, tag): show any of, hide any of; '' stands for untagged."""
    out, tagged = rows, tags.select(key).distinct()
    for names, keep in ((show, True), (hide, False)):
        if not names:
            continue
        hit = tags.filter(F.col("tag").isin([n for n in names if n])).select(key).distinct()
        if "" in names:
            bare = rows.select(key).distinct().join(tagged, key, "left_anti")
            hit = hit.unionByName(bare).distinct()
        out = out.join(hit, key, "left_semi" if keep else "left_anti")
    return out
