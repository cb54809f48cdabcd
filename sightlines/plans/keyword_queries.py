"""Registered queries of the keyword, link and answer operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sightlines.operators import answers as A
from sightlines.operators import keywords as W
from sightlines.operators import search as S

from . import facts
from .facts import AS_OF
from .registry import query
from .search_queries import R


def _pct(part: str, whole: str) -> str:
    return R(f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100 END", 1)


# Our positions, four times as far down as derived, so that some are out of reach; site4 has none.
_OWN_AT = f"""ow AS (SELECT site_id, keyword, min({{'p': p, 'u': url, 'i': i}}) AS b FROM (SELECT site_id, lower(trim(query)) AS keyword, url, CAST(sum(CAST(position * 4 AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS p, sum(impressions) AS i FROM page_query WHERE site_id <> 'site4' GROUP BY ALL) GROUP BY ALL)"""


def _far(spark, d):
    return facts.page_query(spark, d).filter("site_id <> 'site4'").withColumn("position", F.col("position") * 4)


@query("j7_keyword_gap", f"WITH {_OWN_AT} SELECT c.*, {R('b.p', 1)} AS own_position, b.u AS own_url, CASE WHEN b.p <= 30 THEN 'close' WHEN b.i > 0 THEN 'weak' ELSE 'missing' END AS verdict FROM competitor_keyword c LEFT JOIN ow USING (site_id, keyword)", "competitor_keyword page_query")
def j7_keyword_gap(spark, d):
    return W.keyword_gap(facts.competitor_keyword(spark, d), _far(spark, d)).select("competitor", "site_id", "keyword", "position", "volume", "own_position", "own_url", "verdict")


_J8 = f"""{_OWN_AT}, k AS (SELECT competitor, site_id, upper(keyword) || ' ' AS keyword FROM competitor_keyword), v AS (SELECT k.*, {R('b.p', 1)} AS own_position, b.u AS own_url, CASE WHEN k.site_id = 'site4' THEN NULL WHEN b IS NULL THEN 'none' WHEN {R('b.p', 1)} <= 30 THEN 'reach' ELSE 'wrong_page' END AS verdict FROM k LEFT JOIN ow ON ow.site_id = k.site_id AND ow.keyword = lower(trim(k.keyword)))"""


def _verdicts(spark, d):
    c = facts.competitor_keyword(spark, d).select("competitor", "site_id", F.concat(F.upper("keyword"), F.lit(" ")).alias("keyword"))
    return W.demand_verdicts(c, _far(spark, d))


@query("j8_demand_verdicts", f"WITH {_J8} SELECT * FROM v", "competitor_keyword page_query")
def j8_demand_verdicts(spark, d):
    return _verdicts(spark, d)


@query("a55_verdict_counts", f"WITH {_J8} SELECT site_id, verdict, count(*) AS keywords FROM v GROUP BY ALL", "competitor_keyword page_query")
def a55_verdict_counts(spark, d):
    return W.verdict_counts(_verdicts(spark, d))


@query("w16_best_keyword_metric", "SELECT * FROM keyword_metric QUALIFY row_number() OVER (PARTITION BY keyword, country ORDER BY kd IS NULL, checked_at DESC, provider, volume DESC NULLS LAST, kd) = 1", "keyword_metric")
def w16_best_keyword_metric(spark, d):
    return W.best_keyword_metric(facts.keyword_metric(spark, d))


@query(
    "a52_metric_candidates",
    """WITH s AS (SELECT site_id, query, CAST(sum(impressions) AS BIGINT) AS impressions FROM page_query WHERE pos10 BETWEEN 40 AND 200 GROUP BY site_id, query HAVING sum(impressions) >= 2), r AS (SELECT lower(query) AS keyword, 'c' || (right(site_id, 1)::INT % 2) AS country, CAST(sum(impressions) AS BIGINT) AS impressions FROM s GROUP BY ALL),
    f AS (SELECT DISTINCT 'q' || (k % 40) AS keyword, 'c0' AS country FROM event WHERE k % 3 = 0 AND date >= DATE '2024-01-20')
    SELECT *, CAST(row_number() OVER (PARTITION BY country ORDER BY impressions DESC, keyword) AS INTEGER) AS place FROM r ANTI JOIN f USING (keyword, country) QUALIFY place <= 15""",
    "page_query event",
)
def a52_metric_candidates(spark, d):
    near = S.striking_distance(facts.page_query(spark, d), min_impressions=2, limit=None, by_query=True)
    markets = spark.createDataFrame([(f"site{i}", f"c{i % 2}") for i in range(5)], "site_id string, country string")
    e = facts.event(spark, d).filter("k % 3 = 0")
    return W.metric_candidates(near, markets, e.select(F.col("query").alias("keyword"), F.lit("c0").alias("country"), F.col("date").alias("checked_at")), AS_OF, 10, 15)


@query("a53_domain_metrics", "WITH q AS (SELECT DISTINCT 'ref' || (user_id % 120) || '.example' AS domain FROM event), m AS (SELECT ref_domain AS domain, dr, links FROM ref_domain QUALIFY row_number() OVER (PARTITION BY ref_domain ORDER BY last_seen DESC, provider DESC, dr DESC, links DESC) = 1) SELECT domain, dr, links, m.domain IS NOT NULL AS loaded FROM q LEFT JOIN m USING (domain)", "event ref_domain")
def a53_domain_metrics(spark, d):
    q = facts.event(spark, d).select(F.concat(F.lit("ref"), (F.col("user_id") % 120).cast("string"), F.lit(".example")).alias("domain"))
    r = facts.ref_domain(spark, d).groupBy(F.col("ref_domain").alias("domain"), "last_seen", "provider").agg(F.max(F.struct("dr", "links")).alias("m")).select("domain", "last_seen", "provider", "m.dr", "m.links")
    return W.domain_metrics(q, r)


@query(
    "u4_union_keywords",
    """WITH a AS (SELECT upper(keyword) AS keyword, volume, 0 AS source FROM keyword_metric WHERE volume % 20 = 0 UNION ALL SELECT replace(keyword, ' ', '  '), volume + 1, 1 FROM keyword_metric WHERE volume % 30 = 0 UNION ALL SELECT query, NULL, 2 FROM page_query)
    SELECT keyword, volume, source, trim(regexp_replace(lower(keyword), '\\s+', ' ', 'g')) AS norm FROM a QUALIFY row_number() OVER (PARTITION BY norm ORDER BY source, volume DESC NULLS LAST, keyword) = 1""",
    "keyword_metric page_query",
)
def u4_union_keywords(spark, d):
    k = facts.keyword_metric(spark, d)
    a = k.filter("volume % 20 = 0").select(F.upper("keyword").alias("keyword"), "volume")
    b = k.filter("volume % 30 = 0").select(F.regexp_replace("keyword", " ", "  ").alias("keyword"), (F.col("volume") + 1).alias("volume"))
    return W.union_keywords([a, b, facts.page_query(spark, d).select(F.col("query").alias("keyword"), F.lit(None).cast("bigint").alias("volume"))])


@query("u5_execution_matrix", "SELECT question, provider, mode, CAST(r AS INTEGER) AS repeat FROM (SELECT DISTINCT question FROM aeo_check), (SELECT unnest(['a', 'b', 'c']) AS provider), (SELECT unnest(['on', 'off']) AS mode), generate_series(1, 2) g(r)", "aeo_check")
def u5_execution_matrix(spark, d):
    return W.execution_matrix(facts.aeo_check(spark, d).select("question").distinct(), ["a", "b", "c"], ["on", "off"], 2)


@query(
    "a40_demand_trend",
    f"""WITH m AS (SELECT query, date, sum(impressions) AS v, row_number() OVER (PARTITION BY query ORDER BY date) AS n, count(*) OVER (PARTITION BY query) AS c FROM page_query GROUP BY query, date),
    h AS (SELECT query, c, CAST(sum(v) FILTER (n <= c // 2) AS DOUBLE) / (c // 2) AS a, CAST(sum(v) FILTER (n > c - c // 2) AS DOUBLE) / (c // 2) AS b FROM m GROUP BY query, c) SELECT query, CAST(CASE WHEN c >= 6 AND a > 0 THEN {R('(b - a) / a * 100', 0)} END AS INTEGER) AS trend FROM h""",
    "page_query",
)
def a40_demand_trend(spark, d):
    v = facts.page_query(spark, d).groupBy("query", "date").agg(F.sum("impressions").alias("volume"))
    return v.groupBy("query").agg(F.collect_list(F.struct("date", "volume")).alias("points")).select("query", W.demand_trend(F.col("points")).alias("trend"))


@query(
    "a41_spend_by_month",
    "WITH t AS (SELECT 'u' || (user_id % 9) AS user_id, 'prov' || (user_id % 2) AS provider, strftime(ts, '%Y-%m') AS month, greatest(sum(CASE WHEN event_type = 'error' THEN -3 ELSE 1 END), 0) AS units FROM event GROUP BY ALL) SELECT user_id, provider, month, CAST(units AS BIGINT) AS units, CAST(300 AS BIGINT) AS cap, units > 300 AS over_cap FROM t",
    "event",
)
def a41_spend_by_month(spark, d):
    e = facts.event(spark, d).select(F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("user_id"), F.concat(F.lit("prov"), (F.col("user_id") % 2).cast("string")).alias("provider"), "ts", F.when(F.col("event_type") == "error", -3).otherwise(1).alias("units"))
    return W.spend_by_month(e, spark.createDataFrame([(f"u{i}", 300) for i in range(9)], "user_id string, cap bigint"))


@query(
    "a42_field_support",
    """WITH r AS (SELECT 'h' || (p_partkey % 4) AS host, 'e' || (p_size % 2) AS endpoint, CASE WHEN p_partkey % 4 <> 1 THEN p_size END AS volume, CASE WHEN p_partkey % 7 = 0 THEN 1 END AS cpc, CASE WHEN p_partkey % 4 = 3 THEN 2 END AS kd FROM part),
    t AS (SELECT host, endpoint, CAST(count_if(volume IS NOT NULL OR cpc IS NOT NULL OR kd IS NOT NULL) AS BIGINT) AS n, count(volume) > 0 AS volume, count(cpc) > 0 AS cpc, count(kd) > 0 AS kd FROM r GROUP BY ALL)
    SELECT host, endpoint, field, CASE WHEN seen THEN 'supported' WHEN n >= 20 THEN 'unsupported' ELSE 'unknown' END AS support FROM (SELECT host, endpoint, n, 'volume' AS field, volume AS seen FROM t UNION ALL SELECT host, endpoint, n, 'cpc', cpc FROM t UNION ALL SELECT host, endpoint, n, 'kd', kd FROM t)""",
)
def a42_field_support(spark, d):
    p, k = spark.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    rows = p.select(F.concat(F.lit("h"), (k % 4).cast("string")).alias("host"), F.concat(F.lit("e"), (F.col("p_size") % 2).cast("string")).alias("endpoint"), F.when(k % 4 != 1, F.col("p_size")).alias("volume"), F.when(k % 7 == 0, 1).alias("cpc"), F.when(k % 4 == 3, 2).alias("kd"))
    return W.field_support(rows, ["volume", "cpc", "kd"])


@query(
    "a37_backlink_status",
    """WITH b AS (SELECT 'site' || (o_custkey % 5) AS target, CASE o_orderkey % 4 WHEN 0 THEN 'alive' WHEN 1 THEN 'dead' WHEN 2 THEN 'blocked' END AS state, o_orderkey % 3 = 0 AS is_alive, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS indexed FROM orders),
    s AS (SELECT *, coalesce(state, CASE WHEN is_alive THEN 'alive' ELSE 'dead' END) AS st FROM b) SELECT target, count(*) AS total, CAST(count_if(st = 'alive') AS BIGINT) AS alive, CAST(count_if(st = 'dead') AS BIGINT) AS dead, CAST(count_if(st = 'blocked') AS BIGINT) AS blocked, CAST(count_if(coalesce(indexed, FALSE)) AS BIGINT) AS indexed FROM s GROUP BY target""",
)
def a37_backlink_status(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    links = o.select(F.concat(F.lit("site"), (F.col("o_custkey") % 5).cast("string")).alias("target"), F.when(k % 4 == 0, "alive").when(k % 4 == 1, "dead").when(k % 4 == 2, "blocked").alias("state"), (k % 3 == 0).alias("is_alive"), F.when(k % 5 != 0, k % 2 == 0).alias("indexed"))
    return W.backlink_status(links, ["target"])


@query("a38_linking_domains", "SELECT ref_domain, count(DISTINCT target) AS brands, CAST(sum(links) AS BIGINT) AS links, max(dr) AS max_dr FROM ref_domain GROUP BY ref_domain", "ref_domain")
def a38_linking_domains(spark, d):
    return W.linking_domains(facts.ref_domain(spark, d))


@query(
    "j28_outreach_stats",
    f"""WITH p AS (SELECT 'site' || (o_custkey % 5) AS site_id, 'ref' || (o_custkey % 150) || '.example' AS domain, 'camp' || (o_orderkey % 3) AS campaign, ['draft', 'contacted', 'replied'][1 + o_orderkey % 3] AS state, DATE '2024-01-20' + CAST(o_orderkey % 30 AS INTEGER) AS follow_up FROM orders),
    l AS (SELECT DISTINCT ref_domain AS domain, target AS site_id, TRUE AS linked FROM ref_domain),
    t AS (SELECT site_id, campaign, count(*) AS prospects, CAST(count_if(state = 'contacted') AS BIGINT) AS contacted, CAST(count_if(linked AND state <> 'draft') AS BIGINT) AS won, CAST(count_if(state = 'contacted' AND follow_up <= DATE '2024-01-30') AS BIGINT) AS due FROM p LEFT JOIN l USING (domain, site_id) GROUP BY ALL)
    SELECT *, {R('CAST(won AS DOUBLE) / prospects * 100', 1)} AS conversion FROM t""",
    "ref_domain",
)
def j28_outreach_stats(spark, d):
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey")
    states = F.array(F.lit("draft"), F.lit("contacted"), F.lit("replied"))
    p = o.select(
        F.concat(F.lit("site"), (F.col("o_custkey") % 5).cast("string")).alias("site_id"), F.concat(F.lit("ref"), (F.col("o_custkey") % 150).cast("string"), F.lit(".example")).alias("domain"), F.concat(F.lit("camp"), (k % 3).cast("string")).alias("campaign"),
        F.element_at(states, (k % 3 + 1).cast("int")).alias("state"), F.date_add(F.lit(date(2024, 1, 20)), (k % 30).cast("int")).alias("follow_up"),
    )
    return W.outreach_stats(p, facts.ref_domain(spark, d), AS_OF)


@query(
    "j22_related_domains",
    """WITH p AS (SELECT DISTINCT 'd' || c_custkey AS domain, 'ads' AS kind, 'pub' || (c_custkey % 400) AS value, 'strong' AS strength FROM customer UNION SELECT DISTINCT 'd' || c_custkey, 'ns', 'ns' || c_nationkey, 'weak' FROM customer UNION SELECT 'd' || c_custkey, 'ip', 'ip' || (c_custkey % 300), 'weak' FROM customer),
    s AS (SELECT *, count(*) OVER w AS n, min(domain) OVER w AS first FROM p WINDOW w AS (PARTITION BY kind, value) QUALIFY n >= 2)
    SELECT first AS a, domain AS b, CASE WHEN bool_or(strength = 'strong') THEN 'strong' ELSE 'weak' END AS strength, count(*) AS shared, string_agg(DISTINCT kind || ':' || value, '|' ORDER BY kind || ':' || value) AS "values" FROM s WHERE domain <> first GROUP BY 1, 2""",
)
def j22_related_domains(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey")
    tag = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    kinds = F.array(F.struct(F.lit("ads").alias("kind"), tag("pub", key % 400).alias("value"), F.lit("strong").alias("strength")), F.struct(F.lit("ns").alias("kind"), tag("ns", F.col("c_nationkey")).alias("value"), F.lit("weak").alias("strength")), F.struct(F.lit("ip").alias("kind"), tag("ip", key % 300).alias("value"), F.lit("weak").alias("strength")))
    prints = c.select(tag("d", key).alias("domain"), F.explode(kinds).alias("x")).select("domain", "x.*")
    return W.related_domains(prints)


def serps(spark, d):
    """Keyword results: the pages that each query was seen with often."""
    q = facts.page_query(spark, d).groupBy("query", "url").agg(F.sum("impressions").alias("n")).filter(F.col("n") >= 4)
    return q.select(F.col("query").alias("keyword"), "url")


@query("j23_overlap_edges", "WITH s AS (SELECT query AS keyword, lower(url) AS url FROM page_query GROUP BY query, url HAVING sum(impressions) >= 4) SELECT a.keyword AS a, b.keyword AS b, count(*) AS shared FROM s a JOIN s b USING (url) WHERE a.keyword < b.keyword GROUP BY ALL HAVING count(*) >= 16", "page_query")
def j23_overlap_edges(spark, d):
    return W.overlap_edges(serps(spark, d), 16)


@query(
    "j23_cluster_by_serp",
    """WITH RECURSIVE sp AS (SELECT query AS keyword, url FROM page_query GROUP BY ALL HAVING sum(impressions) >= 4), ed AS (SELECT x.keyword AS a, y.keyword AS b FROM sp x JOIN sp y ON x.url = y.url AND x.keyword <> y.keyword GROUP BY ALL HAVING count(*) >= 16),
    nb AS (SELECT a, list(b) AS nb FROM ed GROUP BY a), o AS (SELECT query AS keyword, row_number() OVER (ORDER BY sum(impressions) DESC, query) AS i FROM page_query GROUP BY query), q AS (SELECT o.keyword, i, coalesce(nb, []) AS nb FROM o LEFT JOIN nb ON a = keyword),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seeds, CAST(NULL AS VARCHAR) AS keyword, CAST(NULL AS VARCHAR) AS seed UNION ALL SELECT q.i, CASE WHEN list_has_any(seeds, nb) THEN seeds ELSE list_append(seeds, q.keyword) END, q.keyword, coalesce(list_filter(seeds, lambda s: list_contains(nb, s))[1], q.keyword) FROM r JOIN q ON q.i = r.i + 1)
    SELECT keyword, seed FROM r WHERE keyword IS NOT NULL""",
    "page_query",
)
def j23_cluster_by_serp(spark, d):
    v = facts.page_query(spark, d).groupBy(F.col("query").alias("keyword")).agg(F.sum("impressions").alias("volume"))
    return W.cluster_by_serp(serps(spark, d), v, 16)


_SITES = ["official_store", "aggregator", "forum_ugc", "editorial", "monobrand", "own_kind", "", None]


@query(
    "a45_serp_intent",
    f"""WITH r AS (SELECT query || '-' || (user_id % 20) AS keyword, event_id AS position, CASE WHEN k % 2 = 0 THEN 'buy' WHEN k % 3 = 0 THEN 'info' END AS intent, CASE WHEN user_id % 20 <> 7 THEN [{", ".join("NULL" if x is None else f"'{x}'" for x in _SITES)}][1 + CAST(k AS INT) % 8] END AS site FROM event),
    t AS (SELECT keyword, position, intent, CASE site {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.PAGE_TYPES.items())} WHEN '' THEN NULL ELSE site END AS page_type FROM r), c AS (SELECT keyword, page_type, count(*) AS n FROM t WHERE page_type IS NOT NULL GROUP BY keyword, page_type QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY count(*) DESC, min(position)) = 1),
    a AS (SELECT keyword, count(*) AS results, CASE WHEN avg(CASE WHEN intent = 'buy' THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'transactional' ELSE 'informational' END AS dominant_intent FROM t GROUP BY keyword)
    SELECT keyword, dominant_intent, coalesce(page_type, CASE dominant_intent WHEN 'transactional' THEN 'product_offer' ELSE 'guide' END) AS page_type, CAST(floor(coalesce(n, 0) * 100.0::DOUBLE / results + 0.5) AS INTEGER) AS share, results FROM a LEFT JOIN c USING (keyword)""",
    "event",
)
def a45_serp_intent(spark, d):
    k, u = F.col("k"), F.col("user_id") % 20
    site = F.when(u != 7, F.element_at(F.array(*map(F.lit, _SITES)), (k % 8 + 1).cast("int")))
    r = facts.event(spark, d).select(F.concat_ws("-", "query", u.cast("string")).alias("keyword"), F.col("event_id").alias("position"), F.when(k % 2 == 0, "buy").when(k % 3 == 0, "info").alias("intent"), site.alias("site_type"))
    return W.serp_intent(r)


@query(
    "a54_inspection_targets",
    """WITH t AS (SELECT site_id, url, CAST(sum(impressions) AS BIGINT) AS score FROM page_day WHERE url LIKE '%p1%' GROUP BY ALL), s AS (SELECT DISTINCT site_id, url FROM page_day), m AS (SELECT * FROM t UNION ALL SELECT site_id, url, 0 FROM s ANTI JOIN t USING (site_id, url)),
    b AS (SELECT *, CAST(row_number() OVER (PARTITION BY site_id ORDER BY score DESC, url) AS INTEGER) AS place FROM m QUALIFY place <= 12) SELECT * FROM b ANTI JOIN (SELECT DISTINCT site_id, url FROM page_day WHERE date = DATE '2024-01-30') f USING (site_id, url)""",
    "page_day",
)
def a54_inspection_targets(spark, d):
    p = facts.page_day(spark, d)
    return W.inspection_targets(p.filter(F.col("url").contains("p1")), p, p.select("site_id", "url", F.col("date").alias("inspected_on")), AS_OF, 12)


@query(
    "j24_wanted_keywords",
    "WITH w AS (SELECT DISTINCT query AS keyword FROM event), t AS (SELECT query AS keyword, min(url) AS target_url FROM event WHERE k % 2 = 0 GROUP BY query), g AS (SELECT query AS keyword, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM event WHERE k % 3 = 0 GROUP BY query) SELECT keyword, target_url, tags FROM w LEFT JOIN t USING (keyword) LEFT JOIN g USING (keyword)",
    "event",
)
def j24_wanted_keywords(spark, d):
    e = facts.event(spark, d).withColumn("keyword", F.col("query"))
    return W.wanted_keywords(e.select("keyword").distinct(), e.filter("k % 2 = 0").groupBy("keyword").agg(F.min("url").alias("target_url")), e.filter("k % 3 = 0").select("keyword", F.col("event_type").alias("tag")))


@query(
    "j25_pages_overview",
    "WITH p AS (SELECT DISTINCT url FROM page_day), r AS (SELECT url, count(DISTINCT query) AS rankings FROM page_query WHERE pos10 < 60 GROUP BY url), w AS (SELECT url, count(*) AS wanted FROM page_query WHERE pos10 > 290 GROUP BY url), n AS (SELECT DISTINCT url, TRUE AS has_note FROM page_day WHERE clicks > 4) SELECT url, coalesce(rankings, 0) AS rankings, coalesce(wanted, 0) AS wanted, coalesce(has_note, FALSE) AS has_note FROM p LEFT JOIN r USING (url) LEFT JOIN w USING (url) LEFT JOIN n USING (url)",
    "page_day page_query",
)
def j25_pages_overview(spark, d):
    p, q = facts.page_day(spark, d), facts.page_query(spark, d)
    return W.pages_overview(p, q.filter("pos10 < 60"), q.filter("pos10 > 290"), p.filter("clicks > 4"))


@query("p7_tag_filter", "WITH k AS (SELECT DISTINCT query AS keyword FROM event), t AS (SELECT DISTINCT query AS keyword, 't' || (k % 5) AS tag FROM event WHERE k % 4 <> 0) SELECT keyword FROM k WHERE (keyword IN (SELECT keyword FROM t WHERE tag = 't1') OR keyword NOT IN (SELECT keyword FROM t)) AND keyword NOT IN (SELECT keyword FROM t WHERE tag = 't3')", "event")
def p7_tag_filter(spark, d):
    e = facts.event(spark, d).withColumn("keyword", F.col("query"))
    return W.tag_filter(e.select("keyword").distinct(), e.filter("k % 4 <> 0").select("keyword", F.concat(F.lit("t"), (F.col("k") % 5).cast("string")).alias("tag")), show=["t1", ""], hide=["t3"])


# --------------------------------------------------------------------- answers

_HOST = "regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^www\\.', '')"
_OWN = "(host = 'site0.example' OR ends_with(host, '.site0.example'))"
OWN = ["site0.example"]


@query(
    "a31_ai_metrics",
    f"""WITH o AS (SELECT check_id, count_if(host = 'site0.example') AS own, count(*) AS cites FROM (SELECT *, {_HOST} AS host FROM citation) GROUP BY check_id), g AS (SELECT c.*, own, cites FROM aeo_check c LEFT JOIN o USING (check_id))
    SELECT engine, count(*) AS answers, {_pct("count_if(verdict IN ('cited', 'mentioned'))", 'count(*)')} AS mention_rate, {_pct("count_if(verdict = 'cited')", 'count(*)')} AS citation_rate, {_pct('coalesce(sum(own), 0)', 'coalesce(sum(cites), 0)')} AS first_party_rate, CAST(coalesce(sum(cites), 0) AS BIGINT) AS citations FROM g GROUP BY engine""",
    "aeo_check citation",
)
def a31_ai_metrics(spark, d):
    return A.ai_metrics(facts.aeo_check(spark, d), facts.citation(spark, d), "site0.example", ["engine"])


# Lists of two sources a and b in the forms of providers, and answers; {n} is the check's number.
_LISTS = [
    '["{a}", "{b}", 5, null]', '{"citations": [{"url": "{a}"}, {"domain": "User@{h}:80."}]}', '{"citations": [], "sources": ["{b}", {"title": "no address"}]}', "{a}\n  {b}  \n\n", "  ", None, '{"url": "{b}", "domain": ""}', '"{a}"', '{"citations": {"url": "{a}"}}', '[{"url": "{a}", "domain": "WWW.ref{n}.example"}, {"url": "{a}"}, ["{b}"]]', "[]",
]
_ANSWER = "See {a}, (https:\\/\\/x{n}.example/y) and {b}."
_FILL = lambda t: f"replace(replace(replace(replace({t}, '{{a}}', a), '{{b}}', b), '{{h}}', 'site0.example'), '{{n}}', CAST(check_id % 4 AS VARCHAR))"
_SOURCE_HOST = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(CASE WHEN contains(lower(trim({0})), '://') THEN lower(trim({0})) ELSE 'https://' || lower(trim({0})) END, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[^:\\]]*$', ''), '\\.+$', '')".format
_LIST_SQL = ", ".join("NULL" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _LISTS)
_RESPONSE = f"""rp AS (SELECT c.check_id, question, engine, CASE WHEN c.check_id % 7 = 0 THEN 'error' ELSE 'success' END AS provider_status, {_FILL(f"[{_LIST_SQL}][1 + CAST(c.check_id % {len(_LISTS)} AS INTEGER)]")} AS citations, CASE WHEN c.check_id % 3 <> 0 THEN {_FILL("'" + _ANSWER + "'")} END AS raw_answer FROM (SELECT check_id, min(question) AS question, min(engine) AS engine, min(url) AS a, max(url) AS b FROM citation GROUP BY check_id) c),
 it AS (SELECT *, CASE WHEN trim(coalesce(citations, '')) = '' THEN [] WHEN NOT json_valid(citations) THEN [to_json(x) FOR x IN list_filter([trim(y) FOR y IN string_split(citations, chr(10))], lambda y: y <> '')] WHEN json_type(citations) = 'ARRAY' THEN json_extract(citations, '$[*]') WHEN json_type(citations) <> 'OBJECT' THEN []
   WHEN coalesce(CAST(citations->'$.citations' AS VARCHAR), '[]') <> '[]' THEN CASE WHEN json_type(citations->'$.citations') = 'ARRAY' THEN json_extract(citations, '$.citations[*]') ELSE [] END WHEN coalesce(CAST(citations->'$.sources' AS VARCHAR), '[]') <> '[]' THEN json_extract(citations, '$.sources[*]') ELSE [CAST(citations AS JSON)] END AS items FROM rp),
 ls AS (SELECT *, list_filter([nullif({_SOURCE_HOST("coalesce(CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' ELSE coalesce(nullif(x->>'$.domain', ''), x->>'$.url') END, '')")}, '') FOR x IN list_filter(items, lambda y: json_type(y) IN ('VARCHAR', 'OBJECT'))], lambda z: z IS NOT NULL) AS listed FROM it),
 sp AS (SELECT *, CASE WHEN len(listed) > 0 THEN listed ELSE [{_SOURCE_HOST('u')} FOR u IN list_distinct([regexp_replace(u, '[.,;:''"]+$', '') FOR u IN regexp_extract_all(replace(replace(coalesce(raw_answer, ''), '\\:', ':'), '\\/', '/'), 'https?://[^\\s<>"\\])]+')])] END AS domains FROM ls),
 rs AS (SELECT *, len(domains) > 0 AS usable, len(list_filter(domains, lambda h: h = 'site0.example' OR ends_with(h, '.site0.example'))) > 0 AS own FROM sp)"""


def responses(spark, d):
    """An answer for every check, its sources listed in the form of its number."""
    t = facts.citation(spark, d).groupBy("check_id").agg(F.min("question").alias("question"), F.min("engine").alias("engine"), F.min("url").alias("a"), F.max("url").alias("b"))
    fill = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")), F.lit("{h}"), F.lit("site0.example")), F.lit("{n}"), (F.col("check_id") % 4).cast("string"))
    form = F.element_at(F.array(*map(F.lit, _LISTS)), (F.col("check_id") % len(_LISTS) + 1).cast("int"))
    status = F.when(F.col("check_id") % 7 == 0, "error").otherwise("success")
    return t.select("check_id", "question", "engine", status.alias("provider_status"), fill(form).alias("citations"), F.when(F.col("check_id") % 3 != 0, fill(F.lit(_ANSWER))).alias("raw_answer"))


@query("a32_source_analysis", f"WITH {_RESPONSE} SELECT question, CAST(count_if(provider_status = 'success' AND usable AND own) AS BIGINT) AS numerator, CAST(count_if(provider_status = 'success' AND usable) AS BIGINT) AS denominator, CAST(count_if(provider_status = 'success' AND usable AND own) AS DOUBLE) / nullif(count_if(provider_status = 'success' AND usable), 0) * 100 AS percentage FROM rs GROUP BY question", "citation")
def a32_source_analysis(spark, d):
    return A.source_analysis(responses(spark, d), OWN, ["question"])


@query("a32_answer_sources", f"WITH {_RESPONSE} SELECT check_id, CAST(len(domains) AS INTEGER) AS sources, CASE WHEN usable THEN own END AS company_source, array_to_string(list_sort(list_distinct(list_filter(domains, lambda h: NOT (h = 'site0.example' OR ends_with(h, '.site0.example'))))), ',') AS external FROM rs", "citation")
def a32_answer_sources(spark, d):
    return A.answer_sources(responses(spark, d), OWN).select("check_id", F.size("sources").alias("sources"), "company_source", F.array_join("external", ",").alias("external"))


@query("a56_external_domains", f"WITH {_RESPONSE}, x AS (SELECT question, check_id, unnest(domains) AS domain FROM rs) SELECT question, domain, count(DISTINCT check_id) AS responses, count(*) AS citations FROM x WHERE NOT (domain = 'site0.example' OR ends_with(domain, '.site0.example')) GROUP BY ALL", "citation")
def a56_external_domains(spark, d):
    return A.external_domains(responses(spark, d), OWN, ["question"])


# Providers of every question; a fifth of the checks finds a concept, one provider of some questions finds none.
_CON = """cn AS (SELECT question, engine, 'c' || (check_id % 17) AS concept, check_id % 5 = 0 AND NOT (question LIKE '%3' AND engine = 'engine1') AS present FROM aeo_check), st AS (SELECT question, engine, coalesce(list(DISTINCT concept) FILTER (present), []) AS c FROM cn GROUP BY ALL),
 pr AS (SELECT a.question, CASE WHEN len(a.c) + len(b.c) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.c, b.c)) AS DOUBLE) / len(list_distinct(list_concat(a.c, b.c))) END AS j FROM st a JOIN st b ON a.question = b.question AND a.engine < b.engine),
 ag AS (SELECT question, floor(CAST(sum(CAST(j AS DECIMAL(20,12))) AS DOUBLE) / count(*) * 1000.0 + 0.5) / 1000.0 AS consistency, count(*) AS pairs FROM pr GROUP BY question),
 ea AS (SELECT question, concept, count(DISTINCT CASE WHEN present THEN engine END) AS n FROM cn GROUP BY ALL), nn AS (SELECT question, count(*) AS engines FROM st GROUP BY question),
 cm AS (SELECT question, any_value(engines) AS engines, CAST(count_if(n = engines) AS BIGINT) AS shared, CAST(count_if(n = 1 AND engines > 1) AS BIGINT) AS specific, CAST(count_if(n <> engines AND n <> 1) AS BIGINT) AS inconsistent, count(*) AS concepts FROM ea JOIN nn USING (question) GROUP BY question),
 fn AS (SELECT cm.*, consistency, pairs FROM cm LEFT JOIN ag USING (question))"""


def _concepts(spark, d):
    c = facts.aeo_check(spark, d)
    present = (F.col("check_id") % 5 == 0) & ~(F.col("question").endswith("3") & (F.col("engine") == "engine1"))
    return A.concept_metrics(c.select("question", "engine", F.concat(F.lit("c"), (F.col("check_id") % 17).cast("string")).alias("concept"), present.alias("present")))


@query("a33_concept_metrics", f"WITH {_CON} SELECT * FROM fn", "aeo_check")
def a33_concept_metrics(spark, d):
    return _concepts(spark, d)


@query(
    "a34_consistency_rollup",
    f"WITH {_CON} SELECT 'f' || (length(question) % 2) AS family, count(*) AS questions, {R('CAST(sum(CAST(round(consistency * 1000) AS BIGINT)) AS DOUBLE) / (1000 * count(consistency))', 3)} AS consistency, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(specific) AS BIGINT) AS specific FROM fn GROUP BY 1",
    "aeo_check",
)
def a34_consistency_rollup(spark, d):
    m = _concepts(spark, d)
    fam = facts.aeo_check(spark, d).select("question").distinct().withColumn("family", F.concat(F.lit("f"), (F.length("question") % 2).cast("string")))
    return A.consistency_rollup(m, fam)


@query(
    "a35_share_of_voice",
    f"WITH b AS (SELECT DISTINCT 'brand' || (user_id % 15) AS brand FROM event), n AS (SELECT 'brand' || (user_id % 11) AS brand, count(*) AS mentions FROM event GROUP BY 1), t AS (SELECT brand, coalesce(mentions, 0) AS mentions FROM b LEFT JOIN n USING (brand)), s AS (SELECT sum(mentions) AS total FROM t) SELECT brand, mentions, {R('CAST(mentions AS DOUBLE) / total * 100', 1)} AS share FROM t, s",
    "event",
)
def a35_share_of_voice(spark, d):
    brand = lambda n: F.concat(F.lit("brand"), (F.col("user_id") % n).cast("string")).alias("brand")
    e = facts.event(spark, d)
    return A.share_of_voice(e.select(brand(11)), e.select(brand(15)))


@query(
    "a36_citation_landscape",
    f"""WITH d AS (SELECT question, {_HOST} AS domain, count(*) AS n FROM citation GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, domain) AS place FROM d),
    t AS (SELECT question, count(*) AS domains, CAST(sum(n) AS BIGINT) AS citations, CAST(sum(n) FILTER (place <= 3) AS DOUBLE) / sum(n) AS c, max(domain) FILTER (place = 1) AS top_domain FROM p GROUP BY question)
    SELECT question, domains, citations, top_domain, CAST({R('c * 100', 0)} AS INTEGER) AS top3_share FROM t""",
    "citation",
)
def a36_citation_landscape(spark, d):
    return A.citation_landscape(facts.citation(spark, d))


# What a search found is every citation's host and, of every seventh, a forum; what was opened is every third citation.
_TOUCH = f"""sc AS (SELECT question, {_HOST} AS domain FROM citation UNION ALL SELECT question, 'forum' || (check_id % 5) || '.example' FROM citation WHERE check_id % 7 = 0), ci AS (SELECT question, {_HOST} AS domain FROM citation WHERE check_id % 2 = 0), op AS (SELECT question, {_HOST} AS domain FROM citation WHERE check_id % 3 = 0 AND check_id < 300),
 tc AS (SELECT question, domain, CAST(count_if(how = 1) AS BIGINT) AS cites, bool_or(how = 1) AS cited, bool_or(how = 2) AS scanned, bool_or(how = 3) AS opened, CASE WHEN contains(domain, 'forum') THEN 'forum' ELSE 'other' END AS type FROM (SELECT *, 1 AS how FROM ci UNION ALL SELECT *, 2 FROM sc UNION ALL SELECT *, 3 FROM op) GROUP BY question, domain)"""


def _research(spark, d):
    c = facts.citation(spark, d)
    forum = c.filter("check_id % 7 = 0").select("question", F.concat(F.lit("https://forum"), (F.col("check_id") % 5).cast("string"), F.lit(".example/t")).alias("url"))
    return c.filter("check_id % 2 = 0"), c.select("question", "url").unionByName(forum), c.filter("check_id % 3 = 0 and check_id < 300")


@query("a36_source_types", f"WITH {_TOUCH} SELECT question, type, CAST(sum(cites) AS BIGINT) AS cites, count(*) AS domains, CAST(CASE WHEN sum(sum(cites)) OVER (PARTITION BY question) > 0 THEN {R('CAST(sum(cites) AS DOUBLE) / sum(sum(cites)) OVER (PARTITION BY question) * 100', 0)} ELSE 0 END AS INTEGER) AS pct FROM tc GROUP BY question, type", "citation")
def a36_source_types(spark, d):
    return A.source_types(*_research(spark, d))


@query(
    "a36_domain_trust",
    f"""WITH {_TOUCH}, t AS (SELECT *, {R('0.5::DOUBLE * cited::INT + 0.2::DOUBLE * cites / greatest(1, max(cites) OVER (PARTITION BY question)) + 0.15::DOUBLE * scanned::INT + 0.10::DOUBLE * opened::INT + 0.05::DOUBLE * scanned::INT', 2)} AS trust FROM tc)
    SELECT question, domain, type, cited, opened, cites, trust, CAST(row_number() OVER (PARTITION BY question ORDER BY trust DESC, cites DESC, domain) AS INTEGER) AS place FROM t QUALIFY place <= 12""",
    "citation",
)
def a36_domain_trust(spark, d):
    return A.domain_trust(*_research(spark, d))


@query(
    "a58_answer_coverage",
    """WITH t AS (SELECT site_id, count(DISTINCT engine) AS providers, count(*) AS runs, CAST(count_if(error IS NULL) AS BIGINT) AS valid, CAST(coalesce(sum(check_id % 3) FILTER (error IS NULL), 0) AS BIGINT) AS answers FROM aeo_check GROUP BY site_id) SELECT *, providers * 400 AS expected, answers >= providers * 400 AND valid = runs AS complete FROM t""",
    "aeo_check",
)
def a58_answer_coverage(spark, d):
    c = facts.aeo_check(spark, d)
    return A.answer_coverage(c.select("site_id", "engine", F.col("error").isNull().alias("valid"), (F.col("check_id") % 3).alias("answers")), 400)


@query(
    "a59_citation_sentiment",
    f"""WITH r AS (SELECT {_HOST} AS domain, check_id % 5 AS positive, check_id % 3 AS neutral, check_id % 4 AS negative, check_id % 7 AS joy, check_id % 6 AS fear, check_id % 9 AS anger FROM citation),
    e AS (SELECT domain, CASE WHEN greatest(positive, neutral, negative) <= 0 THEN 'neutral' WHEN positive >= greatest(neutral, negative) THEN 'positive' WHEN neutral >= negative THEN 'neutral' ELSE 'negative' END AS polarity, CASE WHEN greatest(joy, fear, anger) <= 0 THEN NULL WHEN joy >= greatest(fear, anger) THEN 'joy' WHEN fear >= anger THEN 'fear' ELSE 'anger' END AS emotion FROM r), t AS (SELECT domain, polarity, emotion, count(*) AS n FROM e GROUP BY ALL)
    SELECT domain, polarity, CAST(sum(n) AS BIGINT) AS pages, arg_max(emotion, (n, emotion)) FILTER (emotion IS NOT NULL) AS top_emotion FROM t GROUP BY ALL""",
    "citation",
)
def a59_citation_sentiment(spark, d):
    i = F.col("check_id")
    c = facts.citation(spark, d).select(A.host_of(F.col("url")).alias("domain"), (i % 5).alias("positive"), (i % 3).alias("neutral"), (i % 4).alias("negative"), (i % 7).alias("joy"), (i % 6).alias("fear"), (i % 9).alias("anger"))
    return A.citation_sentiment(c, ["joy", "fear", "anger"])


@query(
    "f12_aeo_verdict",
    f"""WITH l AS (SELECT check_id, question, list({_HOST} ORDER BY url) AS h FROM citation GROUP BY ALL), v AS (SELECT check_id, list_position(list_transform(list_distinct_ordered, lambda x: x = 'site0.example' OR ends_with(x, '.site0.example')), TRUE) AS p, question FROM (SELECT check_id, question, CASE WHEN len(h) = 2 AND h[1] = h[2] THEN [h[1]] ELSE h END AS list_distinct_ordered FROM l))
    SELECT check_id, CASE WHEN p > 0 THEN 'cited' WHEN regexp_matches(question, '(^|[^0-9])1([^0-9]|$)') THEN 'mentioned' ELSE 'absent' END AS verdict, CASE WHEN p > 0 THEN CAST(p AS BIGINT) END AS rank FROM v""",
    "citation",
)
def f12_aeo_verdict(spark, d):
    c = facts.citation(spark, d).groupBy("check_id", "question").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    v = A.aeo_verdict(F.col("question"), F.lit("1"), F.lit("site0.example"), F.col("urls"))
    return c.withColumn("v", v).select("check_id", "v.verdict", "v.rank")


@query("f11_links_from_text", "SELECT DISTINCT check_id, unnest([url, 'http://x.example/' || check_id]) AS link FROM citation", "citation")
def f11_links_from_text(spark, d):
    c = facts.citation(spark, d).select("check_id", F.concat(F.lit("See "), "url", F.lit(", and (http://x.example/"), F.col("check_id").cast("string"), F.lit("). Again: "), "url", F.lit(".")).alias("text"))
    return c.select("check_id", F.explode(A.links_from_text(F.col("text"))).alias("link")).distinct()
