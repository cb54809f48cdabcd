"""Registered queries of the change operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sightlines.operators import change as C

from . import facts
from .facts import AS_OF
from .registry import query


@query("s3_upsert_latest", "SELECT site_id, query, url, date, clicks FROM page_query QUALIFY row_number() OVER (PARTITION BY site_id, query, url ORDER BY date DESC) = 1", "page_query")
def s3_upsert_latest(spark, d):
    return C.upsert_latest(facts.page_query(spark, d), ["site_id", "query", "url"], "date").select("site_id", "query", "url", "date", "clicks")


@query(
    "s1_replace_range",
    """SELECT site_id, date, clicks FROM site_day WHERE NOT (date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND site_id IN ('site1', 'site2'))
    UNION ALL SELECT site_id, date, clicks + 100 FROM site_day WHERE site_id IN ('site1', 'site2') AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND day(date) % 2 = 0""",
    "site_day",
)
def s1_replace_range(spark, d):
    old = facts.site_day(spark, d).select("site_id", "date", "clicks")
    new = old.filter(F.col("site_id").isin("site1", "site2") & (F.dayofmonth("date") % 2 == 0)).withColumn("clicks", F.col("clicks") + 100)
    return C.replace_range(old, new, date(2024, 1, 10), date(2024, 1, 20))


@query("s2_plan_backfill", "SELECT site_id, max(date) FILTER (user_id % 3 = 0 OR date < DATE '2023-12-01') AS last_date, CASE WHEN DATE '2024-01-30' - max(date) FILTER (user_id % 3 = 0 OR date < DATE '2023-12-01') <= 30 THEN 30 ELSE 480 END AS days FROM (SELECT 'site' || (user_id % 7) AS site_id, date, user_id % 7 AS user_id FROM event) GROUP BY 1", "event")
def s2_plan_backfill(spark, d):
    e = facts.event(spark, d).select(F.concat(F.lit("site"), (F.col("user_id") % 7).cast("string")).alias("site_id"), "date", (F.col("user_id") % 7).alias("u"))
    return C.plan_backfill(e.select("site_id").distinct(), e.filter("u % 3 = 0").select("site_id", "date"), AS_OF)


@query(
    "s4_reconcile_archive",
    """WITH k AS (SELECT DISTINCT 'u' || (user_id % 4) AS user_id, 's' || user_id AS site_id, user_id % 6 = 0 AS archived, user_id % 5 <> 0 AND user_id % 4 <> 3 AS live, user_id % 4 = 2 AS failed FROM event)
    SELECT user_id, site_id, CASE WHEN failed OR user_id = 'u3' THEN archived ELSE NOT live END AS archived, NOT (failed OR user_id = 'u3') AND (NOT live) <> archived AS changed FROM k""",
    "event",
)
def s4_reconcile_archive(spark, d):
    u = F.col("user_id")
    k = facts.event(spark, d).select(F.concat(F.lit("u"), (u % 4).cast("string")).alias("o"), F.concat(F.lit("s"), u.cast("string")).alias("site_id"), (u % 6 == 0).alias("archived"), ((u % 5 != 0) & (u % 4 != 3)).alias("live"), (u % 4 == 2).alias("failed")).distinct().withColumnRenamed("o", "user_id")
    return C.reconcile_archive(k.select("user_id", "site_id", "archived"), k.filter("live").select("user_id", "site_id"), k.filter("failed").select("user_id"))


@query(
    "s17_merge_into",
    """WITH t AS (SELECT site_id, url, sum(clicks) AS clicks, max(date) AS day, CASE WHEN site_id = 'site1' THEN NULL ELSE min(url) END AS label FROM page_day WHERE date < DATE '2024-01-20' AND url NOT LIKE '%p3' GROUP BY site_id, url),
    s AS (SELECT site_id, url, sum(clicks) AS clicks, max(date) AS day, CASE WHEN site_id = 'site2' THEN NULL ELSE 'new' END AS label FROM page_day WHERE date >= DATE '2024-01-10' AND url NOT LIKE '%p4' GROUP BY site_id, url)
    SELECT site_id, url, CAST(CASE WHEN s.day IS NOT NULL AND (t.day IS NULL OR s.day > t.day) THEN coalesce(t.clicks, 0) + coalesce(s.clicks, 0) ELSE t.clicks END AS BIGINT) AS clicks,
      CASE WHEN s.day IS NOT NULL AND (t.day IS NULL OR s.day > t.day) THEN s.day ELSE t.day END AS day, CASE WHEN s.day IS NOT NULL AND (t.day IS NULL OR s.day > t.day) THEN coalesce(s.label, t.label) ELSE t.label END AS label
    FROM t FULL JOIN s USING (site_id, url)""",
    "page_day",
)
def s17_merge_into(spark, d):
    p = facts.page_day(spark, d)
    agg = lambda rows, label: rows.groupBy("site_id", "url").agg(F.sum("clicks").alias("clicks"), F.max("date").alias("day")).withColumn("label", label)
    t = agg(p.filter((F.col("date") < date(2024, 1, 20)) & ~F.col("url").endswith("p3")), F.when(F.col("site_id") != "site1", F.col("url")))
    s = agg(p.filter((F.col("date") >= date(2024, 1, 10)) & ~F.col("url").endswith("p4")), F.when(F.col("site_id") != "site2", "new"))
    return C.merge_into(t, s, ["site_id", "url"], {"clicks": "add", "day": "set", "label": "keep"}, newer_than="day")


@query("s19_discover_pages", "WITH a AS (SELECT DISTINCT url FROM page_day WHERE date < DATE '2024-01-02'), b AS (SELECT DISTINCT url FROM page_day WHERE date >= DATE '2024-01-30') SELECT url, CASE WHEN a.x AND b.x THEN 'sitemap+ranking' WHEN a.x THEN 'sitemap' ELSE 'ranking' END AS source FROM (SELECT *, TRUE AS x FROM a) a FULL JOIN (SELECT *, TRUE AS x FROM b) b USING (url)", "page_day")
def s19_discover_pages(spark, d):
    p = facts.page_day(spark, d)
    return C.discover_pages(p.filter(F.col("date") < date(2024, 1, 2)), p.filter(F.col("date") >= date(2024, 1, 30)))


_SEEN = "SELECT url, 'l' || (CAST(page_id // 3 AS BIGINT) % 2) AS lastmod, CAST(page_id % 3 AS INTEGER) AS image_count, 0 AS video_count, 0 AS news_count, 'page' AS sitemap_type"


def _sitemap(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").dropDuplicates(["page_id"]).withColumn("url", F.concat_ws("#", "url", F.col("page_id").cast("string")))
    fields = [F.lit(0).alias("video_count"), F.lit(0).alias("news_count"), F.lit("page").alias("sitemap_type")]
    i = F.col("page_id")
    state = p.filter(i % 5 != 0).select(
        "url", F.concat(F.lit("l"), (F.floor(i / 3) % 2).cast("string")).alias("lastmod"), (i % 3).cast("int").alias("image_count"), *fields,
        F.when(i % 7 == 1, "missing").when(i % 7 == 2, "pending").otherwise("unchanged").alias("inventory_status"), F.when(i % 7 == 1, 2).when(i % 7 == 2, 1).otherwise(0).alias("missing_syncs"),
    )
    seen = p.filter(i % 4 != 0).select("url", F.concat(F.lit("l"), (F.floor(i / 3) % 3 % 2).cast("string")).alias("lastmod"), (i % 3).cast("int").alias("image_count"), *fields)
    return state, seen


_SITEMAP = """WITH p AS (SELECT url || '#' || page_id AS url, page_id AS i FROM pages),
 o AS (SELECT url, 'l' || (i // 3 % 2) AS old_lastmod, CAST(i % 3 AS INTEGER) AS old_image, CASE WHEN i % 7 = 1 THEN 'missing' WHEN i % 7 = 2 THEN 'pending' ELSE 'unchanged' END AS st, CASE WHEN i % 7 = 1 THEN 2 WHEN i % 7 = 2 THEN 1 ELSE 0 END AS ms FROM p WHERE i % 5 <> 0),
 n AS (SELECT url, 'l' || (i // 3 % 3 % 2) AS lastmod, CAST(i % 3 AS INTEGER) AS image FROM p WHERE i % 4 <> 0),
 j AS (SELECT url, st, ms, old_lastmod, old_image, lastmod, image, CASE WHEN lastmod IS NOT NULL THEN 0 WHEN {c} THEN coalesce(ms, 0) + 1 ELSE coalesce(ms, 0) END AS m FROM o FULL JOIN n USING (url)),
 k AS (SELECT *, CASE WHEN lastmod IS NOT NULL AND st IS NULL THEN 'added' WHEN lastmod IS NOT NULL AND st IN ('missing', 'pending') THEN 'restored' WHEN lastmod IS NOT NULL AND (lastmod <> old_lastmod OR image <> old_image) THEN 'changed' WHEN lastmod IS NOT NULL THEN 'unchanged' WHEN NOT {c} THEN st WHEN m >= 2 THEN 'missing' ELSE 'pending' END AS s FROM j)
 SELECT url, s AS inventory_status, m AS missing_syncs, coalesce(s = 'missing', FALSE) AND st IS DISTINCT FROM 'missing' AS disappeared, coalesce(lastmod, old_lastmod) AS lastmod, coalesce(image, old_image) AS image_count, 0 AS video_count, 0 AS news_count, 'page' AS sitemap_type FROM k"""


@query("j20_sitemap_diff", _SITEMAP.replace("{c}", "TRUE"))
def j20_sitemap_diff(spark, d):
    return C.sitemap_diff(*_sitemap(spark, d), complete=True)


@query("j20_sitemap_diff_partial", _SITEMAP.replace("{c}", "FALSE"))
def j20_sitemap_diff_partial(spark, d):
    return C.sitemap_diff(*_sitemap(spark, d), complete=False)


_INV = "i AS (SELECT 'g' || (page_id % 4) AS grp, url, CASE page_id % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'excluded' WHEN 2 THEN 'indexed' END AS index_status, ['added', 'changed', 'pending', 'missing', 'unchanged'][1 + page_id % 5] AS inventory_status, CASE WHEN page_id % 6 = 0 THEN 'suspicious' ELSE 'reliable' END AS lastmod_verdict FROM pages)"


def _inventory(spark, d):
    p, i = spark.read.parquet(f"{d}/pages.parquet"), F.col("page_id")
    states = F.array(*[F.lit(s) for s in ("added", "changed", "pending", "missing", "unchanged")])
    return p.select(
        F.concat(F.lit("g"), (i % 4).cast("string")).alias("grp"), "url", F.when(i % 5 == 0, "indexed").when(i % 5 == 1, "excluded").when(i % 5 == 2, "indexed").alias("index_status"),
        F.element_at(states, (i % 5 + 1).cast("int")).alias("inventory_status"), F.when(i % 6 == 0, "suspicious").otherwise("reliable").alias("lastmod_verdict"),
    )


@query(
    "a20_inventory_counters",
    f"""WITH {_INV} SELECT grp, count(*) AS total, CAST(count_if(index_status = 'indexed') AS BIGINT) AS indexed, CAST(count_if(index_status <> 'indexed') AS BIGINT) AS not_indexed, CAST(count_if(index_status IS NULL) AS BIGINT) AS not_checked,
    {", ".join(f"CAST(count_if(inventory_status = '{s}') AS BIGINT) AS {s}" for s in ("added", "changed", "pending", "missing"))}, CAST(count_if(lastmod_verdict = 'suspicious') AS BIGINT) AS lastmod_suspicious FROM i GROUP BY grp""",
)
def a20_inventory_counters(spark, d):
    return C.inventory_counters(_inventory(spark, d), ["grp"])


@query("p9_inventory_not_indexed", f"WITH {_INV} SELECT * FROM i WHERE index_status <> 'indexed'")
def p9_inventory_not_indexed(spark, d):
    return C.inventory_filter(_inventory(spark, d), "not_indexed")


@query(
    "j21_refdomain_diff",
    """WITH o AS (SELECT target, ref_domain, min(first_seen) AS f, max(last_seen) AS l, CASE WHEN max(dr) % 5 = 0 THEN DATE '1998-01-01' END AS lost_at FROM ref_domain WHERE provider = 'prov0' AND dr % 3 <> 0 GROUP BY 1, 2),
    n AS (SELECT target, ref_domain, min(first_seen) AS f, max(last_seen) AS l FROM ref_domain WHERE provider = 'prov1' AND dr % 2 = 0 GROUP BY 1, 2),
    j AS (SELECT target, ref_domain, o.f AS of, o.l AS ol, lost_at, n.f AS nf, n.l AS nl, CASE WHEN n.l IS NOT NULL AND o.l IS NULL THEN 'added' WHEN n.l IS NOT NULL AND lost_at IS NOT NULL THEN 'returned' WHEN n.l IS NOT NULL OR lost_at IS NOT NULL THEN 'kept' ELSE 'lost' END AS change FROM o FULL JOIN n USING (target, ref_domain))
    SELECT target, ref_domain, least(of, nf) AS first_seen, greatest(ol, nl) AS last_seen, CASE WHEN change = 'lost' THEN DATE '2024-01-30' WHEN nl IS NULL THEN lost_at END AS lost_at, change FROM j""",
    "ref_domain",
)
def j21_refdomain_diff(spark, d):
    r = facts.ref_domain(spark, d)
    old = r.filter("provider = 'prov0' and dr % 3 <> 0").groupBy("target", "ref_domain").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("dr").alias("dr"))
    old = old.withColumn("lost_at", F.when(F.col("dr") % 5 == 0, F.lit(date(1998, 1, 1))))
    return C.refdomain_diff(old, r.filter("provider = 'prov1' and dr % 2 = 0"), True, AS_OF)


@query(
    "w12_rank_state",
    """WITH r AS (SELECT *, lag(position) OVER w AS previous, row_number() OVER (PARTITION BY site_id, keyword ORDER BY checked_at DESC, check_id DESC) AS n, min(position) OVER (PARTITION BY site_id, keyword) AS best FROM rank_check WHERE error IS NULL WINDOW w AS (PARTITION BY site_id, keyword ORDER BY checked_at, check_id))
    SELECT site_id, keyword, position AS last_position, previous AS previous_position, best AS best_position, url AS last_url, checked_at FROM r WHERE n = 1""",
    "rank_check",
)
def w12_rank_state(spark, d):
    return C.rank_state(facts.rank_check(spark, d))


@query(
    "w13_rank_history",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY site_id, keyword ORDER BY checked_at DESC, check_id DESC) AS n FROM rank_check WHERE error IS NULL AND position IS NOT NULL QUALIFY n <= 10)
    SELECT site_id, keyword, count(*) AS checks, arg_min(position, n) AS newest, arg_max(position, n) AS oldest, arg_max(position, n) - arg_min(position, n) AS trend FROM r GROUP BY ALL""",
    "rank_check",
)
def w13_rank_history(spark, d):
    return C.rank_history(facts.rank_check(spark, d), 10)


@query(
    "w14_verdict_state",
    "SELECT question, engine, arg_max(verdict, (checked_at, check_id)) FILTER (error IS NULL) AS verdict, max(checked_at) AS checked_at, count(*) AS checks, CAST(count_if(error IS NOT NULL) AS BIGINT) AS errors FROM aeo_check GROUP BY ALL",
    "aeo_check",
)
def w14_verdict_state(spark, d):
    return C.verdict_state(facts.aeo_check(spark, d))


@query(
    "j9_rank_vs_search",
    """WITH a AS (SELECT site_id, keyword AS query, CAST(checked_at AS DATE) AS date, arg_max(position, (checked_at, check_id)) AS rank FROM rank_check WHERE position IS NOT NULL GROUP BY ALL), b AS (SELECT site_id, query, date, min(position) AS search_position FROM page_query GROUP BY ALL)
    SELECT * FROM a FULL JOIN b USING (site_id, query, date)""",
    "rank_check page_query",
)
def j9_rank_vs_search(spark, d):
    return C.rank_vs_search(facts.rank_check(spark, d), facts.page_query(spark, d))


@query(
    "j11_asof_rank",
    "SELECT e.site_id, e.query AS keyword, e.event_id, e.ts AS at, c.position AS rank FROM (SELECT * FROM event WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM rank_check WHERE position IS NOT NULL) c ON e.site_id = c.site_id AND e.query = c.keyword AND e.ts >= c.checked_at",
    "event rank_check",
)
def j11_asof_rank(spark, d):
    e = facts.event(spark, d).filter("event_type = 'purchase'").select("site_id", F.col("query").alias("keyword"), F.col("ts").alias("at"), "event_id")
    return C.asof_rank(e, facts.rank_check(spark, d))


@query(
    "j10_rank_dashboard",
    """WITH t AS (SELECT DISTINCT site_id, keyword FROM rank_check), g AS (SELECT * FROM rank_check WHERE error IS NULL),
    r AS (SELECT site_id, keyword, arg_max(coalesce(position, -1), (checked_at, check_id)) AS last_position, min(position) AS best_position FROM g GROUP BY ALL), s AS (SELECT site_id, lower(query) AS k, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM page_query GROUP BY ALL)
    SELECT t.site_id, t.keyword, nullif(last_position, -1) AS last_position, best_position, clicks, impressions FROM t LEFT JOIN r USING (site_id, keyword) LEFT JOIN s ON s.site_id = t.site_id AND s.k = lower(t.keyword)""",
    "rank_check page_query",
)
def j10_rank_dashboard(spark, d):
    c = facts.rank_check(spark, d)
    return C.rank_dashboard(c.select("site_id", "keyword").distinct(), facts.page_query(spark, d), c).select("site_id", "keyword", "last_position", "best_position", "clicks", "impressions")


_RUNS = "r AS (SELECT run_id, page AS url, CAST(count_if(status = 'FAIL') AS INTEGER) % 3 AS status, CAST(count(*) AS VARCHAR) AS fingerprint FROM signal GROUP BY ALL HAVING count(*) % 5 <> 0)"


@query(
    "w17_monitoring_changes",
    f"""WITH {_RUNS}, o AS (SELECT run_id, dense_rank() OVER (ORDER BY run_id) AS r FROM (SELECT DISTINCT run_id FROM r)), x AS (SELECT r.*, o.r AS k FROM r JOIN o USING (run_id))
    SELECT a.run_id, a.url, a.status, CASE WHEN b.url IS NULL THEN 'new' WHEN a.status <> b.status THEN 'status_changed' WHEN a.fingerprint <> b.fingerprint THEN 'content_changed' ELSE 'unchanged' END AS change FROM x a LEFT JOIN x b ON a.url = b.url AND b.k = a.k - 1""",
    "signal",
)
def w17_monitoring_changes(spark, d):
    r = facts.signal(spark, d).groupBy("run_id", F.col("page").alias("url")).agg(F.count_if(F.col("status") == "FAIL").alias("f"), F.count("*").alias("n")).filter("n % 5 <> 0")
    return C.monitoring_changes(r.select("run_id", "url", (F.col("f") % 3).cast("int").alias("status"), F.col("n").cast("string").alias("fingerprint")))


@query(
    "j19_verify_audit",
    """WITH a AS (SELECT DISTINCT page AS url, title AS rule FROM signal WHERE run_id = 'run01' AND status IN ('FAIL', 'PARTIAL')), b AS (SELECT DISTINCT page AS url, title AS rule FROM signal WHERE run_id = 'run03' AND status IN ('FAIL', 'PARTIAL')),
    p AS (SELECT page AS url, count(*) % 4 <> 0 AS good FROM signal WHERE run_id = 'run03' AND status IN ('FAIL', 'PARTIAL') GROUP BY page)
    SELECT url, rule, CASE WHEN NOT coalesce(good, FALSE) THEN 'inconclusive' WHEN a.x AND b.x THEN 'still_present' WHEN a.x THEN 'resolved' ELSE 'regression' END AS verdict FROM (SELECT *, TRUE AS x FROM a) a FULL JOIN (SELECT *, TRUE AS x FROM b) b USING (url, rule) LEFT JOIN p USING (url)""",
    "signal",
)
def j19_verify_audit(spark, d):
    s = facts.signal(spark, d).filter("status in ('FAIL', 'PARTIAL')")
    audit = lambda run: s.filter(F.col("run_id") == run).groupBy(F.col("page").alias("url")).agg(F.collect_set("title").alias("issues"), F.count("*").alias("n")).withColumn("http_status", F.when(F.col("n") % 4 != 0, 200).otherwise(404))
    return C.verify_audit(audit("run01"), audit("run03"))


@query(
    "c1_stale_keywords",
    "SELECT DISTINCT keyword, country FROM keyword_metric k WHERE NOT EXISTS (SELECT 1 FROM keyword_metric f WHERE f.keyword = k.keyword AND f.country = k.country AND DATE '2024-01-30' - f.checked_at <= 30 AND f.kd IS NOT NULL)",
    "keyword_metric",
)
def c1_stale_keywords(spark, d):
    k = facts.keyword_metric(spark, d)
    return C.stale(k, k, AS_OF, 30, need_kd=True)


@query("u2_value_drift", """WITH t AS (SELECT page, list_distinct(list(title) FILTER (run_id = 'run00')) AS a, list_distinct(list(title) FILTER (run_id = 'run05')) AS b FROM signal GROUP BY page),
    x AS (SELECT page, coalesce(a, []) AS a, coalesce(b, []) AS b FROM t) SELECT page, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS lost, array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), ',') AS added, len(list_intersect(a, b))::INTEGER AS kept FROM x""", "signal")
def u2_value_drift(spark, d):
    s = facts.signal(spark, d)
    t = s.groupBy("page").agg(F.collect_set(F.when(F.col("run_id") == "run00", F.col("title"))).alias("a"), F.collect_set(F.when(F.col("run_id") == "run05", F.col("title"))).alias("b"))
    v = C.value_drift(F.col("a"), F.col("b"))
    return t.select("page", F.array_join(v["lost"], ",").alias("lost"), F.array_join(v["added"], ",").alias("added"), F.size(v["kept"]).alias("kept"))
