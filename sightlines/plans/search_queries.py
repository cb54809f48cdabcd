"""Registered queries of the search-performance operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sightlines.operators import search as S

from . import facts
from .facts import AS_OF
from .registry import query

NOW, BEFORE = "date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'", "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"


def R(x: str, n: int) -> str:
    """The half-up rounding of the operators, as SQL."""
    return f"floor(({x}) * {float(10**n)} + 0.5) / {float(10**n)}"


def POS(on: str = "TRUE") -> str:
    return f"(CAST(sum(CASE WHEN {on} THEN pos10 END) AS DOUBLE) / 10.0) / count(CASE WHEN {on} THEN pos10 END)"


def WPOS(on: str = "TRUE") -> str:
    return f"(CAST(sum(CASE WHEN {on} THEN pos10 * impressions END) AS DOUBLE) / 10.0) / sum(CASE WHEN {on} THEN impressions END)"


def SUM(c: str, on: str = "TRUE") -> str:
    return f"CAST(coalesce(sum(CASE WHEN {on} THEN {c} END), 0) AS BIGINT)"


def PCT(n: str, b: str, zero: str = "full") -> str:
    at = {"full": f"CASE WHEN {n} > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END", "zero": "0.0::DOUBLE", "null": "NULL"}[zero]
    return f"CASE WHEN ({b}) = 0 THEN {at} ELSE (CAST({n} AS DOUBLE) - CAST({b} AS DOUBLE)) / CAST({b} AS DOUBLE) * 100 END"


CTR = "CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions ELSE 0.0::DOUBLE END"
_BOTH = f"{SUM('clicks', NOW)} AS clicks, {SUM('impressions', NOW)} AS impressions, {SUM('clicks', BEFORE)} AS prev_clicks, {SUM('impressions', BEFORE)} AS prev_impressions"
_TWO = f"{_BOTH}, {R(POS(NOW), 2)} AS position, {R(POS(BEFORE), 2)} AS prev_position"


@query(
    "a2_striking_distance",
    f"""SELECT *, {R(f"({CTR}) * 100", 2)} AS ctr FROM (
    SELECT site_id, query, url, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(POS(), 1)} AS position
    FROM page_query WHERE pos10 BETWEEN 40 AND 200 GROUP BY ALL HAVING sum(impressions) >= 2)
    ORDER BY impressions DESC, site_id, query, url LIMIT 100""",
    "page_query",
)
def a2_striking_distance(spark, d):
    return S.striking_distance(facts.page_query(spark, d), min_impressions=2)


@query(
    "a2_striking_by_query",
    f"""SELECT *, {R(f"({CTR}) * 100", 2)} AS ctr FROM (SELECT site_id, query, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(POS(), 1)} AS position
    FROM page_query WHERE pos10 BETWEEN 40 AND 200 GROUP BY ALL HAVING sum(impressions) >= 3)""",
    "page_query",
)
def a2_striking_by_query(spark, d):
    return S.striking_distance(facts.page_query(spark, d), min_impressions=3, limit=None, by_query=True)


@query(
    "a1_site_summary",
    f"""SELECT *, {R(CTR, 4)} AS ctr, {R(PCT('clicks', 'prev_clicks'), 1)} AS clicks_change, {R(PCT('impressions', 'prev_impressions'), 1)} AS impressions_change
    FROM (SELECT site_id, {_TWO} FROM site_day WHERE {NOW} OR {BEFORE} GROUP BY site_id)""",
    "site_day",
)
def a1_site_summary(spark, d):
    return S.site_summary(facts.site_day(spark, d), AS_OF, 15)


@query(
    "j1_compare_pages",
    f"""SELECT *, {R(PCT('clicks', 'prev_clicks'), 1)} AS clicks_change, CASE WHEN impressions > 0 AND prev_impressions = 0 THEN 'new' WHEN impressions = 0 AND prev_impressions > 0 THEN 'lost' ELSE 'kept' END AS status
    FROM (SELECT site_id, url, {_TWO} FROM page_day WHERE {NOW} OR {BEFORE} GROUP BY ALL)""",
    "page_day",
)
def j1_compare_pages(spark, d):
    return S.compare_periods(facts.page_day(spark, d), "url", AS_OF, 15)


@query(
    "j1_compare_queries",
    f"""SELECT *, {R(PCT('clicks', 'prev_clicks', 'null'), 1)} AS clicks_change, CASE WHEN impressions > 0 AND prev_impressions = 0 THEN 'new' WHEN impressions = 0 AND prev_impressions > 0 THEN 'lost' ELSE 'kept' END AS status
    FROM (SELECT site_id, query, {_TWO} FROM page_query WHERE {NOW} OR {BEFORE} GROUP BY ALL)""",
    "page_query",
)
def j1_compare_queries(spark, d):
    return S.compare_periods(facts.page_query(spark, d), "query", AS_OF, 15, zero_baseline="null")


@query(
    "j2_winners_losers",
    f"""WITH t AS (SELECT site_id, query, {SUM('clicks', NOW)} AS now, {SUM('clicks', BEFORE)} AS before FROM page_query WHERE {NOW} OR {BEFORE} GROUP BY ALL),
    x AS (SELECT *, now - before AS delta FROM t WHERE now <> before)
    SELECT CASE WHEN delta > 0 THEN 'winner' ELSE 'loser' END AS side, site_id, query, now, before, delta,
      CASE WHEN delta > 0 THEN CAST(row_number() OVER (PARTITION BY site_id ORDER BY delta DESC, query) AS INTEGER) ELSE CAST(row_number() OVER (PARTITION BY site_id ORDER BY delta, query) AS INTEGER) END AS place
    FROM x QUALIFY place <= 10""",
    "page_query",
)
def j2_winners_losers(spark, d):
    return S.winners_losers(facts.page_query(spark, d), "query", AS_OF, 15, 10)


@query(
    "j3_new_rankings",
    f"""SELECT site_id, query, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, min(position) AS best_position FROM page_query p
    WHERE date BETWEEN DATE '2024-01-28' AND DATE '2024-01-30' AND NOT EXISTS (SELECT 1 FROM page_query o WHERE o.site_id = p.site_id AND o.query = p.query AND o.date BETWEEN DATE '2024-01-25' AND DATE '2024-01-27') GROUP BY ALL""",
    "page_query",
)
def j3_new_rankings(spark, d):
    return S.new_rankings(facts.page_query(spark, d), AS_OF, 3)


@query(
    "j4_chart_series",
    """SELECT a.site_id, a.date, a.clicks, a.impressions, b.clicks AS prev_clicks, b.impressions AS prev_impressions FROM site_day a
    LEFT JOIN site_day b ON a.site_id = b.site_id AND b.date = a.date - 14 WHERE a.date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'""",
    "site_day",
)
def j4_chart_series(spark, d):
    return S.chart_series(facts.site_day(spark, d), AS_OF, 10, match_weekday=True)  # J5: ten days, moved back two whole weeks


@query(
    "j6_position_moves",
    f"""SELECT *, {R('prev_position - position', 1)} AS delta FROM (SELECT site_id, query, {SUM('impressions', NOW)} AS impressions, {R(POS(NOW), 1)} AS position, {R(POS(BEFORE), 1)} AS prev_position
    FROM page_query WHERE {NOW} OR {BEFORE} GROUP BY ALL HAVING {SUM('impressions', NOW)} >= 10 AND {SUM('impressions', BEFORE)} >= 10)""",
    "page_query",
)
def j6_position_moves(spark, d):
    return S.position_moves(facts.page_query(spark, d), AS_OF, 15)


@query(
    "a3_ctr_benchmark",
    f"""WITH t AS (SELECT site_id, query, url, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(POS(), 1)} AS position, CAST(sum(CAST(CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions ELSE 0 END AS DECIMAL(28,6))) AS DOUBLE) / count(*) AS rate
    FROM page_query WHERE position BETWEEN 1 AND 10 GROUP BY ALL HAVING sum(impressions) >= 3),
    e AS (SELECT * EXCLUDE (rate), {R('rate * 1000', 0)} / 10 AS actual_ctr, [27.6, 15.8, 11.0, 8.4, 6.3, 4.9, 3.9, 3.3, 2.7, 2.4][CAST(floor(position + 0.5) AS INTEGER)]::DOUBLE AS expected_ctr FROM t)
    SELECT *, {R('actual_ctr - expected_ctr', 1)} AS difference FROM e""",
    "page_query",
)
def a3_ctr_benchmark(spark, d):
    return S.ctr_benchmark(facts.page_query(spark, d), min_impressions=3)


@query(
    "a10_search_performance",
    f"SELECT *, {R(f'({CTR}) * 100', 2)} AS ctr FROM (SELECT site_id, query, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(WPOS(), 1)} AS position FROM page_query WHERE contains(url, '/p1') AND date >= DATE '2024-01-05' GROUP BY ALL)",
    "page_query",
)
def a10_search_performance(spark, d):
    return S.search_performance(facts.page_query(spark, d), "query", contains="/p1", start=date(2024, 1, 5))


@query(
    "p5_page_queries",
    f"SELECT query, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(POS(), 1)} AS position FROM page_query WHERE url = 'https://site1.example/p4' AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-30' GROUP BY query",
    "page_query",
)
def p5_page_queries(spark, d):
    return S.page_queries(facts.page_query(spark, d), "http://SITE1.example/p4/", AS_OF, 28)


_TERMS = ["q1", "Q27"]
_BRAND = "(contains(lower(query), 'q1') OR contains(lower(query), 'q27'))"


@query(
    "a8_branded_split",
    f"SELECT site_id, date, {SUM('clicks', _BRAND)} AS branded_clicks, {SUM('clicks', 'NOT ' + _BRAND)} AS other_clicks, {SUM('impressions', _BRAND)} AS branded_impressions, {SUM('impressions', 'NOT ' + _BRAND)} AS other_impressions FROM page_query GROUP BY ALL",
    "page_query",
)
def a8_branded_split(spark, d):
    return S.branded_split(facts.page_query(spark, d), _TERMS)


@query(
    "a9_position_buckets",
    f"""WITH q AS (SELECT site_id, query, {POS()} AS p, sum(clicks) AS clicks FROM page_query GROUP BY ALL)
    SELECT site_id, CASE WHEN p <= 3 THEN '1-3' WHEN p <= 10 THEN '4-10' WHEN p <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS queries, CAST(sum(clicks) AS BIGINT) AS clicks FROM q GROUP BY ALL""",
    "page_query",
)
def a9_position_buckets(spark, d):
    return S.position_buckets(facts.page_query(spark, d))


@query(
    "a12_group_metrics",
    f"""WITH v AS (SELECT site_id, url, {_BOTH} FROM page_day WHERE {NOW} OR {BEFORE} GROUP BY ALL),
    g AS (SELECT 'first' AS group_id, * FROM v WHERE contains(url, '/p1') OR url = 'https://site2.example/p3' UNION ALL SELECT 'second', * FROM v WHERE starts_with(url, 'https://site1') UNION ALL SELECT 'none', * FROM v WHERE FALSE)
    SELECT *, {R(PCT('clicks', 'prev_clicks'), 1)} AS clicks_change FROM (SELECT site_id, group_id, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {SUM('prev_clicks')} AS prev_clicks, {SUM('prev_impressions')} AS prev_impressions, count(*) AS "values" FROM g GROUP BY ALL)""",
    "page_day",
)
def a12_group_metrics(spark, d):
    kind = "group_id string, rules array<struct<type:string,values:array<string>>>"
    rules = spark.createDataFrame([("first", [("contains", ["/P1"]), ("equals", ["https://site2.example/p3", "x"])]), ("second", [("startsWith", ["https://site1"])]), ("none", [])], kind)
    return S.group_metrics(facts.page_day(spark, d), rules, "url", AS_OF, 15)


@query(
    "a13_keyword_summary",
    f"SELECT site_id, query, url, count(*) AS observations, {SUM('impressions')} AS impressions, {SUM('clicks')} AS clicks, min(position) AS best_position, max(position) AS worst_position, {R(POS(), 2)} AS avg_position, min(date) AS first_seen, max(date) AS last_seen FROM page_query GROUP BY ALL",
    "page_query",
)
def a13_keyword_summary(spark, d):
    return S.keyword_summary(facts.page_query(spark, d))


@query("j15_latest_observation", "SELECT site_id, query, url, date, clicks, impressions, position FROM page_query QUALIFY row_number() OVER (PARTITION BY site_id, query, url ORDER BY date DESC) = 1", "page_query")
def j15_latest_observation(spark, d):
    return S.latest_observation(facts.page_query(spark, d))


@query(
    "j16_keyword_inventory",
    f"""SELECT *, CASE WHEN DATE '2024-01-30' - last_seen <= 7 THEN 'active_7d' WHEN DATE '2024-01-30' - last_seen <= 30 THEN 'active_30d' WHEN DATE '2024-01-30' - last_seen <= 90 THEN 'stale_90d' ELSE 'historical' END AS status
    FROM (SELECT site_id, query, url, count(*) AS observations, {SUM('impressions')} AS impressions, min(position) AS best_position, arg_max(position, date) AS current_position, max(date) AS last_seen FROM page_query GROUP BY ALL)""",
    "page_query",
)
def j16_keyword_inventory(spark, d):
    return S.keyword_inventory(facts.page_query(spark, d), AS_OF)


@query("a14_landing_pages", f"SELECT site_id, url, count(DISTINCT query) AS keywords, min(position) AS best_position, {R(POS(), 2)} AS avg_position, {SUM('impressions')} AS impressions, {SUM('clicks')} AS clicks FROM page_query GROUP BY ALL", "page_query")
def a14_landing_pages(spark, d):
    return S.landing_pages(facts.page_query(spark, d))


@query("a14_keywords_export", f"SELECT site_id, query, count(DISTINCT url) AS pages, min(position) AS best_position, {R(POS(), 2)} AS avg_position, {SUM('impressions')} AS impressions, {SUM('clicks')} AS clicks FROM page_query GROUP BY ALL", "page_query")
def a14_keywords_export(spark, d):
    return S.keywords_export(facts.page_query(spark, d))


@query(
    "a15_report_window",
    f"""WITH l AS (SELECT site_id, max(date) AS window_end FROM page_query GROUP BY site_id)
    SELECT site_id, window_end, window_end - 9 AS window_start, count(DISTINCT query) AS queries, count(DISTINCT url) AS pages, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(WPOS(), 2)} AS position
    FROM page_query JOIN l USING (site_id) WHERE date > window_end - 10 GROUP BY ALL""",
    "page_query",
)
def a15_report_window(spark, d):
    return S.report_window(facts.page_query(spark, d), 10)


@query(
    "a4_cannibalization_exact",
    f"""WITH t AS (SELECT site_id, query, url, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {POS()} AS position FROM page_query GROUP BY ALL),
    s AS (SELECT *, first(query) OVER (PARTITION BY site_id, url ORDER BY clicks DESC, impressions DESC, query) AS top_query, sum(impressions) OVER (PARTITION BY site_id, query) AS total FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY site_id, query ORDER BY impressions DESC, url) AS place FROM s WHERE CAST(impressions AS DOUBLE) / total >= 0.05)
    SELECT * REPLACE ({R('gap', 1)} AS gap) FROM (SELECT site_id, query, count(*) AS pages, CAST(max(total) AS BIGINT) AS impressions, {SUM('clicks')} AS clicks, max(url) FILTER (place = 1) AS main_url, max(url) FILTER (place = 2) AS rival_url,
    abs(max(position) FILTER (place = 1) - max(position) FILTER (place = 2)) AS gap, max(top_query) FILTER (place = 1) = max(top_query) FILTER (place = 2) AS is_true FROM r GROUP BY ALL HAVING count(*) >= 2) WHERE gap <= 20""",
    "page_query",
)
def a4_cannibalization_exact(spark, d):
    return S.cannibalization_exact(facts.page_query(spark, d), min_share=0.05)


@query(
    "w8_flip_flops",
    """WITH w AS (SELECT site_id, query, date, url FROM page_query QUALIFY row_number() OVER (PARTITION BY site_id, query, date ORDER BY impressions DESC, clicks DESC, url) = 1),
    l AS (SELECT *, lag(url) OVER (PARTITION BY site_id, query ORDER BY date) AS b FROM w) SELECT site_id, query, count(*) AS days, CAST(count_if(b IS NOT NULL AND b <> url) AS BIGINT) AS flips FROM l GROUP BY ALL""",
    "page_query",
)
def w8_flip_flops(spark, d):
    return S.flip_flops(facts.page_query(spark, d))


_WEEKS = [date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 15), date(2024, 1, 22)]
_MATRIX = """m AS (SELECT site_id, url, """ + ", ".join(f"CAST(coalesce(sum(clicks) FILTER (date_trunc('week', date) = DATE '{w}'), 0) AS BIGINT) AS b{i}" for i, w in enumerate(_WEEKS)) + """ FROM page_day WHERE date < DATE '2024-01-29' GROUP BY ALL),
    k AS (SELECT *, b0 + b1 + b2 + b3 AS total, CAST(row_number() OVER (PARTITION BY site_id ORDER BY b0 + b1 + b2 + b3 DESC, url) AS INTEGER) AS place FROM m QUALIFY place <= 12)"""


@query("a6_decay_matrix", f"WITH {_MATRIX} SELECT * FROM k", "page_day")
def a6_decay_matrix(spark, d):
    return S.decay_matrix(facts.page_day(spark, d), "clicks", "week", _WEEKS, 12)


@query(
    "a7_decay_flags",
    f"""WITH {_MATRIX}, c AS (SELECT *, CAST(CASE WHEN b1 + b0 > 0 THEN {R('CAST(b3 + b2 - (b1 + b0) AS DOUBLE) / (b1 + b0) * 100', 0)} ELSE 0 END AS INTEGER) AS change FROM k)
    SELECT *, CASE WHEN change <= -25 THEN 'Critical' ELSE 'Warning' END AS flag FROM c WHERE change < -5""",
    "page_day",
)
def a7_decay_flags(spark, d):
    return S.decay_flags(S.decay_matrix(facts.page_day(spark, d), "clicks", "week", _WEEKS, 12), 4)


@query(
    "w10_densify",
    """SELECT s.site_id, CAST(g.d AS DATE) AS date, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, position FROM (SELECT DISTINCT site_id FROM site_day) s
    CROSS JOIN generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY) g(d) LEFT JOIN site_day x ON x.site_id = s.site_id AND x.date = CAST(g.d AS DATE)""",
    "site_day",
)
def w10_densify(spark, d):
    return S.densify(facts.site_day(spark, d), date(2023, 12, 28), date(2024, 2, 2))


@query(
    "w9_fill_position",
    """SELECT s.site_id, CAST(g.d AS DATE) AS date, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, last_value(position IGNORE NULLS) OVER (PARTITION BY s.site_id ORDER BY g.d ROWS UNBOUNDED PRECEDING) AS position FROM (SELECT DISTINCT site_id FROM site_day) s
    CROSS JOIN generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY) g(d) LEFT JOIN site_day x ON x.site_id = s.site_id AND x.date = CAST(g.d AS DATE)""",
    "site_day",
)
def w9_fill_position(spark, d):
    return S.fill_position(S.densify(facts.site_day(spark, d), date(2023, 12, 28), date(2024, 2, 2)))


@query(
    "w11_normalize_series",
    f"SELECT *, {R('CASE WHEN hi > lo THEN CAST(clicks - lo AS DOUBLE) / (hi - lo) * 85.0 + 5.0 ELSE 47.5 END', 2)} AS level FROM (SELECT *, min(clicks) OVER (PARTITION BY site_id) AS lo, max(clicks) OVER (PARTITION BY site_id) AS hi FROM site_day)".replace("SELECT *, floor", "SELECT * EXCLUDE (lo, hi), floor", 1),
    "site_day",
)
def w11_normalize_series(spark, d):
    return S.normalize_series(facts.site_day(spark, d))


def _updates(spark):
    return spark.createDataFrame([("u1", date(2024, 1, 6), date(2024, 1, 8)), ("u2", date(2024, 1, 15), date(2024, 1, 16)), ("u3", date(2024, 1, 25), date(2024, 1, 26))], "update_id string, start date, end date")


_UPD = "u AS (SELECT * FROM (VALUES ('u1', DATE '2024-01-06', DATE '2024-01-08', DATE '1900-01-01', DATE '2024-01-15'), ('u2', DATE '2024-01-15', DATE '2024-01-16', DATE '2024-01-08', DATE '2024-01-25'), ('u3', DATE '2024-01-25', DATE '2024-01-26', DATE '2024-01-16', DATE '9999-01-01')) v(update_id, s, e, lo, hi))"


@query(
    "j13_event_impact",
    f"""WITH {_UPD}, r AS (SELECT site_id, update_id, clicks, date, CASE WHEN date < s THEN 'before' ELSE 'after' END AS side FROM site_day JOIN u ON (date < s AND date > lo) OR (date > e AND date < hi)),
    n AS (SELECT *, row_number() OVER (PARTITION BY site_id, update_id, side ORDER BY CASE WHEN side = 'before' THEN -epoch(date) ELSE epoch(date) END) AS n FROM r QUALIFY n <= 5),
    t AS (SELECT site_id, update_id, CAST(count_if(side = 'before') AS BIGINT) AS before_days, CAST(count_if(side = 'after') AS BIGINT) AS after_days, CAST(sum(clicks) FILTER (side = 'before') AS DOUBLE) / count_if(side = 'before') AS b, CAST(sum(clicks) FILTER (side = 'after') AS DOUBLE) / count_if(side = 'after') AS a FROM n GROUP BY ALL)
    SELECT site_id, update_id, before_days, after_days, {R('b', 2)} AS before_clicks, {R('a', 2)} AS after_clicks, {R(PCT('a', 'b', 'null'), 1)} AS change FROM t WHERE before_days >= 3 AND after_days >= 3""",
    "site_day",
)
def j13_event_impact(spark, d):
    return S.event_impact(facts.site_day(spark, d), _updates(spark), days=5)


@query("w15_with_neighbours", f"WITH {_UPD} SELECT update_id, s AS start, e AS end, CASE WHEN lo > DATE '1900-01-01' THEN lo END AS prev_end, CASE WHEN hi < DATE '9999-01-01' THEN hi END AS next_start FROM u WHERE EXISTS (SELECT 1 FROM site_day WHERE date BETWEEN s AND e)", "site_day")
def w15_with_neighbours(spark, d):
    seen = facts.site_day(spark, d).select("date").distinct()
    u = S.with_neighbours(_updates(spark))
    return u.join(seen, F.col("date").between(F.col("start"), F.col("end")), "left_semi")


@query(
    "j13_note_impact",
    f"""WITH n AS (SELECT 'n' || row_number() OVER (ORDER BY site_id) AS note_id, site_id, DATE '2024-01-15' AS noted FROM (SELECT DISTINCT site_id FROM site_day)),
    t AS (SELECT site_id, note_id, {SUM('clicks', 'date < noted')} AS before_clicks, {SUM('clicks', 'date >= noted')} AS after_clicks FROM site_day JOIN n USING (site_id) WHERE date - noted BETWEEN -7 AND 6 GROUP BY ALL)
    SELECT *, {R(PCT('after_clicks', 'before_clicks', 'null'), 1)} AS change FROM t""",
    "site_day",
)
def j13_note_impact(spark, d):
    notes = spark.createDataFrame([(f"n{i + 1}", f"site{i}", date(2024, 1, 15)) for i in range(5)], "note_id string, site_id string, date date")
    return S.note_impact(facts.site_day(spark, d), notes)


@query(
    "a17_measure_outcomes",
    f"""WITH c AS (SELECT site_id || '-' || url AS change_id, site_id, url, min(date) + 12 AS live FROM page_day GROUP BY site_id, url),
    k AS (SELECT *, unnest([0, 7, 30, 90]) AS day FROM c), o AS (SELECT * FROM k WHERE day = 0 OR DATE '2024-01-30' - live >= day + 3),
    j AS (SELECT o.*, p.clicks, p.impressions, p.pos10, coalesce(CASE WHEN day = 0 THEN p.date - live BETWEEN -28 AND -1 ELSE p.date - live >= 0 AND p.date - live < day END, FALSE) AS "in" FROM o LEFT JOIN page_day p USING (site_id, url))
    SELECT change_id, site_id, url, day, {SUM('clicks', '"in"')} AS clicks, {SUM('impressions', '"in"')} AS impressions, {R(WPOS('"in"'), 2)} AS position FROM j GROUP BY ALL""",
    "page_day",
)
def a17_measure_outcomes(spark, d):
    p = facts.page_day(spark, d)
    changes = p.groupBy("site_id", "url").agg(F.date_add(F.min("date"), 12).alias("live_at")).withColumn("change_id", F.concat_ws("-", "site_id", "url"))
    return S.measure_outcomes(changes, p, AS_OF)


@query(
    "j12_bucketize",
    f"SELECT site_id, CAST(date_trunc('week', date) AS DATE) AS bucket, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions FROM page_day GROUP BY ALL",
    "page_day",
)
def j12_bucketize(spark, d):
    return facts.page_day(spark, d).groupBy("site_id", S.bucket_start(F.col("date"), "week").alias("bucket")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


@query(
    "a16_digest",
    f"""WITH s AS (SELECT site_id, {SUM('clicks', "date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'")} AS clicks, {SUM('clicks', "date BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'")} AS prev_clicks FROM site_day WHERE date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30' GROUP BY site_id),
    x AS (SELECT *, {R(PCT('clicks', 'prev_clicks'), 1)} AS clicks_change FROM s),
    q AS (SELECT site_id, query, sum(impressions) AS i, row_number() OVER (PARTITION BY site_id ORDER BY sum(impressions) DESC, query) AS n FROM page_query WHERE pos10 BETWEEN 40 AND 200 GROUP BY site_id, query HAVING sum(impressions) >= 2),
    t AS (SELECT site_id, string_agg(query, ',' ORDER BY n) AS top_queries FROM q WHERE n <= 3 GROUP BY site_id)
    SELECT site_id, clicks, prev_clicks, clicks_change, abs(clicks_change) >= 20 AND greatest(clicks, prev_clicks) >= 10 AS significant, abs(clicks_change) >= 20 AND greatest(clicks, prev_clicks) >= 10 AND clicks_change < 0 AS attention, top_queries FROM x LEFT JOIN t USING (site_id)""",
    "site_day page_query",
)
def a16_digest(spark, d):
    return S.digest(facts.site_day(spark, d), facts.page_query(spark, d), AS_OF)


@query(
    "a50_engine_portfolio",
    f"""WITH n AS (SELECT site_id, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, {R(POS('pos10 > 150'), 2)} AS position FROM site_day WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30' AND site_id <> 'site3' GROUP BY site_id),
    o AS (SELECT site_id, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, min(position) AS position FROM site_day GROUP BY site_id)
    SELECT site_id, coalesce(n.clicks, o.clicks) AS clicks, coalesce(n.impressions, o.impressions) AS impressions, CASE WHEN n.clicks IS NOT NULL THEN n.position ELSE o.position END AS position FROM n FULL JOIN o USING (site_id)""",
    "site_day",
)
def a50_engine_portfolio(spark, d):
    s = facts.site_day(spark, d)
    old = s.groupBy("site_id").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.min("position").alias("position"))
    rows = s.filter("site_id <> 'site3'").withColumn("position", F.when(F.col("pos10") > 150, F.col("position")).otherwise(0.0))
    return S.engine_portfolio(rows, old, AS_OF, 15)


@query("a46_page_brief", f"SELECT site_id, query, url, {SUM('impressions')} AS impressions FROM page_query WHERE url <> 'https://site2.example/p5' AND (site_id, query) IN (SELECT (site_id, query) FROM page_query WHERE url = 'https://site2.example/p5') GROUP BY ALL", "page_query")
def a46_page_brief(spark, d):
    return S.page_brief("https://site2.example/p5", facts.page_query(spark, d), facts.page_day(spark, d), AS_OF)["rivals"]


@query("s8_engine_days", f"SELECT site_id, date, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions FROM page_query WHERE date >= DATE '2024-01-10' GROUP BY ALL", "page_query")
def s8_engine_days(spark, d):
    rows = facts.page_query(spark, d)
    ms = (F.datediff("date", F.lit(date(1970, 1, 1))).cast("bigint") * 86_400_000).cast("string")
    return S.engine_days(rows.select("site_id", F.concat(F.lit("/Date("), ms, F.lit(")/")).alias("Date"), F.col("clicks").alias("Clicks"), F.col("impressions").alias("Impressions")), date(2024, 1, 10))


@query(
    "scale_revenue_by_part_month",
    f"""WITH l AS (SELECT 'part' || (l_partkey % 200) AS query, 'supplier' || l_suppkey AS url, CAST(date_trunc('month', l_shipdate) AS DATE) AS bucket, CAST(l_quantity AS BIGINT) AS impressions, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS clicks FROM lineitem)
    SELECT query, bucket, {SUM('clicks')} AS clicks, {SUM('impressions')} AS impressions, count(DISTINCT url) AS pages FROM l GROUP BY ALL""",
)
def scale_revenue_by_part_month(spark, d):
    """A bucketed comparison over the largest given table: part as query, supplier as page, ship month as bucket."""
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = line.select(
        F.concat(F.lit("part"), (F.col("l_partkey") % 200).cast("string")).alias("query"), F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("url"),
        S.bucket_start(F.col("l_shipdate"), "month").alias("bucket"), F.col("l_quantity").cast("bigint").alias("impressions"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("clicks"),
    )
    return rows.groupBy("query", "bucket").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.countDistinct("url").alias("pages"))


@query("p4_page_filter", "SELECT site_id, date, query, url, clicks FROM page_query WHERE contains(url, '.example/p1')", "page_query")
def p4_page_filter(spark, d):
    return S.page_filter(facts.page_query(spark, d), " .example/p1 ").select("site_id", "date", "query", "url", "clicks")


@query("p6_regex_filter", "SELECT site_id, query, url, clicks FROM page_query WHERE regexp_matches(query, '(?i)Q[12]$') OR regexp_matches(url, '(?i)Q[12]$')", "page_query")
def p6_regex_filter(spark, d):
    return S.regex_filter(facts.page_query(spark, d), ["query", "url"], "Q[12]$").select("site_id", "query", "url", "clicks")


@query(
    "t3_in_order",
    "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE lower(n_name) WHEN 'japan' THEN 1 WHEN 'france' THEN 2 ELSE 3 END, lower(n_name)) AS INTEGER) AS place FROM nation",
)
def t3_in_order(spark, d):
    """The order itself is shown by numbering the sorted rows of a table of fixed size."""
    from pyspark.sql import Window

    n = spark.read.parquet(f"{d}/nation.parquet").select("n_name")
    top = S.in_order(n, "n_name", ["Japan", "France"]).withColumn("at", F.monotonically_increasing_id())
    return top.select("n_name", F.row_number().over(Window.orderBy("at")).alias("place"))


@query("t4_listing", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def t4_listing(spark, d):
    return S.listing(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 3, 20)


_DEV = f"(SELECT *, CASE CAST(substr(query, 2) AS BIGINT) % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device FROM page_query)"


@query(
    "a11_breakdown",
    f"""SELECT *, {R(PCT('clicks', 'prev_clicks'), 1)} AS clicks_change, CASE WHEN impressions > 0 AND prev_impressions <= 0 THEN 'new' WHEN impressions <= 0 AND prev_impressions > 0 THEN 'lost' ELSE 'kept' END AS status FROM (SELECT site_id, device, {SUM('clicks', NOW)} AS clicks, {SUM('clicks', BEFORE)} AS prev_clicks, {SUM('impressions', NOW)} AS impressions, {SUM('impressions', BEFORE)} AS prev_impressions FROM {_DEV} WHERE {NOW} OR {BEFORE} GROUP BY ALL)""",
    "page_query",
)
def a11_breakdown(spark, d):
    n = F.substring("query", 2, 9).cast("bigint") % 3
    x = facts.page_query(spark, d).withColumn("device", F.when(n == 0, "mobile").when(n == 1, "desktop").otherwise("tablet"))
    return S.breakdown(x, "device", AS_OF, 15).select("site_id", "device", "clicks", "prev_clicks", "impressions", "prev_impressions", "clicks_change", "status")


@query("n5_week_key", "SELECT DISTINCT date, year(date) || '-W' || lpad(CAST((dayofyear(date) - 1) // 7 + 1 AS VARCHAR), 2, '0') AS week FROM event", "event")
def n5_week_key(spark, d):
    from sightlines.functions.numbers import week_key

    return facts.event(spark, d).select("date", week_key("date").alias("week")).distinct()


@query("n6_rank_potential", f"SELECT keyword, country, provider, volume, greatest(0.0::DOUBLE, {R('volume * 0.1::DOUBLE', 0)} - kd) AS potential FROM keyword_metric WHERE kd IS NOT NULL", "keyword_metric")
def n6_rank_potential(spark, d):
    from sightlines.functions.numbers import rank_potential

    return facts.keyword_metric(spark, d).filter("kd is not null").select("keyword", "country", "provider", "volume", rank_potential("volume", "kd").alias("potential"))


@query("n7_checkpoint_due", "SELECT event_id, day, date_diff('day', date, DATE '2024-01-30') >= day + 3 AS due FROM event, (VALUES (0), (7), (28)) v(day)", "event")
def n7_checkpoint_due(spark, d):
    from sightlines.functions.numbers import checkpoint_due

    e = facts.event(spark, d).select("event_id", "ts", F.explode(F.array(F.lit(0), F.lit(7), F.lit(28))).alias("day"))
    return e.select("event_id", "day", checkpoint_due("ts", "day", AS_OF).alias("due"))


@query("n8_parse_moment", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN date_trunc('second', ts) END AS ts FROM event", "event")
def n8_parse_moment(spark, d):
    from sightlines.functions.numbers import parse_moment

    e, i = facts.event(spark, d), F.col("event_id") % 3
    whole = F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.when(i == 0, F.unix_millis(whole).cast("string")).when(i == 1, F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return e.select("event_id", parse_moment(text).cast("timestamp_ntz").alias("ts"))


@query("p1_grain", "SELECT 'site' AS grain, site_id, CAST(count(*) AS BIGINT) AS n FROM site_day GROUP BY 2 UNION ALL SELECT 'page', site_id, count(*) FROM page_day GROUP BY 2 UNION ALL SELECT 'page_query', site_id, count(*) FROM page_query GROUP BY 2", "site_day page_day page_query")
def p1_grain(spark, d):
    """Three grains told apart in one table by empty strings."""
    s, p, q = (f(spark, d) for f in (facts.site_day, facts.page_day, facts.page_query))
    none = F.lit("")
    mixed = s.select("site_id", none.alias("url"), none.alias("query")).unionByName(p.select("site_id", "url", none.alias("query"))).unionByName(q.select("site_id", "url", "query"))
    out = None
    for g in ("site", "page", "page_query"):
        part = S.grain(mixed, g).groupBy("site_id").agg(F.count("*").alias("n")).select(F.lit(g).alias("grain"), "site_id", "n")
        out = part if out is None else out.unionByName(part)
    return out
