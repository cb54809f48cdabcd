"""Search, check, link and answer tables derived from the given tables.

Every derived table has one Spark expression and one SQL text that say the same.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 1, 30)

_EVENT = """SELECT event_id, ts, CAST(ts AS DATE) AS date, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  'site' || (user_id % 5) AS site_id, 'q' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 40) AS query,
  'https://site' || (user_id % 5) || '.example/p' || (user_id % 17) AS url FROM events"""
_MEASURES = "CAST(count(*) AS BIGINT) AS impressions, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks, CAST(10 + sum(event_id) % 300 AS BIGINT) AS pos10"

# Words that queries are spelled out with.
FIRST, SECOND, THIRD = ["best", "how to buy", "Compare", "red", "site2", "local", "the"], ["crm", "shoes", "café", "running shoes"], ["tools", "software", "prices", "near me", "guide"]
_PICK = lambda xs, n: "[" + ", ".join(f"'{x}'" for x in xs) + f"][1 + {n} % {len(xs)}]"
_SAID = f"{_PICK(FIRST, 'n')} || ' ' || {_PICK(SECOND, '(n // 2)')} || ' ' || {_PICK(THIRD, '(n // 3)')}"

#: name -> (tables it needs, DuckDB SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "event": ((), _EVENT),
    "page_query": (("event",), f"SELECT *, pos10 / 10.0 AS position FROM (SELECT site_id, date, query, url, {_MEASURES} FROM event GROUP BY ALL)"),
    "page_day": (("event",), f"SELECT *, pos10 / 10.0 AS position FROM (SELECT site_id, date, url, {_MEASURES} FROM event GROUP BY ALL)"),
    "site_day": (("event",), f"SELECT *, pos10 / 10.0 AS position FROM (SELECT site_id, date, {_MEASURES} FROM event GROUP BY ALL)"),
    # page_query with its queries spelled out in several words
    "intent_query": (
        ("page_query",),
        f"SELECT site_id, date, n, {_SAID} AS query, url, impressions, clicks, position FROM (SELECT *, CAST(substr(query, 2) AS BIGINT) AS n FROM page_query)",
    ),
    "rank_check": (
        ("event",),
        "SELECT event_id AS check_id, site_id, query AS keyword, ts AS checked_at, url, CASE WHEN event_type <> 'error' AND event_id % 11 <> 0 THEN 1 + event_id % 60 END AS position, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM event",
    ),
    "aeo_check": (
        ("event",),
        "SELECT event_id AS check_id, 'question ' || (k % 25) AS question, 'engine' || (user_id % 4) AS engine, ts AS checked_at, CASE WHEN event_type = 'error' THEN 'timeout' END AS error, CASE event_id % 3 WHEN 0 THEN 'cited' WHEN 1 THEN 'mentioned' ELSE 'absent' END AS verdict, site_id FROM event",
    ),
    "citation": (
        ("event",),
        "SELECT check_id, question, engine, site_id, 'https://' || (CASE WHEN d % 6 = 0 THEN 'www.site0.example' ELSE 'ref' || d || '.example' END) || '/a' || (check_id % 9) AS url FROM (SELECT event_id AS check_id, 'question ' || (k % 25) AS question, 'engine' || (user_id % 4) AS engine, site_id, unnest([event_id % 13, (event_id * 7 + 3) % 13]) AS d FROM event WHERE event_type <> 'error')",
    ),
    "signal": (
        ("event",),
        """SELECT 'run' || lpad(CAST(CAST(date - DATE '2024-01-01' AS BIGINT) // 5 AS VARCHAR), 2, '0') AS run_id, url AS page, 'Check ' || lpad(CAST(k % 24 AS VARCHAR), 2, '0') AS title,
        'Category ' || (k % 6) AS category, CASE WHEN k % 2 = 0 THEN 'geo' ELSE 'aeo' END AS family,
        CASE max(CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) WHEN 5 THEN 'FAIL' WHEN 4 THEN 'PARTIAL' WHEN 3 THEN 'MANUAL_REVIEW' WHEN 2 THEN 'UNKNOWN' ELSE 'PASS' END AS status,
        CASE k % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, CAST(1 + k % 3 AS BIGINT) AS weight FROM event GROUP BY ALL""",
    ),
    "hit": (
        ("event",),
        """SELECT event_id AS hit_id, site_id || '.example' AS domain, ts, CASE event_id % 7 WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 2 THEN 'Mozilla/5.0 (compatible; YandexBot/3.0)'
        WHEN 3 THEN 'Mozilla/5.0 (compatible; GPTBot/1.2)' WHEN 4 THEN 'Mozilla/5.0 (compatible; Mail.RU_Bot/2.0)' WHEN 5 THEN 'AhrefsBot/7.0' ELSE 'Mozilla/5.0 (Windows NT 10.0)' END AS user_agent,
        CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 4 = 0 THEN 304 ELSE 200 END AS status FROM event""",
    ),
    "keyword_metric": (
        (),
        "SELECT lower(p_name) AS keyword, 'c' || (p_partkey % 3) AS country, 'prov' || (p_size % 4) AS provider, CAST(p_size * 10 AS BIGINT) AS volume, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 101 AS BIGINT) END AS kd, DATE '2024-01-30' - CAST(p_partkey % 90 AS INTEGER) AS checked_at FROM part",
    ),
    "ref_domain": (
        (),
        "SELECT 'site' || (o_custkey % 5) AS target, 'ref' || (o_custkey % 97) || '.example' AS ref_domain, 'prov' || (o_orderkey % 2) AS provider, min(CAST(o_orderdate AS DATE)) AS first_seen, max(CAST(o_orderdate AS DATE)) AS last_seen, CAST(max(o_custkey % 90) AS BIGINT) AS dr, CAST(count(*) AS BIGINT) AS links FROM orders GROUP BY 1, 2, 3",
    ),
    "competitor_keyword": (
        ("event",),
        "SELECT 'rival' || (user_id % 3) AS competitor, 'site' || (user_id % 5) AS site_id, 'q' || (k % 60) AS keyword, CAST(min(1 + event_id % 50) AS BIGINT) AS position, CAST(max(k * 10) AS BIGINT) AS volume FROM event GROUP BY ALL",
    ),
}


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    site = F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string"))
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("date"), "user_id", "event_type", "value", k.alias("k"), site.alias("site_id"),
        F.concat(F.lit("q"), (k % 40).cast("string")).alias("query"), F.concat(F.lit("https://"), site, F.lit(".example/p"), (F.col("user_id") % 17).cast("string")).alias("url"),
    )


def _measured(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"), (F.sum("event_id") % 300 + 10).alias("pos10")
    ).withColumn("position", F.col("pos10") / 10.0)


def page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(event(spark, sf_dir), "site_id", "date", "query", "url")


def intent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring(F.col("query"), 2, 9).cast("bigint")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    said = F.concat_ws(" ", pick(FIRST, n), pick(SECOND, F.floor(n / 2)), pick(THIRD, F.floor(n / 3)))
    return page_query(spark, sf_dir).select("site_id", "date", n.alias("n"), said.alias("query"), "url", "impressions", "clicks", "position")


def page_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(event(spark, sf_dir), "site_id", "date", "url")


def site_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(event(spark, sf_dir), "site_id", "date")


def rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("event_type") != "error") & (F.col("event_id") % 11 != 0)
    return event(spark, sf_dir).select(
        F.col("event_id").alias("check_id"), "site_id", F.col("query").alias("keyword"), F.col("ts").alias("checked_at"), "url",
        F.when(good, F.col("event_id") % 60 + 1).alias("position"), F.when(F.col("event_type") == "error", "timeout").alias("error"),
    )


def _asked(e: DataFrame) -> list:
    return [F.col("event_id").alias("check_id"), F.concat(F.lit("question "), (F.col("k") % 25).cast("string")).alias("question"), F.concat(F.lit("engine"), (F.col("user_id") % 4).cast("string")).alias("engine")]


def aeo_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event(spark, sf_dir)
    third = F.col("event_id") % 3
    return e.select(*_asked(e), F.col("ts").alias("checked_at"), F.when(F.col("event_type") == "error", "timeout").alias("error"), F.when(third == 0, "cited").when(third == 1, "mentioned").otherwise("absent").alias("verdict"), "site_id")


def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event(spark, sf_dir).filter("event_type <> 'error'")
    d = F.explode(F.array(F.col("event_id") % 13, (F.col("event_id") * 7 + 3) % 13))
    host = F.when(F.col("d") % 6 == 0, "www.site0.example").otherwise(F.concat(F.lit("ref"), F.col("d").cast("string"), F.lit(".example")))
    return e.select(*_asked(e), "site_id", d.alias("d")).select("check_id", "question", "engine", "site_id", F.concat(F.lit("https://"), host, F.lit("/a"), (F.col("check_id") % 9).cast("string")).alias("url"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    level = F.max(F.when(kind == "error", 5).when(kind == "purchase", 4).when(kind == "signup", 3).when(kind == "click", 2).otherwise(1))
    two = lambda x: F.lpad(x.cast("bigint").cast("string"), 2, "0")
    keyed = e.select(
        F.concat(F.lit("run"), two(F.floor(F.datediff("date", F.lit(date(2024, 1, 1))) / 5))).alias("run_id"), F.col("url").alias("page"), F.concat(F.lit("Check "), two(k % 24)).alias("title"),
        F.concat(F.lit("Category "), (k % 6).cast("string")).alias("category"), F.when(k % 2 == 0, "geo").otherwise("aeo").alias("family"), "event_type",
        F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").when(k % 4 == 2, "medium").otherwise("low").alias("severity"), (k % 3 + 1).alias("weight"),
    )
    keys = [c for c in keyed.columns if c != "event_type"]
    worst = keyed.groupBy(*keys).agg(level.alias("level"))
    status = F.when(F.col("level") == 5, "FAIL").when(F.col("level") == 4, "PARTIAL").when(F.col("level") == 3, "MANUAL_REVIEW").when(F.col("level") == 2, "UNKNOWN").otherwise("PASS")
    return worst.withColumn("status", status).drop("level")


def hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = event(spark, sf_dir), F.col("event_id") % 7
    agents = ["Mozilla/5.0 (compatible; Googlebot/2.1)", "Mozilla/5.0 (compatible; bingbot/2.0)", "Mozilla/5.0 (compatible; YandexBot/3.0)", "Mozilla/5.0 (compatible; GPTBot/1.2)", "Mozilla/5.0 (compatible; Mail.RU_Bot/2.0)", "AhrefsBot/7.0", "Mozilla/5.0 (Windows NT 10.0)"]
    return e.select(
        F.col("event_id").alias("hit_id"), F.concat("site_id", F.lit(".example")).alias("domain"), "ts", F.element_at(F.array(*map(F.lit, agents)), (m + 1).cast("int")).alias("user_agent"),
        F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 4 == 0, 304).otherwise(200).alias("status"),
    )


def keyword_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    return p.select(
        F.lower("p_name").alias("keyword"), F.concat(F.lit("c"), (key % 3).cast("string")).alias("country"), F.concat(F.lit("prov"), (F.col("p_size") % 4).cast("string")).alias("provider"),
        (F.col("p_size") * 10).cast("bigint").alias("volume"), F.when(key % 4 != 0, key % 101).alias("kd"), F.date_sub(F.lit(AS_OF), (key % 90).cast("int")).alias("checked_at"),
    )


def ref_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cust = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_custkey")
    keyed = o.select(
        F.concat(F.lit("site"), (cust % 5).cast("string")).alias("target"), F.concat(F.lit("ref"), (cust % 97).cast("string"), F.lit(".example")).alias("ref_domain"),
        F.concat(F.lit("prov"), (F.col("o_orderkey") % 2).cast("string")).alias("provider"), F.to_date("o_orderdate").alias("d"), (cust % 90).alias("r"),
    )
    return keyed.groupBy("target", "ref_domain", "provider").agg(F.min("d").alias("first_seen"), F.max("d").alias("last_seen"), F.max("r").alias("dr"), F.count("*").alias("links"))


def competitor_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event(spark, sf_dir)
    keyed = e.select(F.concat(F.lit("rival"), (F.col("user_id") % 3).cast("string")).alias("competitor"), "site_id", F.concat(F.lit("q"), (F.col("k") % 60).cast("string")).alias("keyword"), "event_id", "k")
    return keyed.groupBy("competitor", "site_id", "keyword").agg(F.min(F.col("event_id") % 50 + 1).alias("position"), F.max(F.col("k") * 10).alias("volume"))
