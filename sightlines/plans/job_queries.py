"""Registered queries of the ingest and streaming operators."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date

from pyspark.sql import functions as F

from sightlines.operators import change as C
from sightlines.sources import ingest as I
from sightlines.functions.payloads import classify_payload
from sightlines.streaming import jobs as J
from sightlines.streaming import states as SS

from . import facts
from .facts import AS_OF
from .page_queries import _BOT
from .registry import query

_DAILY = f"dy AS (SELECT domain, CAST(ts AS DATE) AS day, {_BOT} AS bot, status, count(*) AS hits FROM hit GROUP BY ALL)"


@query("a18_crawler_daily", f"WITH {_DAILY} SELECT * FROM dy", "hit")
def a18_crawler_daily(spark, d):
    return J.crawler_daily(facts.hit(spark, d))


@query(
    "a19_crawler_stats",
    f"""WITH {_DAILY}, t AS (SELECT domain, CAST(sum(hits) AS BIGINT) AS hits, {", ".join(f"CAST(coalesce(sum(hits) FILTER (bot = '{b}'), 0) AS BIGINT) AS {b}" for b in ("google", "bing", "yandex", "mailru", "ai", "other", "redirect"))}, CAST(coalesce(sum(hits) FILTER (status = 304), 0) AS BIGINT) AS not_modified FROM dy GROUP BY domain)
    SELECT *, floor(CAST(hits AS DOUBLE) / (SELECT sum(hits) FROM t) * 1000 + 0.5) / 10.0 AS share FROM t""",
    "hit",
)
def a19_crawler_stats(spark, d):
    return J.crawler_stats(J.crawler_daily(facts.hit(spark, d)))


def _shared(spark) -> str:
    """A new folder below the one that driver and executors share; a local one only where a local session has none."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark, df, job, sink, mode="update", files=1):
    """Runs a stream over a table's rows, a file at a time, to its end into a foreachBatch sink; returns the sink's path."""
    at = _shared(spark)
    df.repartition(files).write.parquet(f"{at}/in") if files > 1 else df.write.parquet(f"{at}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    q = job(source).writeStream.outputMode(mode).foreachBatch(sink(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{at}/out"


@query("r1_stream_crawler_daily", f"WITH {_DAILY} SELECT * FROM dy", "hit")
def r1_stream_crawler_daily(spark, d):
    out = _streamed(spark, facts.hit(spark, d), J.stream_crawler_daily, lambda p: J.merge_totals(p, ["domain", "day", "bot", "status"], "hits"))
    return J.read_days(spark, out).select("domain", "day", "bot", "status", "hits")


@query("r2_retain_recent", "SELECT h.hit_id, domain FROM hit h JOIN (SELECT domain, max(CAST(ts AS DATE)) AS last FROM hit GROUP BY 1) l USING (domain) WHERE CAST(ts AS DATE) > last - 7", "hit")
def r2_retain_recent(spark, d):
    return J.retain_recent(facts.hit(spark, d), 7).select("hit_id", "domain")


@query(
    "r5_stream_rank_state",
    """WITH r AS (SELECT *, lag(position) OVER (PARTITION BY site_id, keyword ORDER BY checked_at, check_id) AS previous, row_number() OVER (PARTITION BY site_id, keyword ORDER BY checked_at DESC, check_id DESC) AS n, min(position) OVER (PARTITION BY site_id, keyword) AS best FROM rank_check WHERE error IS NULL)
    SELECT site_id, keyword, position AS last_position, previous AS previous_position, best AS best_position FROM r WHERE n = 1""",
    "rank_check",
)
def r5_stream_rank_state(spark, d):
    SS.use_rocksdb(spark)
    out = _streamed(spark, facts.rank_check(spark, d), SS.stream_rank_state, J.state_sink)
    return J.read_states(spark, out, ["site_id", "keyword"]).select("site_id", "keyword", "last_position", "previous_position", "best_position")


@query("r6_stream_verdict_state", "SELECT question, engine, arg_max(verdict, (checked_at, check_id)) FILTER (error IS NULL) AS verdict, CAST(count_if(error IS NOT NULL) AS BIGINT) AS errors FROM aeo_check GROUP BY ALL", "aeo_check")
def r6_stream_verdict_state(spark, d):
    SS.use_rocksdb(spark)
    return J.read_states(spark, _streamed(spark, facts.aeo_check(spark, d), SS.stream_verdict_state, J.state_sink), ["question", "engine"])


@query(
    "r3_evaluate_alerts",
    """WITH r AS (SELECT *, lag(position) OVER w AS previous, row_number() OVER (PARTITION BY site_id, keyword ORDER BY checked_at DESC, check_id DESC) AS n FROM rank_check WHERE error IS NULL WINDOW w AS (PARTITION BY site_id, keyword ORDER BY checked_at, check_id)),
    t AS (SELECT site_id, coalesce(sum(clicks * 5) FILTER (date >= DATE '2024-01-23' AND right(site_id, 1)::INT > 2), 0) AS c, sum(clicks * 5) FILTER (date BETWEEN DATE '2024-01-16' AND DATE '2024-01-22') AS p FROM site_day GROUP BY 1),
    u AS (SELECT site_id, max_by(struct_pack(i := user_id, h := (user_id * 7) % 100), (ts, user_id)) AS a FROM event WHERE event_type <> 'error' GROUP BY 1),
    a AS (SELECT site_id, 'rank_drop' AS kind, keyword AS subject, 'rank_drop:' || site_id || ':' || keyword || ':2024-01-30' AS dedupe_key FROM r WHERE n = 1 AND position - previous >= 5 AND CAST(checked_at AS DATE) >= DATE '2024-01-29'
    UNION ALL SELECT site_id, 'ssl_expiry', site_id || '.example', 'ssl_expiry:' || site_id || ':2024w5' FROM (SELECT DISTINCT site_id FROM event) WHERE right(site_id, 1)::INT < 2
    UNION ALL SELECT site_id, 'traffic_drop', site_id, 'traffic_drop:' || site_id || ':2024w5' FROM t WHERE p >= 50 AND c < p * (1 - 30.0 / 100)
    UNION ALL SELECT site_id, 'audit_score', CAST(a.i AS VARCHAR), 'audit_score:' || a.i FROM u WHERE a.h < 50
    UNION ALL SELECT target, 'lost_link', CAST(count(DISTINCT ref_domain) AS VARCHAR), 'lost_link:' || target || ':2024-01-30' FROM ref_domain WHERE dr >= 50 AND links % 9 = 0 GROUP BY target) SELECT * FROM a WHERE subject <> 'q1'""",
    "rank_check event site_day ref_domain",
)
def r3_evaluate_alerts(spark, d):
    """R3 and R4: alerts that an earlier log does not hold."""
    e = facts.event(spark, d)
    certs = e.select("site_id").distinct().select("site_id", F.concat("site_id", F.lit(".example")).alias("host"), F.when(F.substring("site_id", -1, 1).cast("int") < 2, 3).otherwise(60).alias("days_left"))
    days = facts.site_day(spark, d).withColumn("clicks", F.when((F.col("date") >= F.lit(date(2024, 1, 23))) & (F.substring("site_id", -1, 1).cast("int") <= 2), 0).otherwise(F.col("clicks") * 5))
    audits = e.select(F.col("user_id").alias("audit_id"), "site_id", F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), (F.col("user_id") * 7 % 100).alias("health"))
    lost = facts.ref_domain(spark, d).filter("links % 9 = 0").select(F.col("target").alias("site_id"), "ref_domain", F.lit(AS_OF).alias("lost_at"), "dr")
    alerts = J.evaluate_alerts(AS_OF, days, C.rank_state(facts.rank_check(spark, d)), certs, audits, lost)
    return J.once(alerts, alerts.filter("subject = 'q1'"))


@query("r7_stream_snapshots", "SELECT site_id, CAST(ts AS DATE) AS day, max(ts) AS pulled_at, max_by(event_id, (ts, event_id)) AS event_id FROM event GROUP BY ALL", "event")
def r7_stream_snapshots(spark, d):
    """Pulls arrive as a stream, several of a day in different batches."""
    e = facts.event(spark, d).select("site_id", F.col("ts").cast("timestamp").alias("pulled_at"), "event_id")
    out = _streamed(spark, e, lambda s: s, lambda p: J.snapshot_sink(p, ["site_id"]), "append")
    return J.read_days(spark, out).select("site_id", "day", F.col("pulled_at").cast("timestamp_ntz").alias("pulled_at"), "event_id")


@query(
    "r8_stream_behavior",
    """WITH s AS (SELECT url, CAST(ts AS DATE) AS day, user_id AS sessions, k AS rage_clicks, event_id % 100 AS scroll FROM event QUALIFY row_number() OVER (PARTITION BY url, CAST(ts AS DATE) ORDER BY ts DESC, event_id % 100 DESC) = 1), w AS (SELECT * FROM s QUALIFY day > max(day) OVER (PARTITION BY url) - 14)
    SELECT url, count(*) AS days, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(rage_clicks) AS BIGINT) AS rage_clicks, max(scroll) AS scroll FROM w GROUP BY url""",
    "event",
)
def r8_stream_behavior(spark, d):
    e = facts.event(spark, d).select("url", F.col("ts").cast("timestamp").alias("pulled_at"), F.col("user_id").alias("sessions"), F.col("k").alias("rage_clicks"), (F.col("event_id") % 100).alias("scroll"))
    out = _streamed(spark, e, lambda s: s, lambda p: J.snapshot_sink(p, ["url"]), "append")
    return J.behavior_of_days(spark, out, ["url"], 14)


@query(
    "r8_sliding_behavior",
    """WITH s AS (SELECT url AS key, CAST(ts AS DATE) AS day, user_id AS sessions, k AS rage_clicks, event_id % 100 AS scroll FROM event QUALIFY row_number() OVER (PARTITION BY url, CAST(ts AS DATE) ORDER BY ts DESC, user_id DESC, k DESC, event_id % 100 DESC) = 1), w AS (SELECT *, max(day) OVER (PARTITION BY key) AS last_day FROM s QUALIFY day > max(day) OVER (PARTITION BY key) - 14)
    SELECT key, any_value(last_day) AS last_day, count(*) AS days, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(rage_clicks) AS BIGINT) AS rage_clicks, max(scroll) AS scroll FROM w GROUP BY key""",
    "event",
)
def r8_sliding_behavior(spark, d):
    """The window of A39 kept in state, as pulls arrive."""
    SS.use_rocksdb(spark)
    e = facts.event(spark, d).select(F.col("url").alias("key"), F.col("ts").cast("timestamp").alias("pulled_at"), F.col("user_id").alias("sessions"), F.col("k").alias("rage_clicks"), (F.col("event_id") % 100).alias("scroll"))
    return J.read_states(spark, _streamed(spark, e, lambda s: SS.stream_behavior_window(s, 14), J.state_sink), ["key"])


@query(
    "r4_stream_once",
    "SELECT DISTINCT 'rank_drop:' || site_id || ':' || query || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS dedupe_key FROM event WHERE event_type = 'error'",
    "event",
)
def r4_stream_once(spark, d):
    """Alerts of every failed event, written twice: each key fires once."""
    e = facts.event(spark, d).filter("event_type = 'error'").select("ts", F.concat_ws(":", F.lit("rank_drop"), "site_id", "query", F.to_date("ts").cast("string")).alias("dedupe_key"))
    out = _streamed(spark, e.unionByName(e), J.stream_once, J.state_sink, "append")
    return spark.read.parquet(out).select("dedupe_key")


@query("r7_daily_snapshots", "SELECT site_id, CAST(ts AS DATE) AS day, event_id FROM event QUALIFY row_number() OVER (PARTITION BY site_id, CAST(ts AS DATE) ORDER BY ts DESC) = 1", "event")
def r7_daily_snapshots(spark, d):
    e = facts.event(spark, d).select("site_id", F.col("ts").alias("pulled_at"), "event_id")
    return J.daily_snapshots(e, ["site_id"]).select("site_id", "day", "event_id")


@query(
    "a39_behavior_window",
    """WITH s AS (SELECT url, CAST(ts AS DATE) AS day, user_id AS sessions, k AS rage_clicks, event_id % 100 AS scroll FROM event QUALIFY row_number() OVER (PARTITION BY url, CAST(ts AS DATE) ORDER BY ts DESC) = 1), w AS (SELECT * FROM s QUALIFY day > max(day) OVER (PARTITION BY url) - 14)
    SELECT url, count(*) AS days, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(rage_clicks) AS BIGINT) AS rage_clicks, max(scroll) AS scroll FROM w GROUP BY url""",
    "event",
)
def a39_behavior_window(spark, d):
    e = facts.event(spark, d).select("url", F.col("ts").alias("pulled_at"), F.col("user_id").alias("sessions"), F.col("k").alias("rage_clicks"), (F.col("event_id") % 100).alias("scroll"))
    return J.behavior_window(e, ["url"], 14)


@query("s7_parse_behavior", "SELECT site_id, url, CAST(sum(user_id) FILTER (event_type = 'click') AS BIGINT) AS sessions, CAST(sum(user_id) FILTER (event_type = 'view') AS BIGINT) AS rage_clicks, CAST(NULL AS BIGINT) AS dead_clicks FROM event WHERE event_type IN ('click', 'view') GROUP BY ALL", "event")
def s7_parse_behavior(spark, d):
    name = F.when(F.col("event_type") == "click", "Traffic").otherwise("RageClickCount")
    info = F.array(F.struct("url", F.col("user_id").cast("string").alias("sessionsCount"), F.lit(None).cast("string").alias("subTotal")))
    e = facts.event(spark, d).filter("event_type in ('click', 'view')").select("site_id", F.to_json(F.array(F.struct(name.alias("metricName"), info.alias("information")))).alias("json"))
    return I.parse_behavior(e)


@query("s9_analytics_rows", "SELECT site_id, date, CAST(count(*) AS BIGINT) AS sessions, count(DISTINCT user_id) AS users FROM event GROUP BY ALL", "event")
def s9_analytics_rows(spark, d):
    e = facts.event(spark, d).groupBy("site_id", F.date_format("date", "yyyyMMdd").alias("date")).agg(F.count("*").cast("string").alias("sessions"), F.countDistinct("user_id").cast("string").alias("users"))
    return I.analytics_rows(e)


@query("a51_analytics_breakdowns", "(SELECT url AS value, CAST(sum(k) AS BIGINT) AS k, 'url' AS dimension FROM event GROUP BY url ORDER BY k DESC, value LIMIT 10) UNION ALL (SELECT event_type, CAST(sum(k) AS BIGINT) AS k, 'event_type' FROM event GROUP BY event_type ORDER BY k DESC, event_type LIMIT 10)", "event")
def a51_analytics_breakdowns(spark, d):
    return I.analytics_breakdowns(facts.event(spark, d), ["url", "event_type"], "k")


@query("s11_parse_sitemaps", "SELECT 'https://s.example/a?b=1&c=' || page_id AS url, CASE WHEN page_id % 3 <> 0 THEN CASE WHEN page_id % 3 = 1 THEN '2024-01-0' || (1 + page_id % 9) ELSE 'yesterday' END END AS lastmod, page_id % 3 = 1 AS lastmod_valid, CAST(page_id % 2 AS INTEGER) AS image_count, TRUE AS valid FROM pages")
def s11_parse_sitemaps(spark, d):
    i = F.col("page_id")
    mod = F.when(i % 3 == 1, F.concat(F.lit("<lastmod>2024-01-0"), (i % 9 + 1).cast("string"), F.lit("</lastmod>"))).when(i % 3 == 2, "<lastmod>yesterday</lastmod>").otherwise("")
    body = F.concat(F.lit("<urlset><url><loc>https://s.example/a?b=1&amp;c="), i.cast("string"), F.lit("</loc>"), mod, F.when(i % 2 == 1, "<image:image><x/></image:image>").otherwise(""), F.lit("</url></urlset>"))
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.lit("m").alias("url"), body.alias("body"))
    return I.parse_sitemaps(p).select("url", "lastmod", "lastmod_valid", "image_count", "valid")


@query("s14_parse_robots", "SELECT 'h' || c_custkey AS host, bot, CASE WHEN bot = 'gptbot' AND c_custkey % 2 = 0 THEN 'blocked' WHEN bot <> 'gptbot' AND c_custkey % 3 = 0 THEN 'blocked' ELSE 'allowed' END AS access FROM customer, (VALUES ('gptbot'), ('bingbot')) v(bot)")
def s14_parse_robots(spark, d):
    """Robots files parsed (S14), then root access by bot (F27)."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("User-agent: GPTBot # ai\nDisallow: "), F.when(k % 2 == 0, "/").otherwise("/x"), F.lit("\n\nUser-agent: *\nDisallow: "), F.when(k % 3 == 0, "/").otherwise(""), F.lit("\nAllow: /public"))
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("h"), k.cast("string")).alias("host"), body.alias("body"))
    return I.bot_access(I.parse_robots(docs), ["gptbot", "bingbot"])


@query("s12_parse_inventory", "SELECT 'json' AS source_type, 'https://a.example/' || page_id AS url FROM pages UNION ALL SELECT 'json', 'https://b.example/x' FROM pages")
def s12_parse_inventory(spark, d):
    body = F.concat(F.lit('{"urls": ["https://a.example/'), F.col("page_id").cast("string"), F.lit('", {"deep": "https://b.example/x"}]}'))
    return I.parse_inventory(spark.read.parquet(f"{d}/pages.parquet").select("url", body.alias("body"))).select("source_type", "url")


@query("s13_parse_agent_files", "SELECT 'h' || page_id AS host, 2 AS headings, 2 AS links, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS duplicate_links, 1 AS off_domain FROM pages")
def s13_parse_agent_files(spark, d):
    i = F.col("page_id")
    body = F.concat(F.lit("# Title\n\n## Docs\n- [a](https://x.example/1)\n- [b]("), F.when(i % 2 == 0, "https://x.example/1").otherwise("/local"), F.lit(")\n"))
    docs = spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("h"), i.cast("string")).alias("host"), body.alias("body"))
    return I.parse_agent_files(docs).select("host", "headings", "links", "duplicate_links", "off_domain")


@query("s5_display_numbers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1000.0 + 300 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS n FROM part")
def s5_display_numbers(spark, d):
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(s, F.lit("K"))).when(k == 1, F.concat(s, F.lit(",300"))).when(k == 2, F.concat(F.lit("$"), s, F.lit(".50"))).otherwise("n/a")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", I.number(text).alias("n"))


@query(
    "f32_classify_payload",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'json' WHEN 2 THEN 'fenced_json' WHEN 3 THEN 'embedded_json' WHEN 4 THEN 'plain_text' WHEN 5 THEN 'malformed_json' WHEN 6 THEN 'non_object_json' ELSE 'empty' END AS kind,
    CASE event_id % 8 WHEN 1 THEN '{"a": ' || event_id || '}' WHEN 2 THEN '{"b": ' || event_id || '}' WHEN 3 THEN '{"c": ' || event_id || '}' END AS value FROM events""",
)
def f32_classify_payload(spark, d):
    n = F.col("event_id").cast("string")
    forms = ["", ' {"a": #}', '```json {"b": #} ```', 'it is {"c": #} so', "no answer #", '{"a": ', "[#]", None]
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 8 + 1).cast("int"))
    p = classify_payload(F.replace(text, F.lit("#"), n))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", p.alias("p")).select("event_id", "p.kind", "p.value")
