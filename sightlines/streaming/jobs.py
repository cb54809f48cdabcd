"""Structured Streaming jobs: crawler-hit rollups, alerts, rank and verdict state."""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightlines.functions.urls import BOT_TYPES, bot_type


def crawler_daily(hits: DataFrame) -> DataFrame:
    """Hits by domain, day, bot and status; the same plan for a batch and a stream."""
    return hits.groupBy("domain", F.to_date("ts").alias("day"), bot_type(F.col("user_agent")).alias("bot"), "status").agg(F.count("*").alias("hits"))


def stream_crawler_daily(hits: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running totals of each day, for update mode; days older than the watermark are dropped from state."""
    w = F.window("ts", "1 day")
    t = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w.alias("w"), "domain", bot_type(F.col("user_agent")).alias("bot"), "status").agg(F.count("*").alias("hits"))
    return t.select("domain", F.to_date("w.start").alias("day"), "bot", "status", "hits")


def merge_totals(path: str, keys: list[str], value: str, day: str = "day"):
    """A foreachBatch sink that sets running totals in a Parquet table, by day; read it with `read_days`.

    A batch writes the days that it touches, whole, into a folder of its own number: a replayed
    batch changes nothing, days without news are never written again, and a reader sees whole batches.
    """
    return _day_sink(path, keys, day, lambda rows: rows.groupBy(*keys).agg(F.max(value).alias(value)))


def snapshot_sink(path: str, keys: list[str], order: str = "pulled_at"):
    """A foreachBatch sink that keeps one row for each key and day, the latest pull; read it with `read_days`."""
    def latest(rows: DataFrame) -> DataFrame:
        cols = [c for c in rows.columns if c not in (*keys, "day")]
        best = rows.groupBy(*keys, "day").agg(F.max_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("x"))
        return best.select(*keys, "day", "x.*")

    return _day_sink(path, [*keys, "day"], "day", latest, lambda rows: rows.withColumn("day", F.to_date(order)))


def _day_sink(path: str, keys: list[str], day: str, merge, prepare=lambda rows: rows):
    def sink(batch: DataFrame, epoch: int) -> None:
        new = prepare(batch)
        old = read_days(batch.sparkSession, path, day, before=epoch)
        if old is not None:
            touched = old.join(new.select(day).distinct(), day, "left_semi")
            new = touched.select(*new.columns).unionByName(new)
        merge(new).write.mode("overwrite").partitionBy(day).parquet(f"{path}/epoch={epoch}")

    return sink


def read_days(spark: SparkSession, path: str, day: str = "day", before: int | None = None) -> DataFrame | None:
    """The newest version of each day that batches (below `before`) have written; None where there is none."""
    try:
        all_ = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    rows = all_ if before is None else all_.filter(F.col("epoch") < before)
    newest = rows.groupBy(day).agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, [day, "epoch"]).drop("epoch").withColumn(day, F.col(day).cast("date"))


def state_sink(path: str):
    """A foreachBatch sink of states that a stream emits in update mode; read the last of each key with `read_states`."""
    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def read_states(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    cols = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "epoch").alias("x")).select(*keys, "x.*")


def retain_recent(hits: DataFrame, days: int) -> DataFrame:
    """Raw hits of the last days of each domain: an age bound by partition instead of a row count."""
    last = hits.groupBy("domain").agg(F.max(F.to_date("ts")).alias("last"))
    return hits.join(last, "domain").filter(F.to_date("ts") > F.date_sub("last", days)).drop("last")


def crawler_stats(daily: DataFrame) -> DataFrame:
    """Hits of each domain by bot, those answered 304, and the domain's share of all."""
    t = daily.groupBy("domain").agg(F.sum("hits").alias("hits"), *[F.coalesce(F.sum(F.when(F.col("bot") == b, F.col("hits"))), F.lit(0)).alias(b) for b in BOT_TYPES], F.coalesce(F.sum(F.when(F.col("status") == 304, F.col("hits"))), F.lit(0)).alias("not_modified"))
    total = t.agg(F.sum("hits").alias("all"))  # one row
    return t.join(F.broadcast(total)).withColumn("share", F.floor(F.col("hits") / F.col("all") * 1000 + 0.5) / 10.0).drop("all")


# ---------------------------------------------------------------------- alerts


# Fixed thresholds of the alerts: places lost, percent of clicks lost, days of a certificate, score of an audit, rating of a lost domain.
RANK_DROP, TRAFFIC_DROP, CERTIFICATE_DAYS, AUDIT_SCORE, LOST_RATING, LEAST_CLICKS = 5, 30.0, 14, 50, 50, 50


def evaluate_alerts(
    as_of: date, site_days: DataFrame | None = None, rank_state: DataFrame | None = None, certificates: DataFrame | None = None, audits: DataFrame | None = None, lost_domains: DataFrame | None = None,
) -> DataFrame:
    """(site_id, kind, subject, dedupe_key) of what needs attention on a day; tables that are not given raise nothing.

    * traffic_drop: the last 7 days' clicks of site_days are over 30 % below the 7 before, which had 50 or more; once a week
    * rank_drop: a keyword of rank_state, checked since the day before, fell 5 places or more; once a day
    * ssl_expiry: a certificate (site_id, host, days_left) has 14 days or less; once a week
    * audit_score: the latest completed audit (audit_id, site_id, started_at, status, health) is below 50; once an audit
    * lost_link: domains (site_id, ref_domain, lost_at, dr) rated 50 or more went away since the day before; once a day and site
    """
    day, week = F.lit(as_of.isoformat()), F.lit(f"{as_of.year}w{_week(as_of)}")
    key = lambda *parts: F.concat_ws(":", *parts).alias("dedupe_key")
    out = []
    kind = lambda k: F.lit(k).alias("kind")
    if site_days is not None:
        start, before = F.lit(as_of - timedelta(days=7)), F.lit(as_of - timedelta(days=14))
        sums = site_days.filter(F.col("date") >= before).groupBy("site_id").agg(*[F.coalesce(F.sum(F.when(on, F.col("clicks"))), F.lit(0)).alias(n) for n, on in (("now", F.col("date") >= start), ("was", F.col("date") < start))])
        out.append(sums.filter((F.col("was") >= LEAST_CLICKS) & (F.col("now") < F.col("was") * (1 - TRAFFIC_DROP / 100))).select("site_id", kind("traffic_drop"), F.col("site_id").alias("subject"), key(F.lit("traffic_drop"), "site_id", week)))
    if rank_state is not None:
        fresh = rank_state.filter(F.to_date("checked_at") >= F.lit(as_of - timedelta(days=1)))
        out.append(fresh.filter(F.col("last_position") - F.col("previous_position") >= RANK_DROP).select("site_id", kind("rank_drop"), F.col("keyword").alias("subject"), key(F.lit("rank_drop"), "site_id", "keyword", day)))
    if certificates is not None:
        out.append(certificates.filter(F.col("days_left") <= CERTIFICATE_DAYS).select("site_id", kind("ssl_expiry"), F.col("host").alias("subject"), key(F.lit("ssl_expiry"), "site_id", week)))
    if audits is not None:
        done = audits.filter("status = 'completed'").groupBy("site_id").agg(F.max_by(F.struct("audit_id", "health"), F.struct("started_at", "audit_id")).alias("a"))
        out.append(done.filter(F.col("a.health") < AUDIT_SCORE).select("site_id", kind("audit_score"), F.col("a.audit_id").cast("string").alias("subject"), key(F.lit("audit_score"), F.col("a.audit_id").cast("string"))))
    if lost_domains is not None:
        gone = lost_domains.filter((F.to_date("lost_at") >= F.lit(as_of - timedelta(days=1))) & (F.col("dr") >= LOST_RATING)).groupBy("site_id").agg(F.countDistinct("ref_domain").alias("n"))
        out.append(gone.select("site_id", kind("lost_link"), F.col("n").cast("string").alias("subject"), key(F.lit("lost_link"), "site_id", day)))
    return reduce(DataFrame.unionByName, out)


def _week(d: date) -> int:
    """Number of a week of the year that weekly alerts are told apart by; weeks begin on Sunday."""
    first = date(d.year, 1, 1)
    return math.ceil(((d - first).days + (first.weekday() + 1) % 7 + 1) / 7)


def once(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts whose key is not in the log, each once."""
    return alerts.dropDuplicates(["dedupe_key"]).join(log.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def stream_once(alerts: DataFrame, delay: str = "8 days") -> DataFrame:
    """The same for a stream with a time column ts; the watermark outlives a weekly key."""
    return alerts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dedupe_key"])


# ------------------------------------------------------------------- snapshots


def daily_snapshots(pulls: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and day; a later pull of the day replaces an earlier one."""
    w = Window.partitionBy(*keys, F.to_date("pulled_at")).orderBy(F.desc("pulled_at"))
    return pulls.withColumn("day", F.to_date("pulled_at")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def behavior_window(snapshots: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """Sums over the `days` days that end at each key's last day, one snapshot a day; scroll depth takes its largest."""
    once_ = daily_snapshots(snapshots, keys)
    last = F.max("day").over(Window.partitionBy(*keys))
    t = once_.withColumn("last", last).filter(F.col("day") > F.date_sub("last", days))
    return t.groupBy(*keys).agg(F.count("*").alias("days"), F.sum("sessions").alias("sessions"), F.sum("rage_clicks").alias("rage_clicks"), F.max("scroll").alias("scroll"))


def stream_snapshots(pulls: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Starts the stream that keeps one snapshot a day of each key at `path`; a later pull of the day corrects it."""
    return pulls.writeStream.foreachBatch(snapshot_sink(path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_behavior(pulls: DataFrame, path: str, keys: list[str], checkpoint: str):
    """The same for behaviour pulls (sessions, rage_clicks, scroll); `behavior_of_days` sums the window that ends at each key's last day."""
    return stream_snapshots(pulls, path, keys, checkpoint)


def behavior_of_days(spark: SparkSession, path: str, keys: list[str], days: int = 30) -> DataFrame:
    """Rolling sums over what a behaviour stream has kept."""
    return behavior_window(read_days(spark, path), keys, days)
