"""Change over time: merges, diffs between pulls, and state derived from check series.

Evidence of absence counts only from complete reads: every diff takes `complete`.
State ("last", "previous", "best") is always derived from the series, never stored.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(rows: DataFrame, keys: list[str], order: str, ties: list[str] | None = None) -> DataFrame:
    """The last row of each key by `order`."""
    last = Window.partitionBy(*keys).orderBy(F.desc(order), *(ties or []))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def replace_range(old: DataFrame, new: DataFrame, start: date, end: date, by: str = "site_id") -> DataFrame:
    """Replaces [start, end] of every site that the pull has rows of; days that vanished at the source vanish here."""
    pulled = new.select(F.col(by).alias("__by")).distinct()
    inside = F.col("date").between(F.lit(start), F.lit(end))
    kept = old.filter(~inside).unionByName(old.filter(inside).join(pulled, F.col(by) == F.col("__by"), "left_anti"))
    return kept.unionByName(new.filter(inside))


def plan_backfill(sites: DataFrame, facts: DataFrame, as_of: date, recent: int = 30, full: int = 480) -> DataFrame:
    """How many days to pull for each site: a few where recent rows exist, else all."""
    last = facts.groupBy("site_id").agg(F.max("date").alias("last_date"))
    fresh = F.datediff(F.lit(as_of), "last_date") <= recent
    return sites.join(last, "site_id", "left").withColumn("days", F.when(fresh, recent).otherwise(full))


def reconcile_archive(known: DataFrame, live: DataFrame, failed: DataFrame) -> DataFrame:
    """Archive flag of known sites (user_id, site_id, archived) against live listings; a failed or empty listing changes nothing."""
    listed = live.select("user_id").distinct().join(failed.select("user_id").distinct(), "user_id", "left_anti").withColumn("listed", F.lit(True))
    seen = live.select("user_id", "site_id").distinct().withColumn("seen", F.lit(True))
    both = known.join(listed, "user_id", "left").join(seen, ["user_id", "site_id"], "left")
    gone = F.col("seen").isNull()
    return both.select("user_id", "site_id", F.when(F.col("listed"), gone).otherwise(F.col("archived")).alias("archived"), F.coalesce(F.col("listed") & (gone != F.col("archived")), F.lit(False)).alias("changed"))


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], modes: dict[str, str], newer_than: str | None = None) -> DataFrame:
    """Target after a merge of source; modes by column: set, keep, add, keep_empty.

    set takes the source's value; keep takes it unless null; add sums both;
    keep_empty takes it only where the target has none.  With newer_than, a source row
    changes its target row only if that column is later.
    """
    s = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in modes], F.lit(True).alias("__in"))
    t = target.select(*keys, *modes, F.lit(True).alias("__old"))
    both = t.join(s, keys, "full_outer")
    hit = F.coalesce(F.col("__in"), F.lit(False))
    if newer_than:
        hit = hit & (F.col("__old").isNull() | F.col(newer_than).isNull() | (F.col(f"__{newer_than}") > F.col(newer_than)))

    def one(c: str, mode: str) -> Column:
        old, new = F.col(c), F.col(f"__{c}")
        value = {
            "set": new,
            "keep": F.coalesce(new, old),
            "add": F.when(old.isNull() & new.isNull(), None).otherwise(F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))),
            "keep_empty": F.coalesce(old, new),
        }[mode]
        return F.when(hit, value).otherwise(old).alias(c)

    return both.select(*keys, *[one(c, m) for c, m in modes.items()])


def discover_pages(sitemap: DataFrame, rankings: DataFrame) -> DataFrame:
    """Union of both url sets with where each was found."""
    a, b = sitemap.select("url").distinct().withColumn("a", F.lit(True)), rankings.select("url").distinct().withColumn("b", F.lit(True))
    both = a.join(b, "url", "full_outer")
    return both.select("url", F.when(F.col("a") & F.col("b"), "sitemap+ranking").when(F.col("a"), "sitemap").otherwise("ranking").alias("source"))


# -------------------------------------------------------------------- sitemaps

SITEMAP_FIELDS = ("lastmod", "image_count", "video_count", "news_count", "sitemap_type")


def sitemap_diff(state: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """Next state of every sitemap url: added, changed, restored, unchanged, pending, missing.

    A url goes missing only on its second miss in a row among complete reads.
    """
    old = state.select("url", *[F.col(f).alias(f"old_{f}") for f in SITEMAP_FIELDS], "inventory_status", "missing_syncs")
    new = seen.dropDuplicates(["url"]).select("url", *SITEMAP_FIELDS, F.lit(True).alias("seen"))
    both = old.join(new, "url", "full_outer")
    was, now = F.col("inventory_status").isNotNull(), F.col("seen").isNotNull()
    same = F.lit(True)
    for f in SITEMAP_FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    misses = F.when(now, 0).when(F.lit(complete), F.coalesce("missing_syncs", F.lit(0)) + 1).otherwise(F.coalesce("missing_syncs", F.lit(0)))
    gone = F.when(F.lit(not complete), F.col("inventory_status")).when(misses >= 2, "missing").otherwise("pending")
    status = F.when(now & ~was, "added").when(now & F.col("inventory_status").isin("missing", "pending"), "restored").when(now & ~same, "changed").when(now, "unchanged").otherwise(gone)
    return both.select(
        "url", status.alias("inventory_status"), misses.cast("int").alias("missing_syncs"), (status.eqNullSafe("missing") & ~F.col("inventory_status").eqNullSafe("missing")).alias("disappeared"),
        *[F.coalesce(F.col(f), F.col(f"old_{f}")).alias(f) for f in SITEMAP_FIELDS],
    )


def lastmod_verdict(prev_hash: Column, cur_hash: Column, prev_lastmod: Column, cur_lastmod: Column) -> Column:
    """Whether a page's lastmod follows its content."""
    known = prev_hash.isNotNull() & cur_hash.isNotNull()
    dated, edited = ~prev_lastmod.eqNullSafe(cur_lastmod), prev_hash != cur_hash
    return F.when(~known, "unknown").when(dated & ~edited, "suspicious").when(edited & ~dated, "stale").otherwise("reliable")


# Fixed list filters of an inventory table.
INVENTORY_FILTERS = {
    "indexed": lambda: F.col("index_status") == "indexed",
    "not_indexed": lambda: F.col("index_status").isNotNull() & (F.col("index_status") != "indexed"),
    "not_checked": lambda: F.col("index_status").isNull(),
    "added": lambda: F.col("inventory_status") == "added",
    "changed": lambda: F.col("inventory_status") == "changed",
    "pending": lambda: F.col("inventory_status") == "pending",
    "missing": lambda: F.col("inventory_status") == "missing",
    "lastmod_suspicious": lambda: F.col("lastmod_verdict") == "suspicious",
}


def inventory_filter(inventory: DataFrame, status: str, audited: DataFrame | None = None) -> DataFrame:
    if status == "audit_missing":
        key = lambda c: F.regexp_replace(c, "/+$", "")
        return inventory.join(audited.select(key(F.col("url")).alias("__u")).distinct(), key(F.col("url")) == F.col("__u"), "left_anti")
    return inventory.filter(INVENTORY_FILTERS[status]())


def inventory_counters(inventory: DataFrame, by: list[str]) -> DataFrame:
    return inventory.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(INVENTORY_FILTERS[k]()).alias(k) for k in INVENTORY_FILTERS])


def refdomain_diff(state: DataFrame, pull: DataFrame, complete: bool, as_of: date) -> DataFrame:
    """Referring domains after a pull: added, returned, lost (complete pulls only), kept."""
    keys = ["target", "ref_domain"]
    old = state.select(*keys, F.col("first_seen").alias("old_first"), F.col("last_seen").alias("old_last"), "lost_at")
    new = pull.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    both = old.join(new, keys, "full_outer")
    now, was, lost = F.col("last_seen").isNotNull(), F.col("old_last").isNotNull(), F.col("lost_at").isNotNull()
    change = F.when(now & ~was, "added").when(now & lost, "returned").when(now, "kept").when(lost | F.lit(not complete), "kept").otherwise("lost")
    return both.select(
        *keys, F.least("old_first", "first_seen").alias("first_seen"), F.greatest("old_last", "last_seen").alias("last_seen"),
        F.when(change == "lost", F.lit(as_of)).when(~now, F.col("lost_at")).alias("lost_at"), change.alias("change"),
    )


def verify_audit(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """resolved, still_present, regression or inconclusive for each (url, rule) of two audits (url, http_status, issues).

    A page that is absent now, failed or redirected proves nothing.
    """
    a = baseline.select("url", F.explode("issues").alias("rule")).distinct().withColumn("was", F.lit(True))
    b = current.select("url", F.explode("issues").alias("rule")).distinct().withColumn("now", F.lit(True))
    page = current.groupBy("url").agg(F.max(F.col("http_status").between(200, 299)).alias("good"))
    both = a.join(b, ["url", "rule"], "full_outer").join(page, "url", "left")
    sound = F.coalesce("good", F.lit(False))
    return both.select("url", "rule", F.when(~sound, "inconclusive").when(F.col("was") & F.col("now"), "still_present").when(F.col("was"), "resolved").otherwise("regression").alias("verdict"))


# ------------------------------------------------------------------ check series


def rank_state(checks: DataFrame) -> DataFrame:
    """Last, previous, best position and last url of each keyword; failed checks change nothing."""
    good = checks.filter("error is null")
    w = Window.partitionBy("site_id", "keyword").orderBy("checked_at", "check_id")
    rows = good.select("site_id", "keyword", "checked_at", "check_id", "position", "url", F.lag("position").over(w).alias("previous"))
    return rows.groupBy("site_id", "keyword").agg(
        F.max_by("position", F.struct("checked_at", "check_id")).alias("last_position"), F.max_by("previous", F.struct("checked_at", "check_id")).alias("previous_position"),
        F.min("position").alias("best_position"), F.max_by("url", F.struct("checked_at", "check_id")).alias("last_url"), F.max("checked_at").alias("checked_at"),
    )


def rank_history(checks: DataFrame, n: int = 10) -> DataFrame:
    """Of the last n good checks: oldest, newest and trend (positive is better)."""
    w = Window.partitionBy("site_id", "keyword").orderBy(F.desc("checked_at"), F.desc("check_id"))
    last = checks.filter("error is null and position is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
    t = last.groupBy("site_id", "keyword").agg(F.count("*").alias("checks"), F.min_by("position", "n").alias("newest"), F.max_by("position", "n").alias("oldest"))
    return t.withColumn("trend", F.col("oldest") - F.col("newest"))


def verdict_state(checks: DataFrame) -> DataFrame:
    """Current verdict of each (question, engine); an errored check keeps the last one."""
    order = F.struct("checked_at", "check_id")
    good = F.col("error").isNull()
    return checks.groupBy("question", "engine").agg(
        F.max_by(F.when(good, F.col("verdict")), F.when(good, order)).alias("verdict"), F.max("checked_at").alias("checked_at"), F.count("*").alias("checks"), F.count_if(~good).alias("errors")
    )


def rank_vs_search(checks: DataFrame, obs: DataFrame, days: Column | None = None) -> DataFrame:
    """Tracked rank and search position by day: the last check of a day and the mean of its rows."""
    a = checks.filter("position is not null").groupBy("site_id", F.col("keyword").alias("query"), F.to_date("checked_at").alias("date")).agg(F.max_by("position", F.struct("checked_at", "check_id")).alias("rank"))
    b = obs.groupBy("site_id", "query", "date").agg(F.min("position").alias("search_position"))
    return a.join(b, ["site_id", "query", "date"], "full_outer")


def asof_rank(events: DataFrame, checks: DataFrame) -> DataFrame:
    """The last known rank of (site_id, keyword) at or before each event's time, by one sort."""
    e = events.select("site_id", "keyword", F.col("at").alias("t"), "event_id", F.lit(None).cast("bigint").alias("position"), F.lit(1).alias("kind"))
    c = checks.filter("position is not null").select("site_id", "keyword", F.col("checked_at").alias("t"), F.col("check_id").alias("event_id"), F.col("position").cast("bigint"), F.lit(0).alias("kind"))
    w = Window.partitionBy("site_id", "keyword").orderBy("t", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(c).withColumn("rank", F.last("position", ignorenulls=True).over(w)).filter("kind = 1").select("site_id", "keyword", "event_id", F.col("t").alias("at"), "rank")


def rank_dashboard(tracked: DataFrame, page_query: DataFrame, checks: DataFrame) -> DataFrame:
    """Tracked keywords with their rank state and their newest search metrics."""
    s = page_query.groupBy("site_id", F.lower("query").alias("k")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    t = tracked.join(rank_state(checks), ["site_id", "keyword"], "left").withColumn("k", F.lower("keyword"))
    return t.join(s, ["site_id", "k"], "left").drop("k")


def monitoring_changes(runs: DataFrame) -> DataFrame:
    """Change of each url against its row in the run before (run_id, url, status, fingerprint)."""
    w = Window.partitionBy("url").orderBy("run_id")
    prev = F.lag(F.struct("run_id", "status", "fingerprint")).over(w)
    order = runs.select("run_id").distinct().withColumn("r", F.dense_rank().over(Window.orderBy("run_id")))  # a row for each run
    rows = runs.join(order, "run_id").withColumns({"p": prev, "pr": F.lag("r").over(Window.partitionBy("url").orderBy("r"))})
    missed = F.col("p").isNull() | (F.col("pr") != F.col("r") - 1)
    change = F.when(missed, "new").when(~F.col("p.status").eqNullSafe(F.col("status")), "status_changed").when(~F.col("p.fingerprint").eqNullSafe(F.col("fingerprint")), "content_changed").otherwise("unchanged")
    return rows.select("run_id", "url", "status", change.alias("change"))


def value_drift(src: Column, dst: Column) -> Column:
    """Struct of lost, added and kept values of two arrays."""
    return F.struct(F.array_sort(F.array_except(src, dst)).alias("lost"), F.array_sort(F.array_except(dst, src)).alias("added"), F.array_sort(F.array_intersect(src, dst)).alias("kept"))


def stale(keywords: DataFrame, cache: DataFrame, as_of: date, ttl_days: int, need_kd: bool = False) -> DataFrame:
    """Keywords without a fresh cached row (one with difficulty, if needed)."""
    fresh = cache.filter(F.datediff(F.lit(as_of), "checked_at") <= ttl_days)
    if need_kd:
        fresh = fresh.filter("kd is not null")
    return keywords.select("keyword", "country").distinct().join(fresh.select("keyword", "country").distinct(), ["keyword", "country"], "left_anti")
