"""Search-performance analytics over page x query, page and site facts.

Facts carry site_id, date, [query], [url], clicks, impressions, position.  The
three grains are separate tables and never summed together.  Every operator is
a lazy plan: aggregates combine before their shuffle, top-k comes last.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.functions.numbers import Windows, ctr, exact_sum, js_round, mean_position, pct_change, windows

# Fixed click-through expectations of positions 1..10, in percent.
EXPECTED_CTR = {1: 27.6, 2: 15.8, 3: 11.0, 4: 8.4, 5: 6.3, 6: 4.9, 7: 3.9, 8: 3.3, 9: 2.7, 10: 2.4}


def grain(facts: DataFrame, which: str) -> DataFrame:
    """One grain of a table that tells grains apart by empty strings: site, page or page_query."""
    u, q = F.col("url") != "", F.col("query") != ""
    return facts.filter({"site": ~u & ~q, "page": u & ~q, "page_query": u & q}[which])


def page_filter(facts: DataFrame, part: str | None) -> DataFrame:
    """Rows whose url holds a text; no text keeps all."""
    return facts.filter(F.col("url").contains(part.strip())) if part and part.strip() else facts


def regex_filter(df: DataFrame, columns: list[str], pattern: str | None) -> DataFrame:
    """Rows where any of the columns holds the pattern, in any case; a pattern that is none matches nothing, an empty one all that is not null."""
    whole = f"(?i){pattern or ''}"
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(whole)).collect()  # one constant: does it compile
    except Exception as e:
        if "INVALID_PARAMETER_VALUE" not in str(e) and "PatternSyntaxException" not in str(e):
            raise
        return df.filter(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(whole), F.lit(False))
    return df.filter(hit)


def in_order(df: DataFrame, column: str, values: list[str], *then: str) -> DataFrame:
    """Sorted by a column's place in a list (case does not matter), others after the list by name, nulls last."""
    low = F.lower(F.col(column))
    place = F.array_position(F.array(*[F.lit(v.lower()) for v in values]), low)
    return df.orderBy(F.when(place > 0, place).otherwise(len(values) + 1).asc_nulls_last(), low.asc_nulls_last(), *then)


def listing(df: DataFrame, order: list, page: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered table; pages count from 1."""
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def breakdown(facts: DataFrame, dim: str, as_of: date, days: int) -> DataFrame:
    """A dimension's values (country, device) in both windows of a site, with their changes."""
    return compare_periods(facts, dim, as_of, days)


def _two(facts: DataFrame, w: Windows) -> DataFrame:
    return facts.filter(w.covers("date")).withColumn("side", w.when("date")).filter("side is not null")


def _side(agg, side: str, c: Column | str) -> Column:
    return agg(F.when(F.col("side") == side, F.col(c) if isinstance(c, str) else c))


def period_totals(facts: DataFrame, by: list[str], w: Windows, weighting: str = "rows") -> DataFrame:
    """clicks, impressions, position of both windows, in one pass."""
    rows, out = _two(facts, w), []
    for side, tag in (("now", ""), ("before", "prev_")):
        on = F.col("side") == side
        p = F.when(on, F.col("position"))
        weight = F.when(on, F.col("impressions")) if weighting == "impressions" else None
        out += [
            F.coalesce(_side(F.sum, side, "clicks"), F.lit(0)).alias(f"{tag}clicks"),
            F.coalesce(_side(F.sum, side, "impressions"), F.lit(0)).alias(f"{tag}impressions"),
            mean_position(p, weight).alias(f"{tag}position"),
        ]
    return rows.groupBy(*by).agg(*out)


def site_summary(site_day: DataFrame, as_of: date, days: int = 28, lag: int = 0, zero_baseline: str = "full") -> DataFrame:
    """Totals of a window and change against the one before, by site."""
    t = period_totals(site_day, ["site_id"], windows(as_of, days, lag))
    return t.withColumns(
        {
            "ctr": js_round(ctr("clicks", "impressions"), 4),
            "position": js_round("position", 2),
            "prev_position": js_round("prev_position", 2),
            "clicks_change": js_round(pct_change("clicks", "prev_clicks", zero_baseline), 1),
            "impressions_change": js_round(pct_change("impressions", "prev_impressions", zero_baseline), 1),
        }
    )


def engine_portfolio(site_day: DataFrame, previous: DataFrame | None, as_of: date, days: int = 28) -> DataFrame:
    """Like site_summary for another engine: position only over days that have one; a site without new rows keeps its last row."""
    w = windows(as_of, days)
    now = site_day.filter(F.col("date").between(F.lit(w.start), F.lit(w.end))).groupBy("site_id").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(mean_position(F.when(F.col("position") > 0, F.col("position"))), 2).alias("position")
    )
    if previous is None:
        return now
    old = previous.select("site_id", *[F.col(c).alias(f"old_{c}") for c in ("clicks", "impressions", "position")])
    both = now.join(old, "site_id", "full_outer")
    fresh = F.col("clicks").isNotNull()
    return both.select("site_id", *[F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("clicks", "impressions", "position")])


def compare_periods(facts: DataFrame, dim: str, as_of: date, days: int, lag: int = 0, by: tuple[str, ...] = ("site_id",), zero_baseline: str = "full") -> DataFrame:
    """Both windows by a dimension; status: new, lost or kept."""
    t = period_totals(facts, [*by, dim], windows(as_of, days, lag))
    seen, was = F.col("impressions") > 0, F.col("prev_impressions") > 0
    return t.withColumns(
        {
            "clicks_change": js_round(pct_change("clicks", "prev_clicks", zero_baseline), 1),
            "position": js_round("position", 2),
            "prev_position": js_round("prev_position", 2),
            "status": F.when(seen & ~was, "new").when(~seen & was, "lost").otherwise("kept"),
        }
    )


def winners_losers(facts: DataFrame, dim: str, as_of: date, days: int, k: int = 10, metric: str = "clicks") -> DataFrame:
    """The k largest gains and losses of each site, over the union of both windows' keys."""
    t = period_totals(facts, ["site_id", dim], windows(as_of, days)).withColumn("delta", F.col(metric) - F.col(f"prev_{metric}"))
    up, down = Window.partitionBy("site_id").orderBy(F.desc("delta"), dim), Window.partitionBy("site_id").orderBy("delta", dim)
    ranked = t.filter("delta <> 0").select(
        F.when(F.col("delta") > 0, "winner").otherwise("loser").alias("side"), "site_id", dim, F.col(metric).alias("now"), F.col(f"prev_{metric}").alias("before"), "delta",
        F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down"),
    )
    place = F.when(F.col("side") == "winner", F.col("up")).otherwise(F.col("down"))
    return ranked.withColumn("place", place).filter(F.col("place") <= k).drop("up", "down")


def new_rankings(page_query: DataFrame, as_of: date, days: int) -> DataFrame:
    """Queries seen now and never in the window before, with their best position."""
    w = windows(as_of, days)
    now = page_query.filter(F.col("date").between(F.lit(w.start), F.lit(w.end)))
    old = page_query.filter(F.col("date").between(F.lit(w.before_start), F.lit(w.before_end)))
    fresh = now.groupBy("site_id", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.min("position").alias("best_position"))
    return fresh.join(old.select("site_id", "query").distinct(), ["site_id", "query"], "left_anti")


def chart_series(site_day: DataFrame, as_of: date, days: int, match_weekday: bool = False) -> DataFrame:
    """Daily values with those of the same place in the window before."""
    w = windows(as_of, days, match_weekday=match_weekday)
    shift = (w.start - w.before_start).days
    cols = ["clicks", "impressions"]
    now = site_day.filter(F.col("date").between(F.lit(w.start), F.lit(w.end))).select("site_id", "date", *cols)
    old = site_day.filter(F.col("date").between(F.lit(w.before_start), F.lit(w.before_end))).select(
        "site_id", F.date_add("date", shift).alias("date"), *[F.col(c).alias(f"prev_{c}") for c in cols]
    )
    return now.join(old, ["site_id", "date"], "left")


def position_moves(facts: DataFrame, as_of: date, days: int, min_impressions: int = 10, dim: str = "query") -> DataFrame:
    """Movement of what has positions in both windows; a positive delta is an improvement."""
    t = period_totals(facts, ["site_id", dim], windows(as_of, days))
    both = t.filter((F.col("impressions") >= min_impressions) & (F.col("prev_impressions") >= min_impressions))
    return both.select("site_id", dim, "impressions", js_round("position", 1).alias("position"), js_round("prev_position", 1).alias("prev_position")).withColumn(
        "delta", js_round(F.col("prev_position") - F.col("position"), 1)
    )


def striking_distance(page_query: DataFrame, low: float = 4.0, high: float = 20.0, min_impressions: int = 10, limit: int | None = 100, by_query: bool = False) -> DataFrame:
    """Queries within reach of the first places: rows of the position band, summed by page and query."""
    keys = ["site_id", "query"] if by_query else ["site_id", "query", "url"]
    rows = page_query.filter(F.col("position").between(low, high) & (F.col("query") != ""))
    out = (
        rows.groupBy(*keys)
        .agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(mean_position("position"), 1).alias("position"))
        .filter(F.col("impressions") >= min_impressions)
        .withColumn("ctr", js_round(ctr("clicks", "impressions") * 100, 2))
    )
    return out.orderBy(F.desc("impressions"), *keys).limit(limit) if limit else out


def expected_ctr(position: Column) -> Column:
    """Percent of clicks that the nearest of places 1..10 lets expect."""
    table = F.create_map(*[F.lit(x) for kv in EXPECTED_CTR.items() for x in kv])
    place = F.greatest(F.lit(1), F.least(F.lit(10), js_round(position).cast("int")))
    return F.element_at(table, place)


def ctr_benchmark(page_query: DataFrame, min_impressions: int = 10) -> DataFrame:
    """Mean click-through rate of the rows on the first ten places against what the mean position lets expect, in percent."""
    rows = page_query.filter((F.col("query") != "") & (F.col("url") != "") & F.col("position").between(1, 10))
    t = rows.groupBy("site_id", "query", "url").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(mean_position("position"), 1).alias("position"), mean_position(ctr("clicks", "impressions")).alias("rate")
    )
    t = t.filter(F.col("impressions") >= min_impressions).withColumns({"actual_ctr": js_round(F.col("rate") * 1000) / 10, "expected_ctr": expected_ctr(F.col("position"))})
    return t.drop("rate").withColumn("difference", js_round(F.col("actual_ctr") - F.col("expected_ctr"), 1))


def search_performance(facts: DataFrame, dim: str, contains: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """Totals by query or page, optionally of pages that contain a text."""
    rows = facts
    if contains:
        rows = rows.filter(F.col("url").contains(contains))
    if start:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end:
        rows = rows.filter(F.col("date") <= F.lit(end))
    return rows.groupBy("site_id", dim).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(ctr(F.sum("clicks"), F.sum("impressions")) * 100, 2).alias("ctr"), js_round(mean_position("position", "impressions"), 1).alias("position")
    )


def page_queries(page_query: DataFrame, url: str, as_of: date, days: int = 28) -> DataFrame:
    """Queries of one page, whatever the scheme or last slash of its address."""
    same = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "^https?://", "")), "/+$", "")
    w = windows(as_of, days)
    rows = page_query.filter(F.col("date").between(F.lit(w.start), F.lit(w.end)) & (same(F.col("url")) == same(F.lit(url))))
    return rows.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(mean_position("position"), 1).alias("position"))


# ------------------------------------------------------------- brands and rules


def default_brand(host: Column) -> Column:
    """The first label of a host, without www."""
    return F.lower(F.element_at(F.split(F.regexp_replace(host, "^www\\.", ""), r"\."), 1))


def is_branded(query: Column, terms: list[str] | Column) -> Column:
    if isinstance(terms, list):
        terms = F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() as array<string>)")
    return F.exists(terms, lambda t: (t != "") & F.contains(F.lower(query), F.lower(t)))


def match_rules(value: Column, rules: Column) -> Column:
    """Whether any rule (array<struct<type,values>>) holds: contains, equals or startsWith one of its values, in any case."""
    v = F.lower(value)

    def one(rule: Column) -> Column:
        return F.exists(
            rule["values"],
            lambda x: F.when(rule["type"] == "equals", v == F.lower(x)).when(rule["type"] == "startsWith", F.startswith(v, F.lower(x))).otherwise(F.contains(v, F.lower(x))),
        )

    return F.exists(rules, one)


def group_metrics(facts: DataFrame, rules: DataFrame, dim: str, as_of: date, days: int) -> DataFrame:
    """Metrics of content groups or topic clusters (group_id, rules), with change.

    Values are first summed by value, so the rules are tried once for each
    distinct value, not for each row; the rule table is a small dimension.
    """
    by_value = period_totals(facts, ["site_id", dim], windows(as_of, days))
    hit = by_value.join(F.broadcast(rules), match_rules(F.col(dim), F.col("rules")))
    out = hit.groupBy("site_id", "group_id").agg(
        *[F.sum(c).alias(c) for c in ("clicks", "impressions", "prev_clicks", "prev_impressions")], F.count("*").alias("values")
    )
    return out.withColumn("clicks_change", js_round(pct_change("clicks", "prev_clicks"), 1))


def branded_split(page_query: DataFrame, terms: list[str]) -> DataFrame:
    """Clicks and impressions of branded and other queries by site and day."""
    b = is_branded(F.col("query"), terms)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return page_query.groupBy("site_id", "date").agg(
        zero(F.sum(F.when(b, F.col("clicks")))).alias("branded_clicks"), zero(F.sum(F.when(~b, F.col("clicks")))).alias("other_clicks"),
        zero(F.sum(F.when(b, F.col("impressions")))).alias("branded_impressions"), zero(F.sum(F.when(~b, F.col("impressions")))).alias("other_impressions"),
    )


def position_buckets(page_query: DataFrame) -> DataFrame:
    """Queries by the band of their mean position."""
    q = page_query.groupBy("site_id", "query").agg(mean_position("position").alias("p"), F.sum("clicks").alias("clicks"))
    band = F.when(F.col("p") <= 3, "1-3").when(F.col("p") <= 10, "4-10").when(F.col("p") <= 20, "11-20").otherwise("21+")
    return q.groupBy("site_id", band.alias("bucket")).agg(F.count("*").alias("queries"), F.sum("clicks").alias("clicks"))


# ----------------------------------------------------------------- inventories


def keyword_summary(obs: DataFrame) -> DataFrame:
    return obs.groupBy("site_id", "query", "url").agg(
        F.count("*").alias("observations"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.min("position").alias("best_position"),
        F.max("position").alias("worst_position"), js_round(mean_position("position"), 2).alias("avg_position"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
    )


def latest_observation(obs: DataFrame) -> DataFrame:
    """The newest row of each (site, query, url), without a self-join."""
    newest = F.max_by(F.struct("clicks", "impressions", "position"), F.col("date"))
    return obs.groupBy("site_id", "query", "url").agg(F.max("date").alias("date"), newest.alias("r")).select("site_id", "query", "url", "date", "r.clicks", "r.impressions", "r.position")


def keyword_status(last_seen: Column, as_of: date) -> Column:
    age = F.datediff(F.lit(as_of), last_seen)
    return F.when(age <= 7, "active_7d").when(age <= 30, "active_30d").when(age <= 90, "stale_90d").otherwise("historical")


def keyword_inventory(obs: DataFrame, as_of: date) -> DataFrame:
    """Summary, newest position and recency of every keyword, in one aggregate."""
    t = obs.groupBy("site_id", "query", "url").agg(
        F.count("*").alias("observations"), F.sum("impressions").alias("impressions"), F.min("position").alias("best_position"), F.max_by("position", "date").alias("current_position"), F.max("date").alias("last_seen")
    )
    return t.withColumn("status", keyword_status(F.col("last_seen"), as_of))


def landing_pages(page_query: DataFrame) -> DataFrame:
    return page_query.groupBy("site_id", "url").agg(
        F.countDistinct("query").alias("keywords"), F.min("position").alias("best_position"), js_round(mean_position("position"), 2).alias("avg_position"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )


def keywords_export(page_query: DataFrame) -> DataFrame:
    return page_query.groupBy("site_id", "query").agg(
        F.countDistinct("url").alias("pages"), F.min("position").alias("best_position"), js_round(mean_position("position"), 2).alias("avg_position"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )


def report_window(obs: DataFrame, days: int = 28) -> DataFrame:
    """Totals by site of the `days` days that end at the site's last date."""
    last = obs.groupBy("site_id").agg(F.max("date").alias("window_end"))
    rows = obs.join(last, "site_id").filter(F.col("date") > F.date_sub("window_end", days))
    return rows.groupBy("site_id", "window_end").agg(
        F.date_sub(F.first("window_end"), days - 1).alias("window_start"), F.countDistinct("query").alias("queries"), F.countDistinct("url").alias("pages"),
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), js_round(mean_position("position", "impressions"), 2).alias("position"),
    )


# ------------------------------------------------------------- cannibalization


def cannibalization_exact(page_query: DataFrame, min_share: float = 0.10, max_gap: float = 20.0, brand_terms: list[str] | None = None) -> DataFrame:
    """Queries that two or more pages compete for.

    A page counts with at least min_share of the query's impressions; the two
    largest may lie at most max_gap positions apart.  `is_true` where the two
    share their best query, so that they really aim at the same thing.
    """
    t = page_query.filter(F.col("query") != "")
    if brand_terms:
        t = t.filter(~is_branded(F.col("query"), brand_terms))
    t = t.groupBy("site_id", "query", "url").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), mean_position("position").alias("position"))
    top = Window.partitionBy("site_id", "url").orderBy(F.desc("clicks"), F.desc("impressions"), "query")
    q = Window.partitionBy("site_id", "query")
    rows = t.withColumns({"top_query": F.first("query").over(top), "total": F.sum("impressions").over(q)}).withColumn("share", F.col("impressions") / F.col("total"))
    rows = rows.filter(F.col("share") >= min_share).withColumn("place", F.row_number().over(q.orderBy(F.desc("impressions"), "url")))
    first, second = (lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))), 2
    out = rows.groupBy("site_id", "query").agg(
        F.count("*").alias("pages"), F.max("total").alias("impressions"), F.sum("clicks").alias("clicks"), first("url", 1).alias("main_url"), first("url", second).alias("rival_url"),
        F.abs(first("position", 1) - first("position", second)).alias("gap"), (first("top_query", 1) == first("top_query", second)).alias("is_true"),
    )
    return out.filter((F.col("pages") >= 2) & (F.col("gap") <= max_gap)).withColumn("gap", js_round("gap", 1))


def flip_flops(page_query_day: DataFrame) -> DataFrame:
    """How often the leading page of a query changed from one observed day to the next."""
    t = page_query_day.groupBy("site_id", "query", "date", "url").agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c"))
    best = F.row_number().over(Window.partitionBy("site_id", "query", "date").orderBy(F.desc("i"), F.desc("c"), "url"))
    winner = t.withColumn("n", best).filter("n = 1")
    before = F.lag("url").over(Window.partitionBy("site_id", "query").orderBy("date"))
    return winner.withColumn("b", before).groupBy("site_id", "query").agg(F.count("*").alias("days"), F.count_if(F.col("b").isNotNull() & (F.col("b") != F.col("url"))).alias("flips"))


# ----------------------------------------------------------------------- decay


def bucket_start(day: Column, unit: str) -> Column:
    """First day of the month or week (Monday) of a day."""
    return F.to_date(F.date_trunc(unit, day))


def decay_matrix(page_day: DataFrame, metric: str, unit: str, buckets: list[date], top: int = 50) -> DataFrame:
    """The top pages by the metric, one column for each bucket; the bucket list keeps the pivot to one pass."""
    t = page_day.withColumn("bucket", bucket_start(F.col("date"), unit)).filter(F.col("bucket").isin(buckets))
    t = t.groupBy("site_id", "url").pivot("bucket", buckets).agg(F.sum(metric))
    names = [f"b{i}" for i in range(len(buckets))]
    t = t.toDF("site_id", "url", *names).fillna(0, names)
    t = t.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("total"), "url"))
    return t.withColumn("place", place).filter(F.col("place") <= top)


def decay_flags(matrix: DataFrame, n: int, warn: float = -5.0, critical: float = -25.0) -> DataFrame:
    """Pages whose last two of n buckets are over 5 % (in whole percents) below the two before: Warning, or Critical from 25 % on."""
    now, old = F.col(f"b{n - 1}") + F.col(f"b{n - 2}"), F.col(f"b{n - 3}") + F.col(f"b{n - 4}")
    t = matrix.withColumn("change", F.when(old > 0, js_round((now - old) / old * 100, 0)).otherwise(0.0).cast("int")).filter(F.col("change") < warn)
    return t.withColumn("flag", F.when(F.col("change") <= critical, "Critical").otherwise("Warning"))


# ------------------------------------------------------------ series and events


def densify(series: DataFrame, start: date, end: date) -> DataFrame:
    """Every day of every site: no clicks and no position where there was no row."""
    spine = series.select("site_id").distinct().withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end))))
    return spine.join(series.select("site_id", "date", "clicks", "impressions", "position"), ["site_id", "date"], "left").fillna(0, ["clicks", "impressions"])


def fill_position(series: DataFrame) -> DataFrame:
    """Carries the last known position over gaps."""
    w = Window.partitionBy("site_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("position", F.last("position", ignorenulls=True).over(w))


def normalize_series(series: DataFrame, metric: str = "clicks", low: float = 5.0, high: float = 90.0) -> DataFrame:
    """Min-max scale of each site's series for a sparkline."""
    w = Window.partitionBy("site_id")
    lo, hi = F.min(metric).over(w), F.max(metric).over(w)
    level = F.when(hi > lo, (F.col(metric) - lo) / (hi - lo) * (high - low) + low).otherwise((low + high) / 2)
    return series.withColumn("level", js_round(level, 2))


def with_neighbours(updates: DataFrame) -> DataFrame:
    """Adds the end of all that came before and the start of what comes next."""
    w = Window.orderBy("start", "end", "update_id")
    return updates.withColumns({"prev_end": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "next_start": F.lead("start").over(w)})


#: Days of a bin by which dates meet intervals.
BIN = 32


def in_intervals(rows: DataFrame, intervals: DataFrame, day: str = "date") -> DataFrame:
    """rows with every interval (low, high: the first and last day) that holds their day; by equality on bins of days, then exactly."""
    number = lambda c: F.floor(F.datediff(c, F.lit(date(1970, 1, 1))) / BIN)
    binned = intervals.filter("low <= high").withColumn("__bin", F.explode(F.sequence(number(F.col("low")), number(F.col("high")))))
    return rows.withColumn("__bin", number(F.col(day))).join(binned, "__bin").filter(F.col(day).between(F.col("low"), F.col("high"))).drop("__bin")


def event_impact(site_day: DataFrame, updates: DataFrame, days: int = 14, least: int = 3) -> DataFrame:
    """Mean clicks of the nearest observed days before and after each dated interval (update_id, start, end).

    Windows stop at the neighbours, and 8 times `days` away.
    """
    e = with_neighbours(updates)
    low = F.greatest(F.date_add(F.coalesce("prev_end", F.lit(date(1900, 1, 1))), 1), F.date_sub("start", 8 * days))
    high = F.least(F.date_sub(F.coalesce("next_start", F.lit(date(9999, 1, 1))), 1), F.date_add("end", 8 * days))
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), a.alias("low"), b.alias("high"))
    sides = e.select("update_id", F.explode(F.array(side("before", low, F.date_sub("start", 1)), side("after", F.date_add("end", 1), high))).alias("w")).select("update_id", "w.*")
    rows = in_intervals(site_day, sides)
    near = F.when(F.col("side") == "before", -F.datediff("date", F.lit(date(1970, 1, 1)))).otherwise(F.datediff("date", F.lit(date(1970, 1, 1))))
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("site_id", "update_id", "side").orderBy(near))).filter(F.col("n") <= days)
    t = kept.groupBy("site_id", "update_id").agg(
        *[F.count_if(F.col("side") == s).alias(f"{s}_days") for s in ("before", "after")], *[F.sum(F.when(F.col("side") == s, F.col("clicks"))).alias(f"{s}_sum") for s in ("before", "after")]
    )
    t = t.filter((F.col("before_days") >= least) & (F.col("after_days") >= least))
    b, a = F.col("before_sum") / F.col("before_days"), F.col("after_sum") / F.col("after_days")
    return t.select("site_id", "update_id", "before_days", "after_days", js_round(b, 2).alias("before_clicks"), js_round(a, 2).alias("after_clicks"), js_round(pct_change(a, b, "null"), 1).alias("change"))


def note_impact(site_day: DataFrame, notes: DataFrame, days: int = 7) -> DataFrame:
    """Clicks of the calendar days before and after each note (note_id, site_id, date)."""
    n = notes.select("note_id", "site_id", F.col("date").alias("noted"))
    gap = F.datediff("date", "noted")
    rows = site_day.join(n, "site_id").filter(gap.between(-days, days - 1))
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("clicks"))), F.lit(0))
    t = rows.groupBy("site_id", "note_id").agg(zero(gap < 0).alias("before_clicks"), zero(gap >= 0).alias("after_clicks"))
    return t.withColumn("change", js_round(pct_change("after_clicks", "before_clicks", "null"), 1))


def measure_outcomes(changes: DataFrame, page_day: DataFrame, as_of: date, checkpoints: tuple[int, ...] = (7, 30, 90), baseline: int = 28, settle: int = 3) -> DataFrame:
    """Page metrics before each change (change_id, site_id, url, live_at) and at its closed checkpoints."""
    steps = F.explode(F.array(*[F.lit(c) for c in (0, *checkpoints)]))
    c = changes.select("change_id", "site_id", "url", F.to_date("live_at").alias("live")).withColumn("day", steps)
    c = c.filter((F.col("day") == 0) | (F.datediff(F.lit(as_of), "live") >= F.col("day") + settle))
    rows = page_day.select("site_id", "url", "date", "clicks", "impressions", "position")
    gap = F.datediff("date", "live")
    inside = F.when(F.col("day") == 0, gap.between(-baseline, -1)).otherwise((gap >= 0) & (gap < F.col("day")))
    joined = c.join(rows, ["site_id", "url"], "left").withColumn("in", F.coalesce(inside, F.lit(False)))
    on = lambda x: F.when(F.col("in"), F.col(x))
    return joined.groupBy("change_id", "site_id", "url", "day").agg(
        F.coalesce(F.sum(on("clicks")), F.lit(0)).alias("clicks"), F.coalesce(F.sum(on("impressions")), F.lit(0)).alias("impressions"), js_round(mean_position(on("position"), on("impressions")), 2).alias("position")
    )


def digest(site_day: DataFrame, page_query: DataFrame, as_of: date, days: int = 7, significant: float = 20.0, min_clicks: int = 10, top: int = 3) -> DataFrame:
    """One row for each site: totals, change, attention flag and its best striking-distance queries."""
    s = site_summary(site_day, as_of, days)
    near = striking_distance(page_query, min_impressions=2, limit=None, by_query=True)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("impressions"), "query"))
    best = near.withColumn("n", place).filter(F.col("n") <= top).groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "query"))), lambda x: x["query"]), ",").alias("top_queries"))
    moved = (F.abs(F.col("clicks_change")) >= significant) & (F.greatest("clicks", "prev_clicks") >= min_clicks)
    return s.join(best, "site_id", "left").select("site_id", "clicks", "prev_clicks", "clicks_change", moved.alias("significant"), (moved & (F.col("clicks_change") < 0)).alias("attention"), "top_queries")


def engine_days(rows: DataFrame, cutoff: date) -> DataFrame:
    """Daily totals by site of an engine's rows whose day is written /Date(ms)/."""
    ms = F.regexp_extract("Date", r"/Date\((-?[0-9]+)", 1).try_cast("bigint")
    day = F.to_date(F.timestamp_millis(ms))
    return rows.withColumn("date", day).filter(F.col("date") >= F.lit(cutoff)).groupBy("site_id", "date").agg(F.sum("Clicks").alias("clicks"), F.sum("Impressions").alias("impressions"))


def weighted_total(df: DataFrame, value: str, weight: str) -> Column:
    return exact_sum(F.col(value) * F.col(weight)) / F.sum(weight)


def page_brief(url: str, page_query: DataFrame, page_day: DataFrame, as_of: date, days: int = 28) -> dict[str, DataFrame]:
    """What is known of one page: its queries, months, striking queries, click-through gaps and rivals."""
    own = page_query.filter(F.col("url") == url)
    queries = own.select("site_id", "query").distinct()
    rivals = page_query.filter(F.col("url") != url).join(queries, ["site_id", "query"], "left_semi")
    return {
        "queries": page_queries(page_query, url, as_of, days),
        "months": page_day.filter(F.col("url") == url).groupBy(bucket_start(F.col("date"), "month").alias("month")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")),
        "striking": striking_distance(own, min_impressions=2, limit=None),
        "ctr": ctr_benchmark(own, min_impressions=2),
        "rivals": rivals.groupBy("site_id", "query", "url").agg(F.sum("impressions").alias("impressions")),
    }


def previous_window(as_of: date, days: int) -> tuple[date, date]:
    return as_of - timedelta(days=2 * days - 1), as_of - timedelta(days=days)
