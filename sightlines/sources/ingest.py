"""Readers and writers: metric exports, sitemaps, robots files, nested exports, observation exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed header aliases of metric exports.
ALIASES = {
    "keyword": ("keyword", "keywords", "query", "search term", "phrase"),
    "volume": ("volume", "search volume", "avg. monthly searches", "searches", "avg monthly searches"),
    "kd": ("kd", "difficulty", "keyword difficulty"),
    "cpc": ("cpc", "cost per click"),
    "position": ("position", "current position", "rank"),
    "url": ("url", "current url", "landing page"),
    "domain": ("domain", "target"),
    "ref_domain": ("referring domain", "ref domain", "refdomain", "linking domain"),
    "dr": ("dr", "domain rating", "authority score"),
    "links": ("links", "backlinks", "dofollow links"),
    "competition": ("competition", "competition level"),
}


def number(text: Column) -> Column:
    """A display number: 1.2K, 12,300, $1.20; null for what is none."""
    t = F.upper(F.regexp_replace(F.trim(text), r"[$€£%,\s]", ""))
    scale = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    return F.regexp_replace(t, "[KMB]$", "").try_cast("double") * scale


def renamed(df: DataFrame) -> DataFrame:
    """Columns by their known names; unknown ones are left out."""
    found = {}
    for c in df.columns:
        name = c.strip().strip("\ufeff\"").lower()
        for to, names in ALIASES.items():
            if name in names and to not in found:
                found[to] = c
    return df.select(*[F.col(f"`{c}`").alias(to) for to, c in found.items()])


def export_kind(columns: list[str]) -> str:
    """refdomains, keywords, domains or unknown, by the columns that an export has."""
    have = set(columns)
    return "refdomains" if "ref_domain" in have else "keywords" if "keyword" in have else "domains" if "domain" in have else "unknown"


def read_metric_export(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(kind, typed rows) of a CSV export; delimiter and columns are told from its header line."""
    head = (spark.read.text(path).limit(1).first() or [""])[0]
    sep = max(",;\t", key=head.count)
    raw = renamed(spark.read.csv(path, header=True, sep=sep, encoding="UTF-8"))
    out = raw.withColumns({c: number(F.col(c)) for c in ("volume", "kd", "cpc", "position", "dr", "links") if c in raw.columns})
    return export_kind(out.columns), out


def read_keyword_csv(spark: SparkSession, path: str) -> DataFrame:
    """keyword, volume, competition (Low, Medium, High) of a planner export."""
    _, t = read_metric_export(spark, path)
    level = F.lower(F.trim(F.col("competition"))) if "competition" in t.columns else F.lit(None).cast("string")
    level = F.when(level.isin("mid", "medium"), "Medium").when(level == "high", "High").when(level == "low", "Low")
    return t.select(F.trim("keyword").alias("keyword"), (F.col("volume") if "volume" in t.columns else F.lit(None).cast("double")).alias("volume"), level.alias("competition")).filter("keyword <> ''")


BEHAVIOR = "array<struct<metricName:string,information:array<struct<url:string,sessionsCount:string,subTotal:string>>>>"


def parse_behavior(df: DataFrame) -> DataFrame:
    """site_id, url (null: total), and one column for each metric, of nested metric arrays in `json`."""
    m = df.select("site_id", F.explode(F.from_json("json", BEHAVIOR)).alias("m")).select("site_id", "m.metricName", F.explode("m.information").alias("i"))
    value = F.coalesce(F.col("i.subTotal").try_cast("bigint"), F.col("i.sessionsCount").try_cast("bigint"))
    on = lambda name: F.sum(F.when(F.col("metricName") == name, value))
    return m.groupBy("site_id", F.col("i.url").alias("url")).agg(on("Traffic").alias("sessions"), on("RageClickCount").alias("rage_clicks"), on("DeadClickCount").alias("dead_clicks"))


def analytics_rows(df: DataFrame) -> DataFrame:
    """Typed series of rows with YYYYMMDD days and text metrics."""
    return df.select("site_id", F.to_date("date", "yyyyMMdd").alias("date"), F.col("sessions").try_cast("bigint").alias("sessions"), F.col("users").try_cast("bigint").alias("users"))


def analytics_breakdowns(df: DataFrame, dims: list[str], metric: str, k: int = 10) -> DataFrame:
    """The k largest values of every dimension, stacked."""
    out = None
    for d in dims:
        part = df.groupBy(F.col(d).cast("string").alias("value")).agg(F.sum(metric).alias(metric)).orderBy(F.desc(metric), "value").limit(k).withColumn("dimension", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Entries of sitemap documents (url, body): loc, lastmod and its validity, media counts, kind of entry."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<(url|sitemap)>(.*?)</\1>"), F.lit(0)))
    e = docs.select(F.col("url").alias("source_sitemap"), entry.alias("e"))
    one = lambda tag: F.trim(F.regexp_extract("e", rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1))
    count = lambda tag: F.size(F.regexp_extract_all("e", F.lit(rf"(?i)<({tag})[\s>]"), F.lit(1)))
    loc = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(one("loc"), F.lit("&amp;"), F.lit("&")), "&lt;", "<"), "&gt;", ">"), r"^<!\[CDATA\[(.*?)\]\]>$", "$1")
    lastmod = F.nullif(one("lastmod"), F.lit(""))
    valid = lastmod.rlike(r"^\d{4}-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?)?$") & F.try_to_timestamp(F.substring(lastmod, 1, 10)).isNotNull()
    return e.select(
        "source_sitemap", loc.alias("url"), lastmod.alias("lastmod"), F.coalesce(valid, F.lit(False)).alias("lastmod_valid"), count("image:image").alias("image_count"), count("video:video").alias("video_count"), count("news:news").alias("news_count"),
        F.when(F.lower(F.col("e")).startswith("<sitemap"), "index").otherwise("page").alias("sitemap_type"), loc.rlike(r"(?i)^https?://[^\s/]+").alias("valid"),
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of inventory files, one row each; gzip files (.gz) are unpacked by Spark's reader."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def parse_inventory(docs: DataFrame) -> DataFrame:
    """Urls of text lists, JSON (however deep) and feeds as well: every absolute address of a document, with the kind of source."""
    kind = F.when(F.col("body").rlike("(?is)<(urlset|sitemapindex)"), "sitemap").when(F.col("body").rlike("(?is)<(rss|feed)[\\s>]"), "feed").when(F.col("body").rlike(r"^\s*[\[{]"), "json").otherwise("text")
    plain = F.when(kind == "json", F.replace("body", F.lit(r"\/"), F.lit("/"))).when(kind.isin("feed", "sitemap"), F.replace("body", F.lit("&amp;"), F.lit("&"))).otherwise(F.col("body"))
    found = F.regexp_extract_all(plain, F.lit(r"""(https?://[^\s<>"'\\,\]}]+)"""), F.lit(1))
    return docs.select(F.col("url").alias("source"), kind.alias("source_type"), F.explode(F.array_distinct(found)).alias("url"))


def parse_robots(docs: DataFrame) -> DataFrame:
    """host, agent, allow[], disallow[] of robots files; lines of agents in a row share their rules."""
    line = F.posexplode(F.split("body", r"\r?\n"))
    clean = F.trim(F.regexp_replace("line", "#.*$", ""))
    r = docs.select("host", line.alias("n", "line")).select("host", "n", F.lower(F.trim(F.regexp_extract(clean, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(clean, "^[^:]+:(.*)$", 1)).alias("v")).filter(F.col("k").isin("user-agent", "allow", "disallow"))
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("n")
    r = r.withColumn("start", ((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")).cast("int"))
    r = r.withColumn("g", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rules = r.groupBy("host", "g").agg(*[F.array_sort(F.collect_list(F.when((F.col("k") == k) & (F.col("v") != ""), F.col("v")))).alias(k) for k in ("allow", "disallow")])
    agents = r.filter("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent")).distinct()
    t = agents.join(rules, ["host", "g"])
    return t.groupBy("host", "agent").agg(F.array_sort(F.flatten(F.collect_list("allow"))).alias("allow"), F.array_sort(F.flatten(F.collect_list("disallow"))).alias("disallow"))


def bot_access(groups: DataFrame, bots: list[str]) -> DataFrame:
    """Whether each bot may read the root of every host: its own group, else *."""
    root = lambda c: F.exists(F.col(c), lambda p: p.isin("/", "/*"))
    g = groups.withColumn("blocked", root("disallow") & ~root("allow"))
    hosts = groups.select("host").distinct().select("host", F.explode(F.array(*[F.lit(b) for b in bots])).alias("bot"))
    own = g.select("host", F.col("agent").alias("bot"), F.col("blocked").alias("own"))
    star = g.filter("agent = '*'").select("host", F.col("blocked").alias("star"))
    return hosts.join(own, ["host", "bot"], "left").join(star, "host", "left").select("host", "bot", F.when(F.coalesce("own", "star", F.lit(False)), "blocked").otherwise("allowed").alias("access"))


def parse_agent_files(docs: DataFrame) -> DataFrame:
    """Headings, links, empty sections, duplicate and off-domain links of llms.txt-like documents (host, body)."""
    b = F.coalesce("body", F.lit(""))
    links = F.regexp_extract_all(b, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    heads = F.regexp_extract_all(b, F.lit(r"(?m)^(#{1,6})\s+\S"), F.lit(1))
    empty = F.regexp_extract_all(b, F.lit(r"(?m)^(#{2,6})\s+[^\n]*\n+(?=#|\z)"), F.lit(1))
    off = F.filter(F.array_distinct(links), lambda u: u.rlike("(?i)^https?://") & ~F.contains(F.lower(u), F.col("host")))
    return docs.select("host", F.size(heads).alias("headings"), F.size(links).alias("links"), (F.size(links) - F.size(F.array_distinct(links))).alias("duplicate_links"), F.size(off).alias("off_domain"), F.size(empty).alias("empty_sections"), ((F.size(heads) == 0) | ~b.rlike(r"(?m)^#\s")).alias("malformed"))


# --------------------------------------------------------------------- exports


def safe_cell(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def export_observation(df: DataFrame, fmt: str, path: str) -> None:
    """Writes json (all values as they are), csv (guarded cells), xml or markdown."""
    if fmt == "json":
        df.write.mode("overwrite").json(path, ignoreNullFields=False)
        return
    flat = df.select(*[(F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) for c, t in df.dtypes])
    if fmt == "csv":
        flat.select(*[safe_cell(F.col(c)).alias(c) for c in flat.columns]).write.mode("overwrite").csv(path, header=True, quoteAll=True)
    elif fmt == "xml":
        flat.write.mode("overwrite").format("xml").option("rowTag", "row").save(path)
    elif fmt == "markdown":
        cells = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[|\n]", " ") for c in flat.columns]
        flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_domain(page_query: DataFrame, site: str, path: str) -> None:
    """Three files of a site: keywords, landing pages, page x keyword."""
    from sightlines.operators.search import keyword_summary, keywords_export, landing_pages

    rows = page_query.filter(F.col("site_id") == site)
    for name, t in (("keywords", keywords_export(rows)), ("landing_pages", landing_pages(rows)), ("page_keywords", keyword_summary(rows))):
        t.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def query(spark: SparkSession, sql: str, limit: int = 500) -> DataFrame:
    """One read-only statement over registered views, capped; a statement whose plan holds a command is refused."""
    bare = (sql or "").strip().rstrip(";").strip()
    if not bare or ";" in bare:
        raise ValueError("one SELECT statement only")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)  # reads the text; nothing runs
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    if _any_node(plan, lambda node: any(k.isInstance(node) for k in kinds)):
        raise ValueError("one SELECT statement only")
    return spark.sql(bare).limit(limit)


def _any_node(plan, is_it) -> bool:
    """Whether a parsed plan or a plan below it is such a node."""
    below = plan.children()
    return is_it(plan) or any(_any_node(below.apply(i), is_it) for i in range(below.size()))
