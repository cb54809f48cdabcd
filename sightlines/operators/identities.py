"""Under which address a url is known: to a crawl, as a page of a site, and in a sitemap; sitemaps against crawls.

Host names in other scripts have an ASCII form that no built-in function makes. Only
distinct hosts of that kind go through Python, and their forms are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightlines.functions.unicode import ascii_host

_LABEL = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"


def absolute(value: Column, scheme: str | None = "https") -> Column:
    """A url with its scheme; one without gets `scheme`, or stays as it is where that is None."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    if scheme is None:
        return raw
    return F.when(raw.contains("://") | (raw == ""), raw).when(raw.startswith("//"), F.concat(F.lit(f"{scheme}:"), raw)).otherwise(F.concat(F.lit(f"{scheme}://"), raw))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _port(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r":([^:\]]*)$", 1)


def spelt_host(url: Column) -> Column:
    """The host as it is written, lower-cased, without port, brackets and closing dots."""
    host = F.regexp_replace(_authority(url), r":[^:\]]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(host), r"^\[|\]$", ""), r"\.+$", ""))


def domain_url(domain: Column) -> Column:
    """A bare domain, a domain property or a url as a url, so that its host can be read."""
    raw = F.regexp_replace(F.trim(F.coalesce(domain, F.lit(""))), "(?i)^sc-domain:\\s*", "")
    return absolute(raw)


def with_hosts(df: DataFrame, **urls: Column) -> DataFrame:
    """df with the ASCII host of each url under the given name; null where a url has no valid host."""
    spelt = {name: spelt_host(url) for name, url in urls.items()}
    out = df.withColumns(spelt)
    foreign = reduce(DataFrame.unionByName, [out.select(F.col(n).alias("spelt")).filter(~F.col("spelt").rlike(r"^[\x00-\x7F]*$")).distinct() for n in spelt]).distinct()
    known = foreign.select("spelt", ascii_host("spelt").alias("ascii"))
    for n in spelt:
        key = F.when(~F.col(n).rlike(r"^[\x00-\x7F]*$"), F.col(n))
        out = out.join(known.select(F.col("spelt").alias("__spelt"), F.col("ascii").alias("__ascii")), key == F.col("__spelt"), "left").withColumn(n, F.coalesce("__ascii", n)).drop("__spelt", "__ascii")
    valid = lambda h: h.rlike(rf"^{_LABEL}(\.{_LABEL})*$") | (h.contains(":") & h.rlike("^[0-9a-f:.]+$"))
    return out.withColumns({n: F.when(valid(F.col(n)), F.col(n)) for n in spelt})


def _sound(url: Column, host: Column) -> Column:
    """Whether a url is http or https, with a valid host and port, and names no user."""
    port = _port(url)
    return scheme_of(url).isin("http", "https") & host.isNotNull() & ~_authority(url).contains("@") & ((port == "") | (port.rlike("^[0-9]{1,5}$") & (port.try_cast("int") <= 65535)))


def crawl_identity(url: Column, host: Column) -> Column:
    """scheme, host, port unless it is the scheme's own, path with single slashes, query as it stands; no fragment. null for what is no such url.

    url: made `absolute`; host: its ASCII host.
    """
    port, scheme = F.regexp_replace(_port(url), "^0+(?=[0-9])", ""), scheme_of(url)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path, query = F.regexp_replace(_path(url), "/{2,}", "/"), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    return F.when(_sound(url, host), F.concat(scheme, F.lit("://"), shown, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def page_identity(url: Column, host: Column, wanted: Column) -> Column:
    """https, the site's own host, path without closing slashes; null where the url, www aside, is not of that host."""
    bare = lambda h: F.regexp_replace(h, r"^www\.", "")
    path = F.regexp_replace(_path(url), "/+$", "")
    return F.when(_sound(url, host) & (bare(host) == bare(wanted)), F.concat(F.lit("https://"), wanted, F.when(path == "", "/").otherwise(path)))


def site_pages(pages: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """pages with crawl_id and page_id_url, their two identities; a url that begins with a slash is one of the domain."""
    own = F.trim(F.coalesce(F.col(url), F.lit("")))
    t = with_hosts(pages, __wanted=domain_url(F.col(domain)), __host=absolute(own))
    crawl, inside = crawl_identity(absolute(own), F.col("__host")), own.startswith("/") & ~own.startswith("//")
    there = F.when(inside, F.concat(F.lit("https://"), "__wanted", own)).otherwise(own)
    page = page_identity(there, F.when(inside, F.col("__wanted")).otherwise(F.col("__host")), F.col("__wanted"))
    return t.withColumns({"crawl_id": F.when(own != "", crawl), "page_id_url": F.when(own != "", page)}).drop("__wanted", "__host")


def sitemap_identity(url: Column, host: Column) -> Column:
    """How a sitemap and a crawl know one page: https, host and path without closing slash; a url without scheme as a crawl knows it."""
    given = F.trim(F.coalesce(url, F.lit("")))
    return F.when(given != "", F.coalesce(page_identity(given, F.when(given.contains("://"), host), host), crawl_identity(absolute(given), host)))


def _aliases(df: DataFrame, columns: list[str], keep: Column) -> DataFrame:
    """key, row: of every address of a row, the row; of several rows with one address the last (by seq, if there is one, then url)."""
    have = [c for c in columns if c in df.columns]
    t = df.select(keep.alias("row"), (F.col("seq") if "seq" in df.columns else F.lit(0)).alias("seq"), "url", F.explode(F.array(*have)).alias("__u")).filter("__u <> ''")
    t = with_hosts(t, __h=absolute(F.col("__u"))).withColumn("key", sitemap_identity(F.col("__u"), F.col("__h")))
    return t.filter("key is not null").groupBy("key").agg(F.max_by("row", F.struct("seq", "url")).alias("row"))


def reconcile_sitemap(entries: DataFrame, pages: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every sitemap entry (url, source_sitemap) with the status, canonical and kind of its crawled page, and what is wrong with it.

    pages: url, status_code, resource_type, and if there are: requested_url, final_url, canonical, robots_allowed, robots_meta, seq;
    inventory: url, source, and if there are: final_url, canonical_url, duplicate_of_url, seq.  Any address of a row matches.
    """
    col = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    page = F.struct(*[col(pages, c, k) for c, k in (("status_code", "int"), ("resource_type", "string"), ("canonical", "string"), ("robots_allowed", "boolean"), ("robots_meta", "string"))])
    crawled = _aliases(pages, ["url", "requested_url", "final_url", "canonical"], page)
    listed = _aliases(inventory, ["url", "final_url", "canonical_url", "duplicate_of_url"], F.struct(col(inventory, "source", "string")))
    t = with_hosts(entries, __h=absolute(F.col("url"))).withColumn("key", sitemap_identity(F.col("url"), F.col("__h"))).drop("__h")
    t = t.join(crawled.withColumnRenamed("row", "page"), "key", "left").join(listed.withColumnRenamed("row", "inv"), "key", "left")
    t = with_hosts(t, __c=absolute(F.col("page.canonical"))).withColumn("canonical_key", sitemap_identity(F.col("page.canonical"), F.col("__c")))
    code, found = F.col("page.status_code"), F.col("page").isNotNull()
    rules = [
        ("redirect_in_sitemap", code.between(300, 399)), ("error_status_in_sitemap", code >= 400), ("robots_blocked_in_sitemap", ~F.col("page.robots_allowed")), ("noindex_in_sitemap", F.lower("page.robots_meta").contains("noindex")),
        ("canonical_mismatch", (F.col("page.canonical") != "") & ~F.col("canonical_key").eqNullSafe(F.col("key"))), ("non_html_sitemap_resource", (F.col("page.resource_type") != "") & (F.col("page.resource_type") != "html")),
        ("not_crawled", ~found & F.col("inv").isNull()), ("internal_url_missing_from_sitemap", (F.col("inv.source") != "") & ~F.col("inv.source").contains("sitemap")),
    ]
    findings = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), r) for r, p in rules]))
    return t.select("url", "source_sitemap", code.alias("status_code"), F.coalesce("page.canonical", F.lit("")).alias("canonical"), F.coalesce("page.resource_type", F.lit("")).alias("resource_type"), findings.alias("findings"))
