"""URL identities, classes and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed country domains that name a market; uk stands for gb, all others for themselves.
MARKET_TLDS = (
    "gr fr de es it pt nl be pl cz sk hu ro bg hr rs ba si mk al ua ru by kz se no dk fi ie at ch uk ca au nz jp kr cn in br mx ar cl tr il za eg ae sg my th vn id ph"
).split()
# Fixed path segments by class of url.
UTILITY_SEGMENTS = ["login", "signin", "sign-in", "register", "account", "cart", "checkout", "wp-admin", "wp-login", "search", "print", "attachment", "feed", "feeds"]
CORE_SEGMENTS = ["about", "company", "contact", "leadership", "team", "investors", "investor", "projects", "project", "assets", "asset", "products", "product", "services", "service", "solutions", "sustainability", "governance", "disclosures", "technical", "operations", "corporate", "indigenous", "partners", "partnerships"]
NEWS_SEGMENTS = ["news", "press", "release", "releases", "updates", "blog"]
ARCHIVE_SEGMENTS = ["category", "tag", "author"]
DISCLOSURE_SEGMENTS = ["reports", "filings", "disclosures"]
EVIDENCE_SEGMENTS = ["evidence", "research", "resources", "responsibility"]
DOCUMENT_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx"]
# Fixed priority of each class.
CLASS_PRIORITY = {
    "core_page": 900, "supporting_evidence": 700, "document_disclosure": 650, "article": 560, "news_release": 520, "corporate_media": 480,
    "webcast": 350, "unknown": 250, "archive_taxonomy": 40, "pagination_navigation": 20, "utility": 0, "excluded": -1000,
}
SOURCE_PRIORITY = {"primary_navigation": 2000, "sitemap": 250, "internal_link": 100}
# Fixed words that tell stages of one event apart.
STAGE_WORDS = ["announce", "announces", "announced", "proposed", "proposal", "pricing", "priced", "complete", "completes", "completed", "completion", "update", "updated", "of", "the"]
# A path segment that is a year.
YEAR = "20[0-9]{2}"
# Fixed query keys that only track, and the beginnings of others.
TRACKING_KEYS, TRACKING_PREFIXES = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "source"], ["utm_", "pk_", "mtm_"]
# Fixed path segments of page types.
PAGE_TYPES = [
    ("privacy_legal", "high", ["privacy", "terms", "legal", "cookies", "gdpr"]),
    ("thank_you", "high", ["thanks", "thank-you", "confirmation", "success"]),
    ("application", "medium", ["apply", "application", "careers", "signup", "sign-up"]),
    ("contact", "high", ["contact", "contact-us"]),
    ("blog", "medium", ["blog", "news", "articles", "posts"]),
    ("service", "medium", ["services", "service", "solutions"]),
    ("product", "medium", ["products", "product"]),
    ("utility", "high", ["login", "account", "cart", "checkout", "search", "feed", "feeds"]),
]
# Fixed segments of a page selection: those never worth a place, and those that are.
UNSELECTED_SEGMENTS = ["privacy", "privacy-policy", "terms", "terms-of-service", "login", "signin", "sign-in", "register", "account", "cart", "checkout", "wp-admin", "feed", "search", "sitemap", "404", "cookie-policy", "cookies"]
IMPORTANT_SEGMENTS = ["about", "services", "service", "products", "product", "contact", "faq", "pricing", "locations", "location", "team", "company", "solutions", "industries", "portfolio", "projects", "resources"]


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(path_of(url)), "/"), lambda s: s != "")


def norm_domain(value: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "^[a-z][a-z0-9+.-]*://", ""), "[/?#:].*$", "")
    return F.regexp_replace(bare, "^www\\.", "")


def _page_of_site(url: Column) -> Column:
    """Host and path, whatever scheme, www and last slash."""
    return F.concat(norm_domain(url), F.regexp_replace(path_of(url), "/+$", ""))


def url_variants(url: Column) -> Column:
    bare = F.regexp_replace(url, "/+$", "")
    return F.array(bare, F.concat(bare, F.lit("/")))


def candidate_identity(url: Column, domain: Column) -> Column:
    """The one address under which a crawl knows a page of a domain, or null where the url is not of it.

    https and the domain's own spelling, single slashes, no fragment, no tracking keys, the rest of the query sorted.
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), "^[a-z][a-z0-9+.-]*://", ""), "[/?#:].*$", "")
    whole = F.when(raw.startswith("/"), F.concat(F.lit("https://"), host, raw)).when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(whole, "^[^:]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    tracks = lambda k: k.isin(TRACKING_KEYS) | k.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    pairs = F.transform(F.filter(F.split(query_of(whole), "&"), lambda q: q != ""), lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("="))))
    query = F.array_join(F.array_sort(F.filter(pairs, lambda q: ~tracks(F.lower(F.substring_index(q, "=", 1))))), "&")
    good = (raw != "") & scheme.isin("http", "https") & (norm_domain(whole) == norm_domain(domain)) & (norm_domain(whole) != "")
    return F.when(good, F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _has(s: Column, names: list[str]) -> Column:
    return F.arrays_overlap(s, F.array(*[F.lit(n) for n in names]))


def url_class(url: Column, source_sitemap: Column | None = None) -> Column:
    """Class of a url by the sitemap that lists it, then by its path."""
    s, p = segments(url), F.lower(path_of(url))
    source = F.lower(F.coalesce(source_sitemap, F.lit(""))) if source_sitemap is not None else F.lit("")
    document = F.lit(False)
    for suffix in DOCUMENT_SUFFIXES:
        document = document | p.endswith(suffix)
    return (
        F.when(source.contains("news-release") | p.contains("news-release") | p.contains("/press-release"), "news_release")
        .when(source.contains("page-sitemap"), "core_page").when(source.contains("post-sitemap"), "article").when(source.contains("corporate-media"), "corporate_media")
        .when(source.contains("article"), "article").when(source.contains("webcast"), "webcast").when(source.contains("category") | _has(s, ARCHIVE_SEGMENTS), "archive_taxonomy")
        .when(document | _has(s, DISCLOSURE_SEGMENTS), "document_disclosure").when(_has(s, CORE_SEGMENTS) | (F.size(s) <= 1), "core_page")
        .when(_has(s, NEWS_SEGMENTS), "news_release").when(_has(s, EVIDENCE_SEGMENTS), "supporting_evidence").otherwise("unknown")
    )


def page_type(url: Column) -> Column:
    """struct(type, confidence: high, medium or low) by path alone."""
    s = segments(url)
    kind = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    out = F.when(F.size(s) == 0, kind("homepage", "high"))
    for name, sure, words in PAGE_TYPES:
        if name == "blog":  # the list of posts is an index, what lies under it a post
            out = out.when(_has(s, words) & (F.size(s) == 1), kind("blog_index", sure)).when(_has(s, words), kind("blog_post", sure))
        else:
            out = out.when(_has(s, words), kind(name, sure))
    return out.otherwise(kind("unknown", "low"))


def event_family(url: Column) -> Column:
    """The words of the last path segment without years and words of stage, so that the reports of one event share it."""
    slug = F.element_at(F.concat(F.array(F.lit("")), segments(url)), -1)
    words = F.regexp_extract_all(slug, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(words, lambda w: ~w.isin(STAGE_WORDS) & ~w.rlike("^20[0-9]{2}$")), "-")


def eligibility(url: Column, kind: Column) -> Column:
    """struct(decision: eligible, deferred or excluded; reason)."""
    p, s = F.lower(path_of(url)), segments(url)
    pairs = F.filter(F.split(query_of(url), "&"), lambda q: F.substring_index(q, "=", -1) != "")
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(p.rlike(r"(/feed/?|\.rss|\.atom|\.xml)$"), made("excluded", "feed_or_machine_document"))
        .when(_has(s, UTILITY_SEGMENTS), made("excluded", "utility_or_account_page"))
        .when(kind == "archive_taxonomy", made("excluded", "taxonomy_archive_default"))
        .when(F.exists(pairs, lambda q: F.lower(F.substring_index(q, "=", 1)).contains("page")), made("excluded", "pagination_query"))
        .when(p.rlike("/page/[0-9]+/?$"), made("excluded", "pagination_path"))
        .when(F.size(pairs) > 3, made("deferred", "complex_parameter_variant"))
        .otherwise(made("eligible", "useful_content_candidate"))
    )


def _points(table: dict[str, int], key: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0))


def priority_score(url: Column, kind: Column, source: Column, sitemap_priority: Column | None = None, selected: Column | None = None, depth: Column | None = None, year: str = YEAR) -> Column:
    """Points of a url in a crawl's order: class, source, the sitemap's own priority, depth, segments that are a year, and words of finished or early stages."""
    s, p = segments(url), F.lower(path_of(url))
    score = _points(CLASS_PRIORITY, kind) + _points(SOURCE_PRIORITY, source) + F.when(F.size(s) == 0, 10_000).otherwise(0)
    if selected is not None:
        score = score + F.when(selected, 20_000).otherwise(0)
    if sitemap_priority is not None:
        score = score + F.when(sitemap_priority.isNull(), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sitemap_priority.cast("double"))) * 200))
    if depth is not None:
        score = score - F.greatest(F.lit(0), depth) * 40
    score = score - F.greatest(F.lit(0), F.size(s) - 2) * 30 - F.when(F.exists(s, lambda x: x.rlike(f"^(?:{year})$")), 80).otherwise(0)
    return (score + F.when(p.rlike("completed|completes|final-results|definitive"), 90).otherwise(0) - F.when(p.rlike("proposed|announces-pricing|preliminary"), 40).otherwise(0)).cast("int")


def candidate_score(url: Column, base_url: Column, on_homepage: Column, in_sitemap: Column, year: str = YEAR) -> Column:
    """Points of a page for a small selection: the homepage first, utility pages last, fewer where a segment is a year."""
    s = segments(url)
    home = _page_of_site(url) == _page_of_site(base_url)
    score = F.when(on_homepage, 1000).otherwise(0) + F.when(in_sitemap, 300).otherwise(0) + F.greatest(F.lit(0), 220 - F.size(s) * 45) + F.when(_has(s, IMPORTANT_SEGMENTS), 180).otherwise(0)
    score = score - F.when(F.exists(s, lambda x: x.rlike(f"^(?:{year})$")), 80).otherwise(0) - F.when(F.size(s) >= 4, 100).otherwise(0)
    return F.when(home, 10_000).when(_has(s, UNSELECTED_SEGMENTS), -10_000).otherwise(score).cast("int")


def next_crawl(last: Column, kind: Column, changed: Column) -> Column:
    """Core pages after 7 days, changed ones after 30, others after 90."""
    return F.date_add(last, F.when(kind == "core_page", 7).when(changed, 30).otherwise(90))


# Fixed parts of agent names by kind of crawler; whoever has none of them was sent on as a person.
BOTS = {
    "google": ["googlebot", "google-inspectiontool", "googleother", "storebot-google", "google-site-verification", "google-co"],
    "bing": ["bingbot", "bingpreview", "msnbot"],
    "yandex": ["yandex"],
    "mailru": ["mail.ru", "mailru"],
    "ai": [
        "gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "claude-user", "anthropic-ai", "perplexitybot", "perplexity-user", "deepseekbot", "deepseek", "bytespider", "google-extended", "applebot-extended", "ccbot",
        "meta-externalagent", "meta-externalfetcher", "cohere-ai", "cohere-training", "amazonbot", "youbot", "diffbot", "imagesift", "timpibot", "omgili",
    ],
    "other": ["bot", "crawler", "spider"],
}
BOT_TYPES = [*BOTS, "redirect"]


def bot_type(agent: Column) -> Column:
    """Kind of crawler by its name; redirect for a person."""
    a, out = F.lower(F.coalesce(agent, F.lit(""))), None
    for kind, parts in BOTS.items():
        out = F.when(_holds(a, parts), kind) if out is None else out.when(_holds(a, parts), kind)
    return out.otherwise("redirect")


def resource_type(content_type: Column, url: Column) -> Column:
    """html, feed, xml, json, text, pdf, image, binary or unsupported, by content type, then by the end of the path."""
    c = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    path = F.substring_index(F.lower(F.coalesce(url, F.lit(""))), "?", 1)
    return (
        F.when(c.contains("html"), "html").when(c.contains("rss") | c.contains("atom") | path.endswith(".rss") | path.endswith(".atom"), "feed").when(c.contains("xml"), "xml").when(c.contains("json"), "json").when(c.startswith("text/"), "text")
        .when(c.contains("pdf") | path.endswith(".pdf"), "pdf").when(c.startswith("image/"), "image").when(c.isin("", "application/octet-stream", "application/binary"), "binary").otherwise("unsupported")
    )


def failure_kind(status: Column, error: Column) -> Column:
    """Why a fetch failed, by status 429 and 5xx, then by the error, then by other statuses; empty where it did not."""
    e = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == 429, "rate_limited").when(status >= 500, "server_failure").when(e.contains("timed out") | e.contains("timeout"), "timed_out").when(e.contains("refused"), "connection_refused")
        .when(e.contains("robots"), "blocked").when(status >= 400, "http_error").when(e != "", "fetch_failure").otherwise("")
    )


def market(explicit: Column, host: Column) -> Column:
    """The market that was set, else the one that a country's domain implies, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?i)^sc-domain:", ""), "(?i)^https?://", ""), "/.*$", ""), "(?i)^www\\.", "")
    parts = F.filter(F.split(F.trim(F.lower(bare)), r"\."), lambda p: p != "")
    tld = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return F.coalesce(F.nullif(F.lower(F.trim(explicit)), F.lit("")), F.when(tld.isin(*MARKET_TLDS), F.when(tld == "uk", "gb").otherwise(tld)))


# Fixed parts of host names and addresses that tell a site's type.
FORUM_SITES = ["reddit", "quora", "facebook", "stackexchange", "stackoverflow", "tripadvisor"]
AGGREGATOR_SITES = [
    "rome2rio", "getyourguide", "tripadvisor", "booking", "expedia", "kayak", "holidaytaxis", "viator", "skyscanner", "yelp", "trustpilot", "amazon", "ebay", "aliexpress",
    "walmart", "skroutz", "ubuy", "etsy", "bestbuy", "newegg", "idealo", "pricerunner", "google.com/shopping",
]
STORE_SIGNS = ["/store", "/shop", "/buy", "/eshop", "/product", "/products", "/cart", "/checkout", "/p/", "official", "online-store"]
# Fixed patterns of what a result page is for, and of the type of a cited source.
SERP_INTENTS = [
    ("review", r"\b(review|reviews|rating|ratings|обзор|огляд|отзыв|відгук)\b|/review"),
    ("listicle", r"\btop[\s-]?\d+|\b\d+\s+(best|top)\b|\bbest\b.+\b(sites?|casinos?|apps?|tools?|services?|platforms?|bookmakers?|brokers?|hosts?)\b|\branking(s)?\b|\bлучшие\b|\bнайкращі\b"),
    ("buy", r"\b(buy|shop|store|price|cost|order|cart|checkout|eshop|deal|discount|coupon|for sale|product)\b|/p/|/product"),
    ("info", r"\bhow to\b|\bguide\b|\btutorial\b|\bкак\b|\bяк\b|\bчто такое\b|\bщо таке\b"),
]
SOURCE_TYPES = [
    ("wikipedia", r"(^|\.)wikipedia\.org$|wikidata\.org$"),
    ("forum", r"(reddit|quora|tripadvisor|stackexchange|stackoverflow|forum|discuss|community)\.|forum"),
    ("ecommerce", r"booking\.com|getyourguide|viator|expedia|kiwitaxi|suntransfers|mytransfers|kayak|skyscanner|amazon|ebay|aliexpress|trip\.com|omio|busbud|rome2rio|welcomepickups"),
]


def _holds(text: Column, parts: list[str]) -> Column:
    found = text.contains(parts[0])
    for x in parts[1:]:
        found = found | text.contains(x)
    return found


def _text(c: Column | None) -> Column:
    return F.coalesce(c, F.lit("")) if c is not None else F.lit("")


def site_type(host: Column, url: Column | None = None, title: Column | None = None) -> Column:
    """forum_ugc, aggregator, official_store, or null where neither host nor address tells."""
    h, hay = F.lower(host), F.lower(F.concat_ws(" ", _text(url), _text(title)))
    return F.when(_holds(h, FORUM_SITES), "forum_ugc").when(_holds(h, AGGREGATOR_SITES), "aggregator").when(_holds(hay, STORE_SIGNS), "official_store")


def serp_intent_of(url: Column, title: Column) -> Column:
    """review, listicle, buy, info or use_case, by address and title; words are found in Cyrillic too."""
    hay = F.lower(F.concat_ws(" ", _text(url), _text(title)))
    out = None
    for name, pattern in [(n, p.replace(r"\b", r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))")) for n, p in SERP_INTENTS]:
        out = F.when(hay.rlike(pattern), name) if out is None else out.when(hay.rlike(pattern), name)
    return out.otherwise("use_case")


def source_type(host: Column) -> Column:
    """Type of a cited source by its host: wikipedia, forum, ecommerce or other."""
    h, out = F.lower(host), None
    for name, pattern in SOURCE_TYPES:
        out = F.when(h.rlike(pattern), name) if out is None else out.when(h.rlike(pattern), name)
    return out.otherwise("other")


def has_tag(tags: Column, tag: str) -> Column:
    """Membership in a tag list kept as a JSON array or as comma-separated text."""
    as_json = F.when(F.startswith(F.trim(tags), F.lit("[")), F.from_json(tags, "array<string>"))
    return F.coalesce(F.exists(F.coalesce(as_json, F.transform(F.split(tags, ","), lambda t: F.trim(t))), lambda t: F.lower(t) == tag.lower()), F.lit(False))
