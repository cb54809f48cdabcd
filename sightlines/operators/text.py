"""Text operators: overlap and coverage, fact drift, related intent, a marker-word model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.functions.numbers import js_round
from sightlines.functions.unicode import clean_text, compatible, intent_words

# Fixed word lists.
STOP_WORDS = (
    "a an and are at be by for from in is of on or the to with "
    "и в во на по для из от до как что це та у за "
    "le la les de des du et pour un une en "
    "el la los las de del y para un una con "
    "der die das den dem des ein eine und fur mit von zu"
).split()
INTENT_WORDS = {
    "informational": "how what why guide tutorial learn examples как что гайд руководство comment quoi guide como guia wie ratgeber".split(),
    "commercial": "best top review reviews compare comparison versus vs лучший обзор сравнение meilleur avis comparatif mejor resena vergleich test".split(),
    "transactional": "buy price pricing order book hire shop купить цена заказать acheter prix comprar precio kaufen preis".split(),
    "local": "near nearby local map рядом поблизости cerca proche lokal nahe".split(),
}
PAGE_ROLES = [
    ("guide", r"(/blog/|/guide|/guides|/article|/learn|/resources|how-to|tutorial|руковод)"),
    ("product", r"(/product|/products|/shop|/store|/buy|/pricing|/price|купить|цена)"),
    ("category", r"(/category|/categories|/catalog|/collection|/tag/)"),
    ("landing", r"(/landing|/lp/|/service|/solutions)"),
]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits outside tags."""
    text = F.regexp_replace(text, "<[^>]+>", " ")
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct k-word runs; a shorter text has none."""

    def runs(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(all_)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(words(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def uniqueness_pct(text: Column, other: Column, k: int = 3) -> Column:
    """Whole percents of word runs that two texts don't share; 100 where either has none."""

    def percent(a: Column, b: Column) -> Column:
        shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 100.0).otherwise(js_round((1 - shared / F.greatest(both, F.lit(1))) * 100, 0))

    return let(shingles(text, k), lambda a: let(shingles(other, k), lambda b: percent(a, b)))


def keyword_coverage(before: Column, after: Column, keywords: Column) -> Column:
    """For each phrase: struct(keyword, before, after, lost); occurrences may overlap and stand between word borders."""
    padded = lambda t: F.concat(F.lit(" "), F.array_join(words(t), "  "), F.lit(" "))

    def count(text: Column, phrase: Column) -> Column:
        p = F.concat(F.lit(" "), F.array_join(words(phrase), "  "), F.lit(" "))
        return F.when(F.length(F.trim(p)) > 0, F.size(F.regexp_extract_all(text, F.concat(F.lit("(?=("), F.concat(F.lit(r"\Q"), p, F.lit(r"\E")), F.lit("))")), F.lit(1)))).otherwise(0)

    def each(b: Column, a: Column) -> Column:
        return F.transform(keywords, lambda k: let(F.struct(count(b, k).alias("b"), count(a, k).alias("a")), lambda n: F.struct(k.alias("keyword"), n["b"].alias("before"), n["a"].alias("after"), ((n["b"] > 0) & (n["a"] == 0)).alias("lost"))))

    return let(padded(before), lambda b: let(padded(after), lambda a: each(b, a)))


# --------------------------------------------------------------- related intent

intent_tokens = intent_words(STOP_WORDS)


def infer_intent(tokens: Column) -> Column:
    """The kind whose words tokens hold most of (the first of those alike), or mixed where they hold none."""
    hits = {k: F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in dict.fromkeys(ws)]))) for k, ws in INTENT_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, "mixed")
    for k, n in hits.items():
        out = out.when(n == best, k)
    return out


def page_role(url: Column, queries: Column) -> Column:
    """Role of a page by its path and the queries (array) that it is shown for."""
    path = F.lower(F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1)).otherwise(url))
    joined = F.concat(path, F.lit(" "), F.lower(F.array_join(queries, " ")))
    out = F.when(path.isin("/", ""), "homepage")
    for name, pattern in PAGE_ROLES:
        out = out.when(joined.rlike(pattern), name)
    return out.otherwise("other")


def brand_terms(site_url: Column) -> Column:
    """The names in a site's host, its last label aside, longer than two letters."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(site_url, "^https?://", ""), "^sc-domain:", ""), r"^www\.", "")
    labels = F.split(F.substring_index(host, "/", 1), r"\.")
    names = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return F.filter(names, lambda x: F.length(x) > 2)


def slug_similarity(a: Column, b: Column) -> Column:
    """Shared words of two paths, of all their words; takes the token arrays of both paths."""
    return jaccard(a, b)


def _profiles(page_query: DataFrame, brands: DataFrame | None) -> DataFrame:
    """Rows with their normalised query; those that name the site's own brand (site_id, terms) are left out."""
    rows = page_query.filter((F.col("query") != "") & (F.col("url") != "")).select(
        "site_id", F.trim("query").alias("query"), "url", "date", F.greatest(F.col("impressions"), F.lit(0)).alias("i"), F.greatest(F.col("clicks"), F.lit(0)).alias("c"), "position"
    )
    names = rows.select("query").distinct().withColumns({"norm": clean_text("query"), "tokens": intent_tokens("query")})  # each query is taken apart once
    rows = rows.join(names, "query").filter("norm <> ''")
    if brands is None:
        return rows
    own = F.exists(F.coalesce("terms", F.expr("cast(array() as array<string>)")), lambda t: (t != "") & F.contains("norm", t))
    return rows.join(brands.select("site_id", "terms"), "site_id", "left").filter(~own).drop("terms")


def _active(rows: DataFrame, least: int = 3) -> DataFrame:
    """(site_id, norm, query, tokens, i, c, urls) of the queries with enough impressions and a token."""
    q = rows.groupBy("site_id", "norm").agg(F.min("query").alias("query"), F.min("tokens").alias("tokens"), F.sum("i").alias("i"), F.sum("c").alias("c"), F.array_sort(F.collect_set("url")).alias("urls"))
    return q.filter((F.col("i") >= least) & (F.size("tokens") > 0))


def related_pairs(page_query: DataFrame, brands: DataFrame | None = None, most: int = 200, keep=lambda df: df) -> DataFrame:
    """Query pairs (a, b: normalised) of a site whose words or pages overlap enough.

    Candidates come from two inverted lists, by token and by url; a list with more than
    `most` queries says nothing about intent and is left out, as the definition has it.  An edge
    needs weighted word similarity 0.45, or 0.2 with url overlap 0.25, or a shared word with url overlap 0.66.
    """
    return _edges(keep(_active(_profiles(page_query, brands))), most)


def _edges(q: DataFrame, most: int) -> DataFrame:
    n = q.groupBy("site_id").agg(F.count("*").alias("n"))
    tok = q.select("site_id", "norm", F.explode("tokens").alias("t"))
    df = tok.groupBy("site_id", "t").agg(F.count("*").alias("df"))
    # weights are millionths, so that sums do not depend on the order of words
    lists = tok.join(df, ["site_id", "t"]).join(n, "site_id").withColumn("w", F.round((F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) * 1_000_000).cast("bigint"))
    urls = q.select("site_id", "norm", F.explode("urls").alias("t"))
    ulen = urls.groupBy("site_id", "t").agg(F.count("*").alias("df")).filter(F.col("df").between(2, most))
    keyed = lambda df, kind: df.select("site_id", F.concat(F.lit(kind), "t").alias("k"), "norm")
    keys = keyed(lists.filter(F.col("df").between(2, most)), "t:").unionByName(keyed(urls.join(ulen, ["site_id", "t"], "left_semi"), "u:"))
    pairs = keys.withColumnRenamed("norm", "a").join(keys.withColumnRenamed("norm", "b"), ["site_id", "k"]).filter("a < b").select("site_id", "a", "b").distinct()
    weights = lists.groupBy("site_id", "norm").agg(F.map_from_entries(F.collect_list(F.struct("t", "w"))).alias("m"))
    prof = q.join(weights, ["site_id", "norm"])
    side = lambda x: prof.select("site_id", F.col("norm").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("urls", "tokens", "m")])
    j = pairs.join(side("a"), ["site_id", "a"]).join(side("b"), ["site_id", "b"])
    add = lambda toks: F.aggregate(toks, F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(F.element_at("m_a", t), F.element_at("m_b", t), F.lit(0)))
    both, all_ = add(F.array_intersect("tokens_a", "tokens_b")), add(F.array_union("tokens_a", "tokens_b"))
    lexical = F.when(all_ > 0, both / all_).otherwise(0.0)
    shared = F.array_sort(F.array_intersect("tokens_a", "tokens_b"))
    out = j.select("site_id", "a", "b", lexical.alias("lexical"), jaccard(F.col("urls_a"), F.col("urls_b")).alias("url_overlap"), shared.alias("shared_tokens"))
    return out.filter((F.col("lexical") >= 0.45) | ((F.col("lexical") >= 0.2) & (F.col("url_overlap") >= 0.25)) | ((F.size("shared_tokens") > 0) & (F.col("url_overlap") >= 0.66)))


def flip_flops(rows: DataFrame) -> DataFrame:
    """(site_id, norm, flips): how often the page with most impressions of a query's day is another than on its day before."""
    weight = F.greatest(F.lit(1), F.col("i"))
    day = rows.groupBy("site_id", "norm", "date", "url").agg(F.sum("i").alias("i"), (F.sum(F.col("position").cast("decimal(18,6)") * weight).cast("double") / F.sum(weight)).alias("p"))
    best = day.groupBy("site_id", "norm", "date").agg(F.min_by("url", F.struct(-F.col("i"), "p", "url")).alias("url"))
    before = F.lag("url").over(Window.partitionBy("site_id", "norm").orderBy("date"))
    return best.withColumn("before", before).groupBy("site_id", "norm").agg(F.count_if(F.col("before") != F.col("url")).alias("flips"))


def label_components(edges: DataFrame, keys: list[str], keep) -> DataFrame:
    """keys, node, label: the smallest node that each node reaches.

    Min-label propagation with pointer jumping, so long chains take few rounds.
    """
    both = keep(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = keep(both.select(*keys, F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        lab = now.select(*keys, F.col("node").alias("b"), F.col("label").alias("lb"))
        near = both.join(lab, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("lb").alias("lb"))
        step = now.join(near, [*keys, "node"]).select(*keys, "node", F.least("label", "lb").alias("new"), F.col("label").alias("old"))
        jump = step.select(*keys, F.col("node").alias("new"), F.col("new").alias("up"))
        step = keep(step.join(jump, [*keys, "new"]).select(*keys, "node", F.least("new", "up").alias("label"), "old"))
        now = step.drop("old")
        if not step.filter("label <> old").limit(1).count():
            return now


def cannibalization_related(page_query: DataFrame, keep, brands: DataFrame | None = None, min_impressions: int = 30, top: int = 12, min_share: float = 0.08, max_gap: float = 25.0, least: int = 40) -> DataFrame:
    """Groups of related queries that several pages of a site compete for, with evidence, confidence and recommendation."""
    rows = keep(_profiles(page_query, brands))
    q = keep(_active(rows))
    e = keep(_edges(q, 200))
    comp = label_components(e.select("site_id", "a", "b"), ["site_id"], keep)
    group = ["site_id", "label"]
    w = Window.partitionBy(*group)
    best = q.join(comp.withColumnRenamed("node", "norm"), ["site_id", "norm"]).withColumn("n", F.row_number().over(w.orderBy(F.desc("i"), "norm"))).filter(F.col("n") <= top).drop("urls")
    best = keep(best.withColumn("total", F.sum("i").over(w)).filter(F.col("total") >= min_impressions))
    inside = rows.join(best.select("site_id", "norm", "label", F.col("query").alias("named"), "total"), ["site_id", "norm"])
    weight = F.greatest(F.lit(1), F.col("i"))
    per = inside.groupBy(*group, "url", "named").agg(F.sum("i").alias("i"), F.sum("c").alias("c"), F.sum(F.col("position").cast("decimal(18,6)") * weight).alias("pw"), F.first("total").alias("total"))
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("i")).alias("i"), "named"))), lambda x: x["named"])
    page = per.groupBy(*group, "url").agg(F.sum("i").alias("i"), F.sum("c").alias("c"), F.sum("pw").cast("double").alias("pw"), F.first("total").alias("total"), named.alias("queries"))
    page = page.withColumns({"share": F.col("i") / F.col("total"), "position": F.col("pw") / F.greatest("i", F.lit(1)), "role": page_role(F.col("url"), F.col("queries"))}).filter(F.col("share") >= min_share)
    page = page.withColumn("place", F.row_number().over(w.orderBy(F.desc("i"), "url")))
    pick = lambda c, n: F.max(F.when(F.col("place") == n, F.col(c)))
    g = page.groupBy(*group).agg(
        F.count("*").alias("pages"), *[pick(c, n).alias(f"{c}{n}") for c in ("url", "share", "position") for n in (1, 2)], F.countDistinct(F.when(F.col("place") <= 3, F.col("role"))).alias("roles"), pick("role", 1).alias("main_role"), pick("role", 2).alias("rival_role")
    )
    g = g.withColumn("gap", F.abs(F.col("position1") - F.col("position2"))).filter((F.col("pages") >= 2) & (F.col("gap") <= max_gap))
    chosen = best.select("site_id", "norm", "label")
    within = e.join(chosen.withColumnRenamed("norm", "a"), ["site_id", "a"]).join(chosen.select("site_id", F.col("norm").alias("b")), ["site_id", "b"])
    links = within.groupBy(*group).agg(F.max("lexical").alias("lex"), F.max("url_overlap").alias("ovl"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("shared_tokens")))).alias("shared"))
    flips = best.join(flip_flops(rows), ["site_id", "norm"], "left").groupBy(*group).agg(
        F.sum("flips").alias("flips"), F.sum("i").alias("impressions"), F.sum("c").alias("clicks"), F.count("*").alias("n_queries"), F.min_by("query", "n").alias("primary_query"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "query"))), lambda x: x["query"]).alias("queries"), F.array_distinct(F.flatten(F.collect_list(F.split("norm", " ")))).alias("words"), F.array_join(F.array_sort(F.collect_list("norm")), "|").alias("group_id"),
    )
    t = g.join(links, group).join(flips, group)
    balance = F.least(F.lit(1.0), F.col("share2") / F.greatest(F.lit(0.01), F.col("share1")))
    score = F.col("lex") * 45 + F.col("ovl") * 20 + balance * 15 + F.greatest(F.lit(0.0), 1 - F.col("gap") / 25) * 10 + F.least(F.lit(1.0), F.col("flips") / 3) * 10
    t = t.withColumns({"balance": balance, "confidence": F.greatest(F.lit(0), F.least(F.lit(100), js_round(score).cast("int"))), "top_share": js_round(F.col("share1") * 1000) / 10}).filter(F.col("confidence") >= least)
    path = lambda u: intent_tokens(F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))
    t = t.withColumns({"slug1": path(F.col("url1")), "slug2": path(F.col("url2"))})
    advice = (
        F.when(F.col("roles") > 1, "differentiate").when((F.col("lex") >= 0.78) & (slug_similarity(F.col("slug1"), F.col("slug2")) >= 0.65), "canonical_review")
        .when((F.col("lex") >= 0.72) & (F.col("balance") >= 0.55), "merge_review").when((F.col("top_share") >= 65) & (F.col("flips") == 0), "internal_linking").otherwise("differentiate")
    )
    level = F.when(F.col("confidence") >= 75, "high").when(F.col("confidence") >= 55, "medium").otherwise("low")
    return t.select(
        "site_id", "group_id", "primary_query", F.array_join("queries", "|").alias("queries"), "n_queries", infer_intent(F.col("words")).alias("intent"), "confidence", level.alias("level"), advice.alias("recommendation"), "impressions", "clicks",
        js_round(F.col("lex") * 100).cast("int").alias("query_similarity"), js_round(F.col("ovl") * 100).cast("int").alias("url_overlap"), F.array_join(F.slice("shared", 1, 12), "|").alias("shared_tokens"), "flips", js_round("gap", 1).alias("gap"), "pages",
        F.col("url1").alias("main_url"), "main_role", "top_share", F.col("url2").alias("rival_url"), "rival_role",
    )


# ------------------------------------------------------------------ marker model

# Fixed letters of other scripts that look like Latin ones, and Latin ones that look like Cyrillic ones.
CYRILLIC_LIKE = ("авекмнорстухіѕјԁһӏ", "abekmhopctyxisjdhl")
GREEK_LIKE = ("αβεζηικμνορτυχγ", "abeznikmvoptuxy")
LATIN_LIKE = ("abekmhopctyxij", "авекмнорстухіј")
# Fixed patterns that turn marked-up text into prose, in order.
MARKUP = [
    (r"```[\s\S]*?```", " "),
    (r"(?im)^\s*(Title|Meta Description|URL Slug)\s*:.*$", " "),
    (r"<[^>]+>", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", " "),
    (r"(?m)^\s{0,3}>\s?", " "),
    (r"(?m)^\s*[-*+]\s+", " "),
    (r"(?m)^\s*\d+[.)]\s+", " "),
    (r"(?m)^\s*\|.*\|\s*$", " "),
    (r"[*_~`]+", " "),
    (r"(?i)&[a-z]+;|&#\d+;", " "),
]
WINDOW, LEAST_WINDOW, LEAST_VOCABULARY = 300, 120, 50


def prose(text: Column) -> Column:
    """Text without Markdown, HTML and the like, spaces collapsed."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in MARKUP:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def fold(token: Column) -> Column:
    """A token that mixes scripts in the letters of its main one (Latin where they are even); others stay as they are."""
    n = lambda letters: F.length(F.regexp_replace(token, f"[^{letters}]", ""))
    latin, cyrillic, greek = n("a-z"), n("\u0400-\u04ff"), n("\u0370-\u03ff")
    scripts = (latin > 0).cast("int") + (cyrillic > 0).cast("int") + (greek > 0).cast("int")
    to_latin = F.translate(F.translate(token, *CYRILLIC_LIKE), *GREEK_LIKE)
    return F.when(scripts < 2, token).when((cyrillic > latin) & (cyrillic >= greek), F.translate(token, *LATIN_LIKE)).otherwise(to_latin)


def tokens(text: Column) -> Column:
    """Words of a text column in lower case and plain form, look-alike letters folded."""
    found = F.regexp_extract_all(F.lower(compatible(prose(text))), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'\u2019-]*)"), F.lit(1))
    return F.transform(found, lambda t: F.when(t.rlike("^[a-z0-9'-]*$"), t).otherwise(fold(t)))


_DOC = "\0"  # stands once in every counted document, so its count is theirs; no word has it


def marker_counts(human: DataFrame, machine: DataFrame, documents: bool = False) -> DataFrame:
    """(w, human_n, human_docs, machine_n, machine_docs) of every word, over documents of LEAST_WINDOW tokens or more.

    With `documents`, one more row, named by a zero character, counts the documents of each side.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        # not a filter: Spark would move it below the words and take every text apart twice
        whole = lambda t: F.when(F.size(t) >= LEAST_WINDOW, F.array_append(t, F.lit(_DOC)) if documents else t)
        w = df.select("doc_id", F.explode(let(tokens(F.col("text")), whole)).alias("w"))
        each = w.groupBy("w", "doc_id").agg(F.count("*").alias("c"))
        return each.groupBy("w").agg(F.sum("c").alias(f"{name}_n"), F.count("*").alias(f"{name}_docs"))

    return side(human, "human").join(side(machine, "machine"), "w", "full_outer").fillna(0)


def train_marker_model(human: DataFrame, machine: DataFrame, least_docs: int = 3, size: int = 6000, smooth: float = 0.5) -> DataFrame:
    """(w, weight, docs, human_docs, human_share) of the `size` words that tell most: the largest |weight| * sqrt(documents).

    weight is the log-odds of machine against human text for words in least_docs documents or more of a side.
    Fewer than three documents of a side, or LEAST_VOCABULARY words, give no model.  Callers hold documents for `calibrate` back.
    """
    counts = marker_counts(human, machine, documents=True)
    word = F.col("w") != _DOC
    often = word & ((F.col("human_docs") >= least_docs) | (F.col("machine_docs") >= least_docs))
    known = counts.filter(often)
    of = lambda c, on: F.coalesce(F.sum(F.when(on, F.col(c))), F.lit(0))
    one = counts.agg(of("human_n", word).alias("hn"), of("machine_n", word).alias("mn"), F.count_if(often).alias("v"), of("human_docs", ~word).alias("hd"), of("machine_docs", ~word).alias("md"))  # one row
    odds = lambda n, of: F.log((n + smooth) / (of + smooth * F.col("v")))
    t = known.join(F.broadcast(one)).filter((F.col("v") >= LEAST_VOCABULARY) & (F.col("hd") >= 3) & (F.col("md") >= 3))
    t = t.withColumns({"raw": odds(F.col("machine_n"), F.col("mn")) - odds(F.col("human_n"), F.col("hn")), "docs": F.col("human_docs") + F.col("machine_docs")})
    t = t.select("w", js_round("raw", 4).alias("weight"), "docs", "human_docs", js_round(F.col("human_docs") / F.col("hd"), 2).alias("human_share"), js_round(F.abs("raw") * F.sqrt("docs"), 6).alias("pull"))
    return t.orderBy(F.desc("pull"), "w").limit(size).drop("pull")


def _windows(docs: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """(doc_id, window, words, hits, total): words of every window, those that the model knows and the sum of their weights."""
    t = docs.select("doc_id", F.posexplode_outer(tokens(F.col("text"))).alias("i", "w")).withColumn("window", F.coalesce(F.floor(F.col("i") / size).cast("int"), F.lit(0)))
    w = t.join(F.broadcast(model.select("w", "weight")), "w", "left")  # a model has `size` words at most
    return w.groupBy("doc_id", "window").agg(F.count("w").alias("words"), F.count("weight").alias("hits"), F.sum(F.round(F.col("weight") * 1e4).cast("bigint")).alias("total"))


def _llr() -> Column:
    return F.coalesce(F.col("total") / (1e4 * F.col("hits")), F.lit(0.0))


def _counted() -> Column:
    """Whether a window counts: a last one under LEAST_WINDOW words does not, unless it is the only one."""
    return (F.col("window") == 0) | (F.col("words") >= LEAST_WINDOW)


def window_scores(docs: DataFrame, model: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, window, llr): mean weight of the words of each window that the model knows, 0 without one; an empty document has one window."""
    return _windows(docs, model, size).filter(_counted()).select("doc_id", "window", _llr().alias("llr"))


def calibrate(human_held: DataFrame, machine_held: DataFrame, model: DataFrame) -> DataFrame:
    """One row: cal_human, cal_machine (mean window scores of documents that training did not see) and separation (0..1)."""
    both = window_scores(human_held, model).select("llr", F.lit("h").alias("side")).unionByName(window_scores(machine_held, model).select("llr", F.lit("m").alias("side")))
    x = F.col("llr").cast("decimal(24,12)")
    of = lambda s: F.when(F.col("side") == s, x)
    t = both.agg(*[f(of(s)).alias(f"{n}_{s}") for s in "hm" for n, f in (("s", F.sum), ("n", F.count))], *[F.sum(of(s) * of(s)).alias(f"q_{s}") for s in "hm"])
    mean = lambda s: F.coalesce(F.col(f"s_{s}").cast("double") / F.col(f"n_{s}"), F.lit(0.0))
    var = lambda s: F.when(F.col(f"n_{s}") > 1, F.greatest(F.lit(0.0), (F.col(f"q_{s}").cast("double") - F.col(f"n_{s}") * mean(s) * mean(s)) / (F.col(f"n_{s}") - 1))).otherwise(0.0)
    pooled = F.greatest(F.sqrt((var("h") + var("m")) / 2), F.lit(1e-6))
    apart = F.least(F.lit(1.0), F.abs(mean("m") - mean("h")) / pooled / 4)
    return t.select(js_round(mean("h"), 6).alias("cal_human"), js_round(mean("m"), 6).alias("cal_machine"), js_round(apart, 3).alias("separation"))


def score_documents(docs: DataFrame, model: DataFrame, calibration: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, score (0..100: the mean of its windows' calibrated scores), verdict, words, markers (words that the model knows)."""
    span = F.col("cal_machine") - F.col("cal_human")
    pct = F.when(span != 0, js_round((_llr() - F.col("cal_human")) / span * 100))
    s = _windows(docs, model, size).join(F.broadcast(calibration)).withColumn("s", F.when(_counted(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)).cast("bigint")))
    out = s.groupBy("doc_id").agg(js_round(F.sum("s") / F.count("s")).cast("int").alias("score"), F.count_if(_counted()).alias("windows"), F.sum("words").alias("words"), F.sum("hits").alias("markers"))
    return out.withColumn("verdict", F.when(F.col("score") < 15, "human").when(F.col("score") < 40, "mixed").otherwise("ai"))


def document_markers(docs: DataFrame, model: DataFrame, k: int = 40) -> DataFrame:
    """(doc_id, w, weight, count, contribution, place): the k machine-leaning words of each document that move its score most."""
    each = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("count"))
    t = each.join(F.broadcast(model.select("w", "weight")), "w").withColumn("contribution", js_round(F.col("weight") * F.col("count"), 4)).filter("contribution > 0")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("contribution"), "w"))
    return t.withColumn("place", place).filter(F.col("place") <= k).select("doc_id", "w", "weight", "count", "contribution", "place")


def missing_words(docs: DataFrame, model: DataFrame, k: int = 40) -> DataFrame:
    """(doc_id, words): the k most human-leaning words of the model, three letters or more, that each document lacks."""
    human = model.filter((F.col("weight") < 0) & (F.length("w") > 2)).agg(F.transform(F.array_sort(F.collect_list(F.struct("weight", "w"))), lambda x: x["w"]).alias("human"))  # one row of a bounded model
    return docs.select("doc_id", tokens(F.col("text")).alias("t")).join(F.broadcast(human)).select("doc_id", F.slice(F.array_except("human", "t"), 1, k).alias("words"))


def ban_candidates(model: DataFrame, k: int = 60, niche: float = 0.4) -> DataFrame:
    """The k most machine-leaning words, four letters or more, that are not the human writers' own subject words."""
    return model.filter((F.col("weight") > 0) & (F.length("w") >= 4) & ~F.col("w").rlike("^[0-9]") & (F.col("human_share") < niche)).orderBy(F.desc("weight"), "w").limit(k)


def model_stats(model: DataFrame, calibration: DataFrame) -> DataFrame:
    """Vocabulary, separation on held-out documents, and quality."""
    quality = F.when(F.col("separation") >= 0.6, "good").when(F.col("separation") >= 0.35, "fair").otherwise("weak")
    return model.agg(F.count("*").alias("vocabulary")).join(F.broadcast(calibration)).withColumn("quality", quality)
