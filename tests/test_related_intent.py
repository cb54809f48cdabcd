"""Related intent, intents and roles: known cases, and a brute-force version of the whole grouping."""

import itertools
import math
import random
import re
import unicodedata
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from sightlines.operators import text as T

KIND = "site_id string, query string, url string, date date, impressions bigint, clicks bigint, position double"
HOST = "https://example.com"


def row(query, path, day, impressions, position):
    return ("s", query, HOST + path, date(2026, 8, day), impressions, round(impressions * 0.08), float(position))


def grouped(spark, rows, brands=(), **options):
    own = spark.createDataFrame([("s", list(brands))], "site_id string, terms array<string>")
    return T.cannibalization_related(spark.createDataFrame(rows, KIND), lambda df: df.checkpoint(), own, **options).collect()


def test_queries_group_where_pages_compete(spark):
    rows = [row("best crm software", "/blog/best-crm", 1, 80, 7), row("best crm software", "/crm", 1, 50, 9), row("top crm tools", "/blog/best-crm", 1, 45, 8), row("top crm tools", "/crm", 1, 65, 6)]
    got = grouped(spark, rows)
    assert len(got) == 1
    g = got[0]
    assert set(g.queries.split("|")) == {"best crm software", "top crm tools"} and g.pages == 2
    assert (g.intent, g.recommendation, g.url_overlap, g.shared_tokens) == ("commercial", "differentiate", 100, "crm")


def test_a_shared_homepage_joins_nothing(spark):
    rows = [row("weather tomorrow", "/", 1, 100, 4), row("accounting calculator", "/", 1, 100, 4)]
    assert grouped(spark, rows) == [] and T.related_pairs(spark.createDataFrame(rows, KIND)).count() == 0


def test_brands_tokens_and_roles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.brand_terms(F.lit("sc-domain:www.example.co.uk"))) == ["example"]
    words = spark.createDataFrame([("Как выбрать CRM для бизнеса",), ("最佳搜索工具",)], "q string").select(T.intent_tokens("q").alias("t")).collect()
    assert "crm" in words[0].t and "для" not in words[0].t and any(len(t) == 2 for t in words[1].t)
    assert one(T.page_role(F.lit("https://example.com/blog/crm-guide"), F.array(F.lit("crm guide")))) == "guide"
    assert one(T.page_role(F.lit("https://example.com/x"), F.array(F.lit("buy"), F.lit("цена")))) == "product"
    assert one(T.infer_intent(F.array(F.lit("red"), F.lit("shoes")))) == "mixed"
    branded = [row("example crm", "/crm", 1, 80, 5), row("example crm software", "/software", 1, 60, 6)]
    assert grouped(spark, branded, ["example"]) == []


def test_changes_of_the_leading_page_are_counted(spark):
    days = {1: ((80, 5, 20, 9), (50, 6, 30, 8)), 2: ((10, 10, 90, 4), (20, 9, 70, 5))}
    rows = []
    for day, both in days.items():
        for query, (ia, pa, ib, pb) in zip(("crm comparison", "crm comparisons"), both):
            rows += [row(query, "/a", day, ia, pa), row(query, "/b", day, ib, pb)]
    (g,) = grouped(spark, rows)
    assert g.flips == 2


# -------------------------------------------------------------- brute force


def clean(s):
    bare = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    return re.sub(r"[\W_]+", " ", bare).strip()


def toks(s):
    return [w for w in dict.fromkeys(clean(s).split()) if len(w) > 1 and w not in T.STOP_WORDS]


def half_up(x):
    return math.floor(x + 0.5)


def brute(rows, least_total=30):
    """{(queries, pages, confidence, flips, gap, recommendation)} for one site, one query spelling each."""
    prof = defaultdict(list)
    for _, q, u, d, i, c, p in rows:
        prof[clean(q)].append((q, u, d, i, p))
    act = {k: v for k, v in prof.items() if sum(x[3] for x in v) >= 3 and toks(v[0][0])}
    t = {k: set(toks(v[0][0])) for k, v in act.items()}
    urls = {k: {x[1] for x in v} for k, v in act.items()}
    df = defaultdict(int)
    for k in act:
        for w in t[k]:
            df[w] += 1
    weight = {w: math.log((len(act) + 1) / (n + 1)) + 1 for w, n in df.items()}
    edges = {}
    for a, b in itertools.combinations(sorted(act), 2):
        if not (t[a] & t[b] or urls[a] & urls[b]):
            continue
        lex = sum(weight[w] for w in t[a] & t[b]) / sum(weight[w] for w in t[a] | t[b])
        ovl = len(urls[a] & urls[b]) / len(urls[a] | urls[b])
        if lex >= 0.45 or (lex >= 0.2 and ovl >= 0.25) or (t[a] & t[b] and ovl >= 0.66):
            edges[a, b] = (lex, ovl)
    up = {k: k for k in act}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        up[root(a)] = root(b)
    groups = defaultdict(list)
    for k in {x for e in edges for x in e}:
        groups[root(k)].append(k)
    out = set()
    for ks in groups.values():
        imp = {k: sum(x[3] for x in act[k]) for k in ks}
        top = sorted(ks, key=lambda k: (-imp[k], k))[:12]
        total = sum(imp[k] for k in top)
        page = defaultdict(lambda: [0, 0.0])
        for k in top:
            for _, u, _, i, p in act[k]:
                page[u][0] += i
                page[u][1] += p * max(1, i)
        ps = sorted(((u, i, i / total, w / max(1, i)) for u, (i, w) in page.items() if i / total >= 0.08), key=lambda x: (-x[1], x[0]))
        if total < least_total or len(ps) < 2 or abs(ps[0][3] - ps[1][3]) > 25:
            continue
        gap = abs(ps[0][3] - ps[1][3])
        own = [v for e, v in edges.items() if set(e) <= set(top)]
        lex, ovl = max(x for x, _ in own), max(y for _, y in own)
        flips = 0
        for k in top:
            last = None
            for d in sorted({x[2] for x in act[k]}):
                day = defaultdict(lambda: [0, 0.0, 0])
                for _, u, dd, i, p in act[k]:
                    if dd == d:
                        day[u][0] += i
                        day[u][1] += p * max(1, i)
                        day[u][2] += max(1, i)
                win = min(day, key=lambda u: (-day[u][0], day[u][1] / day[u][2], u))
                flips += last is not None and win != last
                last = win
        balance = min(1, ps[1][2] / max(0.01, ps[0][2]))
        conf = half_up(lex * 45 + ovl * 20 + balance * 15 + max(0, 1 - gap / 25) * 10 + min(1, flips / 3) * 10)
        if conf >= 40:
            out.add(("|".join(top), len(ps), conf, flips, half_up(gap * 10) / 10))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_grouping_equals_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["crm", "tools", "best", "shoes", "red", "guide", "price", "café"]
    queries = [" ".join(r.sample(words, r.randrange(1, 4))) for _ in range(14)]
    rows = list({(q, p, d): row(q, p, d, r.randrange(1, 40), r.randrange(1, 60)) for q, p, d in ((r.choice(queries), f"/p{r.randrange(5)}", r.randrange(1, 6)) for _ in range(150))}.values())
    got = {(g.queries.replace("é", "e"), g.pages, g.confidence, g.flips, g.gap) for g in grouped(spark, rows)}
    assert got == brute(rows)
