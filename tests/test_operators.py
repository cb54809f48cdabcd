"""Small cases with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sightlines.functions import numbers as N
from sightlines.functions import urls as U
from sightlines.operators import answers, change, checks, keywords, pages, search, text
from sightlines.sources import ingest
from sightlines.streaming import jobs

D = date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rounding_and_change(spark):
    assert one(spark, N.js_round(F.lit(2.5))) == 3.0 and one(spark, N.js_round(F.lit(-2.5))) == -2.0
    assert one(spark, N.pct_change(F.lit(5), F.lit(0))) == 100.0
    assert one(spark, N.pct_change(F.lit(5), F.lit(0), "zero")) == 0.0
    assert one(spark, N.pct_change(F.lit(5), F.lit(0), "null")) is None


def test_windows_move_back_to_the_weekday():
    w = N.windows(D(2024, 1, 30), 10, match_weekday=True)
    assert (w.start - w.before_start).days == 14 and (w.end - w.start).days == 9
    assert N.period_days("ytd", D(2024, 2, 1)) == 32


def test_parse_moment(spark):
    t = spark.createDataFrame([("1704067200000",), ("2024-01-01T00:00:00",), ("x",), (None,)], "s string")
    assert [r.x for r in t.select(N.parse_moment("s").alias("x")).collect()] == [datetime(2024, 1, 1), datetime(2024, 1, 1), None, None]


def test_weighted_outcome(spark):
    rows = [("s", "u", D(2024, 1, 2), 1, 10, 2.0), ("s", "u", D(2024, 1, 3), 9, 990, 8.0 - 0.04040404)]
    days = spark.createDataFrame(rows, "site_id string, url string, date date, clicks int, impressions int, position double")
    c = spark.createDataFrame([("c", "s", "u", D(2024, 1, 4))], "change_id string, site_id string, url string, live_at date")
    r = search.measure_outcomes(c, days, D(2024, 1, 5)).collect()
    assert [(x.day, x.clicks, x.impressions, x.position) for x in r] == [(0, 10, 1000, 7.9)]


def test_sitemap_needs_two_complete_misses(spark):
    kind = "url string, lastmod string, image_count int, video_count int, news_count int, sitemap_type string"
    state = spark.createDataFrame([("u", "l", 0, 0, 0, "page", "unchanged", 0)], kind + ", inventory_status string, missing_syncs int")
    none = spark.createDataFrame([], kind)
    assert change.sitemap_diff(state, none, False).first().inventory_status == "unchanged"
    first = change.sitemap_diff(state, none, True)
    assert (first.first().inventory_status, first.first().missing_syncs) == ("pending", 1)
    second = change.sitemap_diff(first.drop("disappeared"), none, True).first()
    assert second.inventory_status == "missing" and second.disappeared


def test_lastmod_verdicts(spark):
    v = lambda *a: one(spark, change.lastmod_verdict(*[F.lit(x).cast("string") for x in a]))
    assert v("h", "h", "1", "2") == "suspicious" and v("h", "k", "1", "2") == "reliable" and v(None, "k", "1", "2") == "unknown"


def test_audit_verification(spark):
    kind = "url string, http_status int, issues array<string>"
    a = spark.createDataFrame([("a", 200, ["x", "y"]), ("b", 200, ["x"])], kind)
    b = spark.createDataFrame([("a", 200, ["y", "z"]), ("b", 404, [])], kind)
    got = {(r.url, r.rule): r.verdict for r in change.verify_audit(a, b).collect()}
    assert got == {("a", "x"): "resolved", ("a", "y"): "still_present", ("a", "z"): "regression", ("b", "x"): "inconclusive"}


def test_partial_backlink_pull_loses_nothing(spark):
    state = spark.createDataFrame([("t", "r", D(2024, 1, 1), D(2024, 1, 2), None)], "target string, ref_domain string, first_seen date, last_seen date, lost_at date")
    none = spark.createDataFrame([], "target string, ref_domain string, first_seen date, last_seen date")
    assert change.refdomain_diff(state, none, False, D(2024, 2, 1)).first().change == "kept"
    assert change.refdomain_diff(state, none, True, D(2024, 2, 1)).first().change == "lost"


def test_history_over_three_runs(spark):
    s = spark.createDataFrame([("r1", "c", "p", "FAIL"), ("r1", "c", "q", "FAIL"), ("r2", "c", "p", "PASS"), ("r2", "c", "q", "FAIL"), ("r3", "c", "p", "PASS"), ("r3", "c", "q", "PASS")], "run_id string, title string, page string, status string").withColumn("family", F.lit("f"))
    h = {(r.page, r.run_id): r.change for r in checks.finding_history(s).collect()}
    assert h["p", "r2"] == "resolved" and h["q", "r2"] == "unchanged" and h["q", "r3"] == "resolved"
    assert one(spark, checks.normal_status(F.lit("UNKNOWN"))) == "DATA_UNAVAILABLE"


def test_greedy_clusters_match_one_at_a_time(spark):
    import random

    rnd = random.Random(3)
    serp = {f"k{i}": {f"u{rnd.randrange(12)}" for _ in range(5)} for i in range(25)}
    vol = {k: rnd.randrange(5) for k in serp}
    want = {}
    for k in sorted(serp, key=lambda k: (-vol[k], k)):
        seeds = [s for s in sorted(set(want.values()), key=lambda s: (-vol[s], s)) if len(serp[s] & serp[k]) >= 3]
        want[k] = seeds[0] if seeds else k
    s = spark.createDataFrame([(k, u) for k, us in serp.items() for u in us], "keyword string, url string")
    got = keywords.cluster_by_serp(s, spark.createDataFrame(list(vol.items()), "keyword string, volume int"), 3)
    assert {r.keyword: r.seed for r in got.collect()} == want


def test_redirects(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "url string, target string")
    got = {t.url: (t.final_url, t.hops, t.loop) for t in pages.redirect_trace(r).collect()}
    assert got["a"] == ("c", 2, False) and got["b"] == ("c", 1, False) and got["x"][2] and got["y"][2]


def test_audit_of_a_healthy_and_an_empty_page(spark):
    good = "<html lang='en'><head><title>A fine page</title><meta name='viewport' content='w'><meta name='description' content='d'><link rel='canonical' href='https://s.example/a'>" + "".join(f"<meta property='og:{k}' content='x'>" for k in ("title", "description", "image")) + "</head><body><h1>A</h1>" + "word " * 200 + "</body></html>"
    p = spark.createDataFrame([("https://s.example/a", good), ("https://s.example/b", "<div id='root'></div>"), ("https://s.example/c", None)], "url string, html string")
    got = {r.url[-1]: set(r.issues) for r in pages.audit_pages(pages.page_facts(p)).collect()}
    assert got["a"] == set() and "js_rendered" in got["b"] and not got["b"] & {"thin_content", "h1_missing"} and got["c"] == set()
    assert len(pages.audit_rules()) == 31


def test_every_page_gets_116_checks(spark):
    p = spark.createDataFrame([("https://s.example/", "<title>T</title><h1>a</h1>"), ("http://s.example/x", None)], "url string, html string")
    got = pages.evaluate_checks(pages.check_facts(p))
    assert {r.url: r["count"] for r in got.groupBy("url").count().collect()} == {"https://s.example/": 116, "http://s.example/x": 116}
    one_ = {r.title: r.status for r in got.filter("url = 'http://s.example/x'").collect()}
    assert one_["Served over HTTPS"] == "FAIL" and one_["Robots file allows the page"] == "UNKNOWN"


def test_mentions(spark):
    assert one(spark, answers.mentions_term(F.lit("We like Acme."), F.lit("acme"))) and not one(spark, answers.mentions_term(F.lit("Acmeville"), F.lit("acme")))


def test_text(spark):
    r = one(spark, text.keyword_coverage(F.lit("a b a b"), F.lit("a"), F.array(F.lit("a b"), F.lit("b a"))))
    assert [(x.before, x.after, x.lost) for x in r] == [(2, 0, True), (1, 0, True)]


def test_unicode(spark):
    from sightlines.functions import unicode as X

    t = spark.createDataFrame([("Crème_Brûlée, 2x!", "bücher.example"), (None, None), ("北京天气 app", "plain.example")], "s string, h string")
    got = t.select(X.clean_text("s").alias("c"), X.word_tokens("s").alias("w"), X.ascii_host("h").alias("h")).collect()
    assert got[0].c == "creme brulee 2x" and got[0].h == "xn--bcher-kva.example" and (got[1].c, got[1].w, got[1].h) == ("", [], "")
    assert got[2].w == ["北京", "京天", "天气", "app"]


def test_exports_and_imports(spark, tmp_path):
    f = tmp_path / "k.csv"
    f.write_text("Keyword;Volume;Difficulty\nred shoes;1.2K;n/a\n")
    kind, t = ingest.read_metric_export(spark, str(f))
    assert kind == "keywords" and t.first().asDict() == {"keyword": "red shoes", "volume": 1200.0, "kd": None}
    df = spark.createDataFrame([(1, "=1+1", None)], "id int, s string, n int")
    for fmt in ("json", "csv", "xml", "markdown"):
        ingest.export_observation(df, fmt, str(tmp_path / fmt))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().s == "'=1+1"
    assert spark.read.json(str(tmp_path / "json")).first().s == "=1+1"
    with pytest.raises(ValueError):
        ingest.query(spark, "select 1; drop table x")


def test_stream_totals_are_replay_safe(spark, tmp_path):
    at = str(tmp_path / "t")
    sink = jobs.merge_totals(at, ["k", "day"], "n")
    df = lambda *rows: spark.createDataFrame([(k, D(2024, 1, day), n) for k, day, n in rows], "k string, day date, n bigint")
    assert jobs.read_days(spark, at) is None
    sink(df(("a", 1, 1), ("b", 1, 2), ("a", 2, 9)), 0)
    sink(df(("a", 1, 5)), 1)
    sink(df(("a", 1, 5)), 1)
    assert {(r.k, r.day.day): r.n for r in jobs.read_days(spark, at).collect()} == {("a", 1): 5, ("b", 1): 2, ("a", 2): 9}
    assert sorted(p.name for p in (tmp_path / "t" / "epoch=1").iterdir() if p.is_dir()) == ["day=2024-01-01"]  # the other day is left alone


def test_snapshots_keep_the_last_pull_of_a_day(spark, tmp_path):
    at = str(tmp_path / "s")
    sink = jobs.snapshot_sink(at, ["k"])
    df = lambda *rows: spark.createDataFrame([("k", datetime(2024, 1, day, hour), n) for day, hour, n in rows], "k string, pulled_at timestamp, n bigint")
    sink(df((1, 9, 1), (2, 9, 2)), 0)
    sink(df((1, 12, 3), (2, 8, 4)), 1)
    sink(df((1, 12, 3), (2, 8, 4)), 1)
    assert sorted((r.day.day, r.n) for r in jobs.read_days(spark, at).collect()) == [(1, 3), (2, 2)]


def test_payload_kinds(spark):
    from sightlines.functions.payloads import classify_payload

    cases = {
        "": "empty", "  \n": "empty", '{"a": 1}': "json", '```json\n{"a": 1}\n```': "fenced_json", '```\n{"a": 1}\n```': "fenced_json", 'Sure: {"a": {"b": 2}} done': "embedded_json", "no json here": "plain_text",
        '{"a": ': "malformed_json", "```json\nnope\n```": "malformed_json", "[1, 2]": "non_object_json", "12": "non_object_json", "null": "non_object_json", "{bad} then {\"a\": 1}": "embedded_json", "12 apples": "plain_text",
    }
    t = spark.createDataFrame([*[(k,) for k in cases], (None,)], "s string")
    got = {r.s: (r.p.kind, r.p.value) for r in t.select("s", classify_payload(F.col("s")).alias("p")).collect()}
    assert {k: got[k][0] for k in cases} == cases and got[None] == ("empty", None)
    assert got['Sure: {"a": {"b": 2}} done'][1] == '{"a": {"b": 2}}' and got["12"][1] is None


def test_filters_orders_and_pages(spark):
    t = spark.createDataFrame([(1, "Alpha", "x"), (2, None, "ALPHABET"), (3, "beta", None)], "id int, a string, b string")
    ids = lambda df: [r.id for r in df.collect()]
    assert sorted(ids(search.regex_filter(t, ["a", "b"], "^alpha"))) == [1, 2] and ids(search.regex_filter(t, ["a"], "(")) == [] and sorted(ids(search.regex_filter(t, ["a"], None))) == [1, 3]
    assert ids(search.in_order(t, "a", ["BETA"])) == [3, 1, 2] and ids(search.listing(t, ["id"], 2, 2)) == [3]


def test_simhash_of_pages(spark):
    import re

    import xxhash

    def brute(text):
        v = [0] * 64
        for w in re.findall("[a-z0-9]+", text.lower()):
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        x = sum(1 << i for i in range(64) if v[i] >= 0)
        return x - (1 << 64) if x >> 63 else x

    base = " ".join(f"token{i % 60}" for i in range(120))
    rows = [("a", base + " tail one"), ("b", base + " other end"), ("c", "Entirely different words"), ("d", ""), ("e", None)]
    t = spark.createDataFrame(rows, "url string, text string")
    fp = {r.url: r.fingerprint for r in pages.simhash(t).collect()}
    assert {k: fp[k] for k in "abc"} == {k: brute(v) for k, v in rows[:3]} and fp["d"] is None and fp["e"] is None
    d = spark.createDataFrame([(fp["a"], fp["b"], fp["c"])], "a bigint, b bigint, c bigint").select(pages.hamming(F.col("a"), F.col("b")).alias("n"), pages.hamming(F.col("a"), F.lit(None).cast("bigint")).alias("m"), pages.hamming(F.col("a"), F.col("c")).alias("f")).first()
    assert d.n <= 3 and d.m == 64 and d.f > 10
    assert [r.s for r in t.select(pages.is_substantial(F.col("text")).alias("s")).collect()] == [True, True, False, False, False]


def test_snapshot_comparison_names_every_change(spark):
    old = [("c", "p1", "FAIL"), ("c", "p2", "PASS"), ("c", "p3", "FAIL"), ("c", "p4", "PARTIAL"), ("c", "gone", "PASS"), ("c", "p5", "MANUAL_REVIEW"), ("c", "p6", "UNKNOWN"), ("c", "p7", "FAIL"), ("c", "p8", "FAIL")]
    new = [("c", "p1", "PASS"), ("c", "p2", "FAIL"), ("c", "p3", "PARTIAL"), ("c", "p4", "FAIL"), ("c", "new", "PASS"), ("c", "bad", "FAIL"), ("c", "p5", "PASS"), ("c", "p6", "PASS"), ("c", "p7", "NOT_APPLICABLE"), ("c", "p8", "FAIL")]
    df = lambda rows: spark.createDataFrame(rows, "title string, page string, status string")
    ch = checks.compare_snapshots(df(new), df(old))
    assert {r.page: r.change for r in ch.collect()} == {
        "p1": "resolved", "p2": "worsened", "p3": "improved", "p4": "worsened", "gone": "no_longer_assessed", "new": "new_page", "bad": "new_issue", "p5": "requires_review", "p6": "evidence_unavailable", "p7": "no_longer_applicable", "p8": "unchanged",
    }
    s = checks.snapshot_summary(ch).first()
    assert (s.findings_resolved, s.findings_worsened, s.pages_improved, s.pages_regressed) == (1, 2, 2, 2)


def test_fixed_values(spark):
    """Values that other tools show for the same rows."""
    v = lambda c: one(spark, c)
    assert v(checks.value_to_fix(F.lit("high"), F.lit("PARTIAL"), F.lit(0.5), F.lit(1), F.lit(4))) == 3 * 0.65 * 2 * 1.25 and v(checks.value_to_fix(F.lit("info"), F.lit("FAIL"), F.lit(0.0), F.lit(0), F.lit(0))) == 1.0
    assert [v(search.expected_ctr(F.lit(p))) for p in (1.0, 2.4, 10.4)] == [27.6, 15.8, 2.4]
    url = lambda p: F.lit(f"https://s.example{p}")
    assert [v(U.url_class(url(p))) for p in ("/", "/x/news/a", "/a/b/c", "/x/tag/y", "/f/a.pdf", "/x/research/y", "/press-release/z")] == ["core_page", "news_release", "unknown", "archive_taxonomy", "document_disclosure", "supporting_evidence", "news_release"]
    assert v(U.url_class(url("/a/b"), F.lit("post-sitemap1.xml"))) == "article"
    assert [tuple(v(U.page_type(url(p)))) for p in ("/", "/blog", "/blog/x", "/terms", "/x")] == [("homepage", "high"), ("blog_index", "medium"), ("blog_post", "medium"), ("privacy_legal", "high"), ("unknown", "low")]
    assert v(U.priority_score(url("/x/2024/deal-completed"), F.lit("news_release"), F.lit("sitemap"))) == 520 + 250 - 30 - 80 + 90
    assert v(U.candidate_score(url("/"), url("/"), F.lit(False), F.lit(False))) == 10_000 and v(U.candidate_score(url("/login"), url("/"), F.lit(True), F.lit(True))) == -10_000 and v(U.candidate_score(url("/about"), url("/"), F.lit(True), F.lit(False))) == 1000 + 175 + 180
    assert v(text.fold(F.lit("раypal"))) == "paypal" and v(text.fold(F.lit("привет"))) == "привет" and v(text.fold(F.lit("приветa"))) == "привета"
    assert v(U.candidate_identity(F.lit("http://www.s.example//a/?utm_x=1&b=2&a=#f"), F.lit("s.example"))) == "https://s.example/a/?a=&b=2" and v(U.candidate_identity(F.lit("https://t.example/"), F.lit("s.example"))) is None
    assert v(U.event_family(url("/n/acme-announces-proposed-sale-of-unit-2024"))) == "acme-sale-unit"


def test_alerts_of_every_kind(spark):
    day = D(2024, 1, 30)
    sites = spark.createDataFrame([("s", D(2024, 1, 20), 60), ("s", D(2024, 1, 25), 40), ("t", D(2024, 1, 20), 40), ("u", D(2024, 1, 20), 60), ("u", D(2024, 1, 24), 50)], "site_id string, date date, clicks bigint")
    ranks = spark.createDataFrame([("s", "k", 9, 3, datetime(2024, 1, 30)), ("s", "old", 9, 3, datetime(2024, 1, 20))], "site_id string, keyword string, last_position bigint, previous_position bigint, checked_at timestamp")
    certs = spark.createDataFrame([("s", "h", 14), ("t", "h", 15)], "site_id string, host string, days_left int")
    audits = spark.createDataFrame([(1, "s", datetime(2024, 1, 1), "completed", 20), (2, "s", datetime(2024, 1, 2), "completed", 80), (3, "t", datetime(2024, 1, 2), "completed", 49), (4, "t", datetime(2024, 1, 3), "failed", 99)], "audit_id int, site_id string, started_at timestamp, status string, health int")
    lost = spark.createDataFrame([("s", "a", day, 60), ("s", "b", day, 50), ("s", "c", day, 10), ("t", "d", D(2024, 1, 1), 90)], "site_id string, ref_domain string, lost_at date, dr int")
    got = {(r.kind, r.site_id, r.subject, r.dedupe_key) for r in jobs.evaluate_alerts(day, sites, ranks, certs, audits, lost).collect()}
    assert got == {
        ("traffic_drop", "s", "s", "traffic_drop:s:2024w5"), ("rank_drop", "s", "k", "rank_drop:s:k:2024-01-30"), ("ssl_expiry", "s", "h", "ssl_expiry:s:2024w5"), ("audit_score", "t", "3", "audit_score:3"), ("lost_link", "s", "2", "lost_link:s:2024-01-30"),
    }


def test_inventories_of_every_kind(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in" / "map.xml.gz", "wt") as f:
        f.write("<urlset><url><loc>https://a.example/x?b=1&amp;c=2</loc></url></urlset>")
    (tmp_path / "in" / "deep.json").write_text('{"a": [{"b": {"url": "https:\\/\\/a.example\\/j"}}, "https://a.example/k"]}')
    (tmp_path / "in" / "list.txt").write_text("https://a.example/1\n\nhttps://a.example/2\nnothing\n")
    (tmp_path / "in" / "feed.rss").write_text("<rss><item><link>https://a.example/f</link></item></rss>")
    got = {(r.source_type, r.url) for r in ingest.parse_inventory(ingest.read_inventory(spark, str(tmp_path / "in"))).collect()}
    assert got == {("sitemap", "https://a.example/x?b=1&c=2"), ("json", "https://a.example/j"), ("json", "https://a.example/k"), ("text", "https://a.example/1"), ("text", "https://a.example/2"), ("feed", "https://a.example/f")}
