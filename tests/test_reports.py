"""Report rules, exposure, crawler views and result intent on small tables whose results follow from their definition."""

import math

import pytest
from pyspark.sql import functions as F

from sightlines.operators import checks as K
from sightlines.operators import keywords, pages, reports

CHECK = "run_id string, check string, family string, status string, severity string, affected long, tested long, value double, evidence boolean"


def check(title, family="Onsite Audit", status="FAIL", severity="high", affected=2, tested=4, value=3.0, evidence=True, run="r"):
    return run, title, family, status, severity, affected, tested, value, evidence


# -------------------------------------------------------------------- exposure


def exposure(spark, signals, traffic, domain="own.example"):
    s = spark.createDataFrame([("r", t, p, st, domain) for t, p, st in signals], "run_id string, title string, page string, status string, domain string")
    t = spark.createDataFrame([(domain, u, n) for u, n in traffic], "domain string, url string, impressions long")
    return {r.title: r for r in K.traffic_exposure(s, t).collect()}


def test_exposure_by_url_then_by_exact_path_on_the_own_host(spark):
    traffic = [("https://own.example/a", 60), ("https://own.example/a", 39), ("https://own.example/b?x=1", 9), ("https://own.example/c?x=1", 5), ("https://own.example/c?x=2", 6), ("https://else.example/d", 50), (None, 7)]
    got = exposure(spark, [
        ("exact", "https://own.example/a", "FAIL"), ("path", "https://OWN.example/b", "PARTIAL"), ("slash", "https://own.example/b/", "FAIL"), ("shared", "/c", "FAIL"), ("bare", "/b", "FAIL"),
        ("foreign", "https://else.example/d", "FAIL"), ("both", "https://own.example/a", "FAIL"), ("both", "/nowhere", "FAIL"), ("both", "/a", "PASS"), ("none", "", "FAIL"), ("none", None, "FAIL"),
    ], traffic, "Own.example")
    full, part = math.log1p(99), math.log1p(9)
    want = {"exact": (1.0, 1, 0), "path": (part / full, 1, 0), "slash": (0.0, 0, 0), "shared": (0.0, 0, 1), "bare": (part / full, 1, 0), "foreign": (0.0, 0, 0), "both": (0.5, 1, 0)}
    assert set(got) == set(want)
    for k, (e, matched, ambiguous) in want.items():
        assert (got[k].exposure, got[k].matched_pages, got[k].ambiguous_pages) == (pytest.approx(e), matched, ambiguous), k
    assert got["both"].affected_pages == 2


def test_exposure_without_traffic_is_zero(spark):
    for traffic in ([], [("https://own.example/a", 0)]):
        got = exposure(spark, [("x", "https://own.example/a", "FAIL")], traffic)
        assert tuple(got["x"])[2:] == (0.0, 0, 0, 0)


def test_merged_checks_take_one_name(spark):
    s = spark.createDataFrame([("r", t, p, st, sv, "f") for t, p, st, sv in [
        ("Single primary heading", "/a", "PASS", "low"), ("One clear H1", "/b", "FAIL", "medium"), ("One clear H1", "/b", "UNKNOWN", "low"), ("One clear H1", "/c", "MANUAL_REVIEW", "critical"), ("Policy", "/a", "FAIL", "low"), ("Policy", "/b", "FAIL", "low"),
    ]], "run_id string, title string, page string, status string, severity string, family string")
    got = {r.check: r for r in K.merge_checks(s, domain_titles=["Policy"]).collect()}
    h1 = got["One clear H1"]
    assert (h1.status, h1.severity, h1.affected, h1.tested, h1.review, h1.unavailable) == ("FAIL", "critical", 1, 3, 1, 1)
    assert (got["Policy"].affected, got["Policy"].tested) == (1, 1)


# ----------------------------------------------------------------- root causes


def test_each_check_has_one_root(spark):
    titles = [t for _, _, xs in reports.ROOT_CAUSES for t in xs]
    assert len(reports.ROOT_CAUSES) == 8 and len(titles) == len(set(titles))
    df = spark.createDataFrame([(" Skip Navigation is offered ",), ("Official profiles connected",), ("My own Check",), ("",), (None,)], "t string")
    assert [tuple(r.r) for r in df.select(reports.root_of(F.col("t")).alias("r")).collect()] == [
        ("accessible-controls", "Interactive controls need accessibility fixes"), ("check:official-profiles-connected", "Official profiles are not consistently connected"),
        ("check:my-own-check", "My own Check"), ("check:", "Issue"), ("check:", "Issue"),
    ]


def roots(spark, rows, signals):
    return reports.root_causes(spark.createDataFrame(rows, CHECK), spark.createDataFrame([("r", *s) for s in signals], "run_id string, check string, page string, status string"))


def test_root_causes_unite_checks_and_their_pages(spark):
    rows = [
        check("FAQ content is visible", "Content", severity="low", value=2.0), check("Question-led headings", "Onsite Audit", status="PARTIAL", severity="critical", value=5.0, evidence=None),
        check("Headed answer blocks", status="MANUAL_REVIEW", value=9.0), check("Odd", None, value=5.0), check("Even", "", value=5.0),
    ]
    signals = [("FAQ content is visible", p, "FAIL") for p in ("/a", "/b")] + [("Question-led headings", p, s) for p, s in (("/b", "FAIL"), ("/c", "PARTIAL"), ("/d", "PASS"))] + [("Odd", "/a", "FAIL"), ("Headed answer blocks", "/z", "FAIL")]
    got = roots(spark, rows, signals).orderBy("place").collect()
    assert [(r.root, r.pages_affected, r.place) for r in got] == [("answer-structure", 3, 1), ("check:odd", 1, 2), ("check:even", 0, 3)]
    a = got[0]
    assert (a.severity, a.value, a.checks, a.titles, a.families, a.confidence) == ("critical", 5.0, 2, ["FAQ content is visible", "Question-led headings"], ["Content", "Onsite Audit"], "medium")
    assert got[1].families == [] and got[1].confidence == "high"
    assert roots(spark, [check("x", status="PASS")], signals).count() == 0


# -------------------------------------------------------------------- findings


def high(spark, rows, search=(), k=5):
    s = spark.createDataFrame([("r", *x) for x in search], "run_id string, impressions long, clicks long, period_start string, period_end string")
    return [(r.title, r.value, r.source) for r in reports.high_signal(spark.createDataFrame(rows, CHECK), s, k).orderBy("place").collect()]


def test_low_clicks_need_impressions_and_a_bounded_period(spark):
    rows = [check("a")]
    assert high(spark, rows, [(1000, 9, "2024-01-01", "2024-02-01")])[0] == (reports.LOW_CLICKS[0], pytest.approx(20 + math.log1p(1000)), "Google Search Console")
    for search in [(1000, 10, "s", "e"), (99, 0, "s", "e"), (1000, 9, "s", None), (1000, 9, "", "e"), (0, 0, "s", "e"), (None, None, "s", "e")]:
        assert [t for t, _, _ in high(spark, rows, [search])] == ["a"], search


def test_broad_trust_issues_lead_and_titles_come_once(spark):
    trust = "Evidence & Trust"
    rows = [check("wide", trust, affected=2, tested=4, value=4.0), check("narrow", trust, affected=1, tested=4, value=6.0), check("Same one", value=2.0), check("same  ONE!", value=3.0), check("unseen", affected=0), check("fine", status="PASS", value=99.0)]
    assert high(spark, rows) == [(reports.TRUST_GAP[0], 22.0, trust), ("narrow", 6.0, trust), ("wide", 4.0, trust), ("same  ONE!", 3.0, "Onsite Audit")]
    assert len(high(spark, rows, k=0)) == 1 and len(high(spark, [check(f"c{i}", value=float(i)) for i in range(9)], k=30)) == 5
    assert high(spark, rows[1:2]) == [("narrow", 6.0, trust)] and high(spark, []) == []


def test_headlines_are_told_once_for_each_root(spark):
    rows = [check("Buttons have accessible names", "B", value=4.0), check("Skip navigation is offered", "A", value=7.0), check("Canonical URL declared", value=1.5)]
    r = roots(spark, rows, [(x[1], "/p", "FAIL") for x in rows])
    f = [("r", "FAQ content is visible", 2.0, "x"), ("r", "Question-led headings", 5.0, "x"), ("r", "Buttons have accessible names", 4.0, "B"), ("r", "Skip navigation is offered", 3.5, "A"), ("r", "Canonical URL declared", 1.5, "S"), ("r", "Other", 1.0, "O")]
    got = reports.executive_findings(spark.createDataFrame(f, "run_id string, title string, value double, source string"), r).orderBy("place").collect()
    assert [(x.title, x.value, x.source, x.root, x.evidence_type) for x in got] == [
        ("Interactive controls need accessibility fixes", 7.0, "A · B", "accessible-controls", "root_cause_group"), (reports.ANSWER_FINDING[0], 6.0, reports.ANSWER_FINDING[1], None, "derived_report_summary"),
        ("Indexability and crawl-control configuration", 1.5, "S", None, "derived_report_summary"), ("Other", 1.0, "O", None, "derived_report_summary"),
    ]
    assert [x.confidence for x in got] == ["high", "medium", "medium", "medium"]


def test_contradictions_of_a_report(spark):
    c = [
        (*check("over", affected=5, tested=4, evidence=True), None), (*check("blind", evidence=None), "worsened"), (*check("minor", severity="low", evidence=False), None), (*check("look", status="MANUAL_REVIEW", evidence=False), "resolved"),
        (*check("still", status="MANUAL_REVIEW"), "unchanged"), (*check("nulls", affected=None, tested=None, severity=None, status=None), None),
    ]
    f = [("r", "Twice"), ("r", " twice"), ("r", ""), ("r", " "), ("r", None), ("r", None), ("other", "twice")]
    src = [("r", "ga4", "Analytics", "connected", "2024-01-01"), ("r", "gsc", "Search", "missing", None), ("r", "x", "X", "connected", ""), ("r", "y", "Y", "stale", None)]
    rp = [("r", 5, 0, 0, "2024-01-01", None, True, False, "a", "c", False, False), ("old", 0, 0, 0, None, None, True, None, "a", "c", True, False), ("fine", 5, 5, 5, "s", "e", False, False, "a", "c", None, True), ("half", None, None, None, None, None, None, None, "a", None, None, None)]
    r = spark.createDataFrame(rp, "run_id string, impressions long, clicks long, keywords long, period_start string, period_end string, clarity boolean, ga4 boolean, audit_run_id string, crawl_run_id string, legacy_unlinked boolean, inputs_linked boolean")
    v = reports.validate_report(
        spark.createDataFrame(c, CHECK + ", latest_change string"), spark.createDataFrame(f, "run_id string, title string"), spark.createDataFrame([("r", "A", 3, 2), ("r", "B", 1, 1), ("r", "C", None, 0)], "run_id string, family string, confirmed long, listed long"),
        spark.createDataFrame(src, "run_id string, key string, label string, state string, observed_at string"), r,
    )
    assert {tuple(x) for x in v.collect()} == {
        ("r", "error", "duplicate_finding", "twice"), ("r", "error", "confirmed_count_differs", "A"), ("r", "error", "affected_exceeds_tested", "over"), ("r", "warning", "priority_without_evidence", "blind"), ("r", "error", "review_as_movement", "look"),
        ("r", "warning", "source_missing", "Search"), ("r", "warning", "source_without_time", "X"), ("r", "error", "unbounded_period", "r"), ("r", "error", "clarity_as_ga4", "r"), ("r", "error", "inputs_unlinked", "r"), ("old", "warning", "legacy_unlinked", "old"),
    }
    assert {(x.run_id, x.errors, x.warnings, x.blocking) for x in reports.report_verdicts(r, v).collect()} == {("r", 7, 3, True), ("old", 0, 1, False), ("fine", 0, 0, False), ("half", 0, 0, False)}


# --------------------------------------------------------- views, result intent

VIEW = "url string, view string, ok boolean, blocked boolean, final_url string, status int, canonical string, indexable boolean, words int, body_hash string, js_redirects array<string>"


def view(name, ok=True, blocked=False, final="https://h.example/", status=200, canonical="c", indexable=True, words=100, body="b", js=()):
    return "u", name, ok, blocked, final, status, canonical, indexable, words, body, list(js)


@pytest.mark.parametrize(
    "bot, human, want",
    [
        ({}, {}, ("clean", 0, [])), ({"final": "https://x.example/"}, {"body": "z"}, ("cloaking", 50, ["host"])), ({"final": "https://H.example:443/"}, {"final": "https://h.example/b"}, ("clean", 0, [])),
        ({"status": 404}, {"body": "z"}, ("suspicious", 40, ["status"])), ({"canonical": "d"}, {}, ("suspicious", 30, ["canonical"])), ({"canonical": ""}, {"canonical": None}, ("clean", 0, [])),
        ({"indexable": False}, {}, ("suspicious", 30, ["indexable"])), ({"words": 59}, {}, ("suspicious", 25, ["words"])), ({"words": 60}, {}, ("clean", 0, [])), ({"words": 0}, {}, ("clean", 0, [])), ({"body": "z"}, {}, ("clean", 15, ["content"])),
        ({"js": ["x"]}, {}, ("suspicious", 25, ["js_redirect"])), ({"ok": False, "blocked": True, "status": 403}, {}, ("suspicious", 20, ["bot_blocked"])), ({"ok": False, "status": 500}, {}, ("clean", 0, [])), ({}, {"ok": False, "status": 500}, ("clean", 0, [])),
        ({"final": "https://x.example/", "status": 404, "canonical": "d"}, {}, ("cloaking", 100, ["host", "status", "canonical"])),
    ],
)
def test_views_of_bot_and_person(spark, bot, human, want):
    r = pages.cloaking_diff(spark.createDataFrame([view("bot", **bot), view("human", **human), view("human", **human), ("alone", *view("bot")[1:])], VIEW)).collect()
    assert [tuple(x)[1:] for x in r] == [want]


def test_result_intent(spark):
    rows = [("k", 1, "buy", "editorial"), ("k", 2, None, "aggregator"), ("k", 3, "buy", "aggregator"), ("k", 4, None, "editorial"), ("k", 5, None, None), ("n", 1, "info", None), ("n", 2, None, ""), ("b", 1, "buy", None), ("o", 1, None, "own")]
    got = {r[0]: tuple(r)[1:] for r in keywords.serp_intent(spark.createDataFrame(rows, "keyword string, position int, intent string, site_type string")).collect()}
    assert got == {"k": ("informational", "guide", 40, 5), "n": ("informational", "guide", 0, 2), "b": ("transactional", "product_offer", 0, 1), "o": ("informational", "own", 100, 1)}
