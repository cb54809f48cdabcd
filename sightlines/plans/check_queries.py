"""Registered queries of the page-check operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightlines.functions.numbers import js_round
from sightlines.operators import checks as K
from sightlines.operators import reports as P

from . import facts
from .registry import query
from .search_queries import R

_S = "CASE status WHEN 'UNKNOWN' THEN 'DATA_UNAVAILABLE' ELSE status END"
_SR = f"CASE {_S} WHEN 'FAIL' THEN 0 WHEN 'PARTIAL' THEN 1 WHEN 'MANUAL_REVIEW' THEN 2 WHEN 'DATA_UNAVAILABLE' THEN 3 WHEN 'PASS' THEN 4 ELSE 5 END"
_VR = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
STATUS, SEVERITY = f"arg_min({_S}, {_SR})", f"arg_min(severity, {_VR})"
_ISSUE = "status IN ('FAIL', 'PARTIAL')"
_CREDIT = "CASE status WHEN 'PASS' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'FAIL' THEN 0.0 END"


def _score(by: str) -> str:
    return f"""SELECT {by}, {R('CAST(got AS DOUBLE) / "of" * 100', 1)} AS score, {R('CAST(n AS DOUBLE) / checks * 100', 1)} AS coverage, checks FROM (SELECT {by}, sum(weight * {_CREDIT}) AS got, sum(CASE WHEN {_CREDIT} IS NOT NULL THEN weight END) AS "of", count({_CREDIT}) AS n, count(*) AS checks FROM signal GROUP BY ALL)"""


@query("a23_score_signals", _score("run_id, family, category"), "signal")
def a23_score_signals(spark, d):
    return K.score_signals(facts.signal(spark, d), ["run_id", "family", "category"])


@query(
    "a24_domain_audit_summary",
    f"""WITH p AS ({_score('run_id, page')}), m AS (SELECT run_id, CAST(sum(CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / (10 * count(score)) AS m FROM p GROUP BY run_id),
    c AS (SELECT run_id, {", ".join(f"CAST(count_if({_S} = '{s}') AS BIGINT) AS {s.lower()}" for s in K.STATUS_ORDER)}, count(DISTINCT page) AS pages FROM signal GROUP BY run_id) SELECT c.*, {R('m', 1)} AS mean_score FROM c JOIN m USING (run_id)""",
    "signal",
)
def a24_domain_audit_summary(spark, d):
    return K.domain_audit_summary(facts.signal(spark, d))


@query("a25_rollup", f"SELECT run_id, page, {STATUS} AS status, {SEVERITY} AS severity FROM signal GROUP BY ALL", "signal")
def a25_rollup(spark, d):
    return facts.signal(spark, d).groupBy("run_id", "page").agg(K.rollup_status(F.col("status")).alias("status"), K.rollup_severity(F.col("severity")).alias("severity"))


# Names and families that the numbered checks of `signal` take in reports, so that aliases and root causes meet.
_NAMED = [
    ("One clear H1", "Content & Answer Readiness"), ("Single primary heading", "Content & Answer Readiness"), ("Sections use H2 headings", "Content & Answer Readiness"),
    ("Common follow-up questions addressed", "Content & Answer Readiness"), ("FAQ content is visible", "Content & Answer Readiness"), ("Question-led headings", "Content & Answer Readiness"),
    ("Headed answer blocks", "Content & Answer Readiness"), ("References or methodology section", "Evidence & Trust"), ("Quantified claims supported", "Evidence & Trust"),
    ("External supporting sources", "Evidence & Trust"), ("Indexing permitted", "Machine Readability & Eligibility"), ("Page is technically indexable!", "Machine Readability & Eligibility"),
    ("Canonical URL declared", "Machine Readability & Eligibility"), ("Canonical relationship is explicit", "Machine Readability & Eligibility"), ("Buttons have accessible names", "Onsite Audit"),
    ("Skip navigation is offered", "Onsite Audit"), ("Organization or person identified", "Identity & Authority"), ("Contact path reachable", "Identity & Authority"),
    ("All images declare alt behavior", "Onsite Audit"), ("Informative images have text alternatives", "Onsite Audit"), ("Official profiles connected", "Identity & Authority"),
    ("Title is concise and descriptive", "SEO Audit"), ("Markup matches the page type", "Machine Readability & Eligibility"), ("Relevant structured data is available", "Machine Readability & Eligibility"),
]
_WIDE = "Skip navigation is offered"
_LIST = lambda i: "[" + ", ".join("'" + x[i] + "'" for x in _NAMED) + "][1 + CAST(right(title, 2) AS INT)]"
_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
# The domain of a run is one of five; some observations know the path alone.
_SIGNALS = f"""sn AS (SELECT run_id, CASE WHEN page LIKE '%p1' OR page LIKE '%p6' THEN regexp_extract(page, '/p[0-9]+$') ELSE page END AS page, status, severity, {_LIST(0)} AS title, {_LIST(1)} AS family,
 'Site' || (CAST(right(run_id, 2) AS INT) % 5) || '.example' AS domain FROM signal), sc AS (SELECT * REPLACE (CASE {_NORM('title')} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHECK_ALIASES.items())} ELSE trim(title) END AS title) FROM sn)"""


def _named(spark, d):
    n = (F.substring("title", -2, 2).cast("int") + 1).alias("n")
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _NAMED]), n)
    page = F.when(F.col("page").rlike("p[16]$"), F.regexp_extract("page", "/p[0-9]+$", 0)).otherwise(F.col("page"))
    domain = F.concat(F.lit("Site"), (F.substring("run_id", -2, 2).cast("int") % 5).cast("string"), F.lit(".example"))
    return facts.signal(spark, d).select("run_id", page.alias("page"), "status", "severity", of(0).alias("title"), of(1).alias("family"), domain.alias("domain"))


def _canonical(spark, d):
    return _named(spark, d).withColumn("title", K.canonical_check_title(F.col("title")))


def _count(on: str) -> str:
    return f"CASE WHEN title = '{_WIDE}' THEN least(count(DISTINCT CASE WHEN {on} THEN page END), 1) ELSE count(DISTINCT CASE WHEN {on} THEN page END) END"


_MERGED = f"""{_SIGNALS}, mg AS (SELECT run_id, title AS "check", min(family) AS family, {STATUS} AS status, {SEVERITY} AS severity, {_count(_ISSUE)} AS affected, {_count("TRUE")} AS tested, {_count("status = 'MANUAL_REVIEW'")} AS review, {_count("status = 'UNKNOWN'")} AS unavailable
 FROM sc GROUP BY run_id, title)"""


def _merged(spark, d):
    return K.merge_checks(_named(spark, d), domain_titles=[_WIDE])


@query("a26_merge_checks", f"WITH {_MERGED} SELECT * FROM mg", "signal")
def a26_merge_checks(spark, d):
    return _merged(spark, d)


# Traffic of a domain: p3 has none, p4 and p6 are seen with a query string, p5 and p1 under two of them.
_SEEN = "CASE WHEN url LIKE '%p4' OR url LIKE '%p6' THEN url || '?a=1' WHEN url LIKE '%p5' OR url LIKE '%p1' THEN url || '?a=' || (day(date) % 2) ELSE url END"
_EXPOSED = f"""pi AS (SELECT 'S' || substr(site_id, 2) || '.example' AS domain, {_SEEN} AS url, sum(impressions) AS i FROM page_day WHERE url NOT LIKE '%p3' GROUP BY ALL), im AS (SELECT *, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pi),
 un AS (SELECT domain, path, count(*) AS n, max(i) AS pi FROM im WHERE host = lower(domain) GROUP BY ALL), tp AS (SELECT domain, max(i) AS top FROM im GROUP BY domain),
 af AS (SELECT DISTINCT run_id, title, domain, page, regexp_replace(page, '^https?://[^/?#]*', '') AS path, page LIKE '/%' OR regexp_extract(page, '^https?://([^/?#]*)', 1) = lower(domain) AS here FROM sc WHERE {_ISSUE}),
 fd AS (SELECT af.*, top, n, im.i IS NULL AND here AS unlisted, CASE WHEN top IS NULL OR NOT here THEN 0 ELSE coalesce(im.i, CASE WHEN n = 1 THEN pi END, 0) END AS found FROM af LEFT JOIN im ON im.domain = af.domain AND im.url = page LEFT JOIN un ON un.domain = af.domain AND un.path = af.path LEFT JOIN tp ON tp.domain = af.domain),
 ex AS (SELECT run_id, title, CAST(sum(CAST(CASE WHEN top IS NOT NULL THEN ln(1 + found) / ln(1 + top) ELSE 0 END AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS exposure, count(top) AS affected_pages, CAST(count_if(found > 0) AS BIGINT) AS matched_pages, CAST(count_if(top IS NOT NULL AND unlisted AND n > 1) AS BIGINT) AS ambiguous_pages FROM fd GROUP BY ALL)"""


def _exposed(spark, d):
    u, q = F.col("url"), (F.dayofmonth("date") % 2).cast("string")
    seen = F.when(u.rlike("p[46]$"), F.concat(u, F.lit("?a=1"))).when(u.rlike("p[15]$"), F.concat(u, F.lit("?a="), q)).otherwise(u)
    p = facts.page_day(spark, d).filter(~u.endswith("p3")).select(F.concat(F.lit("S"), F.substring("site_id", 2, 99), F.lit(".example")).alias("domain"), seen.alias("url"), "impressions")
    return K.traffic_exposure(_canonical(spark, d), p)


@query("a27_traffic_exposure", f"WITH {_SIGNALS}, {_EXPOSED} SELECT * REPLACE ({R('exposure', 4)} AS exposure) FROM ex", "signal page_day")
def a27_traffic_exposure(spark, d):
    return _exposed(spark, d).withColumn("exposure", js_round("exposure", 4))


_SEV = "CASE severity WHEN 'critical' THEN 4.0::DOUBLE WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 ELSE 1.0 END"
_STA = "CASE status WHEN 'FAIL' THEN 1.0::DOUBLE WHEN 'PARTIAL' THEN 0.65 ELSE 0.0 END"
# A check can be looked into if it affects an even number of pages.
_VALUED = f"""{_MERGED}, {_EXPOSED}, vl AS (SELECT mg.*, affected % 2 = 0 AS evidence, {R(f"{_SEV} * {_STA} * (1 + 2 * coalesce(exposure, 0.0)) * (1 + CASE WHEN tested > 0 THEN CAST(affected AS DOUBLE) / tested ELSE 0.0 END)", 3)} AS value FROM mg LEFT JOIN ex ON ex.run_id = mg.run_id AND ex.title = mg."check")"""


def _valued(spark, d):
    m = _merged(spark, d).join(_exposed(spark, d).select("run_id", F.col("title").alias("check"), "exposure"), ["run_id", "check"], "left").fillna(0.0, ["exposure"])
    return m.withColumns({"evidence": F.col("affected") % 2 == 0, "value": K.value_to_fix(F.col("severity"), F.col("status"), F.col("exposure"), F.col("affected"), F.col("tested"))}).drop("exposure")


@query("a28_value_to_fix", f"WITH {_VALUED} SELECT * FROM vl", "signal page_day")
def a28_value_to_fix(spark, d):
    return _valued(spark, d)


_ROOT_OF = lambda c, i: f"CASE lower(trim({c})) " + " ".join(f"WHEN '{t}' THEN '{r[i]}'" for r in P.ROOT_CAUSES for t in r[2])
_KEY = lambda c: _ROOT_OF(c, 0) + f" ELSE 'check:' || replace(lower(trim({c})), ' ', '-') END"
_NAME = lambda c: _ROOT_OF(c, 1) + " " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in P.ISSUE_NAMES.items()) + f" ELSE {c} END"
_ROOTS = f"""bd AS (SELECT *, {_KEY('"check"')} AS root, {_NAME('"check"')} AS name FROM vl WHERE {_ISSUE}), pg AS (SELECT bd.run_id, root, count(DISTINCT page) AS pages_affected FROM bd JOIN sc ON sc.run_id = bd.run_id AND sc.title = bd."check" WHERE sc.{_ISSUE} GROUP BY ALL),
 gr AS (SELECT run_id, root, min(name) AS title, {SEVERITY} AS severity, max(value) AS value, count(*) AS checks, string_agg("check", '|' ORDER BY "check") AS titles, list_sort(list(DISTINCT family)) AS families, CASE WHEN bool_and(evidence) THEN 'high' ELSE 'medium' END AS confidence FROM bd GROUP BY run_id, root),
 rt AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY value DESC, pages_affected DESC, title) AS INTEGER) AS place FROM gr JOIN pg USING (run_id, root))"""


def _roots(spark, d, v):
    return P.root_causes(v, _canonical(spark, d).withColumnRenamed("title", "check"))


@query("a29_root_causes", f"WITH {_VALUED}, {_ROOTS} SELECT * REPLACE (array_to_string(families, '|') AS families) FROM rt", "signal page_day")
def a29_root_causes(spark, d):
    r = _roots(spark, d, _valued(spark, d))
    return r.withColumns({c: F.array_join(c, "|") for c in ("titles", "families")})


# Search totals of each run: runs that end with 3 have no end of their period, three of four few clicks.
_SEARCH = """se AS (SELECT *, CASE WHEN run_id NOT LIKE '%3' THEN '2024-12-31' END AS period_end FROM (SELECT run_id, CAST(sum(impressions) AS BIGINT) AS impressions, CASE WHEN CAST(right(run_id, 2) AS INT) % 4 = 1 THEN CAST(sum(clicks) // 1 AS BIGINT) ELSE CAST(sum(clicks) // 1000 AS BIGINT) END AS clicks
 FROM (SELECT *, 'run' || lpad(CAST(CAST(date - DATE '2024-01-01' AS BIGINT) // 5 AS VARCHAR), 2, '0') AS run_id FROM site_day) GROUP BY run_id))"""


def _search(spark, d):
    two = F.lpad(F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 5).cast("string"), 2, "0")
    s = facts.site_day(spark, d).groupBy(F.concat(F.lit("run"), two).alias("run_id")).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("c"))
    clicks = F.when(F.substring("run_id", -2, 2).cast("int") % 4 == 1, F.col("c")).otherwise(F.floor(F.col("c") / 1000))
    return s.select("run_id", "impressions", clicks.alias("clicks"), F.lit("2024-01-01").alias("period_start"), F.when(~F.col("run_id").endswith("3"), "2024-12-31").alias("period_end"))


_HIGH = f"""{_SEARCH}, al AS (SELECT run_id, '{P.LOW_CLICKS[0]}' AS title, 20 + ln(1 + impressions) AS value, '{P.LOW_CLICKS[1]}' AS source FROM se WHERE impressions >= 100 AND CAST(clicks AS DOUBLE) / impressions < 0.01 AND period_end IS NOT NULL
 UNION ALL SELECT run_id, '{P.TRUST_GAP[0]}', 18 + max(value), '{P.TRUST_GAP[1]}' FROM vl WHERE {_ISSUE} AND family = '{P.TRUST_GAP[1]}' AND CAST(affected AS DOUBLE) / tested >= 0.5 GROUP BY run_id UNION ALL SELECT run_id, "check", value, family FROM vl WHERE {_ISSUE} AND affected > 0),
 on_ AS (SELECT *, {_NORM('title')} AS norm FROM al QUALIFY row_number() OVER (PARTITION BY run_id, norm ORDER BY value DESC, title) = 1),
 hi AS (SELECT run_id, title, value, source, CAST(row_number() OVER (PARTITION BY run_id ORDER BY value DESC, title) AS INTEGER) AS place FROM on_ QUALIFY place <= 5)"""


@query("a49_high_signal", f"WITH {_VALUED}, {_HIGH} SELECT * REPLACE ({R('value', 3)} AS value) FROM hi", "signal page_day site_day")
def a49_high_signal(spark, d):
    return P.high_signal(_valued(spark, d), _search(spark, d)).withColumn("value", js_round("value", 3))


_ANSWERS = "lower(trim(title)) IN (" + ", ".join(f"'{t}'" for t in P.ANSWER_TITLES) + ")"
_EXEC = f"""fi AS (SELECT run_id, "check" AS title, value, family AS source FROM vl WHERE {_ISSUE}),
 f1 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, title) AS p FROM (SELECT * FROM fi WHERE NOT ({_ANSWERS}) UNION ALL SELECT run_id, '{P.ANSWER_FINDING[0]}', max(value) + 1, '{P.ANSWER_FINDING[1]}' FROM fi WHERE {_ANSWERS} GROUP BY run_id) QUALIFY p <= 5),
 f2 AS (SELECT *, {_KEY('title')} AS root FROM f1 QUALIFY row_number() OVER (PARTITION BY run_id, root ORDER BY p) = 1),
 f3 AS (SELECT f2.run_id, coalesce(rt.title, f2.title) AS title, CASE WHEN checks > 1 THEN greatest(f2.value, rt.value) ELSE f2.value END AS value, CASE WHEN checks > 1 THEN array_to_string(families, ' · ') ELSE source END AS source, CASE WHEN checks > 1 THEN f2.root END AS root,
  CASE WHEN checks > 1 THEN confidence ELSE 'medium' END AS confidence, CASE WHEN checks > 1 THEN pages_affected END AS pages_affected, CASE WHEN checks > 1 THEN 'root_cause_group' ELSE 'derived_report_summary' END AS evidence_type FROM f2 LEFT JOIN rt ON rt.run_id = f2.run_id AND rt.root = f2.root)"""


@query("a57_executive_findings", f"WITH {_VALUED}, {_ROOTS}, {_EXEC} SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY value DESC, title) AS INTEGER) AS place FROM f3", "signal page_day")
def a57_executive_findings(spark, d):
    """All issues of a run as findings, so that the answer cluster and root causes with several checks meet."""
    v = _valued(spark, d)
    findings = v.filter(K.is_issue(F.col("status"))).select("run_id", F.col("check").alias("title"), "value", F.col("family").alias("source"))
    return P.executive_findings(findings, _roots(spark, d, v))


# Reports with every kind of contradiction, by number of pages, site, user and run.
_REPORTED = f"""{_MERGED}, ck AS (SELECT *, affected % 2 = 0 AS evidence, ['improved', 'new_issue', 'unchanged'][1 + affected % 3] AS latest_change, CASE WHEN affected % 5 = 3 THEN affected - 1 ELSE tested END AS tried FROM mg),
 fn AS (SELECT run_id, lower(trim(title)) AS subject, count(*) AS n FROM (SELECT run_id, "check" AS title FROM mg UNION ALL SELECT run_id, ' ' || upper("check") FROM mg WHERE affected % 4 = 0) GROUP BY ALL),
 fm AS (SELECT run_id, family, count_if({_ISSUE}) AS confirmed, count_if({_ISSUE} AND affected % 7 <> 1) AS listed FROM mg GROUP BY ALL),
 so AS (SELECT run_id, CASE WHEN family LIKE 'C%' THEN 'ga4' ELSE family END AS key, family AS label, CASE WHEN sum(affected) % 3 = 0 THEN 'missing' ELSE 'connected' END AS state, CASE WHEN sum(affected) % 2 = 0 THEN '2024-05-01' END AS observed_at FROM mg GROUP BY run_id, family),
 rp AS (SELECT run_id, CAST(sum(affected) AS BIGINT) AS n FROM mg GROUP BY run_id)"""


@query(
    "a48_validate_report",
    f"""WITH {_REPORTED} SELECT run_id, 'error' AS level, 'duplicate_finding' AS rule, subject FROM fn WHERE n > 1 UNION ALL SELECT run_id, 'error', 'confirmed_count_differs', family FROM fm WHERE confirmed <> listed
    UNION ALL SELECT run_id, 'error', 'affected_exceeds_tested', "check" FROM ck WHERE affected > tried UNION ALL SELECT run_id, 'warning', 'priority_without_evidence', "check" FROM ck WHERE {_ISSUE} AND severity IN ('critical', 'high') AND NOT evidence
    UNION ALL SELECT run_id, 'error', 'review_as_movement', "check" FROM ck WHERE status = 'MANUAL_REVIEW' AND latest_change <> 'unchanged' UNION ALL SELECT run_id, 'warning', 'source_missing', label FROM so WHERE state = 'missing' UNION ALL SELECT run_id, 'warning', 'source_without_time', label FROM so WHERE state = 'connected' AND observed_at IS NULL
    UNION ALL SELECT run_id, 'error', 'unbounded_period', run_id FROM rp WHERE n > 0 AND n % 2 = 1 UNION ALL SELECT run_id, 'error', 'clarity_as_ga4', run_id FROM rp JOIN so USING (run_id) WHERE key = 'ga4' AND state = 'connected' AND n % 3 <> 0
    UNION ALL SELECT run_id, 'warning', 'legacy_unlinked', run_id FROM rp WHERE n % 5 <> 0 AND n % 4 = 0 UNION ALL SELECT run_id, 'error', 'inputs_unlinked', run_id FROM rp WHERE n % 5 <> 0 AND n % 4 IN (1, 2)""",
    "signal",
)
def a48_validate_report(spark, d):
    return _violations(spark, d)[1]


@query("a48_report_verdicts", f"""WITH {_REPORTED}, e AS (SELECT run_id, count(*) AS errors FROM (SELECT run_id FROM fn WHERE n > 1 UNION ALL SELECT run_id FROM fm WHERE confirmed <> listed UNION ALL SELECT run_id FROM ck WHERE affected > tried UNION ALL SELECT run_id FROM ck WHERE status = 'MANUAL_REVIEW' AND latest_change <> 'unchanged'
    UNION ALL SELECT run_id FROM rp WHERE n % 2 = 1 UNION ALL SELECT run_id FROM rp JOIN so USING (run_id) WHERE key = 'ga4' AND state = 'connected' AND n % 3 <> 0 UNION ALL SELECT run_id FROM rp WHERE n % 5 <> 0 AND n % 4 IN (1, 2)) GROUP BY run_id),
    w AS (SELECT run_id, count(*) AS warnings FROM (SELECT run_id FROM ck WHERE {_ISSUE} AND severity IN ('critical', 'high') AND NOT evidence UNION ALL SELECT run_id FROM so WHERE state = 'missing' OR observed_at IS NULL UNION ALL SELECT run_id FROM rp WHERE n % 5 <> 0 AND n % 4 = 0) GROUP BY run_id)
    SELECT run_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) > 0 AS blocking FROM rp LEFT JOIN e USING (run_id) LEFT JOIN w USING (run_id)""", "signal")
def a48_report_verdicts(spark, d):
    return P.report_verdicts(*_violations(spark, d))


def _violations(spark, d):
    m, n = _merged(spark, d), F.col("affected")
    checks = m.withColumns({
        "evidence": n % 2 == 0, "latest_change": F.element_at(F.array(*map(F.lit, ["improved", "new_issue", "unchanged"])), (n % 3 + 1).cast("int")), "tested": F.when(n % 5 == 3, n - 1).otherwise(F.col("tested")),
    })
    findings = m.select("run_id", F.col("check").alias("title")).unionByName(m.filter(n % 4 == 0).select("run_id", F.concat(F.lit(" "), F.upper("check")).alias("title")))
    bad = K.is_issue(F.col("status"))
    families = m.groupBy("run_id", "family").agg(F.count_if(bad).alias("confirmed"), F.count_if(bad & (n % 7 != 1)).alias("listed"))
    sources = m.groupBy("run_id", "family").agg(F.sum(n).alias("n")).select(
        "run_id", F.when(F.col("family").startswith("C"), "ga4").otherwise(F.col("family")).alias("key"), F.col("family").alias("label"), F.when(F.col("n") % 3 == 0, "missing").otherwise("connected").alias("state"), F.when(F.col("n") % 2 == 0, "2024-05-01").alias("observed_at")
    )
    t = F.col("impressions")
    reports = m.groupBy("run_id").agg(F.sum(n).alias("impressions")).select(
        "run_id", "impressions", F.lit(0).alias("clicks"), F.lit(0).alias("keywords"), F.lit("2024-01-01").alias("period_start"), F.when(t % 2 == 0, "2024-06-30").alias("period_end"), F.lit(True).alias("clarity"), (t % 3 == 0).alias("ga4"),
        F.when(t % 5 != 0, "a1").alias("audit_run_id"), F.lit("c1").alias("crawl_run_id"), (t % 4 == 0).alias("legacy_unlinked"), (t % 4 == 3).alias("inputs_linked"),
    )
    return reports, P.validate_report(checks, findings, families, sources, reports)


@query(
    "a30_family_view",
    f"""WITH c AS (SELECT run_id, family, category, title, {STATUS} AS status, {SEVERITY} AS severity, count(DISTINCT CASE WHEN {_ISSUE} THEN page END) AS affected FROM signal GROUP BY run_id, family, category, title)
    SELECT run_id, family, category, count(*) AS checks, CAST(count_if({_ISSUE}) AS BIGINT) AS failing, {STATUS} AS status, coalesce(arg_min(severity, {_VR}) FILTER ({_ISSUE}), 'info') AS severity, max(affected) AS most_affected FROM c GROUP BY run_id, family, category""",
    "signal",
)
def a30_family_view(spark, d):
    return K.family_view(facts.signal(spark, d))


@query(
    "w7_family_trend",
    f"WITH s AS ({_score('run_id, family')}), t AS (SELECT run_id, family, {STATUS} AS status, count(DISTINCT CASE WHEN {_ISSUE} THEN page END) AS affected FROM signal GROUP BY run_id, family) SELECT * FROM s JOIN t USING (run_id, family)",
    "signal",
)
def w7_family_trend(spark, d):
    return K.family_trend(facts.signal(spark, d))


_HIST = f"""sg AS (SELECT run_id, title, page, {STATUS} AS status, min(family) AS family FROM signal WHERE page NOT LIKE '%p1' OR run_id > 'run02' GROUP BY run_id, title, page),
 rn AS (SELECT title, run_id, row_number() OVER (PARTITION BY title ORDER BY run_id) AS r FROM (SELECT DISTINCT title, run_id FROM sg)), nw AS (SELECT sg.*, r FROM sg JOIN rn USING (title, run_id)),
 jn AS (SELECT a.*, b.status AS before FROM nw a LEFT JOIN nw b ON a.title = b.title AND a.page = b.page AND b.r = a.r - 1),
 hs AS (SELECT title, page, run_id, family, CAST(r AS INTEGER) AS r, status, CASE WHEN before IS NULL AND {_ISSUE} THEN 'new_issue' WHEN before IS NULL THEN 'new_page' WHEN status = before THEN 'unchanged' WHEN 'MANUAL_REVIEW' IN (status, before) THEN 'requires_review' WHEN 'DATA_UNAVAILABLE' IN (status, before) THEN 'evidence_unavailable'
  WHEN 'NOT_APPLICABLE' IN (status, before) THEN 'no_longer_applicable' WHEN before IN ('FAIL', 'PARTIAL') AND status = 'PASS' THEN 'resolved' WHEN before = 'FAIL' THEN 'improved' ELSE 'worsened' END AS change FROM jn)"""


def _history(spark, d):
    """Pages p1 are assessed from the fourth run on."""
    return K.finding_history(facts.signal(spark, d).filter(~F.col("page").endswith("p1") | (F.col("run_id") > "run02")))


@query("w1_finding_history", f"WITH {_HIST} SELECT * FROM hs", "signal")
def w1_finding_history(spark, d):
    return _history(spark, d)


_FIRST_OF = lambda *names: " ".join(f"WHEN bool_or(change = '{c}') THEN '{c}'" for c in names)
_MIXED = "CASE WHEN bool_or(change IN ('worsened', 'new_issue')) AND bool_or(change IN ('resolved', 'improved')) THEN 'mixed'"
_ROLLED = f"rl AS (SELECT run_id, title, {_MIXED} {_FIRST_OF('worsened', 'new_issue', 'resolved', 'improved', 'requires_review', 'evidence_unavailable', 'no_longer_applicable', 'new_page')} ELSE 'unchanged' END AS change, count(DISTINCT page) AS pages, count(DISTINCT CASE WHEN {_ISSUE} THEN page END) AS pages_affected FROM hs GROUP BY ALL)"


@query(
    "w2_last_material_change",
    f"""WITH {_HIST}, {_ROLLED}, mv AS (SELECT *, last_value(CASE WHEN change IN ('worsened', 'new_issue', 'resolved', 'improved', 'mixed') THEN run_id END IGNORE NULLS) OVER (PARTITION BY title ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS last_run FROM rl)
    SELECT mv.*, rl.change AS last_change FROM mv LEFT JOIN rl ON rl.title = mv.title AND rl.run_id = mv.last_run""",
    "signal",
)
def w2_last_material_change(spark, d):
    return K.last_material_change(K.rollup_changes(_history(spark, d), ["run_id", "title"]))


@query("w3_rollup_changes", f"WITH {_HIST}, {_ROLLED} SELECT * FROM rl", "signal")
def w3_rollup_changes(spark, d):
    return K.rollup_changes(_history(spark, d), ["run_id", "title"])


@query(
    "w3_page_lifecycle",
    f"""WITH {_HIST}, sn AS (SELECT DISTINCT title, r, page FROM hs), tp AS (SELECT title, max(r) AS top FROM hs GROUP BY title)
    SELECT a.title, a.r, a.page, 'newly_observed' AS event FROM sn a WHERE a.r > 1 AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.title = a.title AND b.page = a.page AND b.r = a.r - 1)
    UNION ALL SELECT a.title, a.r + 1, a.page, 'no_longer_assessed' FROM sn a JOIN tp USING (title) WHERE a.r < top AND NOT EXISTS (SELECT 1 FROM sn b WHERE b.title = a.title AND b.page = a.page AND b.r = a.r + 1)""",
    "signal",
)
def w3_page_lifecycle(spark, d):
    return K.page_lifecycle(_history(spark, d))


_SUMMARY = f"""tp AS (SELECT title, max(r) AS top, max_by(family, r) AS family FROM hs GROUP BY title), rt AS (SELECT title, page, arg_max(change, r) FILTER (change IN ('worsened', 'new_issue', 'resolved', 'improved')) AS change, max(r) AS r FROM hs GROUP BY title, page),
 cu AS (SELECT rt.*, family FROM rt JOIN tp USING (title) WHERE r = top AND change IS NOT NULL)"""
_COUNTED = ", ".join(f"CAST(count_if(change = '{c}') AS BIGINT) AS {n}" for n, c in (("improved", "improved"), ("worsened", "worsened"), ("resolved", "resolved"), ("new", "new_issue"), ("mixed", "mixed")))


@query("w4_change_summary", f"WITH {_HIST}, {_SUMMARY}, pg AS (SELECT family, page, {_MIXED} {_FIRST_OF('worsened', 'new_issue', 'resolved', 'improved')} END AS change FROM cu GROUP BY family, page) SELECT family, {_COUNTED} FROM pg GROUP BY family", "signal")
def w4_change_summary(spark, d):
    return K.change_summary(_history(spark, d), ("family",))


@query("w4_pulse_summary", f"WITH {_HIST}, {_SUMMARY}, pg AS (SELECT page, {_MIXED} {_FIRST_OF('worsened', 'new_issue', 'resolved', 'improved')} END AS change FROM cu GROUP BY page) SELECT {_COUNTED} FROM pg", "signal")
def w4_pulse_summary(spark, d):
    return K.change_summary(_history(spark, d))


_CMP = f"""a AS (SELECT title, page, {STATUS} AS now FROM signal WHERE run_id = 'run04' GROUP BY title, page), b AS (SELECT title, page, {STATUS} AS was FROM signal WHERE run_id = 'run02' GROUP BY title, page),
 cmp AS (SELECT title, page, now, was, CASE WHEN now IS NULL THEN 'no_longer_assessed' WHEN was IS NULL AND now IN ('FAIL', 'PARTIAL') THEN 'new_issue' WHEN was IS NULL THEN 'new_page' WHEN 'MANUAL_REVIEW' IN (now, was) THEN 'requires_review' WHEN now = 'NOT_APPLICABLE' AND was <> 'NOT_APPLICABLE' THEN 'no_longer_applicable'
  WHEN 'DATA_UNAVAILABLE' IN (now, was) THEN 'evidence_unavailable' WHEN now = was THEN 'unchanged' WHEN was IN ('FAIL', 'PARTIAL') AND now = 'PASS' THEN 'resolved' WHEN was = 'FAIL' AND now = 'PARTIAL' THEN 'improved' WHEN was = 'PARTIAL' AND now = 'FAIL' THEN 'worsened' WHEN was = 'PASS' AND now IN ('FAIL', 'PARTIAL') THEN 'worsened' ELSE 'requires_review' END AS change
  FROM a FULL JOIN b USING (title, page))"""


def _compared(spark, d):
    s = facts.signal(spark, d)
    return K.compare_snapshots(s.filter("run_id = 'run04'"), s.filter("run_id = 'run02'"))


@query("w6_compare_snapshots", f"WITH {_CMP} SELECT * FROM cmp", "signal")
def w6_compare_snapshots(spark, d):
    return _compared(spark, d)


@query(
    "w6_snapshot_summary",
    f"""WITH {_CMP}, p AS (SELECT page, bool_or(change IN ('improved', 'resolved')) AND NOT bool_or(change = 'worsened') AS better, bool_or(change = 'worsened') AS worse FROM cmp GROUP BY page)
    SELECT {", ".join(f"CAST(count_if(change = '{c}') AS BIGINT) AS {n}" for n, c in K.COMPARED.items())}, (SELECT CAST(count_if(better) AS BIGINT) FROM p) AS pages_improved, (SELECT CAST(count_if(worse) AS BIGINT) FROM p) AS pages_regressed FROM cmp""",
    "signal",
)
def w6_snapshot_summary(spark, d):
    return K.snapshot_summary(_compared(spark, d))


_TITLES = "tt AS (SELECT DISTINCT CASE k % 6 WHEN 0 THEN 'Indexing permitted' WHEN 1 THEN 'Page is technically indexable!' WHEN 2 THEN 'Images of ' || url WHEN 3 THEN 'Images on ' || url WHEN 4 THEN 'Single primary heading' ELSE 'ONE clear h1' END AS title FROM event)"


def _titles(spark, d):
    k = F.col("k") % 6
    e = facts.event(spark, d)
    name = F.when(k == 0, "Indexing permitted").when(k == 1, "Page is technically indexable!").when(k == 2, F.concat(F.lit("Images of "), "url")).when(k == 3, F.concat(F.lit("Images on "), "url")).when(k == 4, "Single primary heading").otherwise("ONE clear h1")
    return e.select(name.alias("title")).distinct()


@query(
    "f25_canonical_titles",
    f"WITH {_TITLES} SELECT title, CASE trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHECK_ALIASES.items())} ELSE trim(title) END AS name FROM tt",
    "event",
)
def f25_canonical_titles(spark, d):
    return _titles(spark, d).select("title", K.canonical_check_title(F.col("title")).alias("name"))


@query(
    "f25_overlap_candidates",
    f"""WITH {_TITLES}, n AS (SELECT title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS n FROM tt), c AS (SELECT title, n, list_distinct(string_split(n, ' ')) AS w, CASE n {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHECK_ALIASES.items())} ELSE trim(title) END AS name FROM n),
    s AS (SELECT x.title AS a, y.title AS b, x.name = y.name AS explicit_alias, greatest(CAST(len(list_intersect(x.w, y.w)) AS DOUBLE) / len(list_distinct(list_concat(x.w, y.w))), 1 - CAST(levenshtein(x.n, y.n) AS DOUBLE) / greatest(length(x.n), length(y.n)), CASE WHEN x.name = y.name THEN 1.0 ELSE 0.0 END) AS s FROM c x JOIN c y ON x.title < y.title)
    SELECT a, b, explicit_alias, {R('s', 3)} AS similarity FROM s WHERE s >= 0.72""",
    "event",
)
def f25_overlap_candidates(spark, d):
    return K.overlap_candidates(_titles(spark, d))


@query(
    "u3_page_delta",
    f"""WITH {_HIST}, s AS (SELECT title, r, run_id, list(DISTINCT page) AS p FROM hs GROUP BY ALL) SELECT a.title, a.run_id, CAST(len(list_filter(a.p, lambda x: NOT list_contains(b.p, x))) AS BIGINT) AS new_pages, CAST(len(list_filter(b.p, lambda x: NOT list_contains(a.p, x))) AS BIGINT) AS gone_pages FROM s a JOIN s b ON a.title = b.title AND b.r = a.r - 1""",
    "signal",
)
def u3_page_delta(spark, d):
    return K.page_delta(_history(spark, d))


@query("w5_latest_snapshots", "SELECT report_id, audit_id, created_at FROM (SELECT event_id AS report_id, user_id AS audit_id, date_trunc('hour', ts) AS created_at FROM event) QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY created_at DESC, report_id DESC) = 1", "event")
def w5_latest_snapshots(spark, d):
    e = facts.event(spark, d)
    return K.latest_snapshots(e.select(F.col("event_id").alias("report_id"), F.col("user_id").alias("audit_id"), F.date_trunc("hour", "ts").alias("created_at")))


@query(
    "p12_apply_applicability",
    """WITH g AS (SELECT * FROM (VALUES ('Check 01', 'faq', 'page'), ('Check 02', 'schema', 'domain')) v(title, grp, sc)), s AS (SELECT *, CASE WHEN page LIKE '%p1%' THEN 'article' ELSE 'other' END AS page_type FROM signal)
    SELECT run_id, title, page_type, page, CASE WHEN grp = 'faq' OR (title = 'Check 03' AND page_type = 'article') THEN 'NOT_APPLICABLE' ELSE status END AS status, coalesce(sc, 'page') AS scope FROM s LEFT JOIN g USING (title)""",
    "signal",
)
def p12_apply_applicability(spark, d):
    s = facts.signal(spark, d).withColumn("page_type", F.when(F.col("page").contains("p1"), "article").otherwise("other"))
    groups = spark.createDataFrame([("Check 01", "faq", "page"), ("Check 02", "schema", "domain")], "title string, check_group string, scope string")
    return K.apply_applicability(s, groups, spark.createDataFrame([("Check 03", "article")], "title string, page_type string"), ["schema"]).select("run_id", "title", "page_type", "page", "status", "scope")


@query("p14_apply_exclusions", "SELECT run_id, page, title, category, status FROM signal WHERE page <> 'https://site0.example/p0' AND title <> 'Check 05' AND category <> 'Category 2'", "signal")
def p14_apply_exclusions(spark, d):
    ex = spark.createDataFrame([("page", "https://site0.example/p0"), ("check", "Check 05"), ("category", "Category 2")], "scope string, value string")
    return K.apply_exclusions(facts.signal(spark, d), ex).select("run_id", "page", "title", "category", "status")


@query(
    "a47_recommendation_updates",
    f"""WITH s AS (SELECT title || '|' || page AS root, bool_and(status = 'PASS') AS clean, bool_or({_ISSUE}) AS broken FROM signal GROUP BY 1),
    r AS (SELECT DISTINCT title || '|' || page AS root, CASE WHEN title < 'Check 12' THEN 'verified' WHEN title < 'Check 20' THEN 'implemented' ELSE 'open' END AS st FROM signal UNION ALL SELECT 'no check', 'implemented') SELECT root, st AS old_state, CASE WHEN st = 'implemented' AND clean THEN 'verified' WHEN st = 'verified' AND broken THEN 'reopened' ELSE st END AS state FROM r LEFT JOIN s USING (root)""",
    "signal",
)
def a47_recommendation_updates(spark, d):
    """A recommendation for every check of every page, over all runs, and one that no check belongs to."""
    s = facts.signal(spark, d).select(F.concat_ws("|", "title", "page").alias("title"), F.col("title").alias("check"), "status")
    state = F.when(F.col("check") < "Check 12", "verified").when(F.col("check") < "Check 20", "implemented").otherwise("open")
    rec = s.select(F.col("title").alias("root"), state.alias("state")).distinct().unionByName(spark.createDataFrame([("no check", "implemented")], "root string, state string"))
    return K.recommendation_updates(rec, s, s.select("title", F.col("title").alias("root")).distinct())


_SOURCE_STATUS = ["Sync FAILED", "http error", "stale since May", "ok", "not selected", "", None]


@query(
    "a44_data_coverage",
    f"""WITH s AS (SELECT site_id || '-' || user_id AS source, bool_or(event_type = 'click') AS present, [{", ".join("NULL" if x is None else f"'{x}'" for x in _SOURCE_STATUS)}][1 + user_id % 7] AS status, CASE user_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS selected FROM event GROUP BY site_id, user_id)
    SELECT *, CASE WHEN status IN ('Sync FAILED', 'http error') THEN 'failed' WHEN status = 'stale since May' THEN 'stale' WHEN present THEN 'connected' WHEN selected THEN 'missing' WHEN status = 'not selected' OR (status IS NULL AND selected IS NULL) THEN 'not_selected' ELSE 'missing' END AS state FROM s""",
    "event",
)
def a44_data_coverage(spark, d):
    u = F.col("user_id")
    s = facts.event(spark, d).groupBy("site_id", "user_id").agg(F.bool_or(F.col("event_type") == "click").alias("present"))
    status = F.element_at(F.array(*map(F.lit, _SOURCE_STATUS)), (u % 7 + 1).cast("int"))
    return K.data_coverage(s.select(F.concat_ws("-", "site_id", u.cast("string")).alias("source"), "present", status.alias("status"), F.when(u % 3 == 0, True).when(u % 3 == 1, False).alias("selected")))


_INV = "i AS (SELECT page_id AS i, url || '#' || page_id AS url, 'c' || (page_id % 3) AS url_class, ['eligible', 'duplicate', 'excluded', 'deferred', NULL][1 + page_id % 5] AS eligibility, CASE WHEN page_id % 7 = 1 THEN 'timeout' WHEN page_id % 7 = 2 THEN '' END AS last_error, CASE WHEN page_id % 4 = 1 THEN DATE '2024-01-01' END AS last_crawled_at, CASE WHEN page_id % 6 < 5 THEN ['queued', 'completed', 'failed', 'unchanged', 'excluded'][1 + page_id % 6] END AS state, CASE WHEN page_id % 9 = 1 THEN TRUE WHEN page_id % 9 = 2 THEN FALSE END AS unchanged FROM pages)"


@query(
    "a43_monitoring_inventory",
    f"""WITH {_INV}, o AS (SELECT *, coalesce(state, CASE WHEN eligibility IN ('duplicate', 'excluded') THEN eligibility WHEN coalesce(last_error, '') <> '' THEN 'failed' WHEN last_crawled_at IS NOT NULL THEN 'crawled' ELSE 'deferred' END) AS f FROM i)
    SELECT url_class, CASE WHEN eligibility = 'duplicate' OR f = 'duplicate' THEN 'duplicate' WHEN eligibility = 'excluded' OR f = 'excluded' THEN 'excluded' WHEN f = 'failed' THEN 'failed' WHEN f = 'unchanged' OR unchanged THEN 'unchanged' WHEN f IN ('completed', 'crawled') THEN 'crawled' ELSE 'deferred' END AS outcome, count(*) AS urls FROM o GROUP BY ALL""",
)
def a43_monitoring_inventory(spark, d):
    p, i = spark.read.parquet(f"{d}/pages.parquet"), F.col("page_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    inv = p.select(
        F.concat_ws("#", "url", i.cast("string")).alias("url"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("url_class"), pick(["eligible", "duplicate", "excluded", "deferred", None]).alias("eligibility"),
        F.when(i % 7 == 1, "timeout").when(i % 7 == 2, "").alias("last_error"), F.when(i % 4 == 1, F.lit("2024-01-01").cast("date")).alias("last_crawled_at"), "page_id",
    )
    frontier = inv.select("url", pick(["queued", "completed", "failed", "unchanged", "excluded", None]).alias("state")).filter("state is not null")
    return K.monitoring_inventory(inv, frontier, inv.filter("page_id % 9 in (1, 2)").select("url", (i % 9 == 1).alias("unchanged")))
