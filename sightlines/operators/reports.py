"""Findings of a report: root causes, headline findings, and what in a report contradicts itself.

A check is (run_id, check, family, status, severity, affected, tested, value, evidence); evidence says that an
observation of it can be looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.operators.checks import _map, is_issue, normal_status, normal_title, rollup_severity

# Fixed root causes: key, name and the checks (lower case) that show it.
ROOT_CAUSES = [
    ("schema-page-type", "Sitewide schema and page-type configuration", [
        "markup matches the page type", "page-type schema is appropriate", "web page or site type declared", "primary subject relationship declared",
        "responsible entity structured", "relevant structured data is available", "structured data matches visible content",
    ]),
    ("heading-structure", "Heading structure and page-template hierarchy", [
        "one clear h1", "heading hierarchy is sequential", "sections use h2 headings", "interior hierarchy is visible", "heading order is programmatic",
    ]),
    ("answer-structure", "Content is not consistently structured for answer retrieval", [
        "common follow-up questions addressed", "faq content is visible", "question-led headings", "multiple relevant question forms",
        "sections support fragment linking", "headed answer blocks", "answers follow question headings",
    ]),
    ("evidence-support", "Claims and evidence are not consistently substantiated", [
        "references or methodology section", "quantified claims supported", "source attribution language", "claims retain attribution context",
        "examples or first-hand evidence", "external supporting sources",
    ]),
    ("image-alternatives", "Image accessibility metadata is incomplete", ["image text alternatives"]),
    ("indexability", "Indexability and crawl-control configuration", [
        "page is technically indexable", "robots.txt permits the page", "search snippets are permitted", "canonical url declared", "successful html response",
    ]),
    ("accessible-controls", "Interactive controls need accessibility fixes", [
        "buttons have accessible names", "form controls have accessible names", "link purpose is understandable", "skip navigation is offered",
    ]),
    ("identity-contact", "Organization identity and accountability signals are incomplete", [
        "organization or person identified", "contact and accountability information", "contact path reachable", "named experts or leadership",
    ]),
]
# Fixed names of issues whose check is named after the good state.
ISSUE_NAMES = {
    "official profiles connected": "Official profiles are not consistently connected",
    "lists expose grouped facts or steps": "Lists do not consistently expose grouped facts or steps",
    "title is concise and descriptive": "Some page titles need refinement",
}
# Fixed checks that are told as one headline finding.
ANSWER_TITLES = ["common follow-up questions addressed", "faq content is visible", "question-led headings", "multiple relevant question forms", "sections support fragment linking"]
ANSWER_FINDING = ("Content is not consistently structured for answer retrieval", "Content & Answer Readiness")
# Fixed names of the two findings by rule, with their sources.
LOW_CLICKS = ("Search visibility is not turning into search clicks", "Google Search Console")
TRUST_GAP = ("The main gap is evidence and trust, not visibility", "Evidence & Trust")
MOVED = ["improved", "worsened", "resolved", "new_issue"]


def root_of(title: Column) -> Column:
    """(key, name) of the root cause that a check's title shows; a check of no rule is its own."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    key = F.element_at(_map({x: k for k, _, xs in ROOT_CAUSES for x in xs}), t)
    name = F.element_at(_map({x: n for _, n, xs in ROOT_CAUSES for x in xs} | ISSUE_NAMES), t)
    return F.struct(F.coalesce(key, F.concat(F.lit("check:"), F.replace(t, F.lit(" "), F.lit("-")))).alias("key"), F.coalesce(name, F.nullif(title, F.lit("")), F.lit("Issue")).alias("name"))


def _place(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


def root_causes(checks: DataFrame, signals: DataFrame) -> DataFrame:
    """Issues of each run by root cause, with the pages on which any of its checks fails (signals: run_id, check, page, status).

    value and severity are the worst of the checks; confidence is high where all of them have evidence.
    """
    bad = checks.filter(is_issue(F.col("status"))).withColumn("r", root_of(F.col("check"))).withColumn("root", F.col("r.key"))
    pages = signals.filter(is_issue(F.col("status"))).join(bad.select("run_id", "check", "root"), ["run_id", "check"]).groupBy("run_id", "root").agg(F.countDistinct(F.coalesce("page", F.lit("/"))).alias("pages_affected"))
    groups = bad.groupBy("run_id", "root").agg(
        F.min("r.name").alias("title"), rollup_severity(F.col("severity")).alias("severity"), F.max("value").alias("value"), F.count("*").alias("checks"),
        F.array_sort(F.collect_list("check")).alias("titles"), F.array_sort(F.collect_set(F.nullif("family", F.lit("")))).alias("families"),
        F.when(F.bool_and(F.coalesce("evidence", F.lit(False))), "high").otherwise("medium").alias("confidence"),
    )
    return _place(groups.join(pages, ["run_id", "root"], "left").fillna(0, ["pages_affected"]), F.desc("value"), F.desc("pages_affected"), "title")


def high_signal(checks: DataFrame, search: DataFrame, k: int = 5) -> DataFrame:
    """The k (1 to 5) headline findings of a run, one for each normalised title: two by rule, then issues by value.

    search: (run_id, impressions, clicks, period_start, period_end).  Rules: at least 100 impressions of a bounded period with
    fewer than 1 click in 100; issues of evidence and trust that half of the tested pages have.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    seen, clicks = F.coalesce("impressions", F.lit(0)), F.coalesce("clicks", F.lit(0))
    few = (seen >= 100) & (clicks / F.nullif(seen, F.lit(0)) < 0.01) & said("period_start") & said("period_end")
    row = lambda df, name, value: df.select("run_id", F.lit(name[0]).alias("title"), value.alias("value"), F.lit(name[1]).alias("source"))
    bad = checks.filter(is_issue(F.col("status")))
    broad = bad.filter((F.col("family") == TRUST_GAP[1]) & (F.col("tested") > 0) & (2 * F.col("affected") >= F.col("tested")))
    all_ = row(search.filter(few), LOW_CLICKS, 20 + F.log1p(seen)).unionByName(row(broad.groupBy("run_id").agg(F.max("value").alias("v")), TRUST_GAP, 18 + F.col("v")))
    all_ = all_.unionByName(bad.filter("affected > 0").select("run_id", F.col("check").alias("title"), "value", F.coalesce("family", F.lit("")).alias("source")))
    once = all_.withColumn("norm", normal_title(F.col("title"))).withColumn("n", F.row_number().over(Window.partitionBy("run_id", "norm").orderBy(F.desc("value"), "title"))).filter("n = 1")
    return _place(once, F.desc("value"), "title").filter(F.col("place") <= max(1, min(5, k))).select("run_id", "title", "value", "source", "place")


def executive_findings(findings: DataFrame, roots: DataFrame, k: int = 5) -> DataFrame:
    """findings (run_id, title, value, source) with answer-readiness told once, then one for each root cause; the first k.

    A root cause with several checks speaks for its findings, with the larger value; one with a single check lends its name.
    """
    answers = F.lower(F.trim("title")).isin(ANSWER_TITLES)
    told = findings.filter(answers).groupBy("run_id").agg((F.max("value") + 1).alias("value")).select("run_id", F.lit(ANSWER_FINDING[0]).alias("title"), "value", F.lit(ANSWER_FINDING[1]).alias("source"))
    rest = findings.filter(~F.coalesce(answers, F.lit(False))).select("run_id", "title", "value", "source")
    first = _place(rest.unionByName(told), F.desc("value"), "title").filter(F.col("place") <= k).withColumn("root", root_of(F.col("title"))["key"])
    once = first.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "root").orderBy("place"))).filter("n = 1").drop("n", "place")
    r = roots.select("run_id", "root", F.col("title").alias("name"), F.col("value").alias("most"), "checks", "families", F.col("confidence").alias("sure"), "pages_affected")
    group = F.coalesce(F.col("checks") > 1, F.lit(False))
    pick = lambda yes, no: F.when(group, yes).otherwise(no)
    out = once.join(r, ["run_id", "root"], "left").select(
        "run_id", F.coalesce("name", "title").alias("title"), pick(F.greatest("value", "most"), F.col("value")).alias("value"), pick(F.array_join("families", " · "), F.col("source")).alias("source"),
        pick(F.col("root"), F.lit(None)).alias("root"), pick(F.col("sure"), F.lit("medium")).alias("confidence"), pick(F.col("pages_affected"), F.lit(None)).alias("pages_affected"),
        pick(F.lit("root_cause_group"), F.lit("derived_report_summary")).alias("evidence_type"),
    )
    return _place(out, F.desc("value"), "title").filter(F.col("place") <= k)


def validate_report(checks: DataFrame, findings: DataFrame, families: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """(run_id, level, rule, subject) of everything in a report that contradicts itself; an error blocks it, a warning does not.

    checks: as above with latest_change; findings: run_id, title; families: run_id, family, confirmed, listed; sources: run_id,
    key, label, state, observed_at; reports: run_id, impressions, clicks, keywords, period_start, period_end, clarity, ga4,
    audit_run_id, crawl_run_id, legacy_unlinked, inputs_linked.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    true = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))

    def broken(df: DataFrame, subject: str, **rules: tuple[str, Column]) -> DataFrame:
        found = F.array(*[F.when(true(c), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for rule, (level, c) in rules.items()])
        return df.select("run_id", F.explode(F.array_compact(found)).alias("x"), F.col(subject).cast("string").alias("subject")).select("run_id", "x.level", "x.rule", "subject")

    title = F.lower(F.trim("title")).alias("subject")
    twice = findings.groupBy("run_id", title).agg(F.count("*").alias("n")).filter("n > 1 and subject <> ''")
    out = broken(twice, "subject", duplicate_finding=("error", F.lit(True)))
    out = out.unionByName(broken(families, "family", confirmed_count_differs=("error", F.coalesce("confirmed", F.lit(0)) != F.coalesce("listed", F.lit(0)))))
    out = out.unionByName(broken(
        checks, "check", affected_exceeds_tested=("error", F.coalesce("affected", F.lit(0)) > F.coalesce("tested", F.lit(0))),
        priority_without_evidence=("warning", is_issue(F.col("status")) & F.lower("severity").isin("critical", "high") & ~true("evidence")),
        review_as_movement=("error", (normal_status(F.col("status")) == "MANUAL_REVIEW") & F.col("latest_change").isin(MOVED)),
    ))
    out = out.unionByName(broken(sources, "label", source_missing=("warning", F.col("state") == "missing"), source_without_time=("warning", (F.col("state") == "connected") & ~said("observed_at"))))
    ga4 = sources.filter("key = 'ga4'").groupBy("run_id").agg(F.bool_or(true(F.col("state") == "connected")).alias("ga4_connected"))
    totals = (F.coalesce("impressions", F.lit(0)) != 0) | (F.coalesce("clicks", F.lit(0)) != 0) | (F.coalesce("keywords", F.lit(0)) != 0)
    both = said("audit_run_id") & said("crawl_run_id")
    return out.unionByName(broken(
        reports.join(ga4, "run_id", "left"), "run_id", unbounded_period=("error", totals & ~(said("period_start") & said("period_end"))),
        clarity_as_ga4=("error", true("clarity") & true("ga4_connected") & ~true("ga4")), legacy_unlinked=("warning", both & true("legacy_unlinked")),
        inputs_unlinked=("error", both & ~true("legacy_unlinked") & ~true("inputs_linked")),
    ))


def report_verdicts(reports: DataFrame, violations: DataFrame) -> DataFrame:
    """Errors and warnings of every report, and whether they block it."""
    n = violations.groupBy("run_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return reports.select("run_id").distinct().join(n, "run_id", "left").fillna(0, ["errors", "warnings"]).withColumn("blocking", F.col("errors") > 0)
