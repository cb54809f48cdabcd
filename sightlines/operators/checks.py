"""Page checks: scores, rollups, priorities, history and comparison over runs.

A signal is (run_id, page, title, category, family, status, severity, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightlines.functions.numbers import js_round

# Fixed names under which equal checks are reported, by normalised title.
CHECK_ALIASES = {
    "indexing permitted": "Page is technically indexable",
    "page is technically indexable": "Page is technically indexable",
    "search snippets are permitted": "Search snippets are permitted",
    "snippet generation permitted": "Search snippets are permitted",
    "one clear h1": "One clear H1",
    "single primary heading": "One clear H1",
    "canonical url declared": "Canonical URL declared",
    "canonical relationship is explicit": "Canonical URL declared",
    "relevant structured data is available": "Relevant structured data is available",
    "machine readable structured data present": "Relevant structured data is available",
    "structured data is syntactically valid": "Structured data is syntactically valid",
    "json ld parses successfully": "Structured data is syntactically valid",
    "mobile viewport declared": "Mobile viewport declared",
    "responsive viewport is declared": "Mobile viewport declared",
    "all images declare alt behavior": "Image text alternatives",
    "informative images have text alternatives": "Image text alternatives",
    "image text alternatives": "Image text alternatives",
}
# Fixed orders: worst first.
STATUS_ORDER = ["FAIL", "PARTIAL", "MANUAL_REVIEW", "DATA_UNAVAILABLE", "PASS", "NOT_APPLICABLE"]
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
# Fixed factors of value to fix; any other severity counts 1, any other status 0.
SEVERITY_POINTS = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
STATUS_POINTS = {"FAIL": 1.0, "PARTIAL": 0.65}
CREDIT = {"PASS": 1.0, "PARTIAL": 0.5, "FAIL": 0.0}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def normal_status(status: Column) -> Column:
    return F.when(status == "UNKNOWN", "DATA_UNAVAILABLE").otherwise(status)


def is_issue(status: Column) -> Column:
    return status.isin("FAIL", "PARTIAL")


def _rank(value: Column, order: list[str]) -> Column:
    return F.coalesce(F.element_at(_map({s: i for i, s in enumerate(order)}), value), F.lit(len(order)))


def rollup_status(status: Column) -> Column:
    """Aggregate: the worst status."""
    s = normal_status(status)
    return F.min_by(s, _rank(s, STATUS_ORDER))


def rollup_severity(severity: Column) -> Column:
    return F.min_by(severity, _rank(severity, SEVERITY_ORDER))


def score_signals(signals: DataFrame, by: list[str]) -> DataFrame:
    """Weighted score in percent over what could be judged, and the share that could."""
    credit = F.element_at(_map(CREDIT), F.col("status"))
    judged = credit.isNotNull()
    w = F.col("weight")
    t = signals.groupBy(*by).agg(F.sum(F.when(judged, w * credit)).alias("got"), F.sum(F.when(judged, w)).alias("of"), F.count_if(judged).alias("n"), F.count("*").alias("checks"))
    return t.select(*by, js_round(F.col("got") / F.col("of") * 100, 1).alias("score"), js_round(F.col("n") / F.col("checks") * 100, 1).alias("coverage"), "checks")


def domain_audit_summary(signals: DataFrame) -> DataFrame:
    """Mean page score and status counts of every run."""
    pages = score_signals(signals, ["run_id", "page"])
    counts = signals.groupBy("run_id").agg(*[F.count_if(normal_status(F.col("status")) == s).alias(s.lower()) for s in STATUS_ORDER], F.countDistinct("page").alias("pages"))
    # scores are tenths: summed as whole numbers, so that the order of rows does not matter
    mean = pages.groupBy("run_id").agg((F.sum(F.round(F.col("score") * 10).cast("bigint")) / (10 * F.count("score"))).alias("m"))
    return counts.join(mean, "run_id").withColumn("mean_score", js_round("m", 1)).drop("m")


def apply_applicability(signals: DataFrame, groups: DataFrame, overrides: DataFrame, enabled: list[str]) -> DataFrame:
    """NOT_APPLICABLE for checks of optional groups that are off and for excluded page types; domain checks get their scope.

    groups: (title, check_group, scope); overrides: (title, page_type).
    """
    o = overrides.select("title", "page_type", F.lit(True).alias("excluded"))
    rows = signals.join(groups, "title", "left").join(o, ["title", "page_type"], "left")
    off = F.col("check_group").isNotNull() & ~F.col("check_group").isin(enabled)
    return rows.withColumn("status", F.when(off | F.coalesce("excluded", F.lit(False)), "NOT_APPLICABLE").otherwise(F.col("status"))).withColumn("scope", F.coalesce("scope", F.lit("page"))).drop("check_group", "excluded")


def apply_exclusions(signals: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Without what is excluded by (scope, value): a page, a check or a category."""
    out = signals
    for scope, c in (("page", "page"), ("check", "title"), ("category", "category")):
        out = out.join(exclusions.filter(F.col("scope") == scope).select(F.col("value").alias(c)).distinct(), c, "left_anti")
    return out


def merge_checks(signals: DataFrame, aliases: DataFrame | None = None, domain_titles: list[str] | None = None) -> DataFrame:
    """One row per canonical check of a run: pages affected, tested, to review, unavailable.  A domain-wide check counts one page.

    Tested are all pages with an observation.  Names come from aliases (title, canonical), by default from the fixed ones.
    """
    named = signals.join(aliases, "title", "left").withColumn("check", F.coalesce("canonical", "title")) if aliases is not None else signals.withColumn("check", canonical_check_title(F.col("title")))
    s = named.withColumn("s", normal_status(F.col("status")))
    on = lambda c: F.countDistinct(F.when(c, F.col("page")))
    t = s.groupBy("run_id", "check").agg(
        F.min("family").alias("family"), rollup_status(F.col("status")).alias("status"), rollup_severity(F.col("severity")).alias("severity"), on(is_issue(F.col("s"))).alias("affected"),
        F.countDistinct("page").alias("tested"), on(F.col("s") == "MANUAL_REVIEW").alias("review"), on(F.col("s") == "DATA_UNAVAILABLE").alias("unavailable"),
    )
    wide = F.col("check").isin(domain_titles or [])
    for c in ("affected", "tested", "review", "unavailable"):
        t = t.withColumn(c, F.when(wide, F.least(F.col(c), F.lit(1))).otherwise(F.col(c)))
    return t


def traffic_exposure(signals: DataFrame, page_impressions: DataFrame) -> DataFrame:
    """exposure of each check of a run: mean over affected pages of log1p(impressions) / log1p(most of the domain).

    signals carry the domain of their run; a page is a URL, or a path of the domain where it begins with /.
    page_impressions: (domain, url, impressions).  A page without its own row takes that of its exact path on the
    domain's own host if one URL alone has that path (else it is ambiguous); pages of other hosts count as 0.
    """
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = lambda c: F.lower(F.regexp_extract(c, scheme + "(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = lambda c: F.regexp_extract(F.regexp_replace(c, scheme + "[^/?#]*", ""), "^[^?#]*", 0)
    own = F.lower("domain")
    imp = page_impressions.filter("url <> ''").groupBy("domain", "url").agg(F.sum("impressions").alias("i"))
    by_path = imp.filter(host(F.col("url")) == own).groupBy("domain", path(F.col("url")).alias("path")).agg(F.count("*").alias("n"), F.max("i").alias("pi"))
    top = imp.groupBy("domain").agg(F.max("i").alias("top"))
    affected = signals.filter(is_issue(F.col("status")) & (F.col("page") != "")).select("run_id", "title", "domain", "page").distinct().withColumn("path", path(F.col("page")))
    rows = affected.join(imp.select("domain", F.col("url").alias("page"), "i"), ["domain", "page"], "left").join(by_path, ["domain", "path"], "left").join(top, "domain", "left")
    here = F.col("page").startswith("/") | (host(F.col("page")) == own)
    known, unlisted = F.col("top") > 0, here & F.col("i").isNull() & (F.col("path") != "")
    found = F.when(known & here, F.coalesce("i", F.when(unlisted & (F.col("n") == 1), F.col("pi")), F.lit(0))).otherwise(0)
    level = F.when(known, F.log1p("found") / F.log1p("top")).otherwise(0.0).cast("decimal(20,12)")
    return rows.withColumn("found", found).groupBy("run_id", "title").agg(
        (F.sum(level).cast("double") / F.count("*")).alias("exposure"), F.count_if(known).alias("affected_pages"), F.count_if(F.col("found") > 0).alias("matched_pages"),
        F.count_if(known & unlisted & (F.col("n") > 1)).alias("ambiguous_pages"),
    )


def value_to_fix(severity: Column, status: Column, exposure: Column, affected: Column, tested: Column) -> Column:
    base = F.coalesce(F.element_at(_map(SEVERITY_POINTS), severity), F.lit(1.0)) * F.coalesce(F.element_at(_map(STATUS_POINTS), status), F.lit(0.0))
    prevalence = F.when(tested > 0, affected / tested).otherwise(0.0)
    return js_round(base * (1 + 2 * exposure) * (1 + prevalence), 3)


def family_view(signals: DataFrame, by: tuple[str, ...] = ("run_id", "family", "category")) -> DataFrame:
    """Checks and pages of every category, with their worst status."""
    per_check = signals.groupBy(*by, "title").agg(rollup_status(F.col("status")).alias("status"), rollup_severity(F.col("severity")).alias("severity"), F.countDistinct(F.when(is_issue(F.col("status")), F.col("page"))).alias("affected"))
    return per_check.groupBy(*by).agg(
        F.count("*").alias("checks"), F.count_if(is_issue(F.col("status"))).alias("failing"), rollup_status(F.col("status")).alias("status"),
        F.coalesce(rollup_severity(F.when(is_issue(F.col("status")), F.col("severity"))), F.lit("info")).alias("severity"), F.max("affected").alias("most_affected"),
    )


# --------------------------------------------------------------------- history


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """One snapshot (report_id, audit_id, created_at) for each audit: the last."""
    w = Window.partitionBy("audit_id").orderBy(F.desc("created_at"), F.desc("report_id"))
    return snapshots.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def change_label(status: Column, before: Column) -> Column:
    """Change of one page on one check against the observation before; before is null where that did not assess the page."""
    either = lambda s: (status == s) | (before == s)
    return (
        F.when(before.isNull(), F.when(is_issue(status), "new_issue").otherwise("new_page"))
        .when(status == before, "unchanged")
        .when(either("MANUAL_REVIEW"), "requires_review")
        .when(either("DATA_UNAVAILABLE"), "evidence_unavailable")
        .when(either("NOT_APPLICABLE"), "no_longer_applicable")
        .when(is_issue(before) & (status == "PASS"), "resolved")
        .when((before == "FAIL") & (status == "PARTIAL"), "improved")
        .when(is_issue(status) & before.isin("PARTIAL", "PASS"), "worsened")
        .otherwise("requires_review")
    )


def finding_history(signals: DataFrame) -> DataFrame:
    """Change of every (check, page) against the observation before *of that check*.

    Runs are ranked for each check; rank r is joined with r - 1 on the page.
    """
    s = signals.groupBy("run_id", "title", "page").agg(rollup_status(F.col("status")).alias("status"), F.min("family").alias("family"))
    runs = s.select("title", "run_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy("run_id")))
    now = s.join(runs, ["title", "run_id"])
    before = now.select("title", "page", (F.col("r") + 1).alias("r"), F.col("status").alias("before"))
    rows = now.join(before, ["title", "page", "r"], "left")
    return rows.select("title", "page", "run_id", "family", "r", "status", change_label(F.col("status"), F.col("before")).alias("change"))


#: Changes that move a finding; what comes first decides where several pages differ.
WORSE, BETTER = ["worsened", "new_issue"], ["resolved", "improved"]
MATERIAL = [*WORSE, *BETTER, "mixed"]
STILL = ["requires_review", "evidence_unavailable", "no_longer_applicable", "new_page"]


def _one_change(change: Column, still: bool) -> Column:
    """Aggregate: mixed where pages went both ways, else the first of the changes; unchanged (null without still) where nothing moved."""
    has = lambda *c: F.coalesce(F.bool_or(change.isin(*c)), F.lit(False))
    label = F.when(has(*WORSE) & has(*BETTER), "mixed")
    for c in [*WORSE, *BETTER, *(STILL if still else [])]:
        label = label.when(has(c), c)
    return label.otherwise("unchanged") if still else label


def rollup_changes(history: DataFrame, by: list[str]) -> DataFrame:
    """The change of each finding in each run, with the pages assessed and affected."""
    page = lambda when: F.countDistinct(F.when(when, F.col("page")))
    return history.groupBy(*by).agg(_one_change(F.col("change"), True).alias("change"), F.countDistinct("page").alias("pages"), page(is_issue(F.col("status"))).alias("pages_affected"))


def last_material_change(rolled: DataFrame) -> DataFrame:
    """rolled (title, run_id, change) with the last change that moved the finding, and its run: confirmations don't erase it."""
    w = Window.partitionBy("title").orderBy("run_id").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.last(F.when(F.col("change").isin(MATERIAL), F.struct("change", "run_id")), ignorenulls=True).over(w)
    return rolled.withColumn("last", moved).select(*rolled.columns, F.col("last.change").alias("last_change"), F.col("last.run_id").alias("last_run"))


def page_lifecycle(history: DataFrame) -> DataFrame:
    """For every check and run but the first: pages that it newly observed, and pages of the run before that it no longer assessed."""
    seen = history.select("title", "r", "page").distinct()
    both = seen.select("title", "r", "page", F.lit(1).alias("now"), F.lit(0).alias("was")).unionByName(seen.select("title", (F.col("r") + 1).alias("r"), "page", F.lit(0).alias("now"), F.lit(1).alias("was")))
    last = history.groupBy("title").agg(F.max("r").alias("top"))
    each = both.groupBy("title", "r", "page").agg(F.max("now").alias("now"), F.max("was").alias("was")).join(last, "title").filter("r > 1 and r <= top and now <> was")
    return each.select("title", "r", "page", F.when(F.col("now") == 1, "newly_observed").otherwise("no_longer_assessed").alias("event"))


def change_summary(history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Unique pages by their retained movement: of each check the last material change of a page that its newest run still assesses.

    A page that moved both ways over its checks is mixed; by may hold family, which is that of a check's newest run.
    """
    newest = history.groupBy("title").agg(F.max("r").alias("top"), F.max_by("family", "r").alias("family"))
    kept = F.max_by("change", F.when(F.col("change").isin(MATERIAL), F.col("r")))
    pages = history.groupBy("title", "page").agg(kept.alias("change"), F.max("r").alias("r")).join(newest, "title").filter("r = top and change is not null")
    one = pages.groupBy(*by, "page").agg(_one_change(F.col("change"), False).alias("change"))
    names = {"improved": "improved", "worsened": "worsened", "resolved": "resolved", "new": "new_issue", "mixed": "mixed"}
    return one.groupBy(*by).agg(*[F.count_if(F.col("change") == c).alias(n) for n, c in names.items()])


def compare_snapshots(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(title, page, change, now, was) of every check and page that either of two runs assessed."""
    side = lambda df, name: df.groupBy("title", "page").agg(rollup_status(F.col("status")).alias(name))
    both = side(current, "now").join(side(previous, "was"), ["title", "page"], "full_outer")
    now, was = F.col("now"), F.col("was")
    either = lambda s: (now == s) | (was == s)
    change = (
        F.when(now.isNull(), "no_longer_assessed")
        .when(was.isNull(), F.when(is_issue(now), "new_issue").otherwise("new_page"))
        .when(either("MANUAL_REVIEW"), "requires_review")
        .when((now == "NOT_APPLICABLE") & (was != "NOT_APPLICABLE"), "no_longer_applicable")
        .when(either("DATA_UNAVAILABLE"), "evidence_unavailable")
        .when(now == was, "unchanged")
        .when(is_issue(was) & (now == "PASS"), "resolved")
        .when((was == "FAIL") & (now == "PARTIAL"), "improved")
        .when(((was == "PARTIAL") & (now == "FAIL")) | ((was == "PASS") & is_issue(now)), "worsened")
        .otherwise("requires_review")
    )
    return both.select("title", "page", change.alias("change"), "now", "was")


# Fixed names of the counts of a comparison.
COMPARED = {
    "findings_resolved": "resolved",
    "findings_improved": "improved",
    "findings_worsened": "worsened",
    "new_findings": "new_issue",
    "unchanged_findings": "unchanged",
    "requires_review": "requires_review",
    "evidence_unavailable": "evidence_unavailable",
    "no_longer_assessed": "no_longer_assessed",
    "no_longer_applicable": "no_longer_applicable",
}


def snapshot_summary(changes: DataFrame) -> DataFrame:
    """One row: findings by change, pages that only got better and pages where something got worse."""
    of = lambda *c: F.col("change").isin(*c)
    pages = changes.groupBy("page").agg(
        *[F.count_if(of(c)).alias(name) for name, c in COMPARED.items()], F.bool_or(of("improved", "resolved")).alias("better"), F.bool_or(of("worsened")).alias("worse")
    )
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COMPARED]
    return pages.agg(*sums, F.count_if(F.col("better") & ~F.col("worse")).alias("pages_improved"), F.count_if("worse").alias("pages_regressed"))


def page_delta(history: DataFrame) -> DataFrame:
    """For each check and run after its first: pages newly observed and pages no longer assessed."""
    seen = history.select("title", "page", "r").distinct()
    runs = history.select("title", "r", "run_id").distinct()
    now, was = seen.withColumn("now", F.lit(True)), seen.select("title", "page", (F.col("r") + 1).alias("r"), F.lit(True).alias("was"))
    counts = now.join(was, ["title", "page", "r"], "full_outer").groupBy("title", "r").agg(
        F.count_if(F.col("was").isNull()).alias("new_pages"), F.count_if(F.col("now").isNull()).alias("gone_pages")
    )
    return runs.filter("r > 1").join(counts, ["title", "r"]).select("title", "run_id", "new_pages", "gone_pages")


def family_trend(signals: DataFrame) -> DataFrame:
    """Score and status of each family by run."""
    status = signals.groupBy("run_id", "family").agg(rollup_status(F.col("status")).alias("status"), F.countDistinct(F.when(is_issue(F.col("status")), F.col("page"))).alias("affected"))
    return score_signals(signals, ["run_id", "family"]).join(status, ["run_id", "family"])


def recommendation_updates(recommendations: DataFrame, signals: DataFrame, roots: DataFrame) -> DataFrame:
    """implemented -> verified when all checks of the root pass; verified -> reopened when one fails."""
    s = signals.join(roots, "title").groupBy("root").agg(F.bool_and(normal_status(F.col("status")) == "PASS").alias("clean"), F.bool_or(is_issue(F.col("status"))).alias("broken"))
    r = recommendations.join(s, "root", "left")
    state = F.when((F.col("state") == "implemented") & F.col("clean"), "verified").when((F.col("state") == "verified") & F.col("broken"), "reopened").otherwise(F.col("state"))
    return r.select("root", F.col("state").alias("old_state"), state.alias("state"))


def data_coverage(sources: DataFrame) -> DataFrame:
    """State of every data source (source, present, and as the inventory has it: status, selected; null where it is not listed)."""
    status, listed = F.lower(F.coalesce("status", F.lit(""))), F.col("selected").isNotNull() | F.col("status").isNotNull()
    unwanted = ~F.coalesce("selected", F.lit(False)) & (status.contains("not selected") | ~listed)
    state = F.when(status.contains("failed") | status.contains("error"), "failed").when(status.contains("stale"), "stale").when(F.coalesce("present", F.lit(False)), "connected").when(unwanted, "not_selected").otherwise("missing")
    return sources.withColumn("state", state)


def url_outcomes(inventory: DataFrame, frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """inventory (url, eligibility, last_error, last_crawled_at, ...) with outcome: duplicate, excluded, failed, unchanged, crawled or deferred.

    What the frontier (url, state) says comes before what the inventory knows; pages (url, unchanged) are of the crawl.
    """
    f = frontier.groupBy("url").agg(F.max("state").alias("state"))
    p = pages.groupBy("url").agg(F.max(F.coalesce("unchanged", F.lit(False))).alias("unchanged"))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    kind = F.col("eligibility")
    guess = F.when(kind == "duplicate", "duplicate").when(kind == "excluded", "excluded").when(has("last_error"), "failed").when(has("last_crawled_at"), "crawled").otherwise("deferred")
    first = F.coalesce(F.nullif("state", F.lit("")), guess)
    either = lambda x: F.coalesce(kind == x, F.lit(False)) | (F.col("first") == x)
    t = inventory.join(f, "url", "left").join(p, "url", "left").withColumn("first", first)
    outcome = (
        F.when(either("duplicate"), "duplicate").when(either("excluded"), "excluded").when(F.col("first") == "failed", "failed")
        .when((F.col("first") == "unchanged") | F.coalesce("unchanged", F.lit(False)), "unchanged").when(F.col("first").isin("completed", "crawled"), "crawled").otherwise("deferred")
    )
    return t.select(*inventory.columns, outcome.alias("outcome"))


def monitoring_inventory(inventory: DataFrame, frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts of inventory urls by class and outcome."""
    return url_outcomes(inventory, frontier, pages).groupBy("url_class", "outcome").agg(F.count("*").alias("urls"))


# ---------------------------------------------------------------------- titles


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def canonical_check_title(title: Column) -> Column:
    """The name under which a check is reported."""
    return F.coalesce(F.element_at(_map(CHECK_ALIASES), normal_title(title)), F.trim(F.coalesce(title, F.lit(""))))


def overlap_candidates(titles: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(a, b, similarity, explicit_alias) of different titles that are alike by words, by spelling or by alias.

    Similarity is the largest of word Jaccard, 1 less the edit distance over the longer
    length, and 1 for titles with one canonical name.  Candidates share two neighbouring letters, a word
    or a canonical name, as all titles do that reach 0.72.
    """
    t = titles.filter("title <> ''").select("title").distinct().withColumns({"norm": normal_title(F.col("title")), "name": canonical_check_title(F.col("title"))})
    pairs_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length("norm") - 1, F.lit(1))), lambda i: F.col("norm").substr(i, F.lit(2)))
    keyed = t.withColumn("k", F.explode(F.array_distinct(F.concat(pairs_of, F.transform(F.split("norm", " "), lambda w: F.concat(F.lit("w="), w)), F.array(F.concat(F.lit("c="), "name"))))))
    x = keyed.select("k", F.struct("title", "norm", "name").alias("x"))
    pairs = x.join(x.withColumnRenamed("x", "y"), "k").filter("x.title < y.title").select("x", "y").distinct()
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    a, b = words(F.col("x.norm")), words(F.col("y.norm"))
    union = F.size(F.array_union(a, b))
    jaccard = F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
    longest = F.greatest(F.length("x.norm"), F.length("y.norm"))
    spelling = F.when(longest > 0, 1 - F.levenshtein(F.col("x.norm"), F.col("y.norm")) / longest).otherwise(1.0)
    alias = F.col("x.name") == F.col("y.name")
    rows = pairs.select(F.col("x.title").alias("a"), F.col("y.title").alias("b"), F.greatest(jaccard, spelling, F.when(alias, 1.0).otherwise(0.0)).alias("s"), alias.alias("explicit_alias"))
    return rows.filter(F.col("s") >= threshold).select("a", "b", js_round("s", 3).alias("similarity"), "explicit_alias")
