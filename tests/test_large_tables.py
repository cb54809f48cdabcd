"""Queries whose results, or whose plans, once went wrong on larger tables."""

import duckdb
import pytest

from pyspark.sql import functions as F

from sightlines.llm import simhash
from sightlines.operators import pages
from sightlines.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def same_as_sql(spark, path, name):
    """The query's rows, which are those of its SQL, over the tables in path."""
    con = duckdb.connect()
    for table in path.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(path)).select(*want.columns).collect()
    key = lambda row: tuple(repr(v) for v in row)
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))
    return got


def test_near_search_sends_nothing_whole_to_the_driver(spark):
    docs = spark.createDataFrame([(i, f"one two three four {i // 3}") for i in range(60)], "doc_id long, text string")
    found = simhash.near_documents(docs, F.col("doc_id") % 20 == 0)
    assert "Broadcast" not in plan(found)
    assert {(r.doc_id, r.n_equal) for r in found.collect()} == {(0, 2), (20, 2), (40, 2)}


@pytest.mark.parametrize("name", ["f16_url_class", "t8_candidate_score", "t5_select_crawl_batch"])
def test_page_numbers_are_no_years(spark, tmp_path, name):
    ids = [9, 2009, 2024, 2037, 2065]
    spark.createDataFrame([(i, f"https://h{i}.example/", "") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql(spark, tmp_path, name)) == len(ids)


def test_years_cost_points_unless_named_otherwise(spark):
    from sightlines.functions import urls as U

    url, no = F.lit("https://a.example/x/2009"), F.lit(False)
    scores = [U.candidate_score(url, F.lit("https://a.example/"), no, no, *year) for year in ((), ("2024",))]
    points = [U.priority_score(url, F.lit("unknown"), F.lit(""), None, None, None, *year) for year in ((), ("2024",))]
    assert tuple(spark.range(1).select(*scores, *points).first()) == (50, 130, 170, 250)


def test_link_health_counts_classes_of_pages(spark, tmp_path):
    """Urls with several numbers, without a number's partner, and of several sites; pairs are not made."""
    rows = [(i, f"https://h{i % 3}.example/p{i % 17}", "") for i in range(40)] + [(50, "https://alone.example/", ""), (51, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(same_as_sql(spark, tmp_path, "j17_link_health")) == 42


def test_fingerprints_deal_hosts_before_they_are_made_distinct(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(50)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    same_as_sql(spark, tmp_path, "f28_fingerprints")
    assert plan(QUERIES["f28_fingerprints"](spark, str(tmp_path))).split("Initial Plan")[-1].count("Exchange") == 1


@pytest.mark.parametrize("name", ["m1_word_counts", "h4_without_blocks"])
def test_python_workers_get_small_batches_of_texts(spark, name):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


@pytest.mark.parametrize("name", ["m2_missing_words", "m2_document_markers", "m3_ban_candidates"])
def test_queries_of_the_model_alone_do_not_calibrate(spark, monkeypatch, name):
    from sightlines.operators import text

    monkeypatch.setattr(text, "calibrate", None)
    QUERIES[name](spark, SF)


def test_a_language_is_not_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(QUERIES["f6_uniqueness"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("script, status", [("", "FAIL"), ("""<script type="application/ld+json">{"@type": "Organization"}</script>""", "PASS")])
def test_pages_meet_their_scripts_in_many_tasks(spark, script, status):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    p = spark.createDataFrame([(f"https://s.example/{i}", f"<title>T{i}</title>{script}") for i in range(64)], "url string, html string")
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        checks = pages.evaluate_checks(pages.check_facts(p))
        rows = checks.filter("title = 'Names an organization or person type'").select("status", F.spark_partition_id().alias("task")).collect()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert len(rows) == 64 and {r.status for r in rows} == {status} and len({r.task for r in rows}) > 1


def test_no_text_of_a_page_travels_to_its_scripts(spark):
    p = spark.createDataFrame([("https://s.example/", "<title>T</title>")], "url string, html string")
    node = pages.evaluate_checks(pages.check_facts(p))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    sent = node.children().apply(0).output()
    assert not {"html", "text", "html_low", "t", "links"} & {sent.apply(i).name() for i in range(sent.size())}


def test_words_of_the_catalogue_are_found_as_its_conditions_say(spark):
    texts = ["", "about", "team", "it is a rule", "it is able", "means ", " means ", "refers to x", "<main>", "<maine>", "<nav ", "12 eur", "12  eur", "usd", "7usd", "skip-link", "rel=\"icon", "charset", "opening hours", "such as", "certification"]
    t = spark.createDataFrame([(x, x, x) for x in texts], "t string, links string, html_low string")
    assert set(t.select(*[F.count_if(pages._asked(c) != F.expr(c)) for c in pages.ASKED]).first()) == {0}
