"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sightlines.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["a2_striking_distance", "a1_site_summary", "j1_compare_pages", "j2_winners_losers", "a4_cannibalization_exact", "a6_decay_matrix", "j13_event_impact", "a17_measure_outcomes", "s17_merge_into", "j20_sitemap_diff", "w12_rank_state", "j11_asof_rank", "a26_merge_checks", "w1_finding_history", "j7_keyword_gap", "j22_related_domains", "a31_ai_metrics", "a33_concept_metrics", "h1_page_facts", "h6_audit_pages", "t5_select_crawl_batch", "f6_uniqueness", "a18_crawler_daily", "s11_parse_sitemaps"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
